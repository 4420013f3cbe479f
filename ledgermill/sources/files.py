"""Facts about input files: size, fingerprint, and the plan of work they call for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.sources.orders_csv import number_rows

DEFAULT_THRESHOLD_MB = 100.0
_PART_MB = 128


def input_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder, on any file system that Spark reads."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(location):
        raise FileNotFoundError(path)
    return int(files.getContentSummary(location).getLength())


def decide_strategy(spark: SparkSession, path: str, threshold_mb: float = DEFAULT_THRESHOLD_MB) -> dict:
    """Whether an input is small (few partitions) or large (partitions by size), with the reason."""
    size_mb = input_bytes(spark, path) / (1 << 20)
    small = size_mb <= threshold_mb
    partitions = 1 if small else max(2, int(size_mb // _PART_MB) + 1)
    reason = f"{size_mb:.3f} MB is {'at most' if small else 'above'} {threshold_mb:g} MB"
    return {"file_path": path, "file_size_mb": round(size_mb, 3), "threshold_mb": threshold_mb, "strategy": "small" if small else "large", "partitions": partitions, "reason": reason}


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """source_file, n_lines and file_hash of each file of an input, of any size.

    Two 64-bit hashes of every numbered line are summed, so a file is read in splits by many tasks and no
    value holds more than a line. Lines end at a line feed; a carriage return counts as part of its line.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_block_start").alias("block_start"))
    numbered = number_rows(lines)
    place = F.col("source_row_number")
    sums = [F.sum(h.cast("decimal(20,0)")).alias(n) for n, h in (("a", F.xxhash64(place, "value")), ("b", F.xxhash64(F.lit(1), "value", place)))]
    found = numbered.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_lines"), F.first("length").alias("length"), *sums)
    return found.select("source_file", "n_lines", F.sha2(F.concat_ws(":", "length", "n_lines", "a", "b"), 256).alias("file_hash"))


def input_fingerprint(spark: SparkSession, path: str) -> str:
    """The fingerprint of an input: that of a single file, or one of all its files whatever their names and order; empty files count for nothing."""
    part = lambda at: F.sum(F.conv(F.substring("file_hash", at, 15), 16, 10).cast("decimal(20,0)"))
    files = file_fingerprints(spark, path)
    joined = files.agg(F.count(F.lit(1)).alias("n"), F.min("file_hash").alias("one"), F.sha2(F.concat_ws(":", F.count(F.lit(1)), part(1), part(16), part(31)), 256).alias("many")).first()
    return joined["one"] if joined["n"] == 1 else joined["many"]
