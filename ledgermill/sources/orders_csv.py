"""Raw orders from CSV files, with the place of every row in its file.

Files are read in splits. Where no line has an odd number of quotes, a line is a record. Else records may go over
several lines: a line begins inside a quoted field where the quotes before it are odd in number, which the sums of
the blocks before and of the lines before in the block tell, so such a file is read in splits as well - one pass
counts, one reads. A file whose quotes are odd in all is no file of quoted fields; its lines are taken as records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermill.schema import RAW_COLUMNS

_BOM = "﻿"


_OPTIONS = {"escape": '"', "mode": "PERMISSIVE"}


def read_orders(spark: SparkSession, path: str, fixed_schema: bool = False) -> DataFrame:
    """The columns of RAW as text, source_file and source_row_number (from 1 in each file).

    Columns are found by their names in the header, in any order; missing ones are null. With
    ``fixed_schema`` the header is skipped and columns count by place.
    """
    reader = spark.read.option("header", True).options(**_OPTIONS).option("encoding", "UTF-8")
    names = list(RAW_COLUMNS) if fixed_schema else [c.removeprefix(_BOM).strip() for c in reader.option("inferSchema", False).csv(path).columns]
    schema = ", ".join(f"`{c}` string" for c in names)
    found = {c.lower(): c for c in names}
    columns = lambda prefix="": [F.col(f"{prefix}`{found[c]}`").alias(c) if c in found else F.lit(None).cast("string").alias(c) for c in RAW_COLUMNS]
    rows = reader.schema(schema).option("enforceSchema", True).csv(path)
    rows = rows.select(*columns(), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block_start"))
    lines = _lines(spark, path)
    broken = lines.groupBy("source_file").agg(F.sum("odd").alias("n_odd")).where("n_odd > 0 AND n_odd % 2 = 0").select("source_file")
    if broken.isEmpty():
        return number_rows(rows)
    plain = number_rows(rows.join(broken, "source_file", "left_anti").select(*rows.columns))
    records = _records(lines.join(broken, "source_file", "left_semi")).withColumn("record", F.from_csv("text", schema, _OPTIONS))
    # the header is the first record
    return plain.unionByName(records.where("number > 1").select(*columns("record."), "source_file", (F.col("number") - 1).alias("source_row_number")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, odd (1 where its quotes are odd in number), source_file and block_start of each line."""
    text = spark.read.option("lineSep", "\n").text(path)
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    return text.select("value", odd.alias("odd"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block_start"))


def _records(lines: DataFrame) -> DataFrame:
    """text and number (from 1 in each file) of the records of lines; blank lines between records are none."""
    placed = lines.withColumn("line_id", F.monotonically_increasing_id())
    in_block = Window.partitionBy("source_file", "block_start").orderBy("line_id")
    so_far, up_to_here = in_block.rowsBetween(Window.unboundedPreceding, -1), in_block.rowsBetween(Window.unboundedPreceding, 0)
    quoted = _with_before(placed, F.sum("odd"), "odd_before").withColumn("inside", (F.col("odd_before") + F.coalesce(F.sum("odd").over(so_far), F.lit(0))) % 2 == 1)
    starts = quoted.withColumn("starts", (~F.col("inside") & (F.rtrim("value", F.lit("\r")) != "")).cast("int"))
    numbered = _with_before(starts, F.sum("starts"), "starts_before").withColumn("number", F.col("starts_before") + F.sum("starts").over(up_to_here))
    whole = (F.col("starts") == 1) & (F.col("odd") == 0)
    alone = numbered.where(whole).select("source_file", "number", F.col("value").alias("text"))
    parts = numbered.where(~whole & (F.col("inside") | (F.col("starts") == 1))).groupBy("source_file", "number").agg(F.array_sort(F.collect_list(F.struct("block_start", "line_id", "value"))).alias("lines"))
    joined = parts.select("source_file", "number", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("text"))
    return alone.unionByName(joined).withColumn("text", F.rtrim("text", F.lit("\r")))


def _with_before(rows: DataFrame, total: Column, name: str) -> DataFrame:
    """rows with the total over the blocks of their file before their own."""
    blocks = rows.groupBy("source_file", "block_start").agg(total.alias("in_block"))
    earlier = Window.partitionBy("source_file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("source_file", "block_start", F.coalesce(F.sum("in_block").over(earlier), F.lit(0)).alias(name))
    return rows.join(F.broadcast(before), ["source_file", "block_start"])


def number_rows(rows: DataFrame) -> DataFrame:
    """source_row_number from the order inside a file's blocks and the sizes of the blocks before, without a sort of rows."""
    placed = rows.withColumn("row_id", F.monotonically_increasing_id())
    blocks = placed.groupBy("source_file", "block_start").agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"))
    before = F.coalesce(F.expr("sum(n_rows) OVER (PARTITION BY source_file ORDER BY block_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    starts = blocks.select("source_file", "block_start", "first_id", before.alias("rows_before"))
    joined = placed.join(F.broadcast(starts), ["source_file", "block_start"])  # a row for each block, where the rows themselves would be shuffled
    number = F.col("row_id") - F.col("first_id") + F.col("rows_before") + 1
    return joined.withColumn("source_row_number", number).drop("row_id", "block_start", "first_id", "rows_before")
