"""Reading tables, the shared staging folder and small column helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that shared_dir gives out inside are deleted at the end: what shall stay is staged to a folder from before.

    It holds for the thread that opens it; what other threads stage meanwhile lies elsewhere.
    """
    folder = shared_dir(spark)
    token = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, as a URI with its file system.

    It lies in ``spark.checkpoint.dir``. Where that is unset, a local master gets a
    temporary folder and a cluster gets one in its warehouse.
    """
    inside = _scratch.get()
    if inside:
        return f"{inside}/{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        base = f"file://{tempfile.gettempdir()}/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir")
    # a path without a scheme means the cluster's file system, to tasks that write by pyarrow as well
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut, and a lost executor costs nothing."""
    path = folder or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def packed(rows: DataFrame) -> DataFrame:
    """rows as one struct column ``row``, so that columns of any name can stand beside it."""
    return rows.select(F.struct("*").alias("row"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def row_digest(columns: list[str], schema: T.StructType, prefix: str = "") -> Column:
    """128 bits over the columns of a row: rows that agree in all of them have the same."""
    parts = []
    for c in columns:
        value = F.col(f"{prefix}`{c}`")
        nested = isinstance(schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))
        text = F.to_json(value, {"ignoreNullFields": "false"}) if nested else value.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.md5(F.concat_ws(",", *parts)))


def free_name(rows: DataFrame, name: str) -> str:
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()


#: Rows that go to a Python worker at once, in place of Spark's 10,000: texts are long, and the batches lie outside the heap.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this library's code to the executors, once for an application, and bounds the batches of texts.

    A batch size that is not Spark's own is left alone.
    """
    if spark.conf.get(_BATCH_SETTING) == "10000":
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(package.rglob("*.py")):
                archive.write(path, f"{package.name}/{path.relative_to(package)}")
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
