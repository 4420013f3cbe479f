"""Delta loads: stages with a log, and a streaming front end over a folder of files."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgermill.functions.text import clean_text
from ledgermill.ingest import ingest, raw_of_run
from ledgermill.schema import RAW
from ledgermill.sources.files import input_fingerprint
from ledgermill.sources.orders_csv import number_rows
from ledgermill.store import Store

LOADS, DELTA_IDS, KNOWN, LAST_DELTA = "incremental", "delta_ids", "loaded_files", "last_delta"
STAGES = ("normal", "initial", "delta")


def load(spark: SparkSession, store: Store, path: str, stage: str = "normal", **options) -> dict:
    """Ingests a file as a stage. A file that was loaded before is reported and applied again, which changes nothing.

    A delta records the distinct order ids of all its rows, quarantined ones included, as a table. Files are known
    by an entry under their fingerprint, and the last delta by a document, so neither reads the log.
    """
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}: {', '.join(STAGES)}")
    if stage == "normal":
        return ingest(spark, store, path, **options)
    fingerprint = input_fingerprint(spark, path)
    seen = store.exists(f"{KNOWN}/{fingerprint}/{1:012d}.json")
    figures = ingest(spark, store, path, **options)
    entry = {k: figures[k] for k in ("id_run", "count_inserted", "count_updated", "count_unchanged")} | {"stage": stage, "file": path, "file_hash": fingerprint, "at": datetime.now(timezone.utc).isoformat(), "seen_before": seen}
    if stage == "delta":
        store.put_run(DELTA_IDS, delta_ids(raw_of_run(store, figures["id_run"])), figures["id_run"])
        entry["order_ids_count"] = store.read(DELTA_IDS).where(F.col("run_id") == figures["id_run"]).count()
        store.save_json(LAST_DELTA, {"id_run": figures["id_run"]})
    store.add_to_log(LOADS, entry)
    if not seen:
        store.save_json(f"{KNOWN}/{fingerprint}", {"id_run": figures["id_run"], "file": path})
    return figures | {"stage": stage, "file_hash": fingerprint, "seen_before": seen}


def delta_ids(rows: DataFrame) -> DataFrame:
    return rows.select(clean_text(F.col("order_id")).alias("order_id")).where("order_id <> ''").distinct()


def latest_delta_ids(store: Store) -> DataFrame:
    """order_id of the last delta; none where there was no delta."""
    ids = store.read(DELTA_IDS, "order_id string, run_id string")
    return ids.where(F.col("run_id") == store.load_json(LAST_DELTA, {"id_run": ""})["id_run"]).select("order_id")


def stream_folder(spark: SparkSession, store: Store, folder: str, checkpoint: str, files_per_batch: int = 1000, available_now: bool = True) -> StreamingQuery:
    """Ingests the CSV files of a folder as they come, each micro-batch by the same merge; the raw table names the files.

    The checkpoint remembers the files that are done, and names the stream. The version that a batch makes
    notes its number, so a batch that is repeated after a failure is loaded once; one that had not got so far
    replaces its raw and quarantined rows.
    """
    rows = spark.readStream.schema(RAW).option("header", True).option("escape", '"').option("maxFilesPerTrigger", files_per_batch).csv(folder)
    rows = rows.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block_start"))

    def merge(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            ingest(batch.sparkSession, store, folder, batch=(_stream_id(batch.sparkSession, checkpoint), number), read=number_rows(batch))

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark writes to a checkpoint when it is made."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()["value"])["id"]


def daily_sales_stream(orders: DataFrame, late: str = "2 days") -> DataFrame:
    """Orders and sales by day of a stream of orders (order_date timestamp, order_id, total_amount).

    An order counts once within the watermark, and a day is given out when it can no longer change.
    """
    once = orders.withWatermark("order_date", late).dropDuplicatesWithinWatermark(["order_id"])
    return once.groupBy(F.window("order_date", "1 day").alias("day")).agg(F.count(F.lit(1)).alias("orders"), F.sum(F.coalesce("total_amount", F.lit(0.0))).alias("sales")).select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "orders", "sales")
