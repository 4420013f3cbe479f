"""Loading order files: raw history, classification, merge, quarantine, and the figures of the run."""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill import schema as S
from ledgermill.operators.classify import classify, record_hash
from ledgermill.operators.merge import matches, upsert
from ledgermill.sources.files import decide_strategy
from ledgermill.sources.orders_csv import read_orders
from ledgermill.store import TRIES, ConflictError, Store

RAW_TABLE, VALIDATED_TABLE, QUARANTINE_TABLE, RUNS = "orders_raw", "orders_validated", "orders_quarantine", "runs"
ENGINE = "spark"
#: Records of a load up to which all tasks get their keys and hashes, some 100 MB, and the table is not shuffled to meet them.
FEW_KEYS = 300_000

_ITEM = "struct<sku:string,name:string,qty:double,unit_price:double,total:double,extra:string>"
_CLEAN = (
    "order_id string, order_date timestamp_ntz, status string, customer_id string, customer_name string, customer_phone string, customer_email string, city string, district string, "
    f"delivery_type string, delivery_cost double, payment_method string, payment_status string, payment_amount double, currency string, total_amount double, items array<{_ITEM}>"
)
VALIDATED_SCHEMA = f"{_CLEAN}, quality_status string, corrections array<{S.CORRECTION}>, record_hash string, at_first_validated timestamp, first_seen_run string, last_seen_run string, at_updated timestamp, source_file string, engine_used string"
QUARANTINE_SCHEMA = (
    "source_file string, source_row_number bigint, quarantined_at timestamp, engine_used string, error_codes array<string>, error_details string, "
    f"partial_corrections_attempted array<{S.CORRECTION}>, raw_record struct<{','.join(f'{c}:string' for c in S.RAW_COLUMNS)}>, run_id string"
)


def raw_of_run(store: Store, run_id: str) -> DataFrame:
    """The raw rows of a run: one partition of the raw table, and only the columns asked for."""
    rows = store.read(RAW_TABLE).where(F.col("run_id") == run_id)
    return rows.select("raw_record.*", "source_file", "source_row_number")


def validated(store: Store) -> DataFrame:
    return store.snapshot(VALIDATED_TABLE, VALIDATED_SCHEMA)


def quarantined(store: Store) -> DataFrame:
    return store.read(QUARANTINE_TABLE, QUARANTINE_SCHEMA)


def ingest(
    spark: SparkSession,
    store: Store,
    path: str | None,
    profile: str = "row",
    threshold_mb: float = 100.0,
    resume_run_id: str | None = None,
    skip_raw: bool = False,
    from_raw: bool = False,
    batch: tuple[str, int] | None = None,
    read: DataFrame | None = None,
) -> dict | None:
    """Loads a CSV file, or with ``from_raw`` the raw rows of ``resume_run_id``, and returns the run's figures. ``read``: the rows of the file, as ``read_orders`` gives them.

    The raw rows are written first and are the input of all that follows, so the file is read once.
    Classified rows are written once too, below the store until the run is over, and the quarantine, the
    merge and the counts read that table. Raw rows and quarantine are those of the run, however often it is
    resumed. The merge comes last; it reads the buckets of the validated table that records fall into, rewrites those with
    changed records, and puts new ones beside the rest. A run that fails leaves that table as it was.

    ``batch``, the stream and the number of a micro-batch, names the run, and is noted in the version that the
    merge makes: a batch that has been applied is not loaded again, and None is returned.
    """
    if from_raw and not resume_run_id:
        raise ValueError("from_raw needs the run to resume")
    if batch and store.transaction(VALIDATED_TABLE).applied.get(batch[0], -1) >= batch[1]:
        return None
    run_id = resume_run_id or (f"stream-{batch[0]}-{batch[1]:09d}" if batch else f"run-{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}")
    work = f"work/{run_id}-{uuid.uuid4().hex[:8]}"
    try:
        return _ingest(spark, store, path, profile, threshold_mb, run_id, work, skip_raw, from_raw, batch, read)
    finally:
        store.delete(work)


def _ingest(spark: SparkSession, store: Store, path: str | None, profile: str, threshold_mb: float, run_id: str, work: str, skip_raw: bool, from_raw: bool, batch: tuple[str, int] | None, read: DataFrame | None = None) -> dict:
    began = time.time()
    now = F.lit(datetime.now(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp")
    if from_raw:
        decision = {"file_path": path, "strategy": "resume", "file_size_mb": None, "partitions": None}
        rows = raw_of_run(store, run_id)
    else:
        decision = decide_strategy(spark, path, threshold_mb) if read is None else {"strategy": "stream", "file_size_mb": None, "partitions": None}
        read = read_orders(spark, path) if read is None else read
        if skip_raw:
            rows = read
        else:
            raw = read.select("source_file", "source_row_number", now.alias("ingested_at"), F.lit(ENGINE).alias("engine_used"), F.struct(*S.RAW_COLUMNS).alias("raw_record"))
            store.put_run(RAW_TABLE, raw, run_id)
            rows = raw_of_run(store, run_id)

    def staged(repeats: DataFrame) -> DataFrame:
        repeats.write.parquet(store.path(f"{work}/repeats"))
        return spark.read.schema(repeats.schema).parquet(store.path(f"{work}/repeats"))

    found = classify(rows, profile, staged=staged).withColumn("record_hash", record_hash(F.col("clean"), F.col("quality_status"), F.col("corrections")))
    # of accepted rows the raw fields are in the raw table alone; rows are not sorted by status, which would take the memory of whole rows
    found = found.withColumns({c: F.when(F.col("quality_status") == "quarantine", F.col(c)) for c in S.RAW_COLUMNS})
    found.write.parquet(store.path(f"{work}/found"))
    found = spark.read.schema(found.schema).parquet(store.path(f"{work}/found"))

    rejected = found.where("quality_status = 'quarantine'").select(
        "source_file", "source_row_number", now.alias("quarantined_at"), F.lit(ENGINE).alias("engine_used"),
        "error_codes", "error_details", F.col("corrections").alias("partial_corrections_attempted"), F.struct(*S.RAW_COLUMNS).alias("raw_record"),
    )
    store.put_run(QUARANTINE_TABLE, rejected, run_id)

    accepted = found.where("quality_status <> 'quarantine'").select(
        "clean.*", "quality_status", "corrections", "record_hash", now.alias("at_first_validated"), F.lit(run_id).alias("first_seen_run"),
        F.lit(run_id).alias("last_seen_run"), now.alias("at_updated"), "source_file", F.lit(ENGINE).alias("engine_used"),
    )
    outcome = merge_orders(store, accepted, work, dict([batch]) if batch else None)

    tallies = found.groupBy("quality_status", F.get("error_codes", F.lit(0)).alias("error_code")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row for each code
    counts = {f"count_{k}": sum(r["n"] for r in tallies if r["quality_status"] == k) for k in ("valid", "corrected", "quarantine")}
    codes = {r["error_code"]: r["n"] for r in tallies if r["error_code"]}
    seconds = time.time() - began
    read_rows = sum(counts.values())
    figures = {
        "id_run": run_id, "file_name": path, "file_size_mb": decision["file_size_mb"], "used_engine": ENGINE, "strategy": decision["strategy"], "read_rows": read_rows,
        "loaded_raw": 0 if skip_raw and not from_raw else read_rows, **counts, "seconds_elapsed": round(seconds, 4), "throughput_rows_per_sec": round(read_rows / max(seconds, 1e-9), 2),
        "partitions": decision["partitions"], "counts_case_error": codes, **{f"count_{k}": v for k, v in outcome.items()},
        "consistency_check": counts["count_valid"] + counts["count_corrected"] + counts["count_quarantine"] == read_rows,
        "generated_at": datetime.now(timezone.utc).isoformat(),
    }
    store.add_to_log(RUNS, figures)
    return figures


def merge_orders(store: Store, accepted: DataFrame, work: str, applied: dict[str, int] | None = None) -> dict[str, int]:
    """Puts accepted records into the validated table; how many were inserted, updated and unchanged.

    New records are put beside the rows of their buckets; only buckets with updated ones are made anew. An unchanged record keeps its row as it was; where there are any, the changed ones are written below the folder ``work`` on the way. Where
    another run has changed the same buckets meanwhile, records are compared with its rows anew.
    """
    for attempt in range(TRIES):
        turn = store.transaction(VALIDATED_TABLE)
        touched = turn.touched(accepted, "order_id")
        near = turn.rows(VALIDATED_SCHEMA, touched)
        empty = not any(turn.buckets[b]["rows"] for b in touched if b in turn.buckets)
        incoming = F.broadcast(accepted) if sum(touched.values()) <= FEW_KEYS else accepted
        known = {} if empty else {r["group"]: r for r in matches(near, incoming, "order_id", "record_hash", turn.bucket("order_id")).collect()}  # a row for each bucket
        fresh = {b: n - known[b]["n_known"] if b in known else n for b, n in touched.items()}
        updated = {b: r["n_known"] - r["n_same"] for b, r in known.items()}
        counts = {"inserted": sum(fresh.values()), "updated": sum(updated.values()), "unchanged": sum(r["n_same"] for r in known.values())}
        if not (counts["inserted"] or counts["updated"]):
            if not applied or turn.mark(applied):
                return counts
            continue
        changed = accepted.select(*near.columns)
        if counts["unchanged"]:
            old = near.select(F.col("order_id").alias("old_id"), F.col("record_hash").alias("old_hash"))
            place = store.path(f"{work}/changed-{attempt}")
            changed.join(old, (F.col("order_id") == F.col("old_id")) & (F.col("record_hash") == F.col("old_hash")), "left_anti").write.parquet(place)
            changed = store.spark.read.schema(near.schema).parquet(place)
        put = lambda rows, fresh, empty=empty: fresh if empty else upsert(rows, fresh, ["order_id"], ("at_first_validated", "first_seen_run"))
        changes = {b: n + updated.get(b, 0) for b, n in fresh.items() if n + updated.get(b, 0)}
        if turn.upsert(changed, "order_id", put, changes, fresh, applied):
            return counts
    raise ConflictError(VALIDATED_TABLE)


def status_counts(found: DataFrame) -> DataFrame:
    """One row: rows by quality_status, counted in one pass."""
    kinds = ("valid", "corrected", "quarantine")
    return found.agg(*(F.count_if(F.col("quality_status") == k).alias(f"count_{k}") for k in kinds))


def error_histogram(found: DataFrame) -> DataFrame:
    """error_code and n_rows."""
    # the outer form keeps the optimiser from copying the whole classification into a filter below the explosion
    codes = found.select(F.explode_outer("error_codes").alias("error_code")).where("error_code IS NOT NULL")
    return codes.groupBy("error_code").agg(F.count(F.lit(1)).alias("n_rows"))
