"""Checks of a store's state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermill.api import Engine
from ledgermill.ingest import QUARANTINE_TABLE, RAW_TABLE, RUNS, VALIDATED_TABLE
from ledgermill.operators.dedup import repeated_keys
from ledgermill.refresh import DAILY, PRODUCTS, daily_view, product_view


def verify(engine: Engine) -> list[tuple[str, bool]]:
    """Name and result of each check."""
    store, orders = engine.store, engine.orders()
    facts = orders.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("order_id").alias("ids"), F.count_if(F.col("record_hash").isNull()).alias("no_hash"),
        F.count_if(~F.col("quality_status").isin("valid", "corrected")).alias("odd_status"), F.count_if((F.col("quality_status") == "valid") & (F.size("corrections") > 0)).alias("odd_valid"),
        F.count_if(F.col("currency") != "YER").alias("odd_currency"), F.count_if(F.col("at_first_validated").isNull()).alias("no_first"),
    ).first()
    runs = store.log(RUNS)
    return [
        ("raw table exists", store.exists(RAW_TABLE)),
        ("validated table exists", store.version(VALIDATED_TABLE) is not None),
        ("quarantine table exists", store.exists(QUARANTINE_TABLE)),
        ("runs are recorded", bool(runs)),
        ("every run is consistent", all(r["consistency_check"] for r in runs)),
        ("order ids are unique", facts["n"] == facts["ids"]),
        ("every record has a hash", facts["no_hash"] == 0),
        ("every record is valid or corrected", facts["odd_status"] == 0 and facts["odd_valid"] == 0),
        ("one currency", facts["odd_currency"] == 0),
        ("every record has its first time", facts["no_first"] == 0),
        ("views exist", store.version(DAILY) is not None and store.version(PRODUCTS) is not None),
        ("days are unique", repeated_keys(daily_view(store), "day").isEmpty()),
        ("skus are unique", repeated_keys(product_view(store), "sku").isEmpty()),
    ]
