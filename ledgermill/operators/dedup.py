"""Rows that repeat a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys of several rows, with their number of rows; a null key counts as a key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def flag_repeats(df: DataFrame, key: Column, position: str | None, name: str, keep_first: bool = True, staged: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with a boolean ``name``: rows of a repeated key, all of them or all but the first by position.

    Only keys with several rows are joined back, against their first position, so no key is sorted
    and partial sums shrink a hot key before the shuffle. Null keys never repeat. ``staged`` writes the
    repeated keys and reads them again, so that Spark knows their size: where they are few, no row is shuffled.
    """
    if position is None and keep_first:
        return df.withColumn(name, F.lit(False))
    at = F.col(position) if position else F.lit(0)
    keyed = df.withColumns({"repeat_key": key, "repeat_at": at})
    groups = keyed.where("repeat_key IS NOT NULL").groupBy("repeat_key").agg(F.min("repeat_at").alias("first_at"), F.count(F.lit(1)).alias("n_rows"))
    several = groups.where("n_rows > 1").select(F.col("repeat_key").alias("several_key"), "first_at")
    several = staged(several) if staged else several
    joined = keyed.join(several, F.col("repeat_key") == F.col("several_key"), "left")
    repeats = F.col("first_at").isNotNull()
    if keep_first:
        repeats = repeats & (F.col("repeat_at") > F.col("first_at"))
    return joined.withColumn(name, F.coalesce(repeats, F.lit(False))).drop("repeat_key", "repeat_at", "several_key", "first_at")


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: one aggregation that keeps the least row, so a hot key is combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    least = F.min_by(F.struct(*others), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("least")
    return df.groupBy(*keys).agg(least).select(*keys, *(F.col(f"least.{c}").alias(c) for c in others)).select(*df.columns)
