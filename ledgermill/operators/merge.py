"""Keyed merges as joins: upserts that keep or replace rows, sums, deletes, and outcome counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def upsert(target: DataFrame, source: DataFrame, keys: list[str], insert_only: tuple[str, ...] = ()) -> DataFrame:
    """target with the rows of source put in by key; ``insert_only`` columns of rows that exist stay as they are.

    The keys that both have are found first, of short rows. Whole rows of either side then meet a hash table of those alone, which
    is no larger than their own number in a partition, and are never sorted.
    """
    names = [f"merge_key_{i}" for i, _ in enumerate(keys)]
    same = _all([F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    named = [F.col(k).alias(n) for k, n in zip(keys, names)]
    first = [F.struct(*insert_only).alias("merge_first")] if insert_only else []
    both = target.join(source.select(*named), same, "left_semi").select(*named, *first).hint("shuffle_hash")
    kept = target.join(both, same, "left_anti")
    if not insert_only:
        return kept.unionByName(source.select(*target.columns))
    old = lambda c: F.when(F.col("merge_first").isNotNull(), F.col(f"merge_first.{c}")).otherwise(F.col(c)).alias(c)
    return kept.unionByName(source.join(both, same, "left").select(*(old(c) if c in insert_only else F.col(c) for c in target.columns)))


def replace_rows(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target with whole rows replaced by those of source."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source, allowMissingColumns=True)


def add_into(target: DataFrame, delta: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums of target and delta by key."""
    return target.select(*keys, *sums).unionByName(delta.select(*keys, *sums)).groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast(target.schema[c].dataType).alias(c) for c in sums))


def replace_groups(target: DataFrame, fresh: DataFrame, affected: DataFrame, keys: list[str]) -> DataFrame:
    """target with all affected keys taken out and their fresh rows, where there are any, put in."""
    return target.join(affected.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def match_versions(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """The key of each incoming row and its outcome against existing: inserted, updated or unchanged, by version (a hash)."""
    old = existing.select(F.col(key).alias("old_key"), F.col(version).alias("old_version"))
    joined = incoming.select(key, version).join(old, F.col(key) == F.col("old_key"), "left")
    same = F.col(version).eqNullSafe(F.col("old_version"))
    return joined.select(key, F.when(F.col("old_key").isNull(), "inserted").when(same, "unchanged").otherwise("updated").alias("outcome"))


def upsert_outcome(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """One row: inserted, updated, unchanged of incoming against existing."""
    outcomes = ("inserted", "updated", "unchanged")
    return match_versions(existing, incoming, key, version).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in outcomes))


def matches(existing: DataFrame, incoming: DataFrame, key: str, version: str, group: Column) -> DataFrame:
    """n_known and n_same by a group of the keys: incoming rows whose key exists, and those of them whose version (a hash) is the same. Keys are unique on either side."""
    new = incoming.select(F.col(key).alias("new_key"), F.col(version).alias("new_version"))
    joined = existing.select(key, version).join(new, F.col(key) == F.col("new_key"))
    return joined.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("n_known"), F.count_if(F.col(version).eqNullSafe(F.col("new_version"))).alias("n_same"))


def of_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among keys."""
    return rows.join(keys.select(key), key, "left_semi")
