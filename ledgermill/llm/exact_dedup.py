"""Exact dedup: groups by a 128-bit content hash, smallest stable id stays, bytes compared inside groups.

Contents are equal when they agree after each run of white space became one space. Every member of
a group is compared with the text of the group's smallest id; a text that differs (two contents of
one hash) leaves the group and is grouped by its own bytes. Only DataFrame functions are used.

Groups of a thousandth of all rows or more are at most a thousand. They are resolved by a broadcast
table, so that no key with many rows is shuffled; the other groups meet by a shuffle join.

Defined results: a null text counts as empty; a null doc_id ranks after all others; rows that share
doc_id and content are one group, of which exactly one row stays; an empty table gives an empty
result; other columns are ignored by ``exact_groups`` and kept by ``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.key_filter import build_filter, may_match, without_keys
from ledgermill.llm.shared import SPACE, packed, scratch, shared_dir, stage, text_or_empty, unpacked

#: Groups of at least 1/HOT_SHARE of the rows are hot: there are at most HOT_SHARE of them.
HOT_SHARE = 1000
#: Members of one hash that meet one copy of its smallest id's text.
SALT_ROWS = 1000

Digest = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def with_group(rows: DataFrame, groups: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows with the columns of groups (one row for a key, rows counted in group_rows), or nulls.

    Rows of hot keys are joined on the map side; they and null keys are then spread by their doc_id.
    """
    hot = F.col("group_rows") * F.lit(HOT_SHARE) >= F.lit(max(n_rows, HOT_SHARE))
    columns = [c for c in groups.columns if c != key]
    named = {c: f"hot_{c}" for c in groups.columns}
    marked = rows.join(F.broadcast(groups.where(hot).withColumnsRenamed(named)), F.col(key) == F.col(f"hot_{key}"), "left")
    is_number = rows.schema[key].dataType.simpleString() == "bigint"
    elsewhere = F.xxhash64("doc_id") if is_number else F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    unmatched = F.col(f"hot_{key}").isNotNull() | F.col(key).isNull()
    spread = marked.withColumn("deal", F.when(unmatched, elsewhere).otherwise(F.col(key)))
    cold = groups.where(~hot).withColumnsRenamed({c: f"cold_{c}" for c in groups.columns})
    joined = spread.join(cold, (F.col("deal") == F.col(f"cold_{key}")) & ~unmatched, "left")
    return joined.select(*rows.columns, *(F.coalesce(f"hot_{c}", f"cold_{c}").alias(c) for c in columns))


def exact_groups(docs: DataFrame, digest: Digest = F.md5) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, h and repeats, a row for each row of docs."""
    contents = docs.select("doc_id", normalised(text_or_empty()).alias("content")).withColumn("h", F.unhex(digest(F.col("content"))))
    digests = stage(contents.select("doc_id", "h", F.unhex(F.sha2("content", 256)).alias("sha")))
    n_rows = digests.count()
    # rows that repeat doc_id and content stand as one, with their number
    rows = digests.groupBy("doc_id", "h", "sha").agg(F.count(F.lit(1)).alias("repeats"))
    groups = rows.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.sum("repeats").alias("group_rows"), F.count(F.lit(1)).alias("members"))
    groups = stage(groups.where("members > 1").drop("members"))
    found = with_group(rows, groups, "h", n_rows)
    keep, size = F.coalesce("first_id", "doc_id"), F.coalesce("group_rows", "repeats")

    strays = _strays(contents, groups, n_rows)
    if not strays.isEmpty():
        own = strays.groupBy("h", "content").agg(F.min("doc_id").alias("own_first"), F.count(F.lit(1)).alias("own_rows"))
        moved = strays.join(own, ["h", "content"]).select(F.col("doc_id").alias("moved_id"), F.col("h").alias("moved_h"), F.sha2("content", 256).alias("moved_sha"), "own_first", "own_rows").distinct()
        lost = strays.groupBy(F.col("h").alias("lost_h")).agg(F.count(F.lit(1)).alias("lost_rows"))
        found = found.join(moved, F.col("doc_id").eqNullSafe(F.col("moved_id")) & (F.col("h") == F.col("moved_h")) & (F.lower(F.hex("sha")) == F.col("moved_sha")), "left")
        found = found.join(lost, F.col("h") == F.col("lost_h"), "left")
        is_own = F.col("moved_h").isNotNull()
        keep = F.when(is_own, F.col("own_first")).otherwise(keep)
        size = F.when(is_own, F.col("own_rows")).otherwise(size - F.coalesce("lost_rows", F.lit(0)))

    found = found.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"), "h", "repeats")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")))
    return each.select("doc_id", "keep_id", "group_size", (F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256", "h", "repeats")


def _strays(contents: DataFrame, groups: DataFrame, n_rows: int) -> DataFrame:
    """Rows whose content differs from that of the smallest id of their group, as a staged table."""
    # texts that surely have no other of their hash stay where they are
    marked = may_match(contents, "h", build_filter(groups.select("h"), "h"), "may_repeat")
    shared = marked.where("may_repeat").drop("may_repeat")
    members = stage(with_group(shared, groups, "h", n_rows).where("group_rows IS NOT NULL"))
    salts = F.ceil(F.col("group_rows") / SALT_ROWS)
    first = members.where(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("h").agg(F.min("content").alias("first_content"), F.first("group_rows").alias("group_rows"))
    dealt = first.select("h", "first_content", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts))
    return stage(salted.join(dealt, ["h", "salt"]).where("content <> first_content").select("doc_id", "h", "content"))


def drop_copies(docs: DataFrame, digest: Digest = F.md5) -> DataFrame:
    """docs without the copies: all columns of the row that stays of each group."""
    folder = shared_dir(docs.sparkSession)
    with scratch(docs.sparkSession):
        found = stage(exact_groups(docs, digest), folder)
    identity = lambda doc_id, h: F.unhex(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.hex(h))))
    moved = found.where(~F.col("keep_id").eqNullSafe(F.col("doc_id")))
    hashed = packed(docs).withColumn("content_h", F.unhex(digest(normalised(text_or_empty("row.text")))))
    left = without_keys(hashed, identity(F.col("row.doc_id"), F.col("content_h")), moved.select(identity(F.col("doc_id"), F.col("h")).alias("gone")))
    again = stage(found.where("repeats > 1").select(identity(F.col("doc_id"), F.col("h")).alias("same")).distinct())
    if not again.isEmpty():  # rows that repeat in full: one of each stays, and only texts that may be such rows are shuffled
        marked = may_match(left.withColumn("same", identity(F.col("row.doc_id"), F.col("content_h"))), "same", build_filter(again, "same"), "may_repeat")
        left = marked.where("NOT may_repeat").select("row").unionByName(marked.where("may_repeat").dropDuplicates(["same"]).select("row"))
    return unpacked(left)
