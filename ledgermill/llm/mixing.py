"""Mixing sources to target weights along a time-varying curriculum.

Targets: source k of the sources in code point order (null last) weighs WEIGHTS[k % 3]; the sources
share SHARE of all words by weight, but a source stops at REPEATS times its own words, and what it
leaves is shared again by weight until no source is above its stop. That fixed point is a level L
with target = min(L * weight, stop), found in closed form from the sources sorted by stop / weight.

Positions: over training time t in [0, 1] the weight of a source runs linearly from a start to an
end factor; its integral, scaled to the target, is the source's cumulative demand of words. The
documents of a source follow each other in the order of a hash of id, size and text, epoch after epoch. A document is taken in an
epoch when its middle lies within the target, and its position is the time at which the demand
reaches its first word: the integral inverted. Rows are range-sorted by position.

Only DataFrame functions are used. Offsets inside a source come from sums over ranges of the hash,
so that no source, however large, is sorted by one task.

Defined results: a null text has no words, is never taken and has no position; a null source is one
source, the last; rows that repeat count one by one; an empty table gives an empty result; other
columns are ignored by ``plan_mix`` and kept by ``mix_documents``, which tells rows apart by all of
their columns, so that one doc_id may stand in several sources and on several texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.key_filter import build_filter, may_match
from ledgermill.llm.shared import WORD, packed, row_digest, scratch, shared_dir, stage, text_or_empty, unpacked

WEIGHTS = (3, 1, 2)
SHARE, REPEATS = 1.5, 2.0
#: (start, end) factors of the weight over training time, by place of the source, repeating.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Documents of a source in one range of the hash, on average.
RANGE_ROWS = 2000
#: Places in the mix that meet one copy of a row that repeats in full.
SALT_ROWS = 1000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """source, place, source_size, source_rows, target of the staged sizes (source, size): one row for a source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("place", place)
    weighed = sources.withColumns({"weight": _by_place(weights), "stop": F.col("source_size") * F.lit(float(repeats))})
    before = Window.orderBy(F.col("stop") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("stop") / F.col("weight"), "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1))) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = weighed.withColumn("level", level)
    found = F.max(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.col("level"))).over(Window.partitionBy(F.lit(1)))
    target = F.least("stop", F.coalesce(found * F.col("weight"), "stop"))
    return levelled.select("source", "place", "source_size", "source_rows", target.alias("target"))


def _by_place(values: tuple) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (F.col("place") % len(values)).cast("int") + 1)


def _time_of(share: Column, start: Column, end: Column) -> Column:
    """t with integral of (start + (end - start) x) over [0, t] equal to share of that over [0, 1]."""
    area = share * (start + end) / 2
    # the root of ((end - start) / 2) t^2 + start t = area in the form that is stable for end = start
    return F.least(F.lit(1.0), 2 * area / (start + F.sqrt(F.greatest(F.lit(0.0), start * start + 2 * (end - start) * area))))


def plan_mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, schedules: tuple[tuple[float, float], ...] = SCHEDULES) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, positions and position (the first) of every row, sorted by position."""
    plan = _plan(docs, F.lit(None).cast("binary"), seed, weights, share, repeats, schedules).drop("row_key")
    return plan.withColumn("position", F.get("positions", F.lit(0))).orderBy("position", "doc_id")


def _plan(docs: DataFrame, row_key: Column, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, schedules: tuple[tuple[float, float], ...] = SCHEDULES) -> DataFrame:
    """plan_mix, unsorted, with a column row_key, by which rows of one hash are ordered."""
    words = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    order = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), words.cast("string"), F.md5(text_or_empty()))), 1, 12)
    sizes = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), order.alias("place_hash"), row_key.alias("row_key")))
    targets = stage(source_targets(sizes, weights, share, repeats))
    # the number of sources is that of targets: beyond Spark's broadcast limit this is a shuffle join
    joined = sizes.join(targets.withColumnRenamed("source", "target_source"), F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    n_ranges = F.ceil(F.col("source_rows") / RANGE_ROWS)
    unit = F.conv("place_hash", 16, 10).cast("double") / F.lit(float(1 << 48))  # in [0, 1), in hash order
    dealt = joined.withColumns({"unit": unit, "range": F.floor(unit * n_ranges)})
    ranges = dealt.groupBy("place", "range").agg(F.sum("size").alias("range_size"))
    running = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("place", "range", F.coalesce(F.sum("range_size").over(running), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("place", "range").orderBy("unit", F.col("doc_id").asc_nulls_last(), "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, ["place", "range"])
    offset = F.col("range_start") + F.col("inside")
    epochs = F.when(
        (F.col("size") > 0),
        F.filter(F.sequence(F.lit(0).cast("long"), F.lit(int(-(-repeats // 1)) - 1).cast("long")), lambda e: e * F.col("source_size") + offset + F.col("size") / 2 <= F.col("target")),
    ).otherwise(F.array().cast("array<long>"))
    start, end = (F.element_at(F.array(*(F.lit(float(s[k])) for s in schedules)), (F.col("place") % len(schedules)).cast("int") + 1) for k in (0, 1))
    placed = placed.withColumns({"epochs": epochs, "offset": offset, "curve_start": start, "curve_end": end})
    positions = F.transform("epochs", lambda e: _time_of((e * F.col("source_size") + F.col("offset")) / F.col("target"), F.col("curve_start"), F.col("curve_end")))
    mixed = placed.withColumns({"positions": positions, "copies": F.size("epochs").cast("long")})
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "positions", "row_key")


def mix_documents(docs: DataFrame, **parameters) -> DataFrame:
    """Rows of docs as often as the mix takes them, range-sorted by training position."""
    keyed = lambda rows, prefix="": row_digest(rows, docs.schema, prefix)
    folder = shared_dir(docs.sparkSession)
    with scratch(docs.sparkSession):
        plan = stage(_plan(docs, keyed(docs.columns), **parameters).select("row_key", "positions"), folder)
    several = stage(plan.groupBy("row_key").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1"))
    taken = plan.where(F.size("positions") > 0).select(F.col("row_key").alias("taken_key"), "positions")
    rows = packed(docs).withColumn("row_key", keyed(docs.columns, "row."))
    salt, met = F.lit(0).cast("long"), rows.withColumn("salt", F.lit(0).cast("long"))
    if not several.isEmpty():
        # one row stands for those that repeat it in full, and is dealt to as many tasks as its places call for
        salts = F.ceil(F.coalesce("n_rows", F.lit(1)) / SALT_ROWS)
        counts = several.withColumnsRenamed({"row_key": "several_key"})
        once = may_match(rows, "row_key", build_filter(several, "row_key"), "may_repeat")
        again = once.where("may_repeat").drop("may_repeat").dropDuplicates(["row_key"])
        dealt = again.join(counts, F.col("row_key") == F.col("several_key"), "left").select("row", "row_key", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
        met = once.where("NOT may_repeat").select("row", "row_key", F.lit(0).cast("long").alias("salt")).unionByName(dealt)
        taken = taken.join(counts, F.col("taken_key") == F.col("several_key"), "left")
        salt = F.pmod(F.xxhash64("positions"), salts)
    taken = taken.select("taken_key", "positions", salt.alias("taken_salt"))
    each = met.join(taken, (F.col("row_key") == F.col("taken_key")) & (F.col("salt") == F.col("taken_salt"))).select("row", F.explode("positions").alias("position"))
    return unpacked(each.orderBy("position", "row.doc_id"))
