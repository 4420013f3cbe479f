"""Work of the store that must be shared by many tasks, however large the table is."""

import shutil

from pyspark.sql import functions as F
from records import record, write_csv

from ledgermill import store_queries
from ledgermill.api import Engine
from ledgermill.operators import merge, views
from ledgermill.plans import layout
from ledgermill.sources.orders_csv import read_orders
from ledgermill.starschema import StarSchema
from ledgermill.store import PARTS, Store, _place_of, bucket_of, folders, parts_kept, split
from ledgermill.streaming.incremental import stream_folder


def test_orders_are_written_to_more_files_as_they_grow(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(store_queries, "FILE_ROWS", 100)
    loaded = store_queries.Loaded(StarSchema(spark, sf_dir))
    frame = loaded.raw_in(1)
    sizes = [len(p) for p in frame.select("source_row_number").rdd.glom().map(lambda rows: [r[0] for r in rows]).collect()]
    assert len(sizes) == 15 and max(sizes) <= 100 and sum(sizes) == 1500
    keys = [r[0] for r in frame.select("source_row_number").collect()]
    assert keys == sorted(keys)
    assert "Exchange" not in read_orders(spark, loaded.write("first", frame))._jdf.queryExecution().optimizedPlan().toString()


def test_a_layout_of_equal_values_is_no_one_task(spark, tmp_path):
    rows = spark.range(4000).select(F.format_string("O-%05d", "id").alias("order_id"), F.lit("x").alias("city"), F.lit("2020-01-31").alias("order_date"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = layout.write_layout(rows, f"file://{tmp_path}", layout.Layout(("city", "order_date")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < 2000


def test_sums_of_both_images_leave_what_changed(spark):
    old = spark.createDataFrame([("a", "h1", "d1", 2.0), ("b", "h2", "d2", 3.0), ("c", "h3", "d4", 5.0)], "order_id string, record_hash string, day string, sales double").withColumn("products", F.array(F.struct(F.lit("s").alias("sku"), F.col("day").alias("name"), F.lit(1.0).alias("quantity"), F.col("sales").alias("sales"))))
    new = old.where("order_id <> 'b'").withColumn("record_hash", F.replace("record_hash", F.lit("h3"), F.lit("h9"))).unionByName(old.where("order_id = 'b'").withColumns({"day": F.lit("d3"), "record_hash": F.lit("h8")}))
    signed = views.signed(old, new)
    # d1 is as it was; d4 has a changed order whose amount is the same
    assert sorted(tuple(r) for r in views.day_deltas(signed).collect()) == [("d2", -1, -3.0), ("d3", 1, 3.0), ("d4", 0, 0.0)]
    assert "Join" not in views.part_deltas(signed)._jdf.queryExecution().optimizedPlan().toString()
    assert views.part_deltas(signed).where("sales = 0").count() == 2


def _plans(spark) -> list[str]:
    """Plans of all executions so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [found.apply(n).physicalPlanDescription() for n in range(found.size())]


def test_buckets_are_written_without_a_sort_of_their_rows(spark, tmp_path):
    store, rows = Store(spark, f"file://{tmp_path}", buckets=4, bucket_rows=20), spark.range(200).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    store.merge("t", rows, "k", lambda old, fresh: fresh)
    writes = [p for p in _plans(spark) if f"{tmp_path}/t/data/" in p and "InsertIntoHadoopFsRelationCommand" in p]
    assert writes and not any("Sort" in p for p in writes)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    found = store.snapshot("t", rows.schema)
    assert sorted(r["k"] for r in found.collect()) == list(range(200))
    folders = [e["folder"] for e in store.manifest("t")["buckets"].values() if e["folder"]]
    assert len(found.inputFiles()) == len(folders) > 4  # one file for each bucket


def test_a_task_writes_one_bucket(spark):
    buckets = [*split(1, 3)[1:], *split(split(1, 3)[0], 2)]
    rows = spark.range(2000).select(bucket_of(F.col("id"), buckets).alias("bucket"))
    dealt = rows.repartitionById(len(buckets), _place_of(F.col("bucket"), buckets))
    parts = dealt.rdd.glom().map(lambda p: sorted({r["bucket"] for r in p})).collect()
    assert parts == [[b] for b in sorted(buckets)]


def test_an_upsert_sorts_no_whole_rows(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (None, "n", "y"), (4, "d", "z")], "k int, v string, first string")
    source = spark.createDataFrame([(2, "B", "new"), (None, "N", "new"), (3, "C", "new"), (4, "D", None), (3, "E", "new")], "k int, v string, first string")
    found = merge.upsert(target, source, ["k"], ("first",))
    expected = [(1, "a", "x"), (2, "B", None), (3, "C", "new"), (3, "E", "new"), (4, "D", "z"), (None, "N", "y")]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(expected, key=repr)
    assert sorted((tuple(r) for r in merge.upsert(target, source, ["k"]).collect()), key=repr) == sorted([(1, "a", "x"), *(tuple(r) for r in source.collect())], key=repr)
    # short rows alone are sorted: whole ones, with v, meet hash tables
    plan = merge.upsert(target, source, ["k"], ("first",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "FullOuter" not in plan and plan.count("LeftSemi") == plan.count("SortMergeJoin") == 2


def test_parts_of_one_size_are_made_one():
    for sizes, n_rows, kept in (([], 5, 0), ([100], 100, 1), ([100] * 7, 100, 0), ([10_000] + [100] * 6, 100, 7), ([10_000] + [100] * 7, 100, 1), ([1000] * 7 + [100] * 7, 100, 0), ([100, 9000], 5, 2)):
        assert parts_kept(sizes, n_rows) == kept
    # a table that grows by equal loads: the rows written, with those written again, and the most parts
    sizes, written, most = [], 0, 0
    for _ in range(512):
        kept = parts_kept(sizes, 1000)
        sizes = [*sizes[:kept], sum(sizes[kept:]) + 1000]
        written, most = written + sizes[-1], max(most, len(sizes))
    assert sum(sizes) == 512_000 and written <= 4 * 512_000 and most <= 4 * PARTS


def test_new_rows_are_put_beside_the_old_ones(spark, tmp_path):
    store, put = Store(spark, f"file://{tmp_path}", buckets=2), lambda old, fresh: merge.upsert(old, fresh, ["k"])
    def load(first, last, value):
        rows = spark.range(first, last).select("id", F.concat(F.lit("k"), "id").alias("k"), F.lit(value).alias("v")).drop("id")
        turn = store.transaction("t")
        incoming = turn.touched(rows, "k")
        fresh = turn.touched(rows.join(turn.rows(rows.schema), "k", "left_anti"), "k") if turn.buckets else incoming
        before = {f for e in turn.buckets.values() for f in folders(e)}
        assert turn.upsert(rows, "k", put, incoming, fresh)
        after = {f for e in store.transaction("t").buckets.values() for f in folders(e)}
        assert {r["k"]: r["v"] for r in store.snapshot("t", rows.schema).where(F.col("v") == value).collect()} == {f"k{i}": value for i in range(first, last)}
        return before - after, after - before, rows.schema
    assert [len(x) for x in load(0, 40, 0)[:2]] == [0, 2]
    for n in range(1, PARTS - 1):
        gone, made, schema = load(40 * n, 40 * n + 40, n)
        assert not gone and len(made) == 2  # the rows before were not written again
    old, new = store.changed_rows("t", schema, 1, PARTS - 1)
    assert old.count() == 0 and new.count() == 40 * (PARTS - 2)
    one = store.manifest("t")["buckets"]
    gone, made, _ = load(0, 1, -1)  # an update makes its bucket anew, and leaves the other
    assert len(gone) == PARTS - 1 and len(made) == 1 and sum(one[b] == e for b, e in store.manifest("t")["buckets"].items()) == 1
    gone, made, _ = load(1000, 1040, 9)
    assert len(gone) == PARTS - 1 and len(made) == 2  # the other has as many parts now as are made one
    assert store.snapshot("t", schema).count() == 40 * PARTS
    assert sum(e["rows"] for e in store.manifest("t")["buckets"].values()) == 40 * PARTS
    assert store.vacuum("t", keep=1) and store.snapshot("t", schema).count() == 40 * PARTS


def test_a_stream_writes_no_row_again(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", buckets=2)
    (tmp_path / "in").mkdir()
    seen = set()
    for n in range(2):
        write_csv(tmp_path / f"{n}.csv", [record(order_id=f"O-{n}-{i}", city=None if i else "") for i in range(20)], encoding="utf-8")
        shutil.move(tmp_path / f"{n}.csv", tmp_path / "in" / f"{n}.csv")
        stream_folder(spark, engine.store, f"file://{tmp_path}/in", f"file://{tmp_path}/checkpoint", files_per_batch=1).awaitTermination()
        here = {f for e in engine.store.transaction("orders_validated").buckets.values() for f in folders(e)}
        assert seen <= here and len(here) == 2 * (n + 1)
        seen = here
    assert engine.orders().count() == 40
    assert engine.refresh_ledger()["inserted"] == 40
    raw = engine.store.read("orders_raw").select("source_file", "source_row_number").collect()
    assert sorted((r[0].rsplit("/", 2)[1:], r[1]) for r in raw) == [(["in", f"{n}.csv"], i) for n in range(2) for i in range(1, 21)]
