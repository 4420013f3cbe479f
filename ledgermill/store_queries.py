"""The registered queries that run the engine's store: each writes the orders of the star schema as CSV files and loads them.

They join the registry of ``queries``. A query works in a new folder of the cluster's shared space.
"""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill import cli, ingest, jobs, refresh
from ledgermill.api import Engine
from ledgermill.operators import merge
from ledgermill.plans import explain, layout
from ledgermill.queries import _DETAILS, _KINDS, _STATUS, QUERIES, raw_orders, register
from ledgermill.sources.files import decide_strategy, file_fingerprints, input_fingerprint
from ledgermill.sources.orders_csv import read_orders
from ledgermill.starschema import StarSchema
from ledgermill.streaming.incremental import latest_delta_ids, stream_folder
from ledgermill.verify import verify


def work_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: in spark.checkpoint.dir, else in the warehouse, or a temporary one on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.gettempdir()}/ledgermill" if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


_BEFORE = set(QUERIES)
#: Rows of a CSV file beyond which more files are written: some 40 MB.
FILE_ROWS = 100_000


class Loaded:
    """A store with the orders of a star schema loaded, and later images of some: urgent orders move to another city and day.

    ``varied`` orders have items of seven products under several names and fall on many days, all by their keys; with them,
    urgent orders change names and days as well, and a third image changes half of the urgent ones again, and those of high priority.
    """

    CITY = "عدن"

    def __init__(self, star: StarSchema, varied: bool = False, **options):
        self.star, self.folder, self.varied = star, work_folder(star.spark), varied
        self.engine = Engine(star.spark, f"{self.folder}/store", **options)

    def ranged(self, orders: DataFrame, n_files: int = 3) -> DataFrame:
        """orders in so many ranges of keys, or in more where they would hold over FILE_ROWS rows each, sorted. The keys alone tell the ranges, so two calls agree.

        Orders are dealt before they are written out as text: four short columns are shuffled and sorted.
        """
        rows = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
        least, most, n_rows = rows.agg(F.min("o_orderkey"), F.max("o_orderkey"), F.count(F.lit(1))).first()
        n = max(n_files, -(-n_rows // FILE_ROWS))
        width = -(-((most or 0) - (least or 0) + 1) // n)
        place = F.coalesce(((F.col("o_orderkey") - F.lit(least or 0)) / F.lit(width)).cast("int"), F.lit(0))
        return rows.repartitionById(n, place).sortWithinPartitions("o_orderkey")

    def write(self, name: str, rows: DataFrame, n_files: int | None = None) -> str:
        """rows as CSV files: one for each partition, as they are, or with ``n_files`` so many key ranges in the order of the keys."""
        path = f"{self.folder}/{name}"
        ordered = (rows.repartitionByRange(n_files, "source_row_number").sortWithinPartitions("source_row_number") if n_files else rows).drop("source_row_number")
        ordered.write.option("header", True).option("escape", '"').options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
        return path

    @cached_property
    def raw(self) -> DataFrame:
        return self.raw_in()

    def raw_in(self, n_files: int = 3) -> DataFrame:
        """All orders in ranges of keys, for that many files at least."""
        rows = raw_orders(self.star, self.ranged(self.star.table("orders"), n_files))
        return self._image(rows, "old", "2020-01-1") if self.varied else rows

    def _image(self, rows: DataFrame, name: str, day: str) -> DataFrame:
        key = F.col("source_row_number")
        item = F.concat(F.lit('"sku":"S'), key % 7, F.lit(f'","name":"{name} '), key % 3, F.lit('",'))
        moved = F.concat(F.lit(day), key % 5 + 1, F.lit("T00:00:00"))
        return rows.withColumns({"items_json": F.replace("items_json", F.lit('"sku":"A",'), item), "order_date": F.when(F.col("order_date") == "2020-01-31T00:00:00", moved).otherwise(F.col("order_date"))})

    def _of(self, condition: str) -> DataFrame:
        return raw_orders(self.star, self.ranged(self.star.table("orders").where(condition))).withColumn("city", F.lit(self.CITY))

    @cached_property
    def first(self) -> str:
        return self.write("first", self.raw)

    @cached_property
    def second(self) -> str:
        """The urgent orders, changed."""
        urgent = self._of("o_orderpriority = '1-URGENT'")
        changed = self._image(urgent, "new", "2020-02-0") if self.varied else urgent.withColumn("order_date", F.replace("order_date", F.lit("2020-01-31T"), F.lit("2020-02-01T")))
        return self.write("second", changed.select(*self.raw.columns))

    @cached_property
    def third(self) -> str:
        """Half of the urgent orders and those of high priority, changed again."""
        changed = self._image(self._of("o_orderpriority = '2-HIGH' OR (o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0)"), "last", "2020-03-0")
        return self.write("third", changed.select(*self.raw.columns))

    def both(self, **options) -> list[dict]:
        return [self.engine.ingest(self.first, "initial", **options), self.engine.ingest(self.second, "delta", **options)]


_SAME = "(SELECT o_orderkey, o_orderkey % 16 AS k, o_orderpriority = '1-URGENT' AS urgent, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_custkey FROM orders)"
_KEPT = f"(SELECT *, CASE WHEN urgent AND k <> 4 THEN '2020-02-01' ELSE '2020-01-31' END AS day, {_STATUS} AS status FROM {_SAME} WHERE {_STATUS} <> 'quarantine')"
_ID = "CASE k WHEN 1 THEN '' WHEN 2 THEN ' ' ELSE 'ORD-' || o_orderkey END"


@register("csv_rows", f"SELECT row_number() OVER (ORDER BY o_orderkey) AS row_number, {_ID} AS order_id, CASE k WHEN 10 THEN '5' WHEN 11 THEN '???' ELSE CAST(price + 2000 AS VARCHAR) END AS total_amount, CAST(NULL AS VARCHAR) AS city FROM {_SAME}")
def _csv_rows(star: StarSchema) -> DataFrame:
    """Rows of several CSV files with a column left out, numbered through all files in their order."""
    loaded = Loaded(star)
    path = loaded.write("few", loaded.raw.select("total_amount", "order_id", "source_row_number"))
    rows = read_orders(star.spark, path)
    files = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    before = files.select("source_file", F.coalesce(F.expr("sum(n) OVER (ORDER BY source_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0)).alias("before"))
    return rows.join(before, "source_file").select((F.col("source_row_number") + F.col("before")).alias("row_number"), F.coalesce("order_id", F.lit("")).alias("order_id"), "total_amount", "city")


@register("csv_line_breaks", """SELECT row_number() OVER (ORDER BY o_orderkey) AS row_number, CAST(o_orderkey AS VARCHAR) AS order_id,
    CASE o_orderkey % 4 WHEN 1 THEN 'two' || chr(10) || 'lines, "quoted"' WHEN 2 THEN chr(10) || chr(10) || 'x' ELSE 'plain' END AS district FROM orders""")
def _csv_line_breaks(star: StarSchema) -> DataFrame:
    """Records that go over several lines, numbered as the others are."""
    loaded, kind = Loaded(star), F.col("o_orderkey") % 4
    district = F.when(kind == 1, 'two\nlines, "quoted"').when(kind == 2, "\n\nx").otherwise("plain")
    rows = star.table("orders").select(F.col("o_orderkey").cast("string").alias("order_id"), district.alias("district"), F.col("o_orderkey").alias("source_row_number"))
    found = read_orders(star.spark, loaded.write("breaks", rows, 1))
    return found.select(F.col("source_row_number").alias("row_number"), "order_id", "district")


@register("csv_fixed_schema", f"SELECT {_ID} AS order_id, CASE k WHEN 2 THEN '' ELSE 'CUS-' || o_custkey END AS customer_id, CASE WHEN k IN (11) THEN '[]' WHEN k = 12 THEN 'not-json' WHEN k = 13 THEN '[{{\"sku\":\"A\",\"qty\":-1,\"unit_price\":1,\"total\":1}}]' ELSE '[{{\"sku\":\"A\",\"qty\":1,\"unit_price\":' || price || ',\"total\":' || price || '}}]' END AS items_json FROM {_SAME}")
def _csv_fixed(star: StarSchema) -> DataFrame:
    rows = read_orders(star.spark, Loaded(star).first, fixed_schema=True)
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("order_id", "customer_id")), "items_json")


@register("size_router", "SELECT 'small' AS by_default, 'large' AS by_zero, true AS has_bytes")
def _size_router(star: StarSchema) -> DataFrame:
    path = Loaded(star).second
    found = decide_strategy(star.spark, path, 1 << 20), decide_strategy(star.spark, path, 0.0)
    return star.spark.createDataFrame([(found[0]["strategy"], found[1]["strategy"], found[0]["file_size_mb"] > 0)], "by_default string, by_zero string, has_bytes boolean")


@register("input_fingerprint", "SELECT CAST(count(*) AS BIGINT) AS n_lines, true AS again_the_same, false AS other_the_same FROM orders")
def _fingerprint(star: StarSchema) -> DataFrame:
    """Lines without headers, and whether the fingerprints of a second copy and of other orders are that of the first."""
    loaded = Loaded(star)
    paths = loaded.write("one", loaded.raw_in(1)), loaded.write("again", loaded.raw_in(1)), loaded.second
    hashes = [input_fingerprint(star.spark, p) for p in paths]
    lines = file_fingerprints(star.spark, paths[0]).agg((F.sum("n_lines") - F.count(F.lit(1))).cast("bigint").alias("n_lines"))
    return lines.select("n_lines", F.lit(hashes[0] == hashes[1]).alias("again_the_same"), F.lit(hashes[0] == hashes[2]).alias("other_the_same"))


@register("store_raw", f"SELECT {_ID} AS order_id, 'CUS-' || o_custkey AS customer_id FROM {_SAME} WHERE k <> 2")
def _store_raw(star: StarSchema) -> DataFrame:
    """The raw rows of the first of two runs."""
    loaded = Loaded(star)
    runs = loaded.both()
    rows = ingest.raw_of_run(loaded.engine.store, runs[0]["id_run"])
    return rows.where("customer_id <> ''").select(F.coalesce("order_id", F.lit("")).alias("order_id"), "customer_id")


@register("store_validated", f"SELECT 'ORD-' || o_orderkey AS order_id, status AS quality_status, CAST(price + 2000 AS DOUBLE) AS total_amount, CASE WHEN urgent THEN 'عدن' ELSE 'صنعاء' END AS city, urgent AS updated, true AS first_kept FROM {_KEPT}")
def _store_validated(star: StarSchema) -> DataFrame:
    """The validated table after a load and a delta of changed orders: the insert-only columns are those of the first run."""
    loaded = Loaded(star)
    first, second = loaded.both()
    rows = loaded.engine.orders()
    return rows.select("order_id", "quality_status", "total_amount", "city", (F.col("last_seen_run") == second["id_run"]).alias("updated"), (F.col("first_seen_run") == first["id_run"]).alias("first_kept"))


@register("store_versions", f"SELECT 'ORD-' || o_orderkey AS order_id, 'صنعاء' AS city FROM {_KEPT}")
def _store_versions(star: StarSchema) -> DataFrame:
    """The version before the delta, as it was."""
    loaded = Loaded(star)
    loaded.both()
    return loaded.engine.store.snapshot(ingest.VALIDATED_TABLE, ingest.VALIDATED_SCHEMA, 1).select("order_id", "city")


@register("store_find", f"SELECT 'ORD-' || o_orderkey AS order_id, CAST(price + 2000 AS DOUBLE) AS total_amount FROM {_KEPT} WHERE urgent")
def _store_find(star: StarSchema) -> DataFrame:
    """Records by their keys, from the buckets of the keys alone."""
    loaded = Loaded(star)
    loaded.engine.ingest(loaded.first)
    keys = star.table("orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("ORD-"), "o_orderkey").alias("order_id"))
    return loaded.engine.find(keys).select("order_id", "total_amount")


@register("store_quarantine", f"SELECT o_orderkey AS row_key, {_DETAILS} AS error_details, CASE WHEN contains({_DETAILS}, ';') THEN 'MULTIPLE_CONFLICTING_ERRORS' ELSE {_DETAILS} END AS error_code FROM {_KINDS} WHERE {_STATUS} = 'quarantine' AND k NOT IN (1, 2)")
def _store_quarantine(star: StarSchema) -> DataFrame:
    """Rejected records with their raw rows; those without an order id can not be named."""
    loaded = Loaded(star)
    loaded.engine.ingest(loaded.first)
    rows = loaded.engine.quarantine().where("trim(raw_record.order_id) <> ''")
    return rows.select(F.replace("raw_record.order_id", F.lit("ORD-"), F.lit("")).cast("bigint").alias("row_key"), "error_details", F.get("error_codes", F.lit(0)).alias("error_code"))


@register("store_resumed", f"SELECT error_code, CAST(count(*) AS BIGINT) AS n_rows, CAST(max(n_raw) AS BIGINT) AS n_raw FROM (SELECT CASE WHEN contains({_DETAILS}, ';') THEN 'MULTIPLE_CONFLICTING_ERRORS' ELSE {_DETAILS} END AS error_code, n_raw FROM (SELECT *, count(*) OVER () AS n_raw FROM {_KINDS}) WHERE {_STATUS} = 'quarantine') GROUP BY error_code")
def _store_resumed(star: StarSchema) -> DataFrame:
    """The quarantine by code, and the raw rows, of a run that was resumed from its raw rows and then loaded again."""
    loaded = Loaded(star)
    run = loaded.engine.ingest(loaded.first)["id_run"]
    loaded.engine.ingest(None, resume_run_id=run, from_raw=True)
    loaded.engine.ingest(loaded.first, resume_run_id=run)
    raw = ingest.raw_of_run(loaded.engine.store, run).agg(F.count(F.lit(1)).alias("n_raw"))
    codes = loaded.engine.quarantine().groupBy(F.get("error_codes", F.lit(0)).alias("error_code")).agg(F.count(F.lit(1)).alias("n_rows"))
    return codes.join(F.broadcast(raw))  # one row


@register("store_two_writers", "SELECT o_orderkey AS order_key, CASE WHEN o_orderpriority = '1-URGENT' THEN -1.0 ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS price, 2 AS tries FROM orders")
def _store_two_writers(star: StarSchema) -> DataFrame:
    """A writer of all orders but the urgent ones, while which another writes those and the ones of high priority: the first starts anew and loses nothing."""
    store = Loaded(star).engine.store
    rows = star.table("orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("price"), F.col("o_orderpriority").alias("priority"))
    mine, others = rows.where("priority <> '1-URGENT'").drop("priority"), rows.where("priority IN ('1-URGENT', '2-HIGH')").select("order_key", F.lit(-1.0).alias("price"))
    tries = []

    def put(old: DataFrame, fresh: DataFrame) -> DataFrame:
        tries.append(1)
        if len(tries) == 1:
            store.merge("prices", others, "order_key", lambda a, b: merge.upsert(a, b, ["order_key"]))
        return merge.upsert(old, fresh, ["order_key"])

    found = store.merge("prices", mine, "order_key", put)
    return found.withColumn("tries", F.lit(len(tries)))


@register("store_growth", "SELECT k AS part, CAST(count(*) AS BIGINT) AS n_rows, true AS buckets_fit, true AS one_rewritten FROM (SELECT o_orderkey % 4 AS k FROM orders) GROUP BY k")
def _store_growth(star: StarSchema) -> DataFrame:
    """A table that grows by four merges: its buckets split and stay below their bound, and a changed row rewrites one of them."""
    rows = star.table("orders").select(F.col("o_orderkey").alias("order_key"), (F.col("o_orderkey") % 4).alias("part"))
    bound = max(8, rows.count() // 32)
    store, fits = Loaded(star, buckets=2, bucket_rows=bound).engine.store, True
    put = lambda old, fresh: merge.upsert(old, fresh, ["order_key"])
    for part in range(4):
        store.merge("keys", rows.where(F.col("part") == part), "order_key", put)
        fits = fits and max(e["rows"] for e in store.manifest("keys")["buckets"].values()) <= bound
    before = store.manifest("keys")["buckets"]
    found = store.merge("keys", rows.orderBy("order_key").limit(1), "order_key", put)
    after = store.manifest("keys")["buckets"]
    alone = before.keys() == after.keys() and sum(before[b] != after[b] for b in after) == 1
    return found.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows")).withColumns({"buckets_fit": F.lit(fits), "one_rewritten": F.lit(alone)})


_RUN_COUNTS = f"""CAST(count(*) AS BIGINT) AS read_rows, CAST(count(*) FILTER (s = 'valid') AS BIGINT) AS count_valid, CAST(count(*) FILTER (s = 'corrected') AS BIGINT) AS count_corrected,
    CAST(count(*) FILTER (s = 'quarantine') AS BIGINT) AS count_quarantine"""
_RUNS = f"(SELECT {_STATUS} AS s, urgent FROM {_SAME})"


@register("store_runs", f"""SELECT 1 AS run, {_RUN_COUNTS}, CAST(count(*) FILTER (s <> 'quarantine') AS BIGINT) AS count_inserted, 0::BIGINT AS count_updated, 0::BIGINT AS count_unchanged, true AS consistent FROM {_RUNS}
    UNION ALL SELECT 2, {_RUN_COUNTS}, 0, CAST(count(*) FILTER (s <> 'quarantine') AS BIGINT), 0, true FROM {_RUNS} WHERE urgent
    UNION ALL SELECT 3, {_RUN_COUNTS}, 0, 0, CAST(count(*) FILTER (s <> 'quarantine') AS BIGINT), true FROM {_RUNS} WHERE urgent
    UNION ALL SELECT 4, {_RUN_COUNTS}, 0, CAST(count(*) FILTER (s <> 'quarantine' AND urgent) AS BIGINT), CAST(count(*) FILTER (s <> 'quarantine' AND NOT urgent) AS BIGINT), true FROM {_RUNS}""")
def _store_runs(star: StarSchema) -> DataFrame:
    """The figures of a load, of a delta, of the delta again, and of the first load resumed from its raw rows."""
    loaded = Loaded(star)
    first, _ = loaded.both()
    loaded.engine.ingest(loaded.second, "delta")
    loaded.engine.ingest(None, resume_run_id=first["id_run"], from_raw=True)
    names = ("read_rows", "count_valid", "count_corrected", "count_quarantine", "count_inserted", "count_updated", "count_unchanged")
    rows = [(n, *(int(r[c]) for c in names), r["consistency_check"]) for n, r in enumerate(loaded.engine.runs(), 1)]
    return star.spark.createDataFrame(rows, f"run int, {', '.join(f'{c} bigint' for c in names)}, consistent boolean")


@register("delta_ids", f"SELECT {_ID} AS order_id FROM {_SAME} WHERE urgent AND k NOT IN (1, 2)")
def _delta_ids(star: StarSchema) -> DataFrame:
    loaded = Loaded(star)
    loaded.both()
    return latest_delta_ids(loaded.engine.store)


@register("load_log", "SELECT * FROM (VALUES (1, 'initial', false), (2, 'delta', false), (3, 'delta', true)) AS t(load, stage, seen_before)")
def _load_log(star: StarSchema) -> DataFrame:
    """Files that were loaded before are known by their fingerprint."""
    loaded = Loaded(star)
    loaded.both()
    loaded.engine.ingest(loaded.write("second-again", star.spark.read.option("header", True).option("escape", '"').csv(loaded.second).withColumn("source_row_number", F.regexp_extract("order_id", r"(\d+)$", 1).try_cast("bigint")), 3), "delta")
    loaded.engine.ingest(loaded.second, "delta")
    log = loaded.engine.store.log("incremental")
    return star.spark.createDataFrame([(n, r["stage"], r["seen_before"]) for n, r in enumerate([*log[:2], log[-1]], 1)], "load int, stage string, seen_before boolean")


@register("store_stream", f"SELECT 'ORD-' || o_orderkey AS order_id, status AS quality_status FROM {_KEPT}")
def _store_stream(star: StarSchema) -> DataFrame:
    """A folder of files, loaded by a stream in micro-batches of two files."""
    loaded = Loaded(star)
    stream_folder(star.spark, loaded.engine.store, loaded.first, f"{loaded.folder}/checkpoint", files_per_batch=2).awaitTermination()
    return loaded.engine.orders().select("order_id", "quality_status")


_IMAGE = "CASE WHEN o_orderpriority = '2-HIGH' OR (o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0) THEN 3 WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END"
_VARIED = f"""(SELECT CASE WHEN k = 4 THEN '2020-01-31' ELSE ['2020-01-1', '2020-02-0', '2020-03-0'][image] || (o_orderkey % 5 + 1) END AS day,
    'S' || (o_orderkey % 7) AS sku, ['old ', 'new ', 'last '][image] || (o_orderkey % 3) AS name, price
    FROM (SELECT o_orderkey, o_orderkey % 16 AS k, {_IMAGE} AS image, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders) WHERE {_STATUS} <> 'quarantine')"""
_DAILY_SQL = f"SELECT day, CAST(count(*) AS BIGINT) AS orders, CAST(sum(price + 2000) AS DOUBLE) AS sales FROM {_VARIED} GROUP BY day"
_PRODUCTS_SQL = f"SELECT sku, min(name) AS product, CAST(count(*) AS DOUBLE) AS quantity, CAST(sum(price) AS DOUBLE) AS sales FROM {_VARIED} GROUP BY sku"


def _viewed(star: StarSchema, mode: str) -> Engine:
    """A load and a refresh, two deltas, and one refresh for both."""
    loaded = Loaded(star, varied=True)
    engine = loaded.engine
    engine.ingest(loaded.first, "initial")
    if mode != "full":
        engine.refresh_ledger() if mode == "ledger" else engine.refresh_views("full")
    engine.ingest(loaded.second, "delta")
    engine.ingest(loaded.third, "delta")
    engine.refresh_ledger() if mode == "ledger" else engine.refresh_views(mode)
    return engine


def _view_query(mode: str) -> None:
    @register(f"store_daily_{mode}", _DAILY_SQL)
    def _(star: StarSchema) -> DataFrame:
        return refresh.daily_view(_viewed(star, mode).store).select("day", "orders", "sales")

    @register(f"store_products_{mode}", _PRODUCTS_SQL)
    def _(star: StarSchema) -> DataFrame:
        return refresh.product_view(_viewed(star, mode).store).select("sku", "product", "quantity", "sales")


for _mode in ("full", "incremental", "ledger"):
    _view_query(_mode)


@register("store_checks", "SELECT unnest(['raw table exists', 'validated table exists', 'quarantine table exists', 'runs are recorded', 'every run is consistent', 'order ids are unique', 'every record has a hash', 'every record is valid or corrected', 'one currency', 'every record has its first time', 'views exist', 'days are unique', 'skus are unique']) AS name, true AS holds")
def _store_checks(star: StarSchema) -> DataFrame:
    return star.spark.createDataFrame(verify(_viewed(star, "incremental")), "name string, holds boolean")


@register("job_runs", "SELECT * FROM (VALUES (1, 'daily_reports', 'success'), (2, 'refresh_materialized_views', 'success'), (3, 'refresh_daily_sales', 'success')) AS t(place, job_name, status)")
def _job_runs(star: StarSchema) -> DataFrame:
    """The last runs of jobs, newest first."""
    loaded = Loaded(star)
    loaded.engine.ingest(loaded.first)
    for name in ("refresh_top_products", "refresh_daily_sales", "refresh_materialized_views", "daily_reports"):
        loaded.engine.run_job(name)
    rows = [(n, r["job_name"], r["status"]) for n, r in enumerate(loaded.engine.job_runs(3), 1)]
    return star.spark.createDataFrame(rows, "place int, job_name string, status string")


@register("report_file", f"SELECT period, CAST(count(*) AS BIGINT) AS orders, CAST(sum(price + 2000) AS DOUBLE) AS sales FROM (SELECT '2020-01' AS period, price FROM {_KEPT}) GROUP BY period")
def _report_file(star: StarSchema) -> DataFrame:
    """A report as the job wrote it."""
    loaded = Loaded(star)
    loaded.engine.ingest(loaded.first)
    folder = loaded.engine.run_job("daily_reports")["result"]["folder"]
    return star.spark.read.schema("period string, orders bigint, sales double").json(loaded.engine.store.path(f"{folder}/sales_by_period"))


@register("layout_query", "SELECT o_orderkey AS order_id, o_totalprice AS total_amount FROM orders WHERE o_totalprice >= 400000")
def _layout_query(star: StarSchema) -> DataFrame:
    """A query over the layout of its column."""
    path = layout.write_layout(star.plain_orders, work_folder(star.spark), layout.Layout(("total_amount",)))
    return star.spark.read.parquet(path).where("total_amount >= 400000").select("order_id", "total_amount")


@register("layouts_written", "SELECT unnest(['by_city_order_date', 'by_status_order_date', 'by_customer_id', 'by_city_status_order_date', 'by_customer_id_order_date', 'by_total_amount', 'by_order_date', 'by_order_id']) AS name, true AS at_first, false AS again")
def _layouts_written(star: StarSchema) -> DataFrame:
    """Layouts that a first and a second call write."""
    root = work_folder(star.spark)
    calls = [{i["name"]: i["created"] for i in layout.ensure_layouts(star.orders, root)} for _ in range(2)]
    return star.spark.createDataFrame([(n, made, calls[1][n]) for n, made in calls[0].items()], "name string, at_first boolean, again boolean")


@register("layout_serves", f"SELECT order_id, total_amount, true AS from_layout FROM (SELECT 'ORD-' || o_orderkey AS order_id, CAST(price + 2000 AS DOUBLE) AS total_amount FROM {_KEPT} WHERE o_custkey = 7 ORDER BY order_id LIMIT 20)")
def _layout_serves(star: StarSchema) -> DataFrame:
    """A named query of the engine, which reads the layout of its columns."""
    loaded = Loaded(star)
    loaded.engine.ingest(loaded.first)
    loaded.engine.indexes()
    found = loaded.engine.query_frame("customer_orders", {"customer_id": "CUS-7"}, kind="pquery")
    return found.select("order_id", "total_amount", F.lit(all("/by_customer_id/" in f for f in found.inputFiles())).alias("from_layout"))


@register("plan_summary", "SELECT 'filtered scan' AS scan_type, true AS pushed, 2 AS columns_read, 0 AS exchanges, CAST(count(*) FILTER (o_custkey = 7) AS BIGINT) AS n_returned, CAST(count(*) AS BIGINT) AS rows_examined, 1 AS files_examined FROM orders")
def _plan_summary(star: StarSchema) -> DataFrame:
    found = explain.measure(star.table("orders").where("o_custkey = 7").select("o_orderkey"))
    row = (found["scan_type"], "EqualTo(o_custkey,7)" in found["pushed_filters"][0], len(found["read_schema"][0].split(",")), found["exchanges"], found["n_returned"], found["rows_examined"], found["files_examined"])
    return star.spark.createDataFrame([row], "scan_type string, pushed boolean, columns_read int, exchanges int, n_returned bigint, rows_examined bigint, files_examined int")


@register("index_benchmark", """SELECT * FROM (SELECT 'customer_orders' AS name, CAST(least(count(*) FILTER (o_custkey = 7), 20) AS BIGINT) AS before, CAST(least(count(*) FILTER (o_custkey = 7), 20) AS BIGINT) AS after, CAST(count(*) AS BIGINT) AS examined_before, true AS no_more_after FROM orders
    UNION ALL SELECT 'high_value_orders', CAST(least(count(*) FILTER (o_totalprice >= 100000), 20) AS BIGINT), CAST(least(count(*) FILTER (o_totalprice >= 100000), 20) AS BIGINT), CAST(count(*) AS BIGINT), true FROM orders)""")
def _index_benchmark(star: StarSchema) -> DataFrame:
    """Rows that queries return and examine over the plain table and over their layouts."""
    found = explain.benchmark(star.plain_orders, work_folder(star.spark), {"customer_orders": {"customer_id": 7}, "high_value_orders": {}})
    rows = [(r["name"], r["before"]["n_returned"], r["after"]["n_returned"], r["before"]["rows_examined"], r["after"]["rows_examined"] <= r["before"]["rows_examined"]) for r in found]
    return star.spark.createDataFrame(rows, "name string, before bigint, after bigint, examined_before bigint, no_more_after boolean")


def _command(loaded: Loaded, *arguments: str):
    """What the command line gives for arguments on the store of loaded."""
    return cli.run(loaded.engine, cli.parser().parse_args([loaded.engine.store.root, *arguments]))


@register("cli_aggregation", f"SELECT CASE k WHEN 5 THEN 'قيد الانتظار' ELSE 'مؤكد' END AS status, CAST(count(*) AS BIGINT) AS orders, CAST(sum(price + 2000) AS DOUBLE) AS sales FROM {_KEPT} GROUP BY 1")
def _cli_aggregation(star: StarSchema) -> DataFrame:
    """Orders that one command loads, and a report that another gives."""
    loaded = Loaded(star)
    _command(loaded, "ingest", "--input", loaded.first, "--stage", "initial")
    rows = _command(loaded, "aggregation", "orders_by_status", "--kind", "agg_v2")["results"]
    return star.spark.createDataFrame([(r["status"], r["orders"], r["sales"]) for r in rows], "status string, orders bigint, sales double")


@register("cli_sample", "SELECT CAST(least(count(*), 50) AS BIGINT) AS n_rows, CAST(least(count(*), 50) AS BIGINT) AS n_known, true AS again_the_same FROM orders")
def _cli_sample(star: StarSchema) -> DataFrame:
    """Fifty rows that a command draws: all from the input, and the same for the same seed."""
    loaded = Loaded(star)
    path = loaded.write("few", loaded.raw.select("customer_id", "total_amount", "source_row_number"))
    drawn = []
    for name in ("a", "b"):
        _command(loaded, "sample", "--input", path, "--output", f"{loaded.folder}/{name}", "--rows", "50", "--seed", "5")
        drawn.append(read_orders(star.spark, f"{loaded.folder}/{name}").select("customer_id", "total_amount"))
    known = drawn[0].join(read_orders(star.spark, path).select("customer_id", "total_amount"), ["total_amount"], "left_semi")
    same = drawn[0].exceptAll(drawn[1]).isEmpty() and drawn[1].exceptAll(drawn[0]).isEmpty()
    return star.spark.createDataFrame([(drawn[0].count(), known.count(), same)], "n_rows bigint, n_known bigint, again_the_same boolean")


@register("jobs_due", "SELECT * FROM (VALUES (5, 'none', 0), (15, 'refresh_daily_sales', 1), (16, 'none', 0), (130, 'refresh_top_products', 1), (130, 'refresh_materialized_views', 2), (130, 'daily_reports', 3)) AS t(minute, job_name, place)")
def _jobs_due(star: StarSchema) -> DataFrame:
    """The jobs that an outside scheduler finds due, by minute of the day: each once a day."""
    loaded = Loaded(star)
    loaded.engine.ingest(loaded.first)
    rows = []
    for minute in (5, 15, 16, 130):
        ran = jobs.run_due(loaded.engine.store, datetime(2025, 1, 1, minute // 60, minute % 60, tzinfo=timezone.utc)) or ["none"]
        rows += [(minute, name, 0 if name == "none" else place) for place, name in enumerate(ran, 1)]
    return star.spark.createDataFrame(rows, "minute int, job_name string, place int")


#: Names of the queries of this module.
NAMES = tuple(n for n in QUERIES if n not in _BEFORE)
