"""The registered queries over the star schema, each with the same statement in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill import schema as S
from ledgermill.functions import dates, items, money, text
from ledgermill.functions.text import let
from ledgermill.ingest import error_histogram, status_counts
from ledgermill.operators import merge, views
from ledgermill.operators.classify import classify, record_hash
from ledgermill.operators.dedup import first_rows, flag_repeats, repeated_keys
from ledgermill.operators.sample import sample_rows
from ledgermill.plans import catalog
from ledgermill.starschema import StarSchema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_ORDERS = """(SELECT o_orderkey AS order_id, o_orderdate AS order_date, o_orderstatus AS status, o_custkey AS customer_id, n_name AS city,
    o_orderpriority AS payment_method, c_mktsegment AS payment_status, o_totalprice AS total_amount
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_ITEMS = """(SELECT l_orderkey AS order_id, l_partkey AS sku, p_name AS name, l_quantity AS qty, l_extendedprice AS total
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"""


def _sum(column: str) -> str:
    return f"coalesce(CAST(sum(CAST({column} AS DECIMAL(18,2))) AS DOUBLE), 0.0)"


def register(name: str, sql: str):
    def add(make: Callable[[StarSchema], DataFrame]) -> Callable[[StarSchema], DataFrame]:
        QUERIES[name] = lambda spark, folder: make(StarSchema(spark, folder))
        ORACLES[name] = sql
        return make

    return add


# row queries

_ROW = "order_id, order_date, status, customer_id, city, payment_method, payment_status, total_amount"


def _row_query(name: str, registry: dict, query: str, params: dict, where: str, order: str, limit: int) -> None:
    @register(name, f"SELECT {_ROW} FROM {_ORDERS} WHERE {where} ORDER BY {order}, order_id LIMIT {limit}")
    def _(star: StarSchema) -> DataFrame:
        return registry[query].build(star.orders, params)


_NEWEST, _OLDEST, _LARGEST = "order_date DESC NULLS LAST", "order_date ASC NULLS FIRST", "total_amount DESC NULLS LAST"
_row_query("query_sales_by_city", catalog.QUERIES, "sales_by_city", {"city": "NATION_6"}, "city = 'NATION_6'", _NEWEST, 20)
_row_query("query_delivered_by_date", catalog.QUERIES, "delivered_by_date", {"status": "F", "start": "1996-01-01", "end": "1997-01-01"}, "status = 'F' AND order_date >= TIMESTAMP '1996-01-01' AND order_date < TIMESTAMP '1997-01-01'", _NEWEST, 20)
_row_query("query_customer_orders", catalog.QUERIES, "customer_orders", {"customer_id": 7}, "customer_id = 7", _NEWEST, 20)
_row_query("query_high_value_orders", catalog.QUERIES, "high_value_orders", {}, "total_amount >= 100000", _LARGEST, 20)
_row_query("query_pending_card_orders", catalog.QUERIES, "pending_card_orders", {"payment_status": "BUILDING", "payment_method": "1-URGENT", "city": "NATION_6"}, "payment_status = 'BUILDING' AND payment_method = '1-URGENT' AND city = 'NATION_6'", _NEWEST, 20)
_row_query("pquery_orders_by_city_status", catalog.PARAMETER_QUERIES, "orders_by_city_status", {"city": "NATION_7", "status": "O"}, "city = 'NATION_7' AND status = 'O'", _NEWEST, 20)
_row_query("pquery_customer_orders", catalog.PARAMETER_QUERIES, "customer_orders", {"customer_id": 11}, "customer_id = 11", _NEWEST, 20)
_row_query("pquery_high_value_orders", catalog.PARAMETER_QUERIES, "high_value_orders", {"min_total": 250000}, "total_amount >= 250000", _LARGEST, 20)
_row_query("pquery_sales_by_period", catalog.PARAMETER_QUERIES, "sales_by_period", {"start": "1996-03-01", "end": "1996-04-01"}, "order_date BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-04-01'", _OLDEST, 100)
_row_query("pquery_orders_by_status", catalog.PARAMETER_QUERIES, "orders_by_status", {"status": "P"}, "status = 'P'", _NEWEST, 50)

# reports

_COUNTED = f"CAST(count(*) AS BIGINT) AS orders, {_sum('total_amount')} AS sales"
_PRODUCT = f"{_sum('qty')} AS quantity, {_sum('total')} AS sales"
_MONTHS = f"SELECT strftime(order_date, '%Y-%m') AS period, {_COUNTED} FROM {_ORDERS} WHERE order_date IS NOT NULL GROUP BY 1"
_REPORT_SQL = {
    "sales_by_city": (f"SELECT city, {_COUNTED} FROM {_ORDERS} GROUP BY city ORDER BY sales DESC, city LIMIT 100", f"SELECT city, {_COUNTED} FROM {_ORDERS} GROUP BY city"),
    "top_products": (f"SELECT sku, name AS product, {_PRODUCT} FROM {_ITEMS} GROUP BY sku, name ORDER BY sales DESC, sku LIMIT 100", f"SELECT sku, name, {_PRODUCT} FROM {_ITEMS} GROUP BY sku, name ORDER BY sales DESC, sku LIMIT 20"),
    "top_customers": (f"SELECT customer_id, {_COUNTED} FROM {_ORDERS} GROUP BY customer_id ORDER BY sales DESC, customer_id LIMIT 100", f"SELECT customer_id, {_COUNTED} FROM {_ORDERS} GROUP BY customer_id ORDER BY sales DESC, customer_id LIMIT 20"),
    "sales_by_period": (_MONTHS, _MONTHS),
    "orders_by_status": (f"SELECT status, {_COUNTED} FROM {_ORDERS} GROUP BY status",) * 2,
}


def _report(name: str, registry: dict, report: str, sql: str) -> None:
    @register(name, sql)
    def _(star: StarSchema) -> DataFrame:
        orders = star.orders if report == "sales_by_city" else star.plain_orders
        return registry[report].build(orders, star.product_lines)


for _name, _sqls in _REPORT_SQL.items():
    _report(f"agg_{_name}", catalog.REPORTS, _name, _sqls[0])
    _report(f"agg_{_name}_v2", catalog.REPORTS_V2, _name, _sqls[1])


# keys, counts, outcomes


@register("dup_keys", "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _dup_keys(star: StarSchema) -> DataFrame:
    return repeated_keys(star.table("lineitem"), "l_orderkey", "l_linenumber")


@register("dedup_first", "SELECT text, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def _dedup_first(star: StarSchema) -> DataFrame:
    return first_rows(star.table("documents").select("doc_id", "text", "source"), ["text"], [F.col("doc_id")])


@register("record_hash", """SELECT doc_id, sha256('{"clean":{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') ||
    '},"quality_status":"corrected","corrections":[{"field":"lang","original_value":null,"corrected_value":"' || n_chars || '","rule_code":"R"}]}') AS record_hash FROM documents""")
def _record_hash(star: StarSchema) -> DataFrame:
    clean = F.struct("doc_id", "lang", "source")
    corrections = F.array(text.correction("lang", F.lit(None), F.col("n_chars"), "R"))
    return star.table("documents").select("doc_id", record_hash(clean, F.lit("corrected"), corrections).alias("record_hash"))


@register("sample_topk", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 100")
def _sample(star: StarSchema) -> DataFrame:
    return sample_rows(star.table("orders").select("o_orderkey", "o_custkey"), 100, ["o_orderkey"])


# two images of the orders, by period: some are new, some changed, some gone

_OLD_UNTIL, _NEW_FROM = "2000-01-01", "1997-01-01"
_IMAGES = f"""old AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{_OLD_UNTIL}'),
    new AS (SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice,
                              CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 40 DAY ELSE o_orderdate END AS o_orderdate) FROM orders WHERE o_orderdate >= TIMESTAMP '{_NEW_FROM}')"""
_VERSION = "concat_ws('|', CAST(o_totalprice AS VARCHAR), CAST(o_orderdate AS VARCHAR))"


def _images(star: StarSchema) -> tuple[DataFrame, DataFrame]:
    moment = lambda day: F.lit(day).cast("timestamp_ntz")
    old = star.plain_orders.where(F.col("order_date") < moment(_OLD_UNTIL))
    new = star.plain_orders.where(F.col("order_date") >= moment(_NEW_FROM)).withColumns({
        "total_amount": F.when(F.col("status") == "P", F.col("total_amount") + 100).otherwise(F.col("total_amount")),
        "order_date": F.when(F.col("payment_method") == "1-URGENT", F.col("order_date") + F.expr("INTERVAL 40 DAYS")).otherwise(F.col("order_date")),
    })
    return _hashed(old), _hashed(new)


def _hashed(orders: DataFrame) -> DataFrame:
    return orders.withColumn("record_hash", F.md5(F.concat_ws("|", F.col("total_amount").cast("decimal(18,2)").cast("string"), F.col("order_date").cast("string"))))


@register("upsert_outcome", f"""WITH {_IMAGES}, j AS (SELECT old.o_orderkey IS NOT NULL AS known,
        old.o_totalprice IS NOT DISTINCT FROM new.o_totalprice AND old.o_orderdate IS NOT DISTINCT FROM new.o_orderdate AS same FROM new LEFT JOIN old USING (o_orderkey))
    SELECT CAST(count(*) FILTER (NOT known) AS BIGINT) AS inserted, CAST(count(*) FILTER (known AND NOT same) AS BIGINT) AS updated, CAST(count(*) FILTER (known AND same) AS BIGINT) AS unchanged FROM j""")
def _outcome(star: StarSchema) -> DataFrame:
    old, new = _images(star)
    return merge.upsert_outcome(old, new, "order_id", "record_hash")


@register("join_merge_upsert", f"""WITH {_IMAGES} SELECT coalesce(new.o_orderkey, old.o_orderkey) AS order_id, CASE WHEN new.o_orderkey IS NOT NULL THEN new.o_totalprice ELSE old.o_totalprice END AS total_amount,
    CASE WHEN old.o_orderkey IS NOT NULL THEN 'old' ELSE 'new' END AS first_run, CASE WHEN new.o_orderkey IS NOT NULL THEN 'new' ELSE 'old' END AS last_run
    FROM old FULL JOIN new ON old.o_orderkey = new.o_orderkey""")
def _upsert(star: StarSchema) -> DataFrame:
    old, new = (i.select("order_id", "total_amount", F.lit(n).alias("first_run"), F.lit(n).alias("last_run")) for i, n in zip(_images(star), ("old", "new")))
    return merge.upsert(old, new, ["order_id"], ("first_run",))


@register("join_merge_replace", f"""WITH {_IMAGES} SELECT o_orderkey AS order_id, o_totalprice AS total_amount, 'new' AS run FROM new
    UNION ALL SELECT o_orderkey, o_totalprice, 'old' FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)""")
def _replace(star: StarSchema) -> DataFrame:
    old, new = (i.select("order_id", "total_amount", F.lit(n).alias("run")) for i, n in zip(_images(star), ("old", "new")))
    return merge.replace_rows(old, new, ["order_id"])


@register("join_duplicate_flag", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS is_repeated FROM lineitem")
def _duplicate_flag(star: StarSchema) -> DataFrame:
    lines = star.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return flag_repeats(lines, F.struct("l_orderkey", "l_linenumber"), None, "is_repeated", keep_first=False)


@register("join_existing_versions", f"""WITH {_IMAGES} SELECT new.o_orderkey AS order_id, CASE WHEN old.o_orderkey IS NULL THEN 'inserted'
    WHEN old.o_totalprice = new.o_totalprice AND old.o_orderdate = new.o_orderdate THEN 'unchanged' ELSE 'updated' END AS outcome FROM new LEFT JOIN old USING (o_orderkey)""")
def _existing(star: StarSchema) -> DataFrame:
    old, new = _images(star)
    return merge.match_versions(old, new, "order_id", "record_hash")


@register("join_ledger_lookup", f"""WITH {_IMAGES} SELECT coalesce(new.o_orderkey, old.o_orderkey) AS order_id, old.o_totalprice AS old_sales, new.o_totalprice AS new_sales FROM old FULL JOIN new ON old.o_orderkey = new.o_orderkey""")
def _ledger_lookup(star: StarSchema) -> DataFrame:
    old, new = _images(star)
    pairs = views.ledger_pairs(new, old)
    return pairs.select(F.coalesce("n.order_id", "o.order_id").alias("order_id"), F.col("o.total_amount").alias("old_sales"), F.col("n.total_amount").alias("new_sales"))


@register("join_changed_orders", "SELECT l_orderkey AS order_id, l_partkey AS sku, l_extendedprice AS total FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def _changed_orders(star: StarSchema) -> DataFrame:
    changed = star.plain_orders.where("status = 'P'").select("order_id")
    lines = star.table("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku"), F.col("l_extendedprice").alias("total"))
    return merge.of_keys(lines, changed, "order_id")


@register("join_affected_groups", f"""SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS orders, {_sum('o_totalprice')} AS sales FROM orders
    WHERE strftime(o_orderdate, '%Y-%m-%d') IN (SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_totalprice >= 499000) GROUP BY 1""")
def _affected_groups(star: StarSchema) -> DataFrame:
    days = views.affected_days(star.plain_orders.where("total_amount >= 499000"))
    return views.daily_sales(star.plain_orders.join(days, views.day_of(F.col("order_date")) == F.col("day"), "left_semi"))


@register("join_vanished_keys", f"""WITH {_IMAGES} SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day FROM old
    EXCEPT SELECT strftime(o_orderdate, '%Y-%m-%d') FROM new""")
def _vanished(star: StarSchema) -> DataFrame:
    old, new = _images(star)
    return views.affected_days(old).join(views.affected_days(new), "day", "left_anti")


@register("additive_upsert", f"""WITH parts AS (SELECT o_orderstatus AS status, 1 AS orders, o_totalprice AS sales FROM orders)
    SELECT status, CAST(sum(orders) AS BIGINT) AS orders, round(sum(CAST(sales AS DECIMAL(18,2))))::BIGINT AS sales FROM parts GROUP BY status""")
def _additive(star: StarSchema) -> DataFrame:
    earlier = F.col("order_date") < F.lit(_OLD_UNTIL).cast("timestamp_ntz")
    part = lambda rows: star.plain_orders.where(rows).groupBy("status").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("total_amount").cast("decimal(18,2)")).alias("sales"))
    return merge.add_into(part(earlier), part(~earlier | F.col("order_date").isNull()), ["status"], ["orders", "sales"]).withColumn("sales", F.round("sales").cast("bigint"))


# views

_DAILY = f"SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS orders, {_sum('o_totalprice')} AS sales"


@register("mv_daily", f"{_DAILY} FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def _mv_daily(star: StarSchema) -> DataFrame:
    return views.daily_sales(star.plain_orders)


def _product_view(star: StarSchema) -> DataFrame:
    return views.product_sales(star.product_lines)


@register("mv_products", f"SELECT sku, min(name) AS product, {_PRODUCT} FROM {_ITEMS} WHERE sku IS NOT NULL GROUP BY sku")
def _mv_products(star: StarSchema) -> DataFrame:
    return _product_view(star)


@register("mv_top_products", f"SELECT sku, min(name) AS product, {_PRODUCT} FROM {_ITEMS} GROUP BY sku ORDER BY sales DESC, sku LIMIT 20")
def _mv_top(star: StarSchema) -> DataFrame:
    return views.top_products(_product_view(star))


@register("affected_keys", f"""WITH {_IMAGES}, ids AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT')
    SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT o_orderkey, o_orderdate FROM old UNION ALL SELECT o_orderkey, o_orderdate FROM new) WHERE o_orderkey IN (SELECT o_orderkey FROM ids)""")
def _affected_keys(star: StarSchema) -> DataFrame:
    changed = (F.col("status") == "P") | (F.col("payment_method") == "1-URGENT")
    return views.affected_days(*(i.where(changed) for i in _images(star)))


_NEW_DAILY = f"WITH {_IMAGES} {_DAILY} FROM new GROUP BY 1"


@register("mv_incremental", _NEW_DAILY)
def _mv_incremental(star: StarSchema) -> DataFrame:
    """The view of the old image, refreshed for the orders that differ: equal to a full rebuild."""
    old, new = _images(star)
    versions = lambda i: i.select("order_id", "record_hash")
    gone = versions(old).exceptAll(versions(new)).unionByName(versions(new).exceptAll(versions(old))).select("order_id").distinct()
    days = views.affected_days(old.join(gone, "order_id", "left_semi"), new.join(gone, "order_id", "left_semi"))
    return views.refresh_daily(views.daily_sales(old), new, days)


def _with_items(orders: DataFrame) -> DataFrame:
    return orders.withColumns({"order_id": F.col("order_id").cast("string"), "items": F.array().cast(f"array<{S.ITEM.simpleString()}>")})


@register("mv_ledger", _NEW_DAILY)
def _mv_ledger(star: StarSchema) -> DataFrame:
    """The view of the old image, with the signed differences of the new one: equal to a full rebuild."""
    old, new = (_with_items(i) for i in _images(star))
    no_products = star.spark.createDataFrame([], views.PRODUCT_SCHEMA)
    return views.ledger_refresh(views.daily_sales(old), no_products, views.contributions(old), new).daily


_NEW_PRODUCTS = f"WITH {_IMAGES} SELECT CAST(sku AS VARCHAR) AS sku, min(name) AS product, {_PRODUCT} FROM {_ITEMS} WHERE order_id IN (SELECT o_orderkey FROM new) AND sku IS NOT NULL GROUP BY sku"


@register("mv_incremental_products", _NEW_PRODUCTS)
def _mv_incremental_products(star: StarSchema) -> DataFrame:
    """The product view of the old image, refreshed for the products of the orders that differ."""
    old, new = _images(star)
    versions = lambda i: i.select("order_id", "record_hash")
    gone = versions(old).exceptAll(versions(new)).unionByName(versions(new).exceptAll(versions(old))).select("order_id").distinct()
    old_items, new_items = (star.items.withColumn("sku", F.col("sku").cast("string")).join(i.select("order_id"), "order_id", "left_semi") for i in (old, new))
    skus = views.affected_products(*(i.join(gone, "order_id", "left_semi") for i in (old_items, new_items)))
    return views.refresh_products(views.product_sales(old_items), new_items, skus)


@register("mv_ledger_products", _NEW_PRODUCTS)
def _mv_ledger_products(star: StarSchema) -> DataFrame:
    """The product view of the old image, with the signed differences of the new one's line items."""
    line = F.struct(F.col("sku").cast("string").alias("sku"), "name", "qty", F.lit(None).cast("double").alias("unit_price"), "total", F.lit(None).cast("string").alias("extra"))
    lines = star.items.groupBy("order_id").agg(F.collect_list(line).alias("items"))
    old, new = (i.join(lines, "order_id", "left").withColumn("order_id", F.col("order_id").cast("string")) for i in _images(star))
    view = views.product_sales(old.select(F.explode("items").alias("i")).select("i.*"))
    return views.ledger_refresh(views.daily_sales(old), view, views.contributions(old), new).products


# rules, on dirty fields made of clean ones

_NBSP, _ZERO_WIDTH = " ", "​"


@register("text_clean", "SELECT c_custkey, c_name || ' x' AS cleaned FROM customer")
def _text_clean(star: StarSchema) -> DataFrame:
    dirty = F.concat(F.lit(f"{_NBSP}\t "), F.col("c_name"), F.lit(f"{_NBSP}{_ZERO_WIDTH}x \n"))
    return star.table("customer").select("c_custkey", text.clean_text(dirty).alias("cleaned"))


@register("digits", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ',7' AS cleaned FROM orders")
def _digits(star: StarSchema) -> DataFrame:
    plain = F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(",7"))
    digits = F.translate(plain, "0123456789.,", S.FOREIGN_DIGITS[:10] + S.FOREIGN_DIGITS[20:])
    return star.table("orders").select("o_orderkey", text.ascii_digits(digits).alias("cleaned"))


@register("money", """SELECT o_orderkey,
    CASE WHEN o_orderkey % 7 = 5 THEN NULL WHEN o_orderkey % 7 = 6
        THEN [1000, 1000, 2000, 2000, 2000, 2000, 3000, 3000, 4000, 4000, 5000, 5000, 6000, 6000, 7000, 7000, 8000, 8000, 9000, 9000, 10000, 10000][o_orderkey // 7 % 22 + 1]::DOUBLE ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS value,
    CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'CURRENCY_OR_FORMAT_NORMALIZED' WHEN 2 THEN 'ARABIC_DIGITS_CONVERTED'
         WHEN 3 THEN CASE WHEN o_totalprice >= 1000 THEN 'CURRENCY_OR_FORMAT_NORMALIZED' END WHEN 4 THEN 'CURRENCY_OR_FORMAT_NORMALIZED' WHEN 6 THEN 'CURRENCY_OR_FORMAT_NORMALIZED' END AS rule FROM orders""")
def _money(star: StarSchema) -> DataFrame:
    plain = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    grouped = F.regexp_replace(plain, r"(\d)(?=(\d{3})+\.)", "$1,")
    kind = F.col("o_orderkey") % 7
    word = F.get(F.array(*map(F.lit, S.WORD_NUMBERS)), (F.floor(F.col("o_orderkey") / 7) % 22).cast("int"))
    raw = (
        F.when(kind == 1, F.concat(plain, F.lit(" لاير"))).when(kind == 2, F.translate(plain, "0123456789.", S.FOREIGN_DIGITS[:10] + "٫")).when(kind == 3, grouped)
        .when(kind == 4, F.concat(F.lit("ر.ي. "), plain)).when(kind == 5, F.lit("???")).when(kind == 6, word).otherwise(plain)
    )
    parsed = star.spread("orders").select("o_orderkey", money.parse_money(raw).alias("m"))
    return parsed.select("o_orderkey", "m.value", "m.rule")


@register("currency", "SELECT c_custkey, c_custkey % 4 >= 2 AS corrected FROM customer")
def _currency(star: StarSchema) -> DataFrame:
    raw = F.element_at(F.array(F.lit(" yer "), F.lit(""), F.lit("ريال"), F.lit("USD")), (F.col("c_custkey") % 4).cast("int") + 1)
    return star.table("customer").select("c_custkey", text.currency_corrected(raw).alias("corrected"))


@register("phone", "SELECT c_custkey, '77' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone FROM customer")
def _phone(star: StarSchema) -> DataFrame:
    number = F.concat(F.lit("77-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    raw = F.concat(F.element_at(F.array(F.lit("+967 "), F.lit("00967"), F.lit("("), F.lit(" ")), (F.col("c_custkey") % 4).cast("int") + 1), number)
    return star.table("customer").select("c_custkey", text.clean_phone(raw).alias("phone"))


@register("email", r"""WITH e AS (SELECT doc_id, regexp_replace(regexp_replace(trim(text, chr(32) || chr(10)), '@{2,}', '@', 'g'), '\.{2,}', '.', 'g') AS email
    FROM (SELECT doc_id, replace(replace(text, ' ', '..'), ',', '@@@') AS text FROM documents))
    SELECT doc_id, email, NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$') AS broken FROM e""")
def _email(star: StarSchema) -> DataFrame:
    """Whole texts, with runs of dots for spaces and of at signs for commas."""
    spoiled = F.replace(F.replace("text", F.lit(" "), F.lit("..")), F.lit(","), F.lit("@@@"))
    cleaned = star.table("documents").select("doc_id", text.clean_email(spoiled).alias("email"))
    return cleaned.select("doc_id", "email", text.email_is_broken(F.col("email")).alias("broken"))


@register("email_whole", r"""WITH e AS (SELECT doc_id, regexp_replace(regexp_replace(trim(text, chr(32) || chr(10)), '@{2,}', '@', 'g'), '\.{2,}', '.', 'g') AS email
    FROM (SELECT doc_id, replace(replace(replace(text, ' ', ''), '.', '..'), ',', '@@') AS text FROM documents))
    SELECT doc_id, email, NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$') AS broken FROM e""")
def _email_whole(star: StarSchema) -> DataFrame:
    """Whole texts without spaces, so that some are one address."""
    spoiled = F.replace(F.replace(F.replace("text", F.lit(" "), F.lit("")), F.lit("."), F.lit("..")), F.lit(","), F.lit("@@"))
    cleaned = star.table("documents").select("doc_id", text.clean_email(spoiled).alias("email"))
    return cleaned.select("doc_id", "email", text.email_is_broken(F.col("email")).alias("broken"))


@register("date_norm", """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 10 YEAR AS t, o_orderkey % 5 AS k FROM orders)
    SELECT o_orderkey, CASE WHEN k = 4 OR year(t) > 2100 THEN NULL WHEN k = 2 AND day(t) <= 12 THEN make_timestamp(year(t), day(t), month(t), 0, 0, 0) ELSE date_trunc('day', t) END AS order_date FROM d""")
def _date_norm(star: StarSchema) -> DataFrame:
    later = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 10 YEARS")
    kind = F.col("o_orderkey") % 5
    written = lambda form: F.date_format(later, form)
    raw = (
        F.when(kind == 0, written("yyyy/MM/dd")).when(kind == 1, F.translate(written("yyyy-MM-dd"), "0123456789", S.FOREIGN_DIGITS[:10]))
        .when(kind == 2, written("dd-MM-yyyy")).when(kind == 3, F.concat(written("yyyy-MM-dd"), F.lit("T00:00:00+03:00"))).otherwise(F.lit("not a date"))
    )
    return star.spread("orders").select("o_orderkey", dates.parse_date(raw).alias("order_date"))


@register("choice", "SELECT c_custkey, c_mktsegment || ' a b' AS choice, c_custkey % 2 = 0 AS changed FROM customer")
def _choice(star: StarSchema) -> DataFrame:
    raw = F.concat(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.lit(f"  a{_NBSP}\t b ")).otherwise(F.lit(" a b")))
    return star.table("customer").select("c_custkey", text.clean_choice(raw).alias("choice"), (text.clean_choice(raw) != text.clean_text(raw)).alias("changed"))


@register("items_parse", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 0 ELSE -1 END::BIGINT AS n_items FROM events""")
def _items_parse(star: StarSchema) -> DataFrame:
    kind = F.col("event_id") % 5
    raw = (
        F.when(kind == 0, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(kind == 1, F.concat(F.lit(" ["), F.col("props"), F.lit(", 3] ")))
        .when(kind == 2, F.col("props")).when(kind == 3, F.concat(F.lit("["), F.col("props"), F.lit(","))).otherwise(F.lit("[]"))
    )
    parsed = items.parse_items(raw)
    return star.table("events").select("event_id", F.when(parsed.isNotNull(), F.size(parsed)).otherwise(-1).cast("bigint").alias("n_items"))


_LINES = "(SELECT *, l_orderkey % 4 AS k FROM lineitem)"


def _item_json() -> Column:
    """Lines as JSON: negative, unreadable, written in Arabic digits, or plain, by order."""
    amount = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    kind = F.col("l_orderkey") % 4
    qty = F.when(kind == 0, F.concat(F.lit("-"), amount("l_quantity"))).when(kind == 1, F.lit('"???"')).when(kind == 2, F.concat(F.lit('"'), F.translate(amount("l_quantity"), "0123456789.", S.FOREIGN_DIGITS[:10] + "٫"), F.lit('"'))).otherwise(amount("l_quantity"))
    return F.concat(F.lit('[{"sku":"'), F.col("l_partkey"), F.lit('","qty":'), qty, F.lit(',"unit_price":1.5,"total":'), amount("l_extendedprice"), F.lit("}, 7]"))


@register("items_clean", f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k >= 2 THEN l_quantity END AS qty, CASE WHEN k >= 2 THEN l_extendedprice END AS total, k = 0 AS negative,
    CAST(CASE WHEN k = 2 THEN 1 ELSE 0 END AS BIGINT) AS n_corrections FROM {_LINES}""")
def _items_clean(star: StarSchema) -> DataFrame:
    read = star.spread("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", items.read_items(items.parse_items(_item_json())).alias("lines"))
    kept = read.withColumns({"kept": F.get(items.kept_items(F.col("lines")), F.lit(0)), "negative": items.has_negative(F.col("lines")), "n_corrections": F.size(items.item_corrections(F.col("lines"))).cast("bigint")})
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "kept.qty", "kept.total", "negative", "n_corrections")


@register("total_recompute", """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_totalprice + 2000.3 WHEN 2 THEN 5.0 ELSE o_totalprice + 2000 END AS given, o_totalprice + 2000 AS expected FROM orders)
    SELECT o_orderkey, CAST(CAST(CASE WHEN given IS NULL OR abs(given - expected) > 0.5 THEN expected ELSE given END AS DECIMAL(18,2)) AS DOUBLE) AS total, given IS NULL OR abs(given - expected) > 0.5 AS replaced FROM t""")
def _total_recompute(star: StarSchema) -> DataFrame:
    price, kind = F.col("o_totalprice"), F.col("o_orderkey") % 4
    none = F.lit(None).cast("string")
    lines = F.array(F.struct(none.alias("sku"), none.alias("name"), F.lit(1.0).alias("qty"), price.alias("unit_price"), price.alias("total"), none.alias("extra")))
    given = F.when(kind == 0, F.lit(None).cast("double")).when(kind == 1, price + 2000.3).when(kind == 2, F.lit(5.0)).otherwise(price + 2000)
    found = star.table("orders").select("o_orderkey", let(items.recompute_total(lines, F.lit(2000.0), given), lambda t: t).alias("t"))
    return found.select("o_orderkey", F.col("t.value").cast("decimal(18,2)").cast("double").alias("total"), "t.replaced")


def raw_orders(star: StarSchema, orders: DataFrame | None = None) -> DataFrame:
    """Orders, or some of them in the partitions and the order that they have, as raw text records with one defect each by order_id % 16, 0 and 15 meaning none."""
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 16
    price = F.col("o_totalprice").cast("decimal(18,2)")
    put = lambda defects, good: _case(kind, defects, good)
    item = F.concat(F.lit('[{"sku":"A","qty":1,"unit_price":'), price.cast("string"), F.lit(',"total":'), price.cast("string"), F.lit("}]"))
    total = (price + 2000).cast("string")
    columns = {
        "order_id": put({1: "", 2: " "}, F.concat(F.lit("ORD-"), key)),
        "order_date": put({3: "not-a-date", 4: "2020/01/31", 14: "1999-01-01"}, F.lit("2020-01-31T00:00:00")),
        "status": put({5: "قيد  الانتظار"}, F.lit("مؤكد")), "customer_id": put({2: ""}, F.concat(F.lit("CUS-"), F.col("o_custkey"))), "customer_name": F.lit("ليلى"),
        "customer_phone": put({6: "+967 711222333"}, F.lit("711222333")), "customer_email": put({7: "leila@@shop..test", 8: "@@"}, F.lit("leila@shop.test")),
        "city": F.lit("صنعاء"), "district": F.lit("الوسط"), "delivery_type": F.lit("عادي"), "delivery_cost": F.lit("2000.0"), "payment_method": F.lit("نقدًا عند التسليم"),
        "payment_status": F.lit("بانتظار الدفع"), "payment_amount": F.lit("1.0"), "currency": put({9: "ريال"}, F.lit("YER")),
        "total_amount": put({10: F.lit("5"), 11: F.lit("???")}, total),
        "items_json": put({11: "[]", 12: "not-json", 13: '[{"sku":"A","qty":-1,"unit_price":1,"total":1}]'}, item),
    }
    return (star.spread("orders") if orders is None else orders).select(*(v.cast("string").alias(k) for k, v in columns.items()), key.alias("source_row_number"))


def _case(kind: Column, defects: dict, good: Column) -> Column:
    out = good.cast("string")
    for k, value in defects.items():
        out = F.when(kind == k, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


_STATUS = """CASE WHEN k IN (1, 2, 3, 8, 11, 12, 13, 14) THEN 'quarantine' WHEN k IN (4, 5, 6, 7, 9, 10) THEN 'corrected' ELSE 'valid' END"""
_DETAILS = """CASE k WHEN 1 THEN 'MISSING_ORDER_ID' WHEN 2 THEN 'MISSING_ORDER_ID; MISSING_CUSTOMER_ID' WHEN 3 THEN 'INVALID_IMPOSSIBLE_DATE' WHEN 14 THEN 'INVALID_IMPOSSIBLE_DATE' WHEN 8 THEN 'EMAIL_UNFIXABLE'
    WHEN 11 THEN 'EMPTY_ITEMS; UNKNOWN_PRICE' WHEN 12 THEN 'CORRUPTED_ITEMS_JSON' WHEN 13 THEN 'AMBIGUOUS_NEGATIVE_VALUE' ELSE '' END"""
_KINDS = "(SELECT o_orderkey, o_orderkey % 16 AS k FROM orders)"


@register("classify", f"""SELECT o_orderkey AS row_number, {_STATUS} AS quality_status, {_DETAILS} AS error_details,
    CAST(CASE WHEN k IN (4, 5, 6, 7, 8, 9, 10) THEN 1 ELSE 0 END AS BIGINT) AS n_corrections FROM {_KINDS}""")
def _classify(star: StarSchema) -> DataFrame:
    found = classify(raw_orders(star))
    return found.select(F.col("source_row_number").alias("row_number"), "quality_status", "error_details", F.size("corrections").cast("bigint").alias("n_corrections"))


@register("classify_bulk", f"""SELECT o_orderkey AS row_number, {_STATUS.replace("4, 5, 6, 7, 9, 10", "4, 6, 7, 9, 10")} AS quality_status, {_DETAILS} AS error_details FROM {_KINDS}""")
def _classify_bulk(star: StarSchema) -> DataFrame:
    return classify(raw_orders(star), "bulk").select(F.col("source_row_number").alias("row_number"), "quality_status", "error_details")


@register("error_histogram", f"""SELECT CASE WHEN contains(d, ';') THEN 'MULTIPLE_CONFLICTING_ERRORS' ELSE d END AS error_code, CAST(count(*) AS BIGINT) AS n_rows
    FROM (SELECT {_DETAILS} AS d FROM {_KINDS}) WHERE d <> '' GROUP BY 1""")
def _error_histogram(star: StarSchema) -> DataFrame:
    return error_histogram(classify(raw_orders(star)))


@register("status_counts", f"""SELECT CAST(count(*) FILTER (s = 'valid') AS BIGINT) AS count_valid, CAST(count(*) FILTER (s = 'corrected') AS BIGINT) AS count_corrected,
    CAST(count(*) FILTER (s = 'quarantine') AS BIGINT) AS count_quarantine FROM (SELECT {_STATUS} AS s FROM {_KINDS})""")
def _status_counts(star: StarSchema) -> DataFrame:
    return status_counts(classify(raw_orders(star)))


@register("constraint_report", """SELECT CAST(count(*) AS BIGINT) AS n_rows, 0::BIGINT AS missing_order_id, 0::BIGINT AS missing_customer_id, 0::BIGINT AS missing_total_amount,
    CAST(count(*) FILTER (l_orderkey % 3 = 0) AS BIGINT) AS missing_currency, CAST(count(*) - count(DISTINCT l_orderkey) AS BIGINT) AS repeated_order_id FROM lineitem""")
def _constraints(star: StarSchema) -> DataFrame:
    from ledgermill.plans.layout import constraint_report

    rows = star.table("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("customer_id"), F.col("l_extendedprice").alias("total_amount"), F.when(F.col("l_orderkey") % 3 != 0, "YER").alias("currency"))
    return constraint_report(rows)
