"""Summary views of orders: by day and by product, rebuilt in full or for the groups that changed.

An incremental refresh takes the old and the new image of the changed orders, so a day or product
that an order left is refreshed as well, recomputes all affected groups with one semi-join and one
aggregation per view, and drops groups that became empty. The ledger variant keeps each order's
contribution and applies signed differences instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.operators.merge import replace_groups
from ledgermill.plans.catalog import order_items, total

DAILY_SCHEMA = "day string, orders bigint, sales double"
PRODUCT_SCHEMA = "sku string, product string, quantity double, sales double"
PARTS_SCHEMA = "sku string, name string, lines bigint, quantity double, sales double"
LEDGER_SCHEMA = "order_id string, record_hash string, day string, sales double, products array<struct<sku:string,name:string,quantity:double,sales:double>>"


def day_of(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def daily_sales(orders: DataFrame) -> DataFrame:
    """day, orders, sales of the dated orders."""
    dated = orders.where("order_date IS NOT NULL")
    return dated.groupBy(day_of(F.col("order_date")).alias("day")).agg(F.count(F.lit(1)).alias("orders"), total("total_amount").alias("sales"))


def product_sales(items: DataFrame) -> DataFrame:
    """sku, product, quantity, sales of the items with a sku; of several names of a sku the least is shown."""
    known = items.where(F.col("sku").isNotNull() & (F.col("sku").cast("string") != ""))
    return known.groupBy("sku").agg(F.min("name").alias("product"), total("qty").alias("quantity"), total("total").alias("sales"))


def affected_days(*images: DataFrame) -> DataFrame:
    return _union([i.where("order_date IS NOT NULL").select(day_of(F.col("order_date")).alias("day")) for i in images]).distinct()


def affected_products(*images: DataFrame) -> DataFrame:
    """Distinct skus of the items of the images (item rows)."""
    return _union([i.where("sku IS NOT NULL AND sku <> ''").select("sku") for i in images]).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def refresh_daily(view: DataFrame, orders: DataFrame, days: DataFrame) -> DataFrame:
    """view with the given days recomputed from orders."""
    fresh = daily_sales(orders.where("order_date IS NOT NULL").join(days.withColumnRenamed("day", "affected"), day_of(F.col("order_date")) == F.col("affected"), "left_semi"))
    return replace_groups(view, fresh, days, ["day"])


def refresh_products(view: DataFrame, items: DataFrame, skus: DataFrame) -> DataFrame:
    """view with the given skus recomputed from items."""
    return replace_groups(view, product_sales(items.join(skus, "sku", "left_semi")), skus, ["sku"])


def top_products(view: DataFrame, limit: int = 20) -> DataFrame:
    return view.orderBy(F.col("sales").desc(), "sku").limit(limit)


def contributions(orders: DataFrame) -> DataFrame:
    """The ledger rows of orders (with record_hash): day and sales null where the date is invalid."""
    valid = F.col("order_date").isNotNull()
    named = F.filter(F.coalesce("items", F.array()), lambda i: i["sku"].isNotNull() & (i["sku"] != ""))
    lines = F.transform(named, lambda i: F.struct(i["sku"].alias("sku"), i["name"].alias("name"), F.coalesce(i["qty"], F.lit(0.0)).alias("quantity"), F.coalesce(i["total"], F.lit(0.0)).alias("sales")))
    return orders.select(
        "order_id",
        "record_hash",
        F.when(valid, day_of(F.col("order_date"))).alias("day"),
        F.when(valid, F.coalesce("total_amount", F.lit(0.0))).alias("sales"),
        F.when(valid, lines).alias("products"),
    )


def signed(old: DataFrame, new: DataFrame) -> DataFrame:
    """sign, day, sales, products and mark: contributions that go and that come. Those of an order that is the same on both sides cancel out, as their marks do."""
    fields = ("day", "sales", "products", F.xxhash64("order_id", "record_hash").cast("decimal(20,0)").alias("mark"))
    return old.select(F.lit(-1).alias("sign"), *fields).unionByName(new.select(F.lit(1).alias("sign"), *fields))


def _amount(column: Column) -> Column:
    return F.sum(column.cast("decimal(18,2)")).cast("double")


def day_deltas(rows: DataFrame) -> DataFrame:
    """day, orders and sales that signed contributions add, of days with an order that came, went or changed."""
    sums = rows.where("day IS NOT NULL").groupBy("day").agg(F.sum("sign").alias("orders"), _amount(F.col("sign") * F.col("sales")).alias("sales"), _marks())
    return _moved(sums)


_MARKS = "marks"


def _marks() -> Column:
    return F.sum(F.col("sign") * F.col("mark")).alias(_MARKS)


def _moved(sums: DataFrame) -> DataFrame:
    return sums.where(F.col(_MARKS) != 0).drop(_MARKS)


def add_days(view: DataFrame, delta: DataFrame) -> DataFrame:
    """day, orders and sales of both; days without orders go."""
    columns = ("day", "orders", "sales")
    both = view.select(*columns).unionByName(delta.select(*columns))
    return both.groupBy("day").agg(F.sum("orders").alias("orders"), _amount(F.col("sales")).alias("sales")).where("orders > 0")


def product_parts(items: DataFrame) -> DataFrame:
    """lines, quantity and sales of items by sku and name."""
    known = items.where(F.col("sku").isNotNull() & (F.col("sku") != ""))
    return known.groupBy("sku", "name").agg(F.count(F.lit(1)).alias("lines"), total("qty").alias("quantity"), total("total").alias("sales"))


def part_deltas(rows: DataFrame) -> DataFrame:
    """lines, quantity and sales by sku and name that signed contributions add."""
    lines = rows.select("sign", "mark", F.explode("products").alias("p"))
    sums = (_amount(F.col("sign") * F.col(f"p.{c}")).alias(c) for c in ("quantity", "sales"))
    return _moved(lines.groupBy(F.col("p.sku").alias("sku"), F.col("p.name").alias("name")).agg(F.sum("sign").alias("lines"), *sums, _marks()))


def add_parts(parts: DataFrame, delta: DataFrame) -> DataFrame:
    """Parts of both; those without lines go."""
    both = parts.unionByName(delta).groupBy("sku", "name").agg(F.sum("lines").alias("lines"), *(_amount(F.col(c)).alias(c) for c in ("quantity", "sales")))
    return both.where("lines > 0")


def products_of(parts: DataFrame) -> DataFrame:
    """sku, product (its least name), quantity and sales."""
    return parts.groupBy("sku").agg(F.min("name").alias("product"), total("quantity").alias("quantity"), total("sales").alias("sales"))


def changed_pairs(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows (with order_id and record_hash) of orders that differ by hash, as structs old and new, null where there is none."""
    sides = [rows.select(F.struct("*").alias(name)) for rows, name in ((old, "old"), (new, "new"))]
    joined = sides[0].join(sides[1], F.col("old.order_id") == F.col("new.order_id"), "full")
    return joined.where(F.col("old").isNull() | F.col("new").isNull() | ~F.col("old.record_hash").eqNullSafe(F.col("new.record_hash")))


def change_counts(pairs: DataFrame) -> DataFrame:
    """One row: inserted, updated, removed, and those of them whose date is invalid."""
    was, now = F.col("old").isNotNull(), F.col("new").isNotNull()
    return pairs.agg(F.count_if(now & ~was).alias("inserted"), F.count_if(now & was).alias("updated"), F.count_if(~now).alias("removed"), F.count_if(now & F.col("new.day").isNull()).alias("skipped_invalid"))


@dataclass(frozen=True)
class LedgerRefresh:
    daily: DataFrame
    products: DataFrame
    ledger: DataFrame
    counts: DataFrame


def ledger_pairs(new: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of new beside those of the ledger for the same order, as n.* and o.*; ``here`` is null on the side that has none."""
    n, o = new.withColumn("here", F.lit(True)).alias("n"), ledger.withColumn("here", F.lit(True)).alias("o")
    return n.join(o, F.col("n.order_id") == F.col("o.order_id"), "full")


def ledger_refresh(daily: DataFrame, products: DataFrame, ledger: DataFrame, orders: DataFrame) -> LedgerRefresh:
    """Views and ledger after the orders that changed by hash: old contributions out, new ones in.

    Orders that left the source are taken out too. Sums are kept to two decimals; days without
    orders and products without quantity are purged. ``counts`` has one row: processed, inserted,
    updated, unchanged, removed, skipped_invalid.
    """
    new = contributions(orders)
    joined = ledger_pairs(new, ledger)
    is_new, was_old = F.col("n.here").isNotNull(), F.col("o.here").isNotNull()
    same = is_new & was_old & F.col("n.record_hash").eqNullSafe(F.col("o.record_hash"))
    changed = joined.where(~same)
    fields = ("day", "sales", "products")
    signed = changed.where(is_new).select(F.lit(1).alias("sign"), *(F.col(f"n.{f}") for f in fields)).unionByName(changed.where(was_old).select(F.lit(-1).alias("sign"), *(F.col(f"o.{f}") for f in fields)))
    money = lambda c: F.round(F.sum(c.cast("decimal(18,2)")).cast("double"), 2)

    by_day = signed.where("day IS NOT NULL").select("day", F.col("sign").cast("bigint").alias("orders"), (F.col("sign") * F.col("sales")).alias("sales"))
    daily_sum = daily.select("day", "orders", "sales").unionByName(by_day).groupBy("day").agg(F.sum("orders").alias("orders"), money(F.col("sales")).alias("sales"))
    lines = signed.select("sign", F.explode("products").alias("p"))
    by_sku = lines.select(F.col("p.sku").alias("sku"), (F.col("sign") * F.col("p.quantity")).alias("quantity"), (F.col("sign") * F.col("p.sales")).alias("sales"))
    # sums forget what is taken out, a least name does not: names of the skus that changed are taken from the new ledger
    named = new.select(F.explode("products").alias("p")).select("p.sku", "p.name").join(by_sku.select("sku").distinct(), "sku", "left_semi")
    names = named.groupBy("sku").agg(F.min("name").alias("new_name"), F.lit(True).alias("changed"))
    sums = products.select("sku", "product", "quantity", "sales").unionByName(by_sku, allowMissingColumns=True).groupBy("sku").agg(F.min("product").alias("product"), money(F.col("quantity")).alias("quantity"), money(F.col("sales")).alias("sales"))
    product_sum = sums.join(names, "sku", "left").select("sku", F.when(F.col("changed"), F.col("new_name")).otherwise(F.col("product")).alias("product"), "quantity", "sales")
    counts = joined.agg(
        F.count_if(is_new).alias("processed"),
        F.count_if(is_new & ~was_old).alias("inserted"),
        F.count_if(is_new & was_old & ~same).alias("updated"),
        F.count_if(same).alias("unchanged"),
        F.count_if(~is_new).alias("removed"),
        F.count_if(is_new & F.col("n.day").isNull()).alias("skipped_invalid"),
    )
    return LedgerRefresh(daily_sum.where("orders > 0"), product_sum.where("quantity > 0"), new, counts)
