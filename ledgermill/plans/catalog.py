"""The named queries and reports over validated orders.

``query`` holds fixed row queries, ``pquery`` row queries with parameters, ``agg`` reports and
``agg_v2`` their variants. All are plain DataFrame plans: filters reach the scan, sort and limit fuse
into one top-k, and the key breaks ties so that a limited result is the same in every run. Sums of no
rows are 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowQuery:
    description: str
    where: Callable[[dict], Column]
    order: tuple[Callable[[], Column], ...]
    limit: int
    defaults: dict = field(default_factory=dict)

    def build(self, orders: DataFrame, params: dict | None = None, limit: int | None = None) -> DataFrame:
        given = {k: v for k, v in (params or {}).items() if v is not None}
        unknown = set(given) - set(self.defaults)
        if unknown:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        size = self.limit if limit is None else limit
        if size < 1:
            raise ValueError("limit must be positive")
        return orders.where(self.where(self.defaults | given)).orderBy(*(o() for o in self.order), "order_id").limit(size)


def parse_moment(value: str | datetime | None, name: str = "date") -> datetime:
    """A naive UTC moment of an ISO text; Z and offsets are converted, a text without one is UTC."""
    if value is None or value == "":
        raise ValueError(f"{name} is required")
    moment = value if isinstance(value, datetime) else datetime.fromisoformat(value.replace("Z", "+00:00"))
    return moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


def _moment(value, name: str) -> Column:
    return F.lit(parse_moment(value, name).isoformat(sep=" ")).cast("timestamp_ntz")


def _c(name: str) -> Column:
    return F.col(name)


_newest = (lambda: _c("order_date").desc_nulls_last(),)
_oldest = (lambda: _c("order_date").asc_nulls_first(),)
_largest = (lambda: _c("total_amount").desc_nulls_last(),)
_CITY, _DELIVERED = "صنعاء", "تم التسليم"

QUERIES: dict[str, RowQuery] = {
    "sales_by_city": RowQuery("Orders of a city, newest first", lambda p: _c("city") == p["city"], _newest, 20, {"city": _CITY}),
    "delivered_by_date": RowQuery(
        "Orders of a status in a half-open period, newest first",
        lambda p: (_c("status") == p["status"]) & (_c("order_date") >= _moment(p["start"], "start")) & (_c("order_date") < _moment(p["end"], "end")),
        _newest, 20, {"status": _DELIVERED, "start": "2025-01-01", "end": "2026-01-01"},
    ),
    "customer_orders": RowQuery("Orders of a customer, newest first", lambda p: _c("customer_id") == p["customer_id"], _newest, 20, {"customer_id": "CUS-1"}),
    "high_value_orders": RowQuery("Orders from an amount up, largest first", lambda p: _c("total_amount") >= float(p["min_total"]), _largest, 20, {"min_total": 100000}),
    "pending_card_orders": RowQuery(
        "Orders of a payment status and method in a city, newest first",
        lambda p: (_c("payment_status") == p["payment_status"]) & (_c("payment_method") == p["payment_method"]) & (_c("city") == p["city"]),
        _newest, 20, {"payment_status": "بانتظار الدفع", "payment_method": "بطاقة", "city": _CITY},
    ),
}

PARAMETER_QUERIES: dict[str, RowQuery] = {
    "orders_by_city_status": RowQuery("Orders of a city and status", lambda p: (_c("city") == p["city"]) & (_c("status") == p["status"]), _newest, 20, {"city": _CITY, "status": _DELIVERED}),
    "customer_orders": RowQuery("Orders of a customer", lambda p: _c("customer_id") == p["customer_id"], _newest, 20, {"customer_id": ""}),
    "high_value_orders": RowQuery("Orders from an amount up", lambda p: _c("total_amount") >= float(p["min_total"]), _largest, 20, {"min_total": 100000}),
    "sales_by_period": RowQuery(
        "Orders of a closed period, oldest first; both bounds are required",
        lambda p: _c("order_date").between(_moment(p["start"], "start"), _moment(p["end"], "end")),
        _oldest, 100, {"start": None, "end": None},
    ),
    "orders_by_status": RowQuery("Orders of a status", lambda p: _c("status") == p["status"], _newest, 50, {"status": _DELIVERED}),
}


def total(column: str) -> Column:
    """The sum of a column of amounts with two decimals, exact whatever the order of rows; 0 of no rows."""
    return F.coalesce(F.sum(F.col(column).cast("decimal(18,2)")).cast("double"), F.lit(0.0))


def order_items(orders: DataFrame) -> DataFrame:
    """A row for each item: order_id, order_date, sku, name, qty, total. Orders without items have none."""
    return orders.select("order_id", "order_date", F.explode("items").alias("item")).select("order_id", "order_date", "item.sku", "item.name", "item.qty", "item.total")


def _grouped(orders: DataFrame, *keys: str) -> DataFrame:
    return orders.groupBy(*keys).agg(F.count(F.lit(1)).alias("orders"), total("total_amount").alias("sales"))


def _products(items: DataFrame, name: str) -> DataFrame:
    return items.groupBy("sku", F.col("name").alias(name)).agg(total("qty").alias("quantity"), total("total").alias("sales"))


@dataclass(frozen=True)
class Report:
    description: str
    plan: Callable[[DataFrame], DataFrame]
    order: tuple[Callable[[], Column], ...]
    limit: int | None = None
    of_items: bool = False

    def build(self, orders: DataFrame, items: DataFrame | None = None) -> DataFrame:
        """The report over orders; ``items`` saves the explosion where the lines are a table of their own."""
        source = (order_items(orders) if items is None else items) if self.of_items else orders
        rows = self.plan(source).orderBy(*(o() for o in self.order))
        return rows if self.limit is None else rows.limit(self.limit)


def _by(first: str, *then: str) -> tuple[Callable[[], Column], ...]:
    return (lambda: _c(first).desc(), *(lambda t=t: _c(t).asc_nulls_first() for t in then))


def _by_period(orders: DataFrame) -> DataFrame:
    dated = orders.where(F.col("order_date").isNotNull())
    return _grouped(dated.withColumn("period", F.date_format("order_date", "yyyy-MM")), "period")


_period = (lambda: _c("period").asc(),)

REPORTS: dict[str, Report] = {
    "sales_by_city": Report("Orders and sales by city", lambda o: _grouped(o, "city"), _by("sales", "city"), 100),
    "top_products": Report("Products by sales", lambda i: _products(i, "product"), _by("sales", "sku", "product"), 100, of_items=True),
    "top_customers": Report("Customers by sales", lambda o: _grouped(o, "customer_id"), _by("sales", "customer_id"), 100),
    "sales_by_period": Report("Orders and sales by month", _by_period, _period),
    "orders_by_status": Report("Orders and sales by status", lambda o: _grouped(o, "status"), _by("orders", "status")),
}
REPORTS_V2: dict[str, Report] = {
    "sales_by_city": Report("Orders and sales by city", lambda o: _grouped(o, "city"), _by("sales", "city")),
    "top_products": Report("Twenty products by sales", lambda i: _products(i, "name"), _by("sales", "sku", "name"), 20, of_items=True),
    "top_customers": Report("Twenty customers by sales", lambda o: _grouped(o, "customer_id"), _by("sales", "customer_id"), 20),
    "sales_by_period": Report("Orders and sales by month", _by_period, _period),
    "orders_by_status": Report("Orders and sales by status", lambda o: _grouped(o, "status"), _by("orders", "status")),
}


def named(registry: dict, name: str):
    if name not in registry:
        raise KeyError(f"unknown name {name!r}: {', '.join(registry)}")
    return registry[name]
