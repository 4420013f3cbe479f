"""File layouts in the place of indexes.

A layout is a copy of the orders, range-partitioned and sorted by the columns that a group of queries
filters and sorts on, so that a scan skips row groups by their minima and maxima; keys of equality
get Parquet bloom filters. A layout is written once and found by its columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    columns: tuple[str, ...]
    bloom: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return "by_" + "_".join(self.columns)


LAYOUTS = (
    Layout(("city", "order_date")),
    Layout(("status", "order_date")),
    Layout(("customer_id",), ("customer_id",)),
    Layout(("city", "status", "order_date")),
    Layout(("customer_id", "order_date"), ("customer_id",)),
    Layout(("total_amount",)),
    Layout(("order_date",)),
    Layout(("order_id",), ("order_id",)),
)


def write_layout(orders: DataFrame, root: str, layout: Layout) -> str:
    """Writes a layout below root unless it is there; its path."""
    path = f"{root.rstrip('/')}/{layout.name}"
    if not _exists(orders.sparkSession, f"{path}/_SUCCESS"):
        # the key parts rows that agree in all columns of the layout, which would meet in one task
        dealt = [*layout.columns, *(["order_id"] if "order_id" in orders.columns and "order_id" not in layout.columns else [])]
        writer = orders.repartitionByRange(*dealt).sortWithinPartitions(*layout.columns).write.mode("overwrite")
        for column in layout.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(path)
    return path


def find_layout(spark: SparkSession, root: str, columns: tuple[str, ...]) -> str | None:
    """The path of a layout below root, if it is there."""
    path = f"{root.rstrip('/')}/{Layout(columns).name}"
    return path if _exists(spark, f"{path}/_SUCCESS") else None


def ensure_layouts(orders: DataFrame, root: str, layouts: tuple[Layout, ...] = LAYOUTS) -> list[dict]:
    """Name, path and whether it was written now of each layout; a second call writes nothing."""
    out = []
    for layout in layouts:
        there = _exists(orders.sparkSession, f"{root.rstrip('/')}/{layout.name}/_SUCCESS")
        out.append({"name": layout.name, "columns": list(layout.columns), "path": write_layout(orders, root, layout), "created": not there})
    return out


def _exists(spark: SparkSession, location: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))


def constraint_report(orders: DataFrame) -> DataFrame:
    """One row of counts of rows that break the rules of validated orders; nothing is blocked."""
    required = ("order_id", "customer_id", "total_amount", "currency")
    missing = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in required]
    return orders.agg(F.count(F.lit(1)).alias("n_rows"), *missing, (F.count("order_id") - F.count_distinct("order_id")).alias("repeated_order_id"))
