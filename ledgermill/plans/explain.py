"""What a plan does: its scans, the filters that reach them, its exchanges, and measured rows."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ledgermill.plans.catalog import PARAMETER_QUERIES, named
from ledgermill.plans.layout import LAYOUTS, write_layout


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def summarise(df: DataFrame) -> dict:
    """Nodes of the plan, kind of scan, pushed and partition filters, columns read."""
    text = plan_text(df)
    nodes = re.findall(r"^\(\d+\) ([A-Za-z][\w ]*?)(?: \[|$| )", text, re.M)
    pushed = re.findall(r"PushedFilters: \[(.*?)\]$", text, re.M)
    partition = re.findall(r"PartitionFilters: \[(.*?)\]$", text, re.M)
    read = re.findall(r"ReadSchema: struct<(.*?)>$", text, re.M)
    kind = "partition scan" if any(partition) else "filtered scan" if any(pushed) else "full scan"
    return {"plan_stages": nodes, "scan_type": kind, "pushed_filters": pushed, "partition_filters": partition, "read_schema": read, "exchanges": sum("Exchange" in n for n in nodes), "top_k": "TakeOrderedAndProject" in text}


def measure(df: DataFrame) -> dict:
    """summarise() with seconds, rows returned, and what the scans of one run have read: rows, files, bytes.

    Rows examined are those of the row groups that the scans did not skip, before any filter on rows.
    """
    run = df._jdf.queryExecution()
    began = time.time()
    rows = int(run.toRdd().count())
    seconds = time.time() - began
    scans = list(_scans(run.executedPlan()))
    read = {name: sum(s[metric] for s in scans) for name, metric in (("rows_examined", "numOutputRows"), ("files_examined", "numFiles"), ("bytes_examined", "filesSize"))}
    return summarise(df) | {"execution_time_ms": round(seconds * 1000), "n_returned": rows} | read


def _scans(plan) -> Iterator[dict[str, int]]:
    """Metrics of the file scans of a plan that has run; a stage that is used again counts once."""
    kind = plan.getClass().getSimpleName()
    if kind == "FileSourceScanExec":
        metrics = plan.metrics()
        yield {m: int(metrics.apply(m).value()) for m in ("numOutputRows", "numFiles", "filesSize")}
    elif kind == "AdaptiveSparkPlanExec":
        yield from _scans(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _scans(plan.plan())
    else:
        children = plan.children()
        for i in range(children.size()):
            yield from _scans(children.apply(i))


def compare(before: DataFrame, after: DataFrame) -> dict:
    """The same query over two layouts."""
    return {"before": measure(before), "after": measure(after)}


#: Layout columns that serve a named query.
SERVED_BY = {
    "sales_by_city": ("city", "order_date"),
    "delivered_by_date": ("status", "order_date"),
    "pending_card_orders": ("city", "order_date"),
    "orders_by_city_status": ("city", "status", "order_date"),
    "customer_orders": ("customer_id",),
    "high_value_orders": ("total_amount",),
    "sales_by_period": ("order_date",),
    "orders_by_status": ("status", "order_date"),
}


def benchmark(orders: DataFrame, root: str, queries: dict[str, dict]) -> list[dict]:
    """name, before and after of parameter queries (with their parameters): over orders, and over a layout written below root."""
    out = []
    for name, params in queries.items():
        query = named(PARAMETER_QUERIES, name)
        path = write_layout(orders, root, next(x for x in LAYOUTS if x.columns == SERVED_BY[name]))
        out.append({"name": name, **compare(query.build(orders, params), query.build(orders.sparkSession.read.parquet(path), params))})
    return out
