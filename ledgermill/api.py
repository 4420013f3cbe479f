"""The engine behind one object: ingest, queries, reports, views, layouts, explain, jobs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ledgermill import jobs, refresh
from ledgermill.ingest import RUNS, VALIDATED_SCHEMA, VALIDATED_TABLE, quarantined, validated
from ledgermill.operators.merge import of_keys
from ledgermill.plans import catalog, explain, layout
from ledgermill.store import BUCKET_ROWS, BUCKETS, Store
from ledgermill.streaming import incremental

_REGISTRIES = {"query": catalog.QUERIES, "pquery": catalog.PARAMETER_QUERIES}
_REPORTS = {"agg": catalog.REPORTS, "agg_v2": catalog.REPORTS_V2}


class Engine:
    """Unknown names raise KeyError; wrong parameters, modes and stages raise ValueError."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.store = spark, Store(spark, root, buckets, bucket_rows)

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version, "orders_version": self.store.version(VALIDATED_TABLE)}

    def ingest(self, path: str, stage: str = "normal", **options) -> dict:
        return incremental.load(self.spark, self.store, path, stage, **options)

    def runs(self) -> list[dict]:
        return self.store.log(RUNS)

    def orders(self) -> DataFrame:
        return validated(self.store)

    def find(self, keys: DataFrame) -> DataFrame:
        """The validated records of keys (order_id), from the buckets that the keys fall into."""
        touched = self.store.touched(VALIDATED_TABLE, keys, "order_id")
        return of_keys(self.store.snapshot(VALIDATED_TABLE, VALIDATED_SCHEMA, buckets=touched), keys, "order_id")

    def quarantine(self) -> DataFrame:
        return quarantined(self.store)

    def names(self) -> dict[str, list[str]]:
        return {k: list(v) for k, v in (_REGISTRIES | _REPORTS).items()} | {"jobs": list(jobs.JOBS)}

    def query_frame(self, name: str, params: dict | None = None, limit: int | None = None, kind: str = "query") -> DataFrame:
        """The query over the layout of its columns, where the current orders have it, else over the orders."""
        chosen = catalog.named(catalog.named(_REGISTRIES, kind), name)
        path = layout.find_layout(self.spark, self._layouts(), explain.SERVED_BY[name])
        return chosen.build(self.orders() if path is None else self.spark.read.schema(VALIDATED_SCHEMA).parquet(path), params, limit)

    def query(self, name: str, params: dict | None = None, limit: int | None = None, kind: str = "query", with_plan: bool = False) -> dict:
        """name, description, count_returned and results of a row query: its limit bounds them."""
        frame = self.query_frame(name, params, limit, kind)
        rows = [_plain(r.asDict(recursive=True)) for r in frame.collect()]
        found = {"name": name, "description": _REGISTRIES[kind][name].description, "count_returned": len(rows), "results": rows}
        return found | ({"explain": explain.summarise(frame)} if with_plan else {})

    def aggregate_frame(self, name: str, kind: str = "agg") -> DataFrame:
        return catalog.named(catalog.named(_REPORTS, kind), name).build(self.orders())

    def aggregate(self, name: str, kind: str = "agg") -> dict:
        """name, description, count and results of a report. One that has no limit has a row for each of its groups: read ``aggregate_frame`` where they may be many."""
        rows = [_plain(r.asDict(recursive=True)) for r in self.aggregate_frame(name, kind).toLocalIterator()]
        return {"name": name, "description": _REPORTS[kind][name].description, "count": len(rows), "results": rows}

    def indexes(self) -> list[dict]:
        """Writes the layouts of the current orders that are missing, and deletes those of versions before the last."""
        made = layout.ensure_layouts(self.orders(), self._layouts())
        for old in sorted(self.store._names("layouts"), key=lambda n: int(n.removeprefix("v=")))[:-2]:
            self.store.delete(f"layouts/{old}")
        return made

    def _layouts(self) -> str:
        return self.store.path(f"layouts/v={self.store.version(VALIDATED_TABLE)}")

    def explain(self, name: str, params: dict | None = None, limit: int | None = None, kind: str = "query", columns: tuple[str, ...] = ("city", "order_date")) -> dict:
        """The plan and measured run of a query over the plain table and over a layout."""
        chosen = catalog.named(catalog.named(_REGISTRIES, kind), name)
        path = layout.write_layout(self.orders(), self._layouts(), layout.Layout(columns))
        return explain.compare(chosen.build(self.orders(), params, limit), chosen.build(self.spark.read.parquet(path), params, limit))

    def benchmark(self, queries: dict[str, dict]) -> list[dict]:
        """Plans and measured runs of parameter queries over the orders and over the layouts that serve them."""
        return explain.benchmark(self.orders(), self._layouts(), queries)

    def refresh_views(self, mode: str = "incremental") -> dict:
        """Refreshes both views; incrementally by all that has changed since they were refreshed. Before any refresh and any delta there is nothing to do."""
        if mode == "incremental" and self.store.load_json(incremental.LAST_DELTA, None) is None and self.store.version(refresh.DAILY) is None:
            return {"mode": mode, "message": "no changed orders", "daily_rows": 0, "product_rows": 0}
        return refresh.refresh(self.store, mode)

    def refresh_ledger(self) -> dict:
        return refresh.ledger_refresh(self.store)

    def top_products(self, limit: int = 20) -> list[dict]:
        return [_plain(r.asDict()) for r in refresh.top_products(self.store, limit).collect()]

    def run_job(self, name: str) -> dict:
        return jobs.run_job(self.store, name)

    def run_due_jobs(self) -> list[str]:
        return jobs.run_due(self.store, datetime.now(timezone.utc))

    def job_runs(self, limit: int = 20) -> list[dict]:
        return jobs.recent_runs(self.store, limit)

    def constraints(self) -> dict:
        return layout.constraint_report(self.orders()).first().asDict()


def _plain(value):
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value.isoformat() if isinstance(value, datetime) else value
