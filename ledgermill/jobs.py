"""Jobs of the day with a log of their runs."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import datetime, timezone

from ledgermill.ingest import validated
from ledgermill.plans.catalog import REPORTS_V2
from ledgermill.refresh import incremental_refresh, ledger_refresh
from ledgermill.store import Store

JOB_LOG, REPORTS = "job_runs", "daily_reports"
_busy = threading.Lock()


def _view(name: str) -> Callable[[Store], dict]:
    def job(store: Store) -> dict:
        """Refreshes one view by what has changed since it was refreshed; one that was never built, in full."""
        return incremental_refresh(store, (name,))

    return job


def daily_reports(store: Store) -> dict:
    """Writes each report as a JSON table of its own, below a folder of the run; rows by report."""
    orders, folder = validated(store), f"{REPORTS}/{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
    counts = {}
    for name, report in REPORTS_V2.items():
        path = store.path(f"{folder}/{name}")
        report.build(orders).write.mode("overwrite").json(path)
        counts[name] = store.spark.read.text(path).count()
    return {"folder": folder, "rows": counts}


#: Job: (hour and minute of the day, UTC; what it does).
JOBS: dict[str, tuple[tuple[int, int], Callable[[Store], dict]]] = {
    "refresh_daily_sales": ((0, 10), _view("daily")),
    "refresh_top_products": ((0, 20), _view("products")),
    "refresh_materialized_views": ((1, 0), ledger_refresh),
    "daily_reports": ((2, 0), daily_reports),
}


def run_job(store: Store, name: str, day: str | None = None) -> dict:
    """Runs a job and logs it; skipped while another runs. A failure is logged and raised."""
    if name not in JOBS:
        raise KeyError(f"unknown job {name!r}: {', '.join(JOBS)}")
    if not _busy.acquire(blocking=False):
        return {"job_name": name, "status": "skipped"}
    entry = {"job_name": name, "started_at": datetime.now(timezone.utc).isoformat(), "status": "running"} | ({"day": day} if day else {})
    try:
        entry["result"] = JOBS[name][1](store)
        entry["status"] = "success"
    except Exception as error:
        entry |= {"status": "failed", "error": str(error)[:500]}
        raise
    finally:
        entry["finished_at"] = datetime.now(timezone.utc).isoformat()
        store.add_to_log(JOB_LOG, entry)
        _busy.release()
    return entry


def recent_runs(store: Store, limit: int = 20) -> list[dict]:
    return store.log(JOB_LOG, limit)[::-1]


def run_due(store: Store, now: datetime) -> list[str]:
    """Runs the jobs whose hour has come and that the log does not show for the day; their names.

    To be called by an outside scheduler, as often as it likes. An error of a job is in the log and does not stop the others.
    """
    day = now.date().isoformat()
    done = {r["job_name"] for r in store.log(JOB_LOG, 10 * len(JOBS)) if r.get("day") == day}
    ran = []
    for name, ((hour, minute), _) in JOBS.items():
        if (now.hour, now.minute) >= (hour, minute) and name not in done:
            ran.append(name)
            try:
                run_job(store, name, day)
            except Exception:  # noqa: BLE001 - logged by run_job
                continue
    return ran
