"""Command line: python -m ledgermill.cli STORE COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from ledgermill.api import Engine
from ledgermill.operators.sample import sample_rows
from ledgermill.session import build_session
from ledgermill.sources.orders_csv import read_orders
from ledgermill.verify import verify


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ledgermill")
    top.add_argument("store", help="root folder of the store")
    commands = top.add_subparsers(dest="command", required=True)
    load = commands.add_parser("ingest", help="load a CSV file")
    load.add_argument("--input", required=True)
    load.add_argument("--stage", choices=("normal", "initial", "delta"), default="normal")
    load.add_argument("--profile", choices=("row", "bulk"), default="row")
    load.add_argument("--threshold-mb", type=float, default=100.0)
    for command, kinds in (("query", ("query", "pquery")), ("aggregation", ("agg", "agg_v2"))):
        run = commands.add_parser(command)
        run.add_argument("name")
        run.add_argument("--kind", choices=kinds, default=kinds[0])
        if command == "query":
            run.add_argument("--param", action="append", default=[], metavar="NAME=VALUE")
            run.add_argument("--limit", type=int)
            run.add_argument("--explain", action="store_true")
    commands.add_parser("indexes", help="write missing layouts")
    plan = commands.add_parser("explain", help="compare a query over the table and over a layout")
    plan.add_argument("name")
    bench = commands.add_parser("benchmark-indexes", help="time parameter queries over the table and over their layouts")
    bench.add_argument("--query", action="append", required=True, metavar="NAME[,PARAM=VALUE...]")
    refresh = commands.add_parser("refresh-mv")
    refresh.add_argument("--mode", choices=("full", "incremental", "ledger"), default="incremental")
    job = commands.add_parser("job")
    job.add_argument("name")
    commands.add_parser("due-jobs", help="run the jobs of the day that are due")
    products = commands.add_parser("top-products")
    products.add_argument("--limit", type=int, default=20)
    commands.add_parser("runs")
    commands.add_parser("verify")
    sample = commands.add_parser("sample", help="write a sample of a CSV file")
    sample.add_argument("--input", required=True)
    sample.add_argument("--output", required=True)
    sample.add_argument("--rows", type=int, default=1000)
    sample.add_argument("--seed", type=int, default=42)
    return top


def run(engine: Engine, given: argparse.Namespace):
    """The result of a command, ready for JSON."""
    match given.command:
        case "ingest":
            return engine.ingest(given.input, given.stage, profile=given.profile, threshold_mb=given.threshold_mb)
        case "query":
            return engine.query(given.name, dict(p.split("=", 1) for p in given.param), given.limit, given.kind, given.explain)
        case "aggregation":
            return engine.aggregate(given.name, given.kind)
        case "indexes":
            return engine.indexes()
        case "explain":
            return engine.explain(given.name)
        case "benchmark-indexes":
            return engine.benchmark({name: dict(p.split("=", 1) for p in params) for name, *params in (q.split(",") for q in given.query)})
        case "refresh-mv":
            return engine.refresh_ledger() if given.mode == "ledger" else engine.refresh_views(given.mode)
        case "job":
            return engine.run_job(given.name)
        case "due-jobs":
            return engine.run_due_jobs()
        case "top-products":
            return engine.top_products(given.limit)
        case "runs":
            return engine.runs()
        case "verify":
            return dict(verify(engine))
        case "sample":
            rows = read_orders(engine.spark, given.input)
            picked = sample_rows(rows, given.rows, ["source_file", "source_row_number"], given.seed)
            picked.drop("source_file", "source_row_number").coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(given.output)
            return {"rows": given.rows, "output": given.output}


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    try:
        print(json.dumps(run(Engine(build_session(), given.store), given), ensure_ascii=False, indent=1, default=str))
    except (KeyError, ValueError, FileNotFoundError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
