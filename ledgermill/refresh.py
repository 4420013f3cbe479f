"""Refreshing the stored summary views.

The manifest of a view names the version of the orders that it shows. An incremental refresh reads what the orders'
versions since then have changed - the buckets that were written, however many loads of whatever stage wrote them -
and adds the signed contributions of the old and new images. It reads no other order, and commits only if the view
still shows the version that it began with, so two refreshes at once do not count a change twice.

Products are kept by sku and name first (``PARTS``): sums forget what is taken out, a least name does not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.ingest import VALIDATED_SCHEMA, VALIDATED_TABLE
from ledgermill.operators import views
from ledgermill.operators.merge import replace_groups
from ledgermill.plans.catalog import order_items
from ledgermill.store import TRIES, ConflictError, Store, bucket_of, folders

DAILY, PRODUCTS, PARTS, LEDGER, STATE = "daily_sales_summary", "top_products_summary", "product_parts", "mv_source_ledger", "mv_refresh_state"
MODES = ("full", "incremental")
VIEWS = ("daily", "products")
#: What a table has applied: the version of the orders, and of the parts.
_ORDERS, _PARTS_SEEN = "orders", "parts"
_DAILY_SCHEMA, _PRODUCT_SCHEMA = f"{views.DAILY_SCHEMA}, updated_at timestamp", f"{views.PRODUCT_SCHEMA}, updated_at timestamp"


def _stamped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("updated_at", F.lit(datetime.now(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp"))


def daily_view(store: Store) -> DataFrame:
    return store.snapshot(DAILY, _DAILY_SCHEMA)


def product_view(store: Store) -> DataFrame:
    return store.snapshot(PRODUCTS, _PRODUCT_SCHEMA)


class _Work:
    """Tables of a refresh that are read several times, deleted when it is over."""

    def __init__(self, store: Store):
        self.store, self.folder = store, f"work/refresh-{uuid.uuid4().hex}"

    def __enter__(self) -> Callable[[DataFrame], DataFrame]:
        return self.staged

    def __exit__(self, *_) -> None:
        self.store.delete(self.folder)

    def staged(self, rows: DataFrame) -> DataFrame:
        path = self.store.path(f"{self.folder}/{uuid.uuid4().hex}")
        rows.write.parquet(path)
        return self.store.spark.read.schema(rows.schema).parquet(path)


def full_refresh(store: Store, which: tuple[str, ...] = VIEWS) -> dict:
    """Rebuilds the views from all validated orders."""
    result = {"mode": "full_initial_refresh"}
    version = store.version(VALIDATED_TABLE) or 0
    orders = store.snapshot(VALIDATED_TABLE, VALIDATED_SCHEMA, version or None)
    if "daily" in which:
        store.transaction(DAILY).replace(_stamped(views.daily_sales(orders)), "day", whatever=True, applied={_ORDERS: version})
        result["daily_rows"] = daily_view(store).count()
    if "products" in which:
        store.transaction(PARTS).replace(views.product_parts(order_items(orders)), "sku", whatever=True, applied={_ORDERS: version}, unique=False)
        _show_products(store)
        result["product_rows"] = product_view(store).count()
    _clean_up(store)
    return result


def incremental_refresh(store: Store, which: tuple[str, ...] = VIEWS) -> dict:
    """Adds what has changed since each view was last refreshed; a view that was never built is built in full."""
    result = {"mode": "incremental"}
    for name in which:
        result[{"daily": "daily_rows", "products": "product_rows"}[name]] = _again(lambda name=name: _catch_up(store, name), name)
    _clean_up(store)
    return result if any(result.get(k) for k in ("daily_rows", "product_rows")) else result | {"message": "no changed orders"}


def _again(attempt: Callable[[], int | None], name: str):
    """What attempt gives, when it is not None: other writers came first then."""
    for _ in range(TRIES):
        if (found := attempt()) is not None:
            return found
    raise ConflictError(name)


def _catch_up(store: Store, name: str) -> int | None:
    """Days or products that were changed; None if another refresh came first."""
    turn, version = store.transaction(DAILY if name == "daily" else PARTS), store.version(VALIDATED_TABLE) or 0
    if turn.applied.get(_ORDERS, -1) not in {0, *store.versions(VALIDATED_TABLE)}:  # never built, or so long ago that its version is gone
        built = full_refresh(store, (name,))
        return built["daily_rows" if name == "daily" else "product_rows"]
    since = turn.applied[_ORDERS]
    with _Work(store) as staged:
        n_rows = 0
        if since != version:
            # orders that are the same in both versions cancel out in the sums, so no order is joined with its old image
            signed = views.signed(*map(views.contributions, store.changed_rows(VALIDATED_TABLE, VALIDATED_SCHEMA, since, version)))
            if (n_rows := _apply(turn, name, signed, {_ORDERS: version}, staged)) is None:
                return None
        if name == "products":
            _again(lambda: _show_products(store), PRODUCTS)
    return n_rows


def _apply(turn, name: str, signed: DataFrame, applied: dict[str, int], staged: Callable[[DataFrame], DataFrame], anew: bool = False) -> int | None:
    """Adds signed contributions to the days or parts; days or products that they touch, None after a conflict."""
    daily = name == "daily"
    delta = staged(_stamped(views.day_deltas(signed)) if daily else views.part_deltas(signed))
    n_rows = delta.select("day" if daily else "sku").distinct().count()
    key, add = ("day", lambda rows, d: _stamped(views.add_days(rows, d))) if daily else ("sku", views.add_parts)
    if anew:
        done = turn.replace(add(delta.where("false"), delta), key, applied=applied, unique=daily)
    else:
        done = turn.merge(delta, key, add, applied, unique=daily) if n_rows else turn.mark(applied)
    return n_rows if done else None


def _show_products(store: Store) -> bool | None:
    """Brings the product view to the version of its parts: the products of the buckets that have changed."""
    turn, version = store.transaction(PRODUCTS), store.version(PARTS)
    since = turn.applied.get(_PARTS_SEEN)
    if since == version:
        return True
    if since is None or since not in store.versions(PARTS):
        return turn.replace(_stamped(views.products_of(store.snapshot(PARTS, views.PARTS_SCHEMA, version))), "sku", applied={_PARTS_SEEN: version}) or None
    old, new = store.changed_rows(PARTS, views.PARTS_SCHEMA, since, version)
    with _Work(store) as staged:
        skus = old.select("sku").unionByName(new.select("sku")).distinct()
        changed = staged(_stamped(skus.join(views.products_of(new), "sku", "left")).select("sku", "product", "quantity", "sales", "updated_at"))
        if changed.isEmpty():
            return turn.mark({_PARTS_SEEN: version}) or None
        there = lambda rows, fresh: replace_groups(rows, fresh.where("quantity IS NOT NULL"), fresh, ["sku"])
        return turn.merge(changed, "sku", there, {_PARTS_SEEN: version}) or None


def _clean_up(store: Store) -> None:
    """Versions that neither readers nor the next refresh need."""
    seen = {t: store.transaction(t).applied for t in (DAILY, PARTS, PRODUCTS)}
    for table in (DAILY, PRODUCTS, LEDGER):
        if store.version(table) is not None:
            store.vacuum(table)
    if _PARTS_SEEN in seen[PRODUCTS]:
        store.vacuum(PARTS, since=seen[PRODUCTS][_PARTS_SEEN])
    needed = [a[_ORDERS] for a in seen.values() if _ORDERS in a]
    if needed:
        store.vacuum(VALIDATED_TABLE, since=min(needed))


def refresh(store: Store, mode: str = "incremental", which: tuple[str, ...] = VIEWS) -> dict:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: {', '.join(MODES)}")
    return full_refresh(store, which) if mode == "full" else incremental_refresh(store, which)


def ledger_refresh(store: Store) -> dict:
    """Applies the changed orders' contributions to the views by signed sums, and keeps each order's contribution.

    The ledger has the buckets of the orders, and notes the folders that each of them speaks for: only buckets whose
    orders were written since are read and written. It speaks for the views while they show the same version; else it starts anew.
    """
    return _again(lambda: _ledger_turn(store), LEDGER)


def _ledger_turn(store: Store) -> dict | None:
    ledger, daily, parts, orders = (store.transaction(t) for t in (LEDGER, DAILY, PARTS, VALIDATED_TABLE))
    at = [t.applied.get(_ORDERS) for t in (ledger, daily, parts)]
    anew = at[0] is None or at != [at[0]] * 3
    here = {" ".join(folders(e)): b for b, e in orders.buckets.items() if e["folder"]}
    spoken = {} if anew else {e["source"]: b for b, e in ledger.buckets.items()}
    fresh, stale = {b: f for f, b in here.items() if f not in spoken}, set(ledger.buckets) if anew else {b for f, b in spoken.items() if f not in here}
    counts = dict.fromkeys(("inserted", "updated", "removed", "skipped_invalid"), 0)
    applied = {_ORDERS: orders.number}
    with _Work(store) as staged:
        if fresh or stale or anew:
            new = views.contributions(orders.rows(VALIDATED_SCHEMA, fresh))
            old = ledger.rows(views.LEDGER_SCHEMA, () if anew else stale)
            # only keys, hashes and days meet; in the sums orders that stay the same cancel out
            counts = views.change_counts(views.changed_pairs(*(side.select("order_id", "record_hash", "day") for side in (new, old)))).first().asDict()
            signed = views.signed(old, new)
            for name, turn in (("daily", daily), ("products", parts)):
                if _apply(turn, name, signed, applied, staged, anew) is None:
                    return None
            _again(lambda: _show_products(store), PRODUCTS)
            dealt = bucket_of(F.col("order_id"), orders.buckets) if orders.buckets else F.lit(1)
            if not ledger.put(stale, new, dealt, {b: {"source": f} for b, f in fresh.items()}, "order_id", applied):
                return None
    processed = sum(e["rows"] for e in orders.buckets.values())
    counts = {"processed": processed, **counts, "unchanged": processed - counts["inserted"] - counts["updated"]}
    store.save_json(STATE, {"last_refresh_at": datetime.now(timezone.utc).isoformat(), "last_result": counts})
    _clean_up(store)
    return counts


def top_products(store: Store, limit: int = 20) -> DataFrame:
    return views.top_products(product_view(store), limit)
