"""Tables of a store: tables of runs, and keyed tables as versioned snapshots in buckets.

A version of a keyed table is a numbered manifest that names the folder of each bucket of keys. Any number of
writers may work at once: each writes the buckets that it changes below a folder of its own and then makes the
next manifest, which appears whole and only where no other writer has made it. Who comes second looks at
what the first has changed: if none of it is in the buckets that the second has read, these join the new version,
else the second works again on the new version (``Transaction``). Buckets that nobody touches are named again.

A bucket's rows lie in one folder, or in several: rows of new keys are put beside those that are there, and folders of about
one size are made one when there are many (``PARTS``), so a row is written again a few times however many merges follow.

Keys are dealt by extendible hashing: a bucket stands for the low bits of the keys' hashes, and is split in two, again and
again, when it would hold more than ``bucket_rows`` rows, so that buckets keep their size however a table grows.

A table of runs has a folder for each run, so a run that is repeated or resumed replaces its rows. Small documents
are numbered as manifests are, and logs have a file for each entry. All paths go through Hadoop's file systems.
Manifests need a file system that renames or links without replacing: HDFS and local or mounted disks do.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFESTS, _DATA = "_manifests", "data"
#: Buckets of a keyed table when it is made (the next power of two), and rows beyond which a bucket is split: some 100 MB.
BUCKETS, BUCKET_ROWS = 16, 1_000_000
#: Folders of a bucket, of one size within a factor of 8, that are made one.
PARTS = 8
#: Files that a task of a write by columns keeps open before it sorts the rest; 0 sorts all rows.
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
#: Times that buckets which came out too large are split again in one commit.
_SPLITS = 8
#: Times that a merge starts anew when other writers change its buckets.
TRIES = 20
#: Age at which a folder that no manifest names is taken for one that a writer has left.
GRACE_SECONDS = 86_400.0


class ConflictError(RuntimeError):
    """Other writers changed the same buckets again and again."""


class DuplicateKeyError(ValueError):
    """Rows to be written repeat a key."""


def split(bucket: int, levels: int) -> list[int]:
    """The buckets that a bucket falls apart into. A bucket is a 1 bit before the low bits that it stands for."""
    depth = bucket.bit_length() - 1
    value = bucket - (1 << depth)
    return [(1 << depth + levels) | (i << depth) | value for i in range(1 << levels)]


def parts_of(entry: dict) -> list[dict]:
    """folder and rows of what a bucket holds, oldest first."""
    beside = entry.get("parts", [])
    first = {"folder": entry["folder"], "rows": entry["rows"] - sum(p["rows"] for p in beside)}
    return [first, *beside] if first["folder"] else beside


def folders(entry: dict) -> list[str]:
    return [p["folder"] for p in parts_of(entry)]


def _of_parts(parts: list[dict], **facts) -> dict:
    return {"folder": parts[0]["folder"], "rows": sum(p["rows"] for p in parts), **({"parts": parts[1:]} if parts[1:] else {}), **facts}


def parts_kept(sizes: list[int], n_rows: int) -> int:
    """How many parts stay as they are where n_rows are put beside them; the others, the last, are made one with the rows.

    Those are the last parts of no greater size class, where they and the rows are PARTS in number.
    """
    size_class = lambda n: n.bit_length() // 3
    kept, total = len(sizes), n_rows
    while True:
        first = kept
        while first and size_class(sizes[first - 1]) <= size_class(total):
            first -= 1
        if kept - first < PARTS - 1:
            return kept
        kept, total = first, total + sum(sizes[first:kept])


def bucket_of(key: Column, buckets: Iterable[int]) -> Column:
    """The bucket of a key: its hash's low bits looked up in the directory of the buckets, four bytes a slot; 0 where none of them holds it."""
    buckets = list(buckets)
    deepest = max(b.bit_length() - 1 for b in buckets)
    slots = [0] * (1 << deepest)
    for b in buckets:
        for below in split(b, deepest - (b.bit_length() - 1)):
            slots[below - (1 << deepest)] = b
    slot = F.xxhash64(key).bitwiseAND(F.lit((1 << deepest) - 1).cast("long"))
    # a text folds to one array, however many slots there are
    return F.get(F.from_json(F.lit(json.dumps(slots)), "array<int>"), slot.cast("int"))


def _place_of(bucket: Column, buckets: Iterable[int]) -> Column:
    """The place of a bucket among buckets, by a table with a slot for each number; 0 where it is none of them."""
    places = {b: n for n, b in enumerate(sorted(buckets))}
    slots = [places.get(b, 0) for b in range(max(places) + 1)]
    return F.coalesce(F.get(F.from_json(F.lit(json.dumps(slots)), "array<int>"), bucket), F.lit(0))


class Store:
    """``buckets`` and ``bucket_rows``: of keyed tables. A merge rewrites the buckets that its rows fall into."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.bucket_rows = spark, root.rstrip("/"), bucket_rows
        self.first_buckets = split(1, max(0, buckets - 1).bit_length())

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    # tables of runs

    def put_run(self, table: str, rows: DataFrame, run_id: str) -> None:
        """Makes rows (without run_id) the run's rows in a table, in the place of what the run has written before."""
        fresh = f"{table}/_new/{uuid.uuid4().hex}"
        rows.write.parquet(self.path(fresh))
        self.delete(f"{table}/run_id={run_id}")
        self._rename(fresh, f"{table}/run_id={run_id}")
        self.add_to_log(f"commits/{table}", {"run_id": run_id, "at": time.time()})

    def read(self, table: str, schema: StructType | str | None = None) -> DataFrame:
        """A table of runs; without one, an empty table of the schema."""
        try:
            return self.spark.read.parquet(self.path(table))
        except AnalysisException as missing:
            if schema is None or not any(x in str(missing) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                raise
            return self.spark.createDataFrame([], schema)

    # keyed snapshot tables

    def version(self, table: str) -> int | None:
        return max(self._numbers(f"{table}/{_MANIFESTS}"), default=None)

    def manifest(self, table: str, version: int | None = None) -> dict | None:
        """buckets (rows and folder by bucket, and the parts beside that folder; no folder where it is empty) and applied (by stream the last batch, by source its version) of a version, else of the current one."""
        version = self.version(table) if version is None else version
        return None if version is None else json.loads(self._read_text(f"{table}/{_MANIFESTS}/{version:012d}.json"))

    def transaction(self, table: str) -> Transaction:
        return Transaction(self, table)

    def snapshot(self, table: str, schema: StructType | str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The current or an earlier version of a keyed table, or some of its buckets; without a version, an empty table of the schema."""
        found = (self.manifest(table, version) or {"buckets": {}})["buckets"]
        chosen = None if buckets is None else {str(b) for b in buckets}
        return self.rows_of(table, schema, (f for b, e in found.items() if chosen is None or b in chosen for f in folders(e)))

    def rows_of(self, table: str, schema: StructType | str, folders: Iterable[str]) -> DataFrame:
        paths = [f"{self.path(table)}/{f}" for f in folders if f]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, table: str, rows: DataFrame, key: str) -> list[int]:
        """The buckets that rows fall into: at most as many numbers as the table has buckets."""
        return list(self.transaction(table).touched(rows, key))

    def versions(self, table: str) -> list[int]:
        return sorted(self._numbers(f"{table}/{_MANIFESTS}"))

    def changed_rows(self, table: str, schema: StructType | str, since: int, until: int) -> tuple[DataFrame, DataFrame]:
        """The rows of the folders that version ``since`` has and ``until`` has not, and those that ``until`` has instead."""
        old, new = ({f for e in (self.manifest(table, v) or {"buckets": {}})["buckets"].values() for f in folders(e)} if v else set() for v in (since, until))
        return self.rows_of(table, schema, sorted(old - new)), self.rows_of(table, schema, sorted(new - old))

    def changes(self, table: str, schema: StructType | str, since: int, key: str, version: str, until: int | None = None) -> DataFrame:
        """What a table's versions after ``since`` (0: none) have changed: structs ``old`` and ``new`` of each key whose ``version`` (a hash)
        differs, one of them null where there is no row. Only folders that differ are read."""
        found = self.changed_rows(table, schema, since, self.version(table) if until is None else until)
        old, new = (rows.select(F.struct("*").alias(name)) for rows, name in zip(found, ("old", "new")))
        joined = old.join(new, F.col(f"old.{key}").eqNullSafe(F.col(f"new.{key}")), "full")
        return joined.where(~F.col(f"old.{version}").eqNullSafe(F.col(f"new.{version}")) | F.col("old").isNull() | F.col("new").isNull())

    def replace(self, table: str, rows: DataFrame, key: str | None = None) -> DataFrame:
        """Makes rows the next version, in buckets of the key where one is given, whatever other writers do; rows may read the current one."""
        self.transaction(table).replace(rows, key, whatever=True)
        return self.snapshot(table, rows.schema)

    def merge(self, table: str, changed: DataFrame, key: str, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """The next version, with the buckets that changed falls into made anew by combine(their rows, changed); again if others change them meanwhile."""
        for _ in range(TRIES):
            if self.transaction(table).merge(changed, key, combine):
                return self.snapshot(table, changed.schema)
        raise ConflictError(table)

    def vacuum(self, table: str, keep: int = 2, since: int | None = None, grace: float = GRACE_SECONDS) -> int:
        """Deletes all but the last versions of a keyed table, and what only they name; how many folders went.

        Versions from ``since`` on stay as well. Folders that no manifest names go after ``grace`` seconds.
        """
        numbers = sorted(self._numbers(f"{table}/{_MANIFESTS}"))
        named = {n: {f for e in self.manifest(table, n)["buckets"].values() for f in folders(e)} for n in numbers}
        old = [n for n in numbers[:-keep] if since is None or n < since]
        kept = set().union(*(named[n] for n in numbers if n not in old))
        for n in old:
            self.delete(f"{table}/{_MANIFESTS}/{n:012d}.json")
        gone = set().union(*(named[n] for n in old)) - kept
        for folder in gone:
            self.delete(f"{table}/{folder}")
        writers = {f.split("/")[1] for f in kept}
        for writer, age in self._ages(f"{table}/{_DATA}"):
            if writer not in writers and (age > grace or any(f.split("/")[1] == writer for f in gone)):
                self.delete(f"{table}/{_DATA}/{writer}")
        return len(gone)

    @contextmanager
    def unsorted(self) -> Iterator[None]:
        """Writes by a column, of which each task has one value, go straight to the file: Spark would sort all rows of a task by it first, in memory."""
        conf, before = self.spark.conf, self.spark.conf.get(_OPEN_FILES)
        conf.set(_OPEN_FILES, "1")
        try:
            yield
        finally:
            conf.set(_OPEN_FILES, before)

    # small documents

    def load_json(self, name: str, default):
        """The last state of a document, or default where there is none; a broken one raises."""
        number = max(self._numbers(name), default=None)
        return default if number is None else json.loads(self._read_text(f"{name}/{number:012d}.json"))

    def save_json(self, name: str, value) -> None:
        """The next state of a document; the one before stays beside it."""
        text = json.dumps(value, ensure_ascii=False, indent=1, default=str)
        while not self._put(name, max(self._numbers(name), default=0) + 1, text):
            pass
        for n in sorted(self._numbers(name))[:-2]:
            self.delete(f"{name}/{n:012d}.json")

    def add_to_log(self, name: str, entry: dict) -> None:
        self._write_new(f"{name}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json", json.dumps(entry, ensure_ascii=False, default=str))

    def log(self, name: str, last: int | None = None) -> list[dict]:
        """The entries of a log in order, or the last ones."""
        names = sorted(n for n in self._names(name) if n.endswith(".json"))
        return [json.loads(self._read_text(f"{name}/{n}")) for n in (names if last is None else names[len(names) - min(last, len(names)) :])]

    # files

    def exists(self, name: str) -> bool:
        files, path = self._file(name)
        return bool(files.exists(path))

    def delete(self, name: str) -> None:
        files, path = self._file(name)
        files.delete(path, True)

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _rename(self, name: str, to: str) -> None:
        files, path = self._file(name)
        if not files.rename(path, self._file(to)[1]):
            raise FileExistsError(to)

    def _listed(self, folder: str) -> list:
        files, path = self._file(folder)
        return list(files.listStatus(path)) if files.exists(path) else []

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._listed(folder)]

    def _ages(self, folder: str) -> list[tuple[str, float]]:
        return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in self._listed(folder)]

    def _numbers(self, folder: str) -> list[int]:
        return [int(n[:-5]) for n in self._names(folder) if re.fullmatch(r"\d+\.json", n)]

    def _put(self, folder: str, number: int, text: str) -> bool:
        return self._write_new(f"{folder}/{number:012d}.json", text)

    def _read_text(self, name: str) -> str:
        files, path = self._file(name)
        stream = files.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write_new(self, name: str, text: str) -> bool:
        """Writes a file that appears whole, in one step and only where there is none; whether it did."""
        files, path = self._file(name)
        _, part = self._file(f"{name}.{uuid.uuid4().hex}.part")
        stream = files.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if files.getUri().getScheme() != "file":
                return bool(files.rename(part, path))  # refuses a name that is there
            os.link(part.toUri().getPath(), path.toUri().getPath())  # a rename would replace it on local disks
            return True
        except FileExistsError:
            return False
        finally:
            files.delete(part, False)


class Transaction:
    """Work on a version of a keyed table. Whatever is read through it, and all that it writes, belongs to that version.

    ``merge``, ``replace``, ``put`` and ``mark`` make the next version and tell whether they could: not where another writer has
    changed buckets that the transaction touches since it began. Then all is as it was, and the work starts with a new one.
    """

    def __init__(self, store: Store, table: str):
        self.store, self.table = store, table
        self.number = store.version(table) or 0
        found = store.manifest(table, self.number) if self.number else {"buckets": {}, "applied": {}}
        self.buckets: dict[int, dict] = {int(b): e for b, e in found["buckets"].items()}
        self.applied: dict[str, int] = found["applied"]

    def bucket(self, key: str) -> Column:
        return bucket_of(F.col(key), self.buckets or self.store.first_buckets)

    def touched(self, rows: DataFrame, key: str) -> dict[int, int]:
        """Rows by the buckets that they fall into."""
        return {r["bucket"]: r["n"] for r in rows.groupBy(self.bucket(key).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()}

    def rows(self, schema: StructType | str, buckets: Iterable[int] | None = None) -> DataFrame:
        chosen = self.buckets if buckets is None else [b for b in buckets if b in self.buckets]
        return self.store.rows_of(self.table, schema, (f for b in chosen for f in folders(self.buckets[b])))

    def merge(self, changed: DataFrame, key: str, combine: Callable[[DataFrame, DataFrame], DataFrame], applied: dict[str, int] | None = None, unique: bool = True) -> bool:
        """The buckets that changed falls into made anew by combine(their rows, changed), and split where they grow too large."""
        incoming = self.touched(changed, key)
        old = self.rows(changed.schema, incoming)
        fresh = changed.join(old.select(F.col(key).alias("old_key")), F.col(key) == F.col("old_key"), "left_anti") if self.buckets else changed
        return self._merge(changed, key, combine, incoming, self.touched(fresh, key) if self.buckets else incoming, False, applied, unique)

    def upsert(self, changed: DataFrame, key: str, combine: Callable[[DataFrame, DataFrame], DataFrame], incoming: dict[int, int], fresh: dict[int, int], applied: dict[str, int] | None = None) -> bool:
        """As ``merge``, where combine leaves rows of other keys as they are, and the rows of changed by bucket are known, and those of them whose keys
        the table has not: a bucket that gets such rows alone is not made anew; they are put beside its rows."""
        return self._merge(changed, key, combine, incoming, fresh, True, applied, True)

    def _merge(self, changed: DataFrame, key: str, combine: Callable[[DataFrame, DataFrame], DataFrame], incoming: dict[int, int], fresh: dict[int, int], beside: bool, applied: dict[str, int] | None, unique: bool) -> bool:
        below, aside = [], {}
        for b, n in incoming.items():
            there = parts_of(self.buckets[b]) if b in self.buckets else []
            rows, levels = sum(p["rows"] for p in there) + fresh.get(b, 0), 0
            if beside and there and n == fresh.get(b) and rows <= self.store.bucket_rows:
                aside[b] = there[: parts_kept([p["rows"] for p in there], n)]
                continue
            while rows > self.store.bucket_rows << levels:
                levels += 1
            below += split(b, levels)
        whole = [b for b in incoming if b not in aside]
        made = combine(self.rows(changed.schema, whole), self._within(changed, key, whole) if aside else changed) if whole else None
        if aside:
            again = [f for b, kept in aside.items() for f in folders(self.buckets[b])[len(kept) :]]
            added = self._within(changed, key, aside) if whole else changed
            added = added.unionByName(self.store.rows_of(self.table, changed.schema, again)) if again else added
            made = made.unionByName(added) if whole else added
        rest = [b for b in (self.buckets or self.store.first_buckets) if b not in incoming]
        facts = {b: {} for b in ([*below, *aside] if self.buckets else [*rest, *below])}
        return self.put(set(incoming), made, bucket_of(F.col(key), [*rest, *below, *aside]), facts, key if unique else None, applied, by=key, aside=aside)

    def _within(self, rows: DataFrame, key: str, buckets: Iterable[int]) -> DataFrame:
        return rows.where(self.bucket(key).isin(*buckets))

    def replace(self, rows: DataFrame, key: str | None = None, whatever: bool = False, applied: dict[str, int] | None = None, unique: bool = True) -> bool:
        """rows in the place of all buckets; with ``whatever``, changes of others since the transaction began are lost."""
        buckets = (list(self.buckets) or self.store.first_buckets) if key else [1]
        return self.put(set(self.buckets), rows, bucket_of(F.col(key), buckets) if key else F.lit(1), {b: {} for b in buckets}, key if unique else None, applied, whatever)

    def mark(self, applied: dict[str, int]) -> bool:
        """The same rows, and what of another table or stream has been applied."""
        return self._commit(set(), {}, applied, False)

    def put(self, gone: set[int], rows: DataFrame, bucket: Column, facts: dict[int, dict], key: str | None = None, applied: dict[str, int] | None = None, whatever: bool = False, by: str | None = None, aside: dict[int, list[dict]] | None = None) -> bool:
        """rows in the buckets of ``facts`` (what the manifest says of each besides), in the place of the buckets gone. Raises where a key is repeated.

        Buckets dealt ``by`` a column that came out too large are split, where that parts their rows. ``aside``: parts of buckets
        that the rows are put beside.
        """
        entries = self._write(rows, bucket, facts, key)
        for _ in range(_SPLITS if by else 0):
            large = {b: e for b, e in entries.items() if e["rows"] > self.store.bucket_rows}
            if not large:
                break
            below = {c: {} for b in large for c in split(b, 1)}
            again = self.store.rows_of(self.table, rows.schema, (e["folder"] for e in large.values()))
            entries = {b: e for b, e in entries.items() if b not in large} | self._write(again, bucket_of(F.col(by), below), below, None)
        entries |= {b: _of_parts([*parts, {"folder": entries[b]["folder"], "rows": entries[b]["rows"]}]) for b, parts in (aside or {}).items()}
        return self._commit(gone, entries, applied or {}, whatever)

    def _write(self, rows: DataFrame, bucket: Column, facts: dict[int, dict], key: str | None) -> dict[int, dict]:
        folder = f"{_DATA}/{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", bucket)
        # one task writes a bucket, and a task one bucket: one file for each, however many tasks have made the rows
        dealt = dealt.repartitionById(len(facts), _place_of(F.col("bucket"), facts)) if len(facts) > 1 else dealt
        with self.store.unsorted():
            dealt.write.partitionBy("bucket").parquet(self.store.path(f"{self.table}/{folder}"))
        counts = self._counts(folder, dealt.schema, key)
        return {b: {"folder": f"{folder}/bucket={b}" if b in counts else "", "rows": counts.get(b, 0), **more} for b, more in facts.items()}

    def _counts(self, folder: str, schema: StructType, key: str | None) -> dict[int, int]:
        """Rows by bucket as they were written."""
        path = self.store.path(f"{self.table}/{folder}")
        if not any(n.startswith("bucket=") for n in self.store._names(f"{self.table}/{folder}")):
            return {}
        found = self.store.spark.read.schema(schema).parquet(path)
        if key:
            found = found.groupBy("bucket", key).agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
        else:
            found = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("most"))
        counts = found.collect()  # a row for each bucket
        if any(r["most"] > 1 for r in counts):
            self.store.delete(f"{self.table}/{folder}")
            raise DuplicateKeyError(f"{self.table}: {sum(r['most'] > 1 for r in counts)} buckets repeat a value of {key}")
        return {r["bucket"]: r["n"] for r in counts}

    def _commit(self, gone: set[int], entries: dict[int, dict], applied: dict[str, int], whatever: bool) -> bool:
        folder = f"{self.table}/{_MANIFESTS}"
        while True:
            now = self.store.transaction(self.table)
            mine = gone | (set(entries) - set(self.buckets))
            if whatever:
                rest = {}
            elif any(now.buckets.get(b) != self.buckets.get(b) for b in mine) or any(now.applied.get(s) != self.applied.get(s) for s in applied) or (not self.buckets and now.buckets):
                return False
            else:
                rest = {b: e for b, e in now.buckets.items() if b not in gone}
            text = json.dumps({"buckets": rest | entries, "applied": now.applied | applied})
            if self.store._put(folder, now.number + 1, text):
                return True
