"""N-gram Jaccard join: exact links of documents whose sets of word shingles are similar.

Two documents link when 100 * |intersection| >= percent * |union| of their sets of distinct shingles
(five words; a shorter text is one shingle). Jaccard distance is a metric, so pivots and the
triangle inequality can split the documents into regions. In a corpus, though, nearly all documents
share nothing with each other and lie at distance 1 from every pivot, where no triangle inequality
separates them. The join therefore works on three levels:

1. Pivots of one shingle. Every shingle is a pivot, and a document visits the regions of its rarest
   ones: of n shingles the first n - ceil(percent * n / 100) + 1 by (documents, hash), the boundary
   within which partners must share a region. A shingle of one document is a region of its own, so
   a document with that many of those has no partner and leaves. In a region two documents can link
   only if what stands behind the shingle in both is long enough for their lengths, so a visitor
   leaves a region that has no such partner for it: pages of one template that is too small a part of
   them never meet. Documents that meet in regions form islands, and links never leave an island.
2. Pivots that are documents. An island beyond LEAF_KEYS is split in rounds by joins with a few of
   its documents: each document goes to the region of the nearest pivot (Voronoi), is a guest where
   the triangle inequality leaves room for a partner, and stays behind when all that could concern
   it is linked. Groups that do not get small in ROUNDS rounds meet in blocks, pair by pair.
3. ``metric_links`` does the same inside a task.

Texts of one set are one node, so copies never multiply. Shingles move as packed arrays, a row for
a task's share of a key range, and a key range holds about RANGE_KEYS keys at every input size. With
more than COARSE ranges the arrays go through coarse ranges first, so that a row is never dealt to
more than COARSE parts and holds many keys however many ranges there are. Shingles of very many
documents are counted first and dealt by document, so that no task holds all documents of one.

Shingles are 64-bit hashes (48 bits when they are compared), and a node is a 128-bit hash of its set.
A chunk names its nodes by their places, so docs must be a table that reads the same each time.

Defined results: a text without words (null, empty, white space) has an empty set and links with
nothing; a null doc_id never becomes a component_id unless all rows of the component have none;
rows that share a doc_id are linked by their own texts alone, each row with its result; an empty
table gives an empty result; other columns are ignored by ``jaccard_components`` and kept by
``drop_near_copies``. The latter keeps exactly one row of each component: the first by doc_id, nulls
last, then by the digest of id and text; of rows that repeat both, any one stays. Rows without words
all stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.exact_dedup import with_group
from ledgermill.llm.graph import connected_components
from ledgermill.llm.key_filter import build_filter, may_match, without_keys
from ledgermill.llm.metric_links import Group
from ledgermill.llm.shared import WORD, packed, partitions_of, scratch, shared_dir, ship, stage, text_or_empty, unpacked
from ledgermill.llm.text_arrays import mix, windows, words_of

PERCENT, SIZE = 75, 5
RANGE_KEYS, LEAF_KEYS, FLUSH_KEYS = 1_000_000, 1_500_000, 1_000_000
#: Parts that a row of packed keys is dealt to at once.
COARSE = 1024
#: Nodes of a chunk, so that a place in it fits two bytes.
CHUNK_NODES = 60_000
ROUNDS, ROUND_PIVOTS, SALTS = 8, 4, 64
#: A shingle is common from this many nodes on, and from one node in COMMON_SHARE on.
COMMON_LEAST, COMMON_SHARE = 1000, 2000
#: Nodes from which a region is crowded, and length classes up to the double length.
REGION_ROWS, LENGTH_STEPS = 5000, 32
#: Share of the nodes that a task holds at once from which it counts a shingle towards the common ones.
NOMINATED_SHARE = 0.001

_SALTS = np.array([0x9E6C63D0876A9A35, 0xC2B2AE3D27D4EB4F, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03], dtype=np.uint64)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Place and sorted distinct shingle hashes of each text."""
    for block in words_of(column, lower=True):
        hashes = block.hashes()
        for i in range(len(block.bounds) - 1):
            yield block.first + i, np.unique(windows(hashes[block.bounds[i] : block.bounds[i + 1]], size))


_NO_KEYS = np.zeros(0, dtype=np.uint64)


def _node(keys: np.ndarray) -> bytes:
    """128 bits of a set: two sums of independent hashes of its keys and of their number."""
    n = np.uint64(len(keys))
    sums = np.array([mix(mix(keys ^ _SALTS[i]) + _SALTS[i + 2]).sum(dtype=np.uint64) for i in (0, 1)], dtype=np.uint64)
    return mix(sums ^ mix(n + _SALTS[2:])).tobytes()


def shingle_sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, node, content (a digest of id and text) of every row; rows of one set have one node."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, nodes = np.zeros(batch.num_rows, np.int64), [_node(_NO_KEYS)] * batch.num_rows
            for i, keys in _sets(batch.column(1), size):
                counts[i], nodes[i] = len(keys), _node(keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(nodes, pa.binary()), batch.column(2)], names=["doc_id", "n_shingles", "node", "content"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _content_key().alias("content"))
    return rows.mapInArrow(each, "doc_id bigint, n_shingles bigint, node binary, content binary")


def _content_key(prefix: str = "") -> Column:
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(f"{prefix}doc_id").cast("string"), F.lit("")), text_or_empty(f"{prefix}text"))))


def _one_of_each(docs: DataFrame, sets: DataFrame, n_rows: int) -> DataFrame:
    """The texts of docs without those whose set a row of a smaller doc_id has too."""
    several = sets.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_rows")).where("group_rows > 1")
    found = with_group(sets, stage(several), "node", n_rows)
    gone = found.where("first_id IS NOT NULL AND NOT doc_id <=> first_id").select(F.col("content").alias("gone"))
    return without_keys(docs.select("doc_id", "text"), _content_key(), gone).select("text")


def _held_nodes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[bytes, np.ndarray]]]:
    """Chunks of distinct nodes of a task with their 48-bit keys."""
    held, seen, total = [], set(), 0
    for batch in batches:
        for _, keys in _sets(batch.column(0), size):
            node = _node(keys)
            if len(keys) and node not in seen:
                seen.add(node)
                held.append((node, keys >> np.uint64(16)))
                total += len(keys)
                if total >= FLUSH_KEYS or len(held) == CHUNK_NODES:
                    yield held
                    held, seen, total = [], set(), 0
    if held:
        yield held


def _common_keys(texts: DataFrame, size: int, n_nodes: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of very many nodes, sorted, with their counts.

    At most COMMON_SHARE x (mean keys of a node) keys reach the driver. They only decide how work is
    dealt, so it does not matter that a key which no task nominates is missed.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held_nodes(batches, size):
            keys, counts = np.unique(np.concatenate([k for _, k in held]), return_counts=True)
            many = counts >= max(3, NOMINATED_SHARE * len(held))
            yield pa.RecordBatch.from_arrays([pa.array(keys[many].view(np.int64)), pa.array(counts[many])], names=["key", "n"])

    nominated = texts.select(F.col("text").cast("string")).mapInArrow(each, "key bigint, n bigint")
    common = nominated.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(least, n_nodes // COMMON_SHARE))
    found = common.toArrow()  # 16 bytes a key
    keys, counts = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def _is_in(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys if len(table) else np.zeros(len(keys), dtype=bool)


#: Packed keys: of each run of a chunk its number of keys, then the keys' places in their chunks, the keys, and in how
#: many nodes they are. A negative target is a bucket of chunks, as -1 - bucket; such rows may hold a chunk's nodes.
_PACKED = pa.schema([("target", pa.int32()), *((c, pa.binary()) for c in ("chunks", "runs", "places", "keys", "counts", "nodes", "sizes"))])
_PACKED_DDL = "target int, chunks binary, runs binary, places binary, keys binary, counts binary, nodes binary, sizes binary"


def _six_bytes(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six_bytes(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _heads(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))[: len(values)])


def _packed_rows(target: np.ndarray, chunk: np.ndarray, places: np.ndarray, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[dict]:
    """A row for each target that occurs."""
    order = np.argsort(target, kind="stable")
    target, chunk, places, keys = target[order], chunk[order], places[order], keys[order]
    counts = None if counts is None else counts[order]
    starts = _heads(target)
    for a, b in zip(starts, np.append(starts[1:], len(target))):
        runs = _heads(chunk[a:b])
        row = {"target": int(target[a]), "chunks": chunk[a:b][runs].tobytes(), "runs": np.diff(np.append(runs, b - a)).astype(np.int32).tobytes(), "places": places[a:b].tobytes(), "keys": _six_bytes(keys[a:b])}
        yield row if counts is None else row | {"counts": counts[a:b].tobytes()}


def _joined(table: pa.Table, column: str) -> bytes:
    return b"".join(x for x in table.column(column).to_pylist() if x is not None)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """chunk, place, key and count (or None) of all keys of packed rows."""
    chunk = np.repeat(np.frombuffer(_joined(table, "chunks"), np.int64), np.frombuffer(_joined(table, "runs"), np.int32))
    counts = np.frombuffer(_joined(table, "counts"), np.uint32)
    return chunk, np.frombuffer(_joined(table, "places"), np.uint16), _from_six_bytes(_joined(table, "keys")), counts if len(counts) else None


def _fan(n_parts: int, coarse: int) -> int:
    return -(-n_parts // coarse)


def _bucket_of(chunk: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix(chunk.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)


def _dealt_finely(rows: DataFrame, fan: int, part_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Rows of coarse parts (fan parts each) as rows of parts; part_of(key, chunk). A task gets a share of a coarse part."""
    if fan == 1:
        return rows

    def each(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["deal"])
        if table.column("target")[0].as_py() < 0:
            return table
        chunk, places, keys, counts = _unpacked(table)
        return pa.Table.from_pylist(list(_packed_rows(part_of(keys, chunk), chunk, places, keys, counts)), schema=_PACKED)

    return rows.withColumn("deal", F.pmod(F.xxhash64("chunks"), F.lit(fan)).cast("int")).groupBy("target", "deal").applyInArrow(each, _PACKED_DDL)


def _key_ranges(texts: DataFrame, size: int, n_ranges: int, n_buckets: int, common: np.ndarray, coarse: int) -> DataFrame:
    """The keys of all nodes, packed: a row for a chunk's keys of one range, eight bytes a key.

    A node is named by its chunk and its place there. Negative targets get the chunk's nodes and sizes, and its
    common keys, so that no task holds all nodes of one.
    """
    fan = _fan(n_ranges, coarse)

    def pack(held: list[tuple[bytes, np.ndarray]], number: int) -> pa.RecordBatch:
        sizes = np.array([len(k) for _, k in held], dtype=np.int32)
        chunk = np.array([(TaskContext.get().partitionId() << 32) + number])
        home = -1 - int(_bucket_of(chunk, n_buckets)[0])
        keys = np.concatenate([k for _, k in held])
        places = np.repeat(np.arange(len(held), dtype=np.uint16), sizes)
        target = (keys % np.uint64(n_ranges) // np.uint64(fan)).astype(np.int32)
        target[_is_in(keys, common)] = home
        rows = [{"target": home, "chunks": chunk.tobytes(), "runs": np.zeros(1, np.int32).tobytes(), "nodes": b"".join(n for n, _ in held), "sizes": sizes.tobytes()}]
        rows += _packed_rows(target, np.broadcast_to(chunk, keys.shape), places, keys)
        return pa.RecordBatch.from_pylist(rows, schema=_PACKED)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in enumerate(_held_nodes(batches, size)):
            yield pack(held, number)

    rows = texts.select(F.col("text").cast("string")).mapInArrow(each, _PACKED_DDL)
    return _dealt_finely(rows, fan, lambda keys, chunk: (keys % np.uint64(n_ranges)).astype(np.int32))


def _shared_keys(ranges: DataFrame, n_buckets: int, common: np.ndarray, common_counts: np.ndarray, coarse: int) -> DataFrame:
    """Keys of two or more nodes with their number of nodes, and the nodes, packed by bucket of chunks."""
    fan = _fan(n_buckets, coarse)

    def forward(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        for r in rows:
            if r["keys"] is not None:
                keys = _from_six_bytes(r["keys"])
                r["counts"] = common_counts[np.searchsorted(common, keys)].astype(np.uint32).tobytes()
        return pa.Table.from_pylist(rows, schema=_PACKED)

    def each(table: pa.Table) -> pa.Table:
        if table.column("target")[0].as_py() < 0:
            return forward(table)
        chunk, places, keys, _ = _unpacked(table)
        order = np.argsort(keys)
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        several = np.concatenate((same, [False])) | np.concatenate(([False], same))
        keys, order = keys[several], order[several]
        lengths = np.diff(np.append(_heads(keys), len(keys)))
        counts = np.repeat(lengths, lengths).astype(np.uint32)
        at = np.argsort(order)  # back in the order of the chunks
        order = order[at]
        chunk = chunk[order]
        return pa.Table.from_pylist(list(_packed_rows(_bucket_of(chunk, n_buckets) // fan, chunk, places[order], keys[at], counts[at])), schema=_PACKED)

    found = ranges.groupBy("target").applyInArrow(each, _PACKED_DDL)
    fine = _dealt_finely(found, fan, lambda keys, chunk: _bucket_of(chunk, n_buckets))
    return fine.withColumn("bucket", F.when(F.col("target") < 0, -1 - F.col("target")).otherwise(F.col("target")))


def _survivors(shared: DataFrame, percent: int) -> DataFrame:
    """Of nodes that may have partners: n, keys (sorted, shared ones only), alone (its keys that no other has), regions (those it visits) and their nodes."""
    schema = pa.schema([("node", pa.binary()), ("n", pa.int64()), ("keys", pa.binary()), ("alone", pa.int64()), ("regions", pa.list_(pa.int64())), ("crowds", pa.list_(pa.int64()))])

    def of_chunk(nodes: bytes, sizes: np.ndarray, places: np.ndarray, keys: np.ndarray, counts: np.ndarray, out: list[dict]) -> None:
        order = np.lexsort((keys, counts, places))
        places, keys, counts = places[order], keys[order], counts[order]
        bounds = np.searchsorted(places, np.arange(len(sizes) + 1))
        alone = sizes - np.diff(bounds)
        visits = sizes - (percent * sizes.astype(np.int64) + 99) // 100 + 1 - alone
        for i in np.flatnonzero((np.diff(bounds) > 0) & (visits > 0)):
            own = keys[bounds[i] : bounds[i + 1]]
            out.append({"node": nodes[16 * i : 16 * i + 16], "n": int(sizes[i]), "keys": np.sort(own).tobytes(), "alone": int(alone[i]), "regions": own[: visits[i]].view(np.int64), "crowds": counts[bounds[i] : bounds[i + 1]][: visits[i]].astype(np.int64)})

    def each(table: pa.Table) -> pa.Table:
        heads = {int.from_bytes(r["chunks"], "little"): r for r in table.filter(pc.is_valid(table.column("nodes"))).select(["chunks", "nodes", "sizes"]).to_pylist()}
        chunk, places, keys, counts = _unpacked(table)
        order = np.argsort(chunk, kind="stable")
        chunk, starts = chunk[order], _heads(chunk[order])
        out: list[dict] = []
        for a, b in zip(starts, np.append(starts[1:], len(chunk))):
            at, head = order[a:b], heads[int(chunk[a])]
            of_chunk(head["nodes"], np.frombuffer(head["sizes"], np.int32), places[at], keys[at], counts[at], out)
        return pa.Table.from_pylist(out, schema=schema)

    return shared.groupBy("bucket").applyInArrow(each, "node binary, n bigint, keys binary, alone bigint, regions array<bigint>, crowds array<bigint>")


def _with_partners(visits: DataFrame, n_salts: int) -> DataFrame:
    """node and region of the visits (node, region, n, most) that leave room for a partner."""
    length = F.floor(F.log2("n") * LENGTH_STEPS).cast("int")
    classes = visits.groupBy("region", length.alias("length")).agg(F.min("n").alias("least_n"), F.max("most").alias("most_most"), F.count(F.lit(1)).alias("n_nodes"))
    regions = classes.groupBy("region").agg(F.collect_list(F.struct("length", "least_n", "most_most", "n_nodes")).alias("lengths"))
    on = ["region"]
    if n_salts > 1:  # the visits of a crowded region are dealt to several tasks
        visits = visits.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(n_salts)))
        regions = regions.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_salts - 1).cast("long"))))
        on = ["region", "salt"]
    partner = F.exists("lengths", lambda c: (c["least_n"] <= F.col("most")) & (c["most_most"] >= F.col("n")) & ((c["n_nodes"] > 1) | (c["length"] != length)))
    return visits.join(regions, on).where(partner).select("node", "region")


def _meetings(survivors: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between nodes that share a region with room for a partner.

    In a region, x and y can share no more than what stands from its key on in both, each in its order of
    rarity. So x needs a y with n(y) <= most(x) and n(x) <= most(y), where most is the largest partner that
    its rest allows. Lengths are looked up by class, of which a region has at most LENGTH_STEPS for a doubling.
    """
    visits = survivors.select("node", "n", "alone", F.posexplode(F.arrays_zip("regions", "crowds")).alias("place", "visit"))
    rest = F.col("n") - F.col("alone") - F.col("place")
    most = (F.floor(F.lit(100 + percent) * rest / F.lit(percent)) - F.col("n")).cast("int")
    visits = visits.select("node", F.col("visit.regions").alias("region"), F.col("n").cast("int").alias("n"), most.alias("most"), (F.col("visit.crowds") > REGION_ROWS).alias("crowded"))
    # one shuffle by region serves all that follows; crowded regions are combined before the shuffle and dealt anew
    quiet = _with_partners(visits.where("NOT crowded").drop("crowded").repartition(partitions_of(survivors.sparkSession), "region"), 1)
    crowded = _with_partners(visits.where("crowded").drop("crowded"), SALTS)
    return _stars(quiet).unionByName(_stars(crowded))


def _stars(visits: DataFrame) -> DataFrame:
    first = visits.groupBy("region").agg(F.min("node").alias("first_node"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return visits.join(first, "region").where("node <> first_node").select(F.col("node").alias("a"), F.col("first_node").alias("b"))


def _islands(survivors: DataFrame, percent: int) -> DataFrame:
    """node and island of the nodes that share a region with another."""
    return connected_components(_meetings(survivors, percent)).select("node", F.col("root").alias("island"))


_LINKS = "a bigint, b bigint"


def _leaf_links(groups: DataFrame, percent: int, n_packs: int) -> DataFrame:
    """Star edges of the components inside each group (grp, node, n, keys, guest) that fits a task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def each(table: pa.Table) -> pa.Table:
        grp = np.array(table.column("grp").to_pylist(), dtype=object)
        n, guest = (table.column(c).to_numpy() for c in ("n", "guest"))
        node = table.column("node").combine_chunks()
        raw = table.column("keys").to_pylist()
        ordinal = np.unique(grp, return_inverse=True)[1] if len(grp) else np.zeros(0, np.int64)
        order = np.argsort(ordinal, kind="stable")
        heads = _heads(ordinal[order])
        a, b = [], []
        for lo, hi in zip(heads, np.append(heads[1:], len(order))):
            at = order[lo:hi]
            sets = [np.frombuffer(raw[i], dtype=np.uint64) for i in at]
            group = Group(n[at], np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets]))), percent)
            is_guest = guest[at].astype(bool)
            group.link(np.flatnonzero(~is_guest), np.flatnonzero(is_guest))
            roots = group.roots()
            linked = roots != np.arange(len(at))
            a.append(at[linked])
            b.append(at[roots[linked]])
        return pa.Table.from_arrays([node.take(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())) for x in (a, b)], schema=schema)

    packs = groups.withColumn("pack", F.pmod(F.xxhash64("grp"), F.lit(n_packs)).cast("int"))
    return packs.groupBy("pack").applyInArrow(each, _LINKS)


def _round(groups: DataFrame, percent: int, number: int) -> tuple[DataFrame, DataFrame]:
    """One split of large groups by document pivots: links found, and the groups that are left."""
    spark = groups.sparkSession
    reach = 1 - percent / 100
    homes = groups.where("NOT guest")
    picks = [F.min_by(F.struct("node", "n", "keys"), F.xxhash64("node", F.lit(number * ROUND_PIVOTS + j))).alias(f"p{j}") for j in range(ROUND_PIVOTS)]
    pivots = homes.groupBy("grp").agg(*picks).select("grp", F.array(*(f"p{j}" for j in range(ROUND_PIVOTS))).alias("pivots"))
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = groups.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(pivots, ["grp", "salt"])
    fields = ("grp", "node", "n", "keys", "guest", "linked_to", "distance")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                own = np.frombuffer(r["keys"], dtype=np.uint64)
                known: dict[int, tuple[float, bool]] = {}
                for p in r["pivots"]:
                    if p["node"] not in known:
                        inter = len(np.intersect1d(own, np.frombuffer(p["keys"], dtype=np.uint64), assume_unique=True))
                        union = r["n"] + p["n"] - inter
                        known[p["node"]] = (1 - inter / union, 100 * inter >= percent * union)
                table = sorted(known.items())
                for p, (_, linked) in table:
                    if linked and p != r["node"]:
                        out.append({"node": r["node"], "linked_to": p})
                if r["node"] in known:
                    continue  # a pivot has met all
                least = min(d for _, (d, _) in table)
                home = next(i for i, (_, (d, _)) in enumerate(table) if d == least)
                for i, (p, (d, linked)) in enumerate(table):
                    if (i == home and not r["guest"]) or (d <= least + 2 * reach + 1e-9 and (r["guest"] or i < home)):
                        out.append({"grp": f"{r['grp']}/{p}", "node": r["node"], "n": r["n"], "keys": r["keys"], "guest": bool(r["guest"] or i != home), "distance": d, "linked_to": p if linked else None})
            yield pa.RecordBatch.from_pylist([{f: x.get(f) for f in fields} for x in out], schema=pa.schema([("grp", pa.string()), ("node", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("guest", pa.bool_()), ("linked_to", pa.int64()), ("distance", pa.float64())]))

    dealt = stage(met.mapInArrow(each, "grp string, node bigint, n bigint, keys binary, guest boolean, linked_to bigint, distance double"))
    links = dealt.where("grp IS NULL").select(F.col("node").alias("a"), F.col("linked_to").alias("b"))
    placed = dealt.where("grp IS NOT NULL")
    # of a region, sets linked to its pivot matter only as partners of sets that are not
    loose = placed.where("linked_to IS NULL").groupBy("grp").agg(F.min("distance").alias("from_distance"))
    left = placed.join(loose, "grp").where(f"linked_to IS NULL OR distance >= from_distance - {reach} - 1e-9")
    with_home = left.where("NOT guest").select("grp").distinct()
    return links, stage(left.join(with_home, "grp", "left_semi").select("grp", "node", "n", "keys", "guest"))


def _blocks(groups: DataFrame, sizes: DataFrame, leaf_keys: int) -> DataFrame:
    """Large groups as pairs of blocks, each within a leaf."""
    n_blocks = F.ceil(F.col("group_keys") * 3 / F.lit(leaf_keys))
    rows = groups.join(sizes, "grp").withColumn("n_blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("node"), "n_blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    pair = F.concat_ws("/", "grp", F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
    return rows.select(F.concat(pair, F.lit("#")).alias("grp"), "node", "n", "keys", F.lit(False).alias("guest"))


def _links(survivors: DataFrame, percent: int, leaf_keys: int) -> DataFrame:
    groups = stage(survivors.join(_islands(survivors, percent), "node").select(F.col("island").cast("string").alias("grp"), "node", "n", "keys", F.lit(False).alias("guest")))
    packs = partitions_of(groups.sparkSession)
    found: DataFrame | None = None
    add = lambda links: links if found is None else found.unionByName(links)
    for number in range(ROUNDS + 1):
        sizes = stage(groups.groupBy("grp").agg(F.sum(F.length("keys") / 8).cast("long").alias("group_keys")))
        large = sizes.where(F.col("group_keys") > leaf_keys)
        total = sizes.agg(F.sum("group_keys")).first()[0] or 0
        n_packs = max(packs, total // leaf_keys + 1)
        if large.isEmpty():
            return add(_leaf_links(groups, percent, n_packs))
        found = add(stage(_leaf_links(groups.join(large, "grp", "left_anti"), percent, n_packs)))
        groups = groups.join(large.select("grp"), "grp", "left_semi")
        if number == ROUNDS:
            blocks = _blocks(groups, large, leaf_keys)
            return add(_leaf_links(blocks, percent, n_packs))
        links, groups = _round(groups, percent, number)
        found = add(links)
    return found


def _classes(docs: DataFrame, percent: int = PERCENT, size: int = SIZE, range_keys: int = RANGE_KEYS, leaf_keys: int = LEAF_KEYS, common_least: int = COMMON_LEAST, coarse: int = COARSE) -> tuple[DataFrame, int]:
    """doc_id, n_shingles, content and class (of the component, null without words) of every row, and the number of rows."""
    ship(docs.sparkSession)
    folder = shared_dir(docs.sparkSession)
    with scratch(docs.sparkSession):
        sets = stage(shingle_sets(docs, size))
        n_rows, total = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
        spread = partitions_of(docs.sparkSession)
        n_ranges = max(spread, total // range_keys + 1)
        n_buckets = max(spread, n_ranges // 4)
        texts = _one_of_each(docs, sets, n_rows)
        common, counts = _common_keys(texts, size, n_rows, common_least)
        shared = _shared_keys(_key_ranges(texts, size, n_ranges, n_buckets, common, coarse), n_buckets, common, counts, coarse)
        # rows that repeat in full may leave a node in several chunks: it is then its own partner, which changes nothing
        named = stage(_survivors(shared, percent).withColumnRenamed("node", "set").withColumn("node", F.monotonically_increasing_id()))
        roots = connected_components(_links(named.drop("set"), percent, leaf_keys))
        # a root of eight bytes and a set of sixteen are never the same
        roots = named.select("set", "node").join(roots, "node").groupBy("set").agg(F.unhex(F.lpad(F.hex(F.min("root")), 16, "0")).alias("root"))
        marked = sets.join(roots, F.col("node") == F.col("set"), "left").withColumn("class", F.coalesce("root", "node"))
        marked = marked.select("doc_id", "n_shingles", "content", F.when(F.col("n_shingles") > 0, F.col("class")).alias("class"))
        return stage(marked, folder), n_rows


def jaccard_components(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id reachable by links, itself included."""
    marked, n_rows = _classes(docs, **parameters)
    marked = marked.drop("content")
    least = marked.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("group_rows"))
    least = stage(least.where("group_rows > 1"))
    return with_group(marked, least, "class", n_rows).select("doc_id", "n_shingles", F.coalesce("least_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one row of each component: the first by (doc_id, nulls last, digest of id and text)."""
    marked, n_rows = _classes(docs, **parameters)
    rank = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "content")
    first = marked.where("class IS NOT NULL").groupBy("class").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("group_rows"))
    first = stage(first.where("group_rows > 1").select("class", F.col("first.content").alias("first_content"), "group_rows"))
    found = stage(with_group(marked, first, "class", n_rows).where("first_content IS NOT NULL").select("content", "first_content"))
    whole = packed(docs).withColumn("near_key", _content_key("row."))
    left = without_keys(whole, F.col("near_key"), found.where("content <> first_content").select(F.col("content").alias("gone")))
    again = found.where("content = first_content").groupBy("content").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("content")
    again = stage(again)
    if not again.isEmpty():  # rows that repeat in full: one of each stays
        hit = may_match(left, "near_key", build_filter(again, "content"), "near_hit").withColumn("near_hit", F.col("near_hit") & text_or_empty("row.text").rlike(WORD))
        left = hit.where("NOT near_hit").unionByName(hit.where("near_hit").dropDuplicates(["near_key"]))
    return unpacked(left)
