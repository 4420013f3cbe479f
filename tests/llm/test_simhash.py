import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgermill.llm import simhash
from ledgermill.llm.graph import connected_components
from ledgermill.llm.hamming_trie import hamming_links, near_pairs
from ledgermill.llm.simhash import fingerprint, simhash_components


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [words[i : i + 3] for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, radius=3):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


def _signed(value):
    return value - (1 << 64) if value >> 63 else value


def _spoiled(value, n, rng):
    for bit in rng.sample(range(64), n):
        value ^= 1 << bit
    return value


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_same_as_the_contract(documents, corpus, monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    assert all(fingerprint(t or "") == plain_fingerprint(t) for _, t in corpus[::3])
    if piece == 50:
        return
    prints = [plain_fingerprint(t) for _, t in corpus]
    root = components(sorted(set(prints)))
    least = collections.defaultdict(list)
    for (i, _), f in zip(corpus, prints):
        least[root[f]].append(i)
    expected = sorted(((i, f"{f:016x}", min((x for x in least[root[f]] if x is not None), default=None)) for (i, _), f in zip(corpus, prints)), key=repr)
    found = simhash_components(documents)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected


def test_no_documents_and_no_ids(spark, no_documents):
    assert simhash_components(no_documents).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, None), (3, "")], "doc_id bigint, text string")
    found = sorted((tuple(r) for r in simhash_components(rows).collect()), key=repr)
    print_of = f"{plain_fingerprint('a b c'):016x}"
    assert found == sorted([(None, print_of, None)] * 2 + [(None, "0" * 16, 3), (3, "0" * 16, 3)], key=repr)


@pytest.mark.parametrize(("node_rows", "task_rows"), [(4096, 1 << 17), (16, 1 << 17), (64, 4)])
def test_links_of_many_fingerprints(spark, node_rows, task_rows):
    """Uniform ones, chains, and a dense cloud around one value; tasks of few rows make Spark walk down to the last level."""
    rng = random.Random(node_rows)
    values = [rng.getrandbits(64) for _ in range(300)]
    values += [_spoiled(rng.choice(values), rng.randint(1, 5), rng) for _ in range(300)]
    centre = rng.getrandbits(64)
    values += [centre, 0, (1 << 64) - 1, *(_spoiled(centre, rng.randint(1, 4), rng) for _ in range(150)), *((1 << k) for k in range(0, 64, 7))]
    values = sorted(set(values))
    links = hamming_links(spark.createDataFrame([(_signed(v),) for v in values], "fp long"), 3, node_rows, task_rows)
    labels = {r["node"]: r["root"] for r in connected_components(links).collect()}
    groups, expected = collections.defaultdict(set), collections.defaultdict(set)
    for v, r in components(values).items():
        expected[r].add(v)
        groups[labels.get(_signed(v), _signed(v))].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_pairs_of_two_nodes():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 1 << 62, 500, dtype=np.uint64))
    b = np.unique(np.concatenate([a[::3] ^ np.uint64(1 << 40), a[::5] ^ np.uint64(7), rng.integers(0, 1 << 62, 200, dtype=np.uint64)]))
    found = {(int(i), int(j)) for x, y in near_pairs(a, b, False, 0, 0, 7) for i, j in zip(x, y)}
    sure = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (int(x) ^ int(y)).bit_count() <= 7 and (int(x) ^ int(y)).bit_count() and (int(x) >> 32 ^ int(y) >> 32).bit_count() <= 3}
    assert sure <= found and all((int(a[i]) ^ int(b[j])).bit_count() <= 7 for i, j in found)


def test_a_cloud_of_copies_has_few_edges(spark):
    """Edges grow with the fingerprints and not with their pairs."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = sorted({_spoiled(centre, rng.randint(0, 3), rng) for _ in range(3000)})
    links = hamming_links(spark.createDataFrame([(_signed(v),) for v in values], "fp long"), 3)
    assert links.count() < 10 * len(values) and connected_components(links).select(F.col("root")).distinct().count() == 1
