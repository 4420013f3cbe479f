import collections
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.llm.graph import connected_components
from ledgermill.llm.jaccard_join import drop_near_copies, jaccard_components
from ledgermill.llm.metric_links import Group
from ledgermill.llm.text_arrays import words_of


def brute(docs, percent=75):
    sets = []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[a : a + 5]) for a in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for shingle in s:
            holders[shingle].append(i)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return collections.Counter((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs))


@pytest.fixture(scope="module")
def families(corpus):
    """The corpus with families of edited copies at many distances, and one large family."""
    rng = random.Random(3)
    rows, words = list(corpus), "alpha beta gamma delta".split()
    for _ in range(60):
        text = rng.choice(corpus[:190])[1].split()[: rng.choice([6, 20, 60, 200])]
        for _ in range(rng.randint(1, 12)):
            edited = list(text)
            for _ in range(rng.randint(0, max(1, len(edited) // 12))):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rows.append((100_000 + len(rows), " ".join(edited)))
    text = "".join(f"w{i} " for i in range(120)).split()
    for i in range(150):
        edited = list(text)
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(120)] = f"x{rng.randrange(50)}"
        rows.append((200_000 + i, " ".join(edited)))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"leaf_keys": 2000}, {"leaf_keys": 300, "range_keys": 5000}, {"common_least": 4}, {"range_keys": 20_000, "coarse": 5, "common_least": 30}], ids=["leaves", "rounds", "blocks", "common", "coarse"])
def test_components(spark, families, sizes):
    docs = spark.createDataFrame(families, "doc_id bigint, text string")
    assert collections.Counter(tuple(r) for r in jaccard_components(docs, **sizes).collect()) == brute(families)


def test_other_thresholds(spark, families):
    docs = spark.createDataFrame(families, "doc_id bigint, text string")
    assert collections.Counter(tuple(r) for r in jaccard_components(docs, percent=50).collect()) == brute(families, 50)


def test_drop_near_copies(documents, corpus):
    left = drop_near_copies(documents)
    assert left.columns == documents.columns
    keep = {d for d, _, c in brute(corpus) if d == c} - {None}
    assert {r["doc_id"] for r in left.where("doc_id IS NOT NULL").collect()} == keep


@pytest.mark.parametrize("seed", range(6))
def test_links_of_a_group(seed):
    rng = np.random.default_rng(seed)
    base = [rng.choice(4000, 40, replace=False) for _ in range(5)]
    sets = []
    for _ in range(90):
        s = set(base[rng.integers(5)].tolist())
        for _ in range(rng.integers(0, 14)):
            s.discard(next(iter(s)))
            s.add(int(rng.integers(4000)))
        sets.append(np.array(sorted(s), dtype=np.uint64))
    sizes, bounds = np.array([len(s) for s in sets]), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    group = Group(sizes, np.concatenate(sets), bounds, 75)
    group.link(np.arange(60), np.arange(60, 90))
    want = Group(sizes, np.concatenate(sets), bounds, 75)
    for i in range(60):
        for j in range(i + 1, 90):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= 75 * (sizes[i] + sizes[j] - inter):
                want.join(i, j)
    assert (group.roots() == want.roots()).all()


@pytest.mark.parametrize("seed", range(4))
def test_sets_that_no_pivot_parts(seed):
    """Sets of one template: by their rarest keys they link as all pairs do."""
    rng = np.random.default_rng(seed)
    sets = []
    for i in range(150):
        own = rng.integers(5, 30)
        template = rng.choice(80, 80 if seed % 2 else int(rng.integers(70, 81)), replace=False)
        sets.append(np.unique(np.concatenate((template, 1000 + 100 * i + np.arange(own)))).astype(np.uint64))
    sizes, bounds = np.array([len(s) for s in sets]), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    group, want = (Group(sizes, np.concatenate(sets), bounds, 75) for _ in range(2))
    group._link_by_rarest(np.arange(100), np.arange(100, 150))
    for i in range(100):
        for j in range(i + 1, 150):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= 75 * (sizes[i] + sizes[j] - inter):
                want.join(i, j)
    assert (group.roots() == want.roots()).all()


def test_a_large_group_that_no_pivot_parts():
    n = 20_000
    keys = np.concatenate([np.concatenate((np.arange(80), 1000 + 20 * i + np.arange(20))) for i in range(n)]).astype(np.uint64)
    began = time.time()
    group = Group(np.full(n, 100), keys, np.arange(n + 1) * 100, 75)
    group.link(np.arange(n), np.arange(0))
    assert (group.roots() == np.arange(n)).all() and time.time() - began < 60


def test_template_pages(spark):
    """Pages that share 80 of 100 shingles do not link, and take time in proportion to their number; a copy of one does."""
    template = " ".join(f"t{i}" for i in range(84))
    own = F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), F.col("id").cast("string")) for k in range(20)))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(template), own).alias("text"))
    docs = docs.unionByName(docs.where("doc_id < 5").select((F.col("doc_id") + 50_000).alias("doc_id"), F.concat("text", F.lit(" more")).alias("text")))
    began = time.time()
    found = jaccard_components(docs).where("doc_id <> component_id").collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(50_000 + i, i) for i in range(5)}
    assert time.time() - began < 240


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100)] + [(200, 300), (300, 200), (250, 300)]
    rows = connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in rows} == {i: 0 for i in range(41)} | {200: 200, 250: 200, 300: 200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_words_of_a_batch():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice("aé \n\tB漢\x0b") for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, "", "  "]
    seen = {}
    for block in (40, 1 << 20):
        for words in words_of(pa.array(texts), block=block):
            hashes = words.hashes()
            for i in range(len(words.offsets) - 1):
                at = slice(words.bounds[i], words.bounds[i + 1])
                found = [bytes(words.data[a:b]).decode() for a, b in zip(words.starts[at], words.ends[at])]
                assert found == re.findall(r"[^\x20\x09-\x0D]+", texts[words.first + i] or "")
                for w, h in zip(found, hashes[at]):
                    assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_empty_table(no_documents):
    assert jaccard_components(no_documents).count() == 0 and drop_near_copies(no_documents).count() == 0


def test_many_copies_are_one_node(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a b c d e f g h i j").otherwise(F.concat_ws(" ", *(F.md5(F.concat(F.col("id").cast("string"), F.lit(k))) for k in range(8)))).alias("text"))
    rows = jaccard_components(docs).groupBy((F.col("doc_id") % 3 == 0).alias("copy")).agg(F.count_distinct("component_id").alias("n")).collect()
    assert {r["copy"]: r["n"] for r in rows} == {True: 1, False: 2000}


def test_one_row_of_each_component_stays(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(40))
    near = lambda name: f"{words(name)} more"
    rows = [
        (3, words("a"), "stays"), (7, near("a"), "goes"), (7, words("b"), "stays"), (None, words("a") + " else", "goes"),
        (8, words("c"), "one of c"), (8, near("c"), "one of c"), (None, words("d"), "one of d"), (None, near("d"), "one of d"), (None, words("e"), "stays"),
        (9, words("f"), "one of f"), (9, words("f"), "one of f"), (10, near("f"), "goes"), (None, words("g"), "one of g"), (None, words("g"), "one of g"),
        (11, "", "stays"), (11, "", "stays"), (None, None, "stays"), (None, " ", "stays"), (12, words("h"), "stays"),
    ]
    left = collections.Counter(r["is"] for r in drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string, `is` string")).collect())
    assert left == {"stays": sum(r[2] == "stays" for r in rows), **{f"one of {x}": 1 for x in "cdfg"}}
