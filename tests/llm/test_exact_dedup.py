import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ledgermill.llm.exact_dedup import drop_copies, exact_groups


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def expected(corpus):
    groups = collections.defaultdict(list)
    for i, t in corpus:
        groups[normal(t)].append(i)
    rows = collections.Counter()
    for i, t in corpus:
        ids = groups[normal(t)]
        known = [x for x in ids if x is not None]
        rows[(i, min(known) if known else None, len(ids), hashlib.sha256(normal(t).encode()).hexdigest())] += 1
    return rows, len(groups)


@pytest.mark.parametrize("digest", [F.md5, lambda c: F.substring(F.md5(c), 1, 2)], ids=["md5", "colliding"])
def test_groups(documents, corpus, digest):
    rows, n_groups = expected(corpus)
    found = exact_groups(documents, digest).collect()
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == rows
    assert sum(r["kept"] for r in found) == n_groups
    assert all(r["keep_id"] == r["doc_id"] for r in found if r["kept"])


@pytest.mark.parametrize("digest", [F.md5, lambda c: F.substring(F.md5(c), 1, 2)], ids=["md5", "colliding"])
def test_drop_copies(documents, corpus, digest):
    left = drop_copies(documents, digest)
    assert left.columns == documents.columns
    rows = left.collect()
    assert sorted(normal(r["text"]) for r in rows) == sorted({normal(t) for _, t in corpus})


def test_a_hot_group(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("int"))).alias("text"))
    rows = exact_groups(docs).groupBy("kept").agg(F.count(F.lit(1)).alias("n"), F.max("group_size").alias("size")).collect()
    assert {r["kept"]: r["n"] for r in rows}[False] == 1999 + sum(1 for i in range(3000) if (2 * i) % 3 and (2 * i + 1) % 3) and max(r["size"] for r in rows) == 2000


def test_empty_table(no_documents):
    assert exact_groups(no_documents).count() == 0 and drop_copies(no_documents).count() == 0
