import re
from collections import Counter, defaultdict

import pytest

from ledgermill.llm.mixing import SCHEDULES, _plan, mix_documents, plan_mix
from ledgermill.llm.shared import row_digest


def targets(sizes):
    """Shares by weight, stops, and what is left shared again, step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    stop, left, out = {s: 2.0 * sizes[s] for s in order}, 1.5 * sum(sizes.values()), {}
    active = set(order)
    while active:
        level = left / sum(weight[s] for s in active)
        over = {s for s in active if level * weight[s] > stop[s]}
        if not over:
            return out | {s: level * weight[s] for s in active}
        for s in over:
            out[s] = stop[s]
            left -= stop[s]
        active -= over
    return out


def test_plan(documents):
    source = documents.collect()
    sizes = defaultdict(int)
    for r in source:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    rows = plan_mix(documents).collect()
    assert len(rows) == len(source)
    aim, taken = targets(sizes), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(aim[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["taken"] == 0 or r["taken"] % r["size"] == 0)
        assert len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    largest = max(r["size"] for r in rows)
    for s in sizes:
        assert abs(taken[s] - aim[s]) <= largest
    first = [r["position"] for r in rows if r["position"] is not None]
    assert first == sorted(first)


def test_positions_follow_the_demand(spark, sf_dir):
    """Words of a source placed before t are the integral of its schedule up to t."""
    rows = plan_mix(spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")).collect()
    places = sorted({r["source"] for r in rows})
    for place, source in enumerate(places[:6]):
        own = [r for r in rows if r["source"] == source]
        start, end = SCHEDULES[place % 3]
        for t in (0.25, 0.5, 0.75):
            demand = own[0]["target"] * (start * t + (end - start) * t * t / 2) / ((start + end) / 2)
            placed = sum(r["size"] for r in own for p in r["positions"] if p < t)
            assert abs(placed - demand) <= 2 * max(r["size"] for r in own)


def test_reruns_agree(documents):
    again = documents.repartition(7)
    assert sorted(map(repr, plan_mix(documents).collect())) == sorted(map(repr, plan_mix(again).collect()))


def test_documents_are_repeated_whole(documents):
    plan = plan_mix(documents).collect()
    mixed = mix_documents(documents)
    assert mixed.columns == documents.columns
    assert mixed.count() == sum(r["copies"] for r in plan)


def test_empty_table(no_documents):
    assert plan_mix(no_documents).count() == 0 and mix_documents(no_documents).count() == 0


def test_rows_are_told_apart_by_all_columns(spark):
    """Each row comes out as often as the plan takes a row like it: ids on several texts and sources, null ids, full repeats."""
    words = lambda n, w: " ".join([w] * n)
    rows = [(1, words(5, "a"), "s1", "x"), (1, words(5, "a"), "s2", "x"), (1, words(5, "a"), "s2", "y"), (1, words(5, "b"), "s2", "x"), (None, words(5, "a"), "s1", "x"), (None, words(5, "a"), None, None), (None, None, "s1", "x")]
    rows += [(2, words(6, "c"), "s1", "z")] * 40 + [(i, words(7, f"d{i}"), "s3", "x") for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars string")
    planned = Counter()
    for r in _plan(docs, row_digest(docs.columns, docs.schema)).collect():
        planned[bytes(r["row_key"])] += r["copies"]
    mixed = Counter(tuple(r) for r in mix_documents(docs).collect())
    keys = {bytes(r["k"]): tuple(r)[:4] for r in docs.select("*", row_digest(docs.columns, docs.schema).alias("k")).collect()}
    assert mixed == Counter({keys[k]: n for k, n in planned.items() if n}) and len(keys) == len(set(rows))
    assert sum(n for r, n in mixed.items() if r[2] == "s2") == sum(r["copies"] for r in plan_mix(docs).where("source = 's2'").collect())
