import collections
import re
from itertools import permutations

import duckdb
import pytest

from ledgermill.llm.filter_audit import FILTERS, Walk, adjacent_swaps, audit_orders, cells, filter_audit
from ledgermill.llm.queries import oracle_sql, queries


def _masks(rows):
    """Failed filters of rows (doc_id, text, lang), by the contract."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and i > least[text]]
        out.append({x for x, f in zip(FILTERS, fails) if f})
    return out


def _plain(rows, labels):
    flags = collections.defaultdict(lambda: [False, False])
    for i, quality, toxic in labels:
        if i is not None:
            flags[i] = [flags[i][0] or quality == 1, flags[i][1] or toxic == 1]
    parts = collections.defaultdict(list)
    for (i, _, lang), failed in zip(rows, _masks(rows)):
        parts[lang or ""].append((failed, *(flags[i] if i in flags else (False, False))))
    out = {}
    for part, docs in parts.items():
        sums = collections.Counter()
        for order in map("".join, permutations(FILTERS)):
            left = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                sums[f] += len(gone)
                failing = sum(f in d[0] for d in docs)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = sums[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def _found(frame):
    rows = [tuple(r) for r in frame.collect()]
    found = {r[:3]: r[3:] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def labels(spark):
    given = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 6010, 2)] + [(6005, 1, 1), (6005, 0, 0), (6004, None, 1), (None, 1, 1)]
    return spark.createDataFrame(given, "doc_id bigint, quality int, toxic int"), given


def test_same_as_applying_every_order(documents, labels):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.select("doc_id", "text", "lang").collect()]
    rows += [(i, t, "fr") for i, t, _ in rows[:40]] + [(None, t, "en") for _, t, _ in rows[20:60]]  # copies in other parts and without ids
    frame = documents.sparkSession.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, lang string, mask int")
    assert _found(filter_audit(frame, labels[0])) == _plain(rows, labels[1])


def test_no_documents_and_no_labels(documents, no_documents, labels):
    assert filter_audit(no_documents, labels[0]).count() == 0
    lost = filter_audit(documents, labels[0].where("false")).selectExpr("sum(good_lost + toxic_lost) as lost", "count(*) as n").first()
    assert lost["lost"] == 0 and lost["n"] % 600 == 0


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = {tuple(order)}
    for place in adjacent_swaps(n):
        order[place], order[place + 1] = order[place + 1], order[place]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(permutations(range(n)))


def test_a_swap_counts_two_steps_again(monkeypatch):
    walk = Walk({0: (5, 1, 0), 3: (4, 2, 2), 6: (1, 0, 0)}, 3)
    counted = []
    count = Walk._count
    monkeypatch.setattr(Walk, "_count", lambda self, place: (counted.append(place), count(self, place))[1])
    for place in adjacent_swaps(3):
        walk.swap(place)
        assert counted[-2:] == [place, place + 1]
    assert len(counted) == 2 * 5 and sum(walk.shapley) == 6 * 5


def test_cells_are_few(documents, labels):
    found = cells(documents, labels[0])
    assert found.count() <= 32 * documents.select("lang").distinct().count() and found.selectExpr("sum(n) as n").first()["n"] == documents.count()
    assert audit_orders(found.where("mask = 0")).where("removed <> 0").count() == 0


def test_same_as_sql(spark, sf_dir):
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    frame, expected = queries()["op13_filter_audit"](spark, sf_dir), duck.sql(oracle_sql()["op13_filter_audit"])
    assert sorted(frame.columns) == sorted(expected.columns)
    assert sorted(map(tuple, frame.select(*expected.columns).collect())) == sorted(expected.fetchall())
