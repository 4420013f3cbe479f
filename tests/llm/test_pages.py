import base64
import collections
import hashlib
import html
import re

import numpy as np
import pytest
from layouts import DECIDED, LAYOUTS, MORE
from pyspark.sql import functions as F

from ledgermill.llm.crf import ChainCRF, Sequences
from ledgermill.llm.html_blocks import blocks_of, features_of
from ledgermill.llm.html_extract import default_model, extract_main_text, main_texts
from ledgermill.llm.labelled_pages import labelled_pages
from ledgermill.llm.shared import stage
from ledgermill.llm.warc import deduplicate_pages, parse_record, read_archives, write_archives


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]


def test_model_on_held_out_pages():
    right = wrong = missed = 0
    for page, truth in labelled_pages(150, seed=99):
        found = default_model().decode(Sequences.of([features_of(blocks_of(page))]))
        truth = np.array(truth)
        right, wrong, missed = right + ((found == 1) & (truth == 1)).sum(), wrong + ((found == 1) & (truth == 0)).sum(), missed + ((found == 0) & (truth == 1)).sum()
    assert 2 * right / (2 * right + wrong + missed) > 0.97


def test_pages_of_the_table(spark, sf_dir, pages):
    def article(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        return "\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)) if t)

    rows = {r["page_id"]: r for r in extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    same = [rows[i]["text"] == article(p) for i, _, p in pages]
    assert np.mean(same) > 0.98 and all(r["n_chars"] == len(r["text"]) for r in rows.values())


def test_parts_of_a_page():
    page = """<html><head><title>t</title></head><body><div class="cookie-notice"><p>We use cookies here.</p></div><header class="site-header"><a href="/">Home</a></header>
    <nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><div class="content"><h1>A heading of it</h1><p>First &amp; long
    sentence of the text, which goes on.<p>Second <b>one</b> here, with more words in it.<script>var x = "<p>no</p>";</script></div>
    <div class="comments"><p>Great text, I liked it.</p></div><form><p>Your name</p></form><footer>&copy; Someone</footer>"""
    assert main_texts([page, ""], default_model()) == ["A heading of it\nFirst & long sentence of the text, which goes on.\nSecond one here, with more words in it.", ""]


@pytest.mark.parametrize("name", [*LAYOUTS, *DECIDED])
def test_layouts_made_by_hand(name):
    page, text = (LAYOUTS | DECIDED)[name]
    assert main_texts([page], default_model()) == [text]


def test_share_of_right_blocks_on_pages_made_by_hand():
    right = []
    for page, expected in MORE:
        blocks = blocks_of(page)
        assert [b.text for b in blocks] == [t for t, _ in expected]
        right += list(default_model().decode(Sequences.of([features_of(blocks)])) == np.array([k for _, k in expected]))
    assert len(right) == 72 and np.mean(right) > 0.97


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>Before</p><svg class='i'/><p>Article</p>", ["Before", "Article"]),
        ("<p>Before</p><svg><title>icon</title><path><p>Article</p>", ["Before", "Article"]),
        ("<p>Before</p><object data=x /><p>Article</p>", ["Before", "Article"]),
        ("<p>Before <math><mi>x</mi><p>Article</p>", ["Before x", "Article"]),
        ("<p>Before</p><select><option>one<p>Article</p>", ["Before", "Article"]),
        ("<p>Before</p><noscript><p>Article</p>", ["Before", "Article"]),
        ("<title/><p>Article</p>", ["Article"]),
        ("<p>Before</p><template><p>hidden</p></template><p>Article</p>", ["Before", "Article"]),
        ("<p>Before</p><template><p>Article</p>", ["Before", "Article"]),
        ("<p>Before</p><script>x<p>y", ["Before"]),
        ("<p>One <svg/>line</p>", ["One line"]),
    ],
)
def test_elements_that_are_self_closed_or_left_open(page, texts):
    assert [b.text for b in blocks_of(page)] == texts


def test_parts_between_the_ends_of_a_deep_path():
    page = "<div>" * 70 + "<nav class=menu>" + "<div>" * 70 + "deep"
    names = {n for t, n in blocks_of(page)[0].path if not t}
    assert ("nav", "") in blocks_of(page)[0].path and names == {"menu"}


def test_repeated_pages_and_clashing_columns(spark):
    page = LAYOUTS["news"][0]
    rows = [(1, "u", page, "t", 5, "x"), (1, "u", page, "t", 5, "x"), (None, None, page, None, None, None), (2, "v", None, "", 0, "")]
    found = extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int, h string"))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    text = LAYOUTS["news"][1]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "u", text, len(text))] * 2 + [(None, None, text, len(text)), (2, "v", "", 0)], key=repr)


def test_a_very_long_page(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>Long</h1>" + "".join(f"<p>Paragraph number {i} of the text, with some words in it.</p>" for i in range(60_000)) + "</article></body></html>"
    (row,) = extract_main_text(spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")).collect()
    assert row["text"].count("\n") == 60_000 and row["text"].startswith("Long\nParagraph number 0 of")


def test_quotes_outside_values_and_deep_nesting():
    assert [b.text for b in blocks_of("<p title=Bob's>one</p><p don't>it's two</p><p x='a>b'>three</p>")] == ["one", "it's two", "three"]
    deep = blocks_of("<div class=outer>" + "<div>x" * 20_000 + "</div>" * 20_000 + "</i>" * 20_000 + "</div><p>y")
    assert len(deep) == 20_001 and deep[-1].path == (("p", ""),) and deep[-2].path[0] == ("div", "outer") and len(deep[-2].path) == 128


def test_decoding_does_not_depend_on_the_batch(monkeypatch):
    rng = np.random.default_rng(1)
    data = Sequences.of([[[int(rng.integers(0, 50))] for _ in range(int(n))] for n in rng.integers(0, 40, 60)])
    model = ChainCRF(3)
    model.weights[:50] = rng.normal(size=(50, 3))
    model.transitions[:] = rng.normal(size=(3, 3))
    whole = model.decode(data)
    monkeypatch.setattr("ledgermill.llm.crf.PADDED_STEPS", 64)
    assert (model.decode(data) == whole).all()


def test_broken_pages(spark):
    odd = ["<p>a<", "<!-- open", "<script>x", "</div></p>", "<a href='x>y'>z", "\x00<p>&#0;&nosuch;", "<" * 5000, "<p>" * 5000, None, ""]
    rows = spark.createDataFrame([(i, None, t) for i, t in enumerate(odd)], "page_id bigint, url string, html string")
    assert extract_main_text(rows).count() == len(odd) and extract_main_text(rows.where("false")).count() == 0


def test_crf_gradient_and_decoding():
    rng = np.random.default_rng(0)
    sequences = [[[int(f) for f in rng.integers(0, 30, 3)] for _ in range(rng.integers(1, 6))] for _ in range(4)]
    data = Sequences.of(sequences)
    labels = rng.integers(0, 3, len(data.starts) - 1)
    model = ChainCRF(3)
    for part in (model.weights[:30], model.transitions, model.first):
        part += rng.normal(size=part.shape).astype(np.float32)
    scores = model._scores(data)

    def paths(s):
        rows = scores[data.bounds[s] : data.bounds[s + 1]]
        for path in np.ndindex(*(3,) * len(rows)):
            yield path, model.first[path[0]] + sum(rows[t][path[t]] + (model.transitions[path[t - 1], path[t]] if t else 0) for t in range(len(rows)))

    best = [max(paths(s), key=lambda p: p[1])[0] for s in range(4)]
    assert model.decode(data, batch=3).tolist() == [x for p in best for x in p]
    which = np.arange(4)
    at, real = model._padded(data.bounds, which)
    marginals, pairs, _ = model._gradient(scores, at, real)
    expected = np.zeros((3, 3))
    for s in range(4):
        every = list(paths(s))
        mass = np.exp([v for _, v in every])
        mass /= mass.sum()
        for t in range(data.bounds[s + 1] - data.bounds[s]):
            for label in range(3):
                assert marginals[s, t, label] == pytest.approx(sum(m for m, (p, _) in zip(mass, every) if p[t] == label), abs=1e-6)
        for m, (p, _) in zip(mass, every):
            for a, b in zip(p, p[1:]):
                expected[a, b] += m
    assert np.allclose(pairs, expected, atol=1e-5) and len(labels) == len(data.starts) - 1


def _resolved(pages, min_bytes):
    first, used, rows = {}, set(), collections.Counter()
    for i, _, page in pages:
        if i is not None:
            first[page or ""] = min(first.get(page or "", i), i)
    for i, _, page in pages:
        payload, original = (page or "").encode(), first.get(page or "")
        response = len(payload) < min_bytes or original is None or (i == original and (page or "") not in used)
        if i == original:
            used.add(page or "")
        rows[(i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if response else "revisit", None if response else original)] += 1
    return rows


@pytest.mark.parametrize("min_bytes", [0, 3])
def test_archives(spark, pages, min_bytes):
    rows = [*pages[:40], *((500 + i, "u", pages[i % 7][2]) for i in range(40)), (600, "a\nb", None), (601, None, ""), (602, "x", "é"), (602, "x", "é"), (603, "x", "é"), (None, "n", "é"), (None, "n", "zz"), (None, "n", "zz"), (700, "l", "x" * 500_000)]
    frame = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id bigint, url string, html string, h string, size int")
    found = deduplicate_pages(frame, min_bytes=min_bytes)
    assert collections.Counter(tuple(r)[:5] for r in found.collect()) == _resolved(rows, min_bytes)
    assert deduplicate_pages(frame.where("false")).count() == 0


def test_each_row_keeps_its_url(spark):
    rows = [(1, "http://b/", "same"), (1, "http://a/", "same"), (1, "http://a/", "same"), (2, "http://c/", "same"), (None, "http://d/", "same"), (3, "http://e/", None), (3, "http://f/", ""), (4, None, "own"), (None, "http://g/", "alone"), (None, "http://h/", "alone")]
    found = deduplicate_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert collections.Counter((r["page_id"], r["url"]) for r in found) == collections.Counter((i, u or "") for i, u, _ in rows)
    assert {(r["page_id"], r["url"]) for r in found if r["record_type"] == "response"} == {(1, "http://a/"), (3, "http://e/"), (4, ""), (None, "http://g/"), (None, "http://h/")}
    assert sum(r["record_type"] == "response" for r in found) == 5


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    rows = spark.range(640).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.md5(F.col("id").cast("string")).alias("html")).repartition(64)
    folder = f"file://{tmp_path}/warc"
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        archives = stage(write_archives(rows, folder))
        assert archives.count() == 64
        tasks = read_archives(archives, folder).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(tasks) > 32 and sum(r["count"] for r in tasks) == 640


def test_records_on_disk(spark, tmp_path):
    import gzip

    frame = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>")], "page_id bigint, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/warc"
    names = [r["archive"] for r in write_archives(frame, folder).collect()]
    records = {}
    for name in names:
        raw = gzip.decompress((tmp_path / "warc" / name).read_bytes())
        for part in raw.split(b"\r\n\r\nWARC/1.1\r\n"):
            part = part if part.startswith(b"WARC/") else b"WARC/1.1\r\n" + part
            headers, http, payload = parse_record(part)
            records[headers["warc-type"]] = (headers, payload)
    response, revisit = records["response"], records["revisit"]
    assert response[1] == b"<p>x</p>" and revisit[1] == b""
    assert revisit[0]["warc-refers-to"] == response[0]["warc-record-id"] and revisit[0]["warc-refers-to-target-uri"] == "http://a/"
    assert response[0]["warc-payload-digest"] == revisit[0]["warc-payload-digest"]
