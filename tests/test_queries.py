import math
import re

import duckdb
import pytest

from ledgermill import store_queries  # noqa: F401 - joins the registry
from ledgermill.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, sf_dir, duck, name):
    frame = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(expected.columns)
    assert _rows(frame.columns, frame.collect()) == _rows(expected.columns, expected.fetchall())


def test_whole_texts_are_cleaned_as_emails(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["email_whole"](spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    for i, raw in texts.items():
        spoiled = raw.replace(" ", "").replace(".", "..").replace(",", "@@").strip(" \n")
        email = re.sub(r"\.{2,}", ".", re.sub("@{2,}", "@", spoiled))
        assert rows[i]["email"] == email
        assert rows[i]["broken"] == (re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", email) is None)
    assert max(len(r["email"]) for r in rows.values()) > 60
