import random

import pytest


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    """(doc_id, text) of real documents and of the odd cases."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(3)
    alphabet = [*"ab é漢🙂\n\t\r.,@+0123456789-()|#\x0b\x00ß", "the", "ing", " a b c d e"]
    odd = [(5000 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    odd += [(6000, None), (6001, ""), (6002, " \n\t"), (6003, "one"), (6004, "word " * 30_000), (None, "no id"), (None, None), (6005, "twice"), (6005, "twice"), (6006, "Twice"), (6007, rows[0][1]), (6008, rows[0][1].replace(" ", "  "))]
    return rows + odd


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus as a table with a language, a source, nulls in both, and columns whose names operators use themselves."""
    langs, sources = ("en", "fr", "xx", None), ("src1", "src0", None, "é", "z")
    rows = [(i, t, langs[k % 4], sources[k % 5], len(t or ""), k, "c", k) for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, h string, quality int")


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.where("false")
