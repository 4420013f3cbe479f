import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql.conf import RuntimeConfig

from ledgermill.llm import shared
from ledgermill.llm.exact_dedup import drop_copies, exact_groups
from ledgermill.llm.queries import queries
from ledgermill.llm.shared import scratch, shared_dir, stage


class _Unset:
    """A session's settings without a shared folder, which can not be changed."""

    def __init__(self, conf):
        self.conf = conf

    def get(self, key, *default):
        return default[0] if key == "spark.checkpoint.dir" else self.conf.get(key, *default)

    def set(self, key, value):
        assert key != "spark.checkpoint.dir"
        self.conf.set(key, value)


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op8_id_shards", "op9_sentencepiece", "op10_warc_revisits"])
def test_without_a_shared_folder(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(type(spark), "conf", property(lambda self: _Unset(RuntimeConfig(self._jsparkSession.conf()))))
    assert queries()[name](spark, sf_dir).count() > 0


def test_folders_have_a_file_system(spark):
    assert shared_dir(spark).startswith("file:/")


def test_scratch_is_of_its_thread(spark):
    """What another thread stages while a block is open stays."""
    inside, staged = threading.Event(), threading.Event()

    def other():
        inside.wait(30)
        table = stage(spark.range(5))
        staged.set()
        return table

    with ThreadPoolExecutor(1) as pool:
        waits = pool.submit(other)
        with scratch(spark):
            mine = shared_dir(spark)
            stage(spark.range(3))
            inside.set()
            assert staged.wait(30)
        assert waits.result().count() == 5
    assert shared._scratch.get() is None and shared_dir(spark).rpartition("/")[0] != mine.rpartition("/")[0]


def test_two_threads_at_once(spark, documents):
    expected = sorted((tuple(r) for r in exact_groups(documents).drop("h").collect()), key=repr)
    kept = drop_copies(documents).count()
    with ThreadPoolExecutor(2) as pool:
        first = pool.submit(lambda: sorted((tuple(r) for r in exact_groups(documents).drop("h").collect()), key=repr))
        second = pool.submit(lambda: drop_copies(documents).count())
        assert first.result() == expected and second.result() == kept


def test_repeated_rows_do_not_shuffle_all_texts(spark):
    """One row that repeats in full: the others' texts stay where they are."""
    words = [(i, f"text {i} {uuid.uuid4().hex}") for i in range(300)]
    docs = spark.createDataFrame([*words, words[3], words[3]], "doc_id bigint, text string")
    kept = drop_copies(docs)
    plan = kept._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in kept.collect()) == sorted(words) and "may_repeat" in plan
