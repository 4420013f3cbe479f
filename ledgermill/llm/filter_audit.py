"""Filter interaction audit: what each filter of a set removes in every order in which the filters can be applied.

Every document is judged by all filters once, and counted in the cell of its part and of its mask (the set of
filters that it fails): at most parts x 2**filters rows, summed before they are shuffled. All orders are then
answered from a part's cells, without the documents: from one permutation to the next two neighbours change
places, so only their two steps are counted again, and every filter's Shapley sum grows along the walk.

The one filter that looks beyond a document tells texts that a smaller doc_id has too. Documents of one text
fail the same other filters, so they are summed by text, part and labels before the smallest id of the text is told.

Defined results: a null text is empty and a null lang is the part "". A null doc_id is neither smaller nor
larger than any other, and has no labels; rows that share a doc_id do not repeat each other, and each counts. Of several
labels of a doc_id any quality or toxic of 1 counts. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.shared import SPACE, stage, text_or_empty

#: The filters by letter, a bit each. The last one is that of repeated texts.
FILTERS = "ABCDE"
MIN_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = "[#$%&*|]"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column, words: Column) -> tuple[Column, ...]:
    """The filters that look at one text: too short, too few distinct words, too many capitals, symbols."""
    n_words, length = F.size(words).cast("long"), F.length(text).cast("long")
    return (
        n_words < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n_words,
        100 * (length - F.length(F.translate(text, _CAPITALS, ""))) > MOST_CAPITALS * length,
        text.rlike(_SYMBOLS),
    )


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and mask of each row, without the filter of repeated texts; equal rows stand as one with n_rows."""
    texts = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text")).withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(F.col("text"), F.col("words")))), F.lit(0))
    rows = texts.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    return rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n_rows"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, n_good and n_toxic: documents by part and set of failed filters."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("label_place")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    rows = stage(judged(docs))
    # rows without an id meet no label, and are dealt by their text
    place = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.hex("digest")))
    labelled = rows.withColumn("place", place).join(known, (F.col("place") == F.col("label_place")) & F.col("doc_id").isNotNull(), "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    labelled = labelled.select("doc_id", "part", "digest", "mask", "n_rows", *flags)
    key = ("digest", "part", "mask", "good", "toxic")
    # of a text: how many rows, how many without an id, and the smallest id with its rows
    copies = labelled.groupBy(*key).agg(
        F.sum("n_rows").alias("n_rows"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n_rows"))).alias("least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n_rows")).otherwise(0)).alias("n_without_id"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    kept = F.col("n_without_id") + F.when(F.col("least.doc_id") == first, F.col("least.n_rows")).otherwise(0)
    told = copies.select("part", "mask", "good", "toxic", "n_rows", kept.alias("n_first"))
    repeated = 1 << (len(FILTERS) - 1)
    split = F.explode(F.array(F.struct("mask", F.col("n_first").alias("n")), F.struct((F.col("mask") + repeated).alias("mask"), (F.col("n_rows") - F.col("n_first")).alias("n"))))
    each = told.select("part", "good", "toxic", split.alias("cell")).select("part", "good", "toxic", "cell.mask", "cell.n").where("n > 0")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"))


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places i, so that swapping i and i + 1 again and again visits every permutation of n once: each item in turn walks through the orders of the smaller ones."""
    if n < 2:
        return
    down = True
    for below in [*adjacent_swaps(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if below is not None:
            yield below + 1 if down else below  # the largest item stands at the left end, or at the right one
        down = not down


class Walk:
    """The steps of one order over the cells of a part; ``swap`` goes to the next order and counts two steps again."""

    def __init__(self, found: dict[int, tuple[int, int, int]], n_filters: int):
        self.n, masks = n_filters, range(1 << n_filters)
        self.order = list(range(n_filters))
        # documents, good ones and toxic ones that pass all filters of a set
        self.passing = [tuple(sum(c[k] for m, c in found.items() if not m & s) for k in range(3)) for s in masks]
        self.failing = [sum(found.get(m, (0, 0, 0))[0] for m in masks if m >> f & 1) for f in range(n_filters)]
        self.unique = [found.get(1 << f, (0, 0, 0))[0] for f in range(n_filters)]
        self.steps = [{} for _ in self.order]
        for place in range(n_filters):
            self._count(place)
        self.shapley = [0] * n_filters
        self._add()

    def _count(self, place: int) -> None:
        f = self.order[place]
        before = sum(1 << g for g in self.order[:place])
        was, now = self.passing[before], self.passing[before | 1 << f]
        removed = was[0] - now[0]
        self.steps[place] = {"filter": f, "kept": now[0], "removed": removed, "redundant": self.failing[f] - removed, "unique_fails": self.unique[f], "good_lost": was[1] - now[1], "toxic_lost": was[2] - now[2]}

    def _add(self) -> None:
        for step in self.steps:
            self.shapley[step["filter"]] += step["removed"]

    def swap(self, place: int) -> None:
        self.order[place], self.order[place + 1] = self.order[place + 1], self.order[place]
        self._count(place)
        self._count(place + 1)
        self._add()


def audit_orders(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and counts: a row for each step of each order of the filters, for each part of ``found`` (as of ``cells``)."""
    n = len(filters)
    parts = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))  # 2**n at most

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, listed in zip(batch["part"], batch["cells"]):
                at = Walk({c["mask"]: (c["n"], c["n_good"], c["n_toxic"]) for c in listed}, n)
                rows = []
                for place in [*adjacent_swaps(n), None]:
                    name = "".join(filters[f] for f in at.order)
                    rows += [{"part": part, "filter_order": name, "step": i + 1, **step} for i, step in enumerate(at.steps)]
                    if place is not None:
                        at.swap(place)
                out = pd.DataFrame(rows)
                out["shapley"] = [at.shapley[f] for f in out.pop("filter")]
                yield out

    return parts.mapInPandas(walk, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of FILTERS over docs (doc_id, text, lang) with labels (doc_id, quality, toxic), by lang."""
    return audit_orders(cells(docs, labels))
