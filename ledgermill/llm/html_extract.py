"""HTML extraction: a chain model over the leaf blocks of a page keeps the blocks of its main text.

The features of a block are its ancestors' elements and the names in their classes, and its own
length, share of linked text, sentences and place; neighbours are tied by transition weights. The
model is trained on TRAINING_PAGES labelled pages (``labelled_pages``; any labelled table can be
given instead) and decoded by Viterbi over padded batches of pages.

Defined results: a null or empty page, and one without main text, has an empty text; unclosed and
misnested elements are closed where HTML closes them or at the end; the text of icons, lists of
options and templates is no text of the page; what stands behind a script or style without an end is
lost, as in a browser; pages are decoded one by one, so ties, repeated rows and null keys need no
rule; an empty table gives an empty result; columns beside page_id, url and html are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.crf import ChainCRF, Sequences
from ledgermill.llm.html_blocks import blocks_of, features_of
from ledgermill.llm.labelled_pages import labelled_pages
from ledgermill.llm.shared import ship

TRAINING_PAGES = 2400
#: Pages decoded at once, by characters.
DECODE_CHARS = 4_000_000


def train(pages: list[tuple[str, list[int]]]) -> ChainCRF:
    sequences, labels = [], []
    for page, truth in pages:
        blocks = blocks_of(page)
        if len(blocks) != len(truth):
            raise ValueError(f"{len(truth)} labels for {len(blocks)} blocks")
        sequences.append(features_of(blocks))
        labels += truth
    return ChainCRF(2).fit(Sequences.of(sequences), np.array(labels, dtype=np.int64))


@lru_cache(maxsize=2)
def default_model(n_pages: int = TRAINING_PAGES) -> ChainCRF:
    return train(labelled_pages(n_pages))


def main_texts(pages: list[str], model: ChainCRF) -> list[str]:
    blocks = [blocks_of(p) for p in pages]
    labels = model.decode(Sequences.of([features_of(b) for b in blocks])) if any(blocks) else np.zeros(0)
    bounds = np.concatenate(([0], np.cumsum([len(b) for b in blocks], dtype=np.int64)))
    return ["\n".join(x.text for x, keep in zip(b, labels[lo:hi]) if keep) for b, lo, hi in zip(blocks, bounds, bounds[1:])]


def extract_main_text(pages: DataFrame, model: ChainCRF | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    ship(pages.sparkSession)
    model = model or default_model()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            held: list[str] = []
            size = 0
            for value in batch.column(2):
                held.append(value.as_py() or "")
                size += len(held[-1])
                if size >= DECODE_CHARS:
                    texts += main_texts(held, model)
                    held, size = [], 0
            texts += main_texts(held, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(each, "page_id bigint, url string, text string, n_chars bigint")
