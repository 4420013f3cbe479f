"""A bounded filter for keys: tells rows that surely have no partner from those that may have one.

The filter of a table of binary keys is a bitmap, one bit for the leading bits of each key, kept as rows
of 32,768 bits. Its size follows the number of keys: 2**20, 2**24 or at most 2**28 positions, 32 MB, so it
can be broadcast. A key without its bit is surely absent; with it, an exact join decides. Beyond some 100
million keys the largest bitmap clears little; results stay the same and more rows take the exact way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill.llm.shared import stage

SIZES = (20, 24, 28)
#: Positions of the bitmap for a key, at least, where a size allows it.
SPARE = 16
_ROW = 1 << 15


@dataclass(frozen=True)
class KeyFilter:
    rows: DataFrame  # filter_row, filter_bits
    bits: int


def _position(key: Column, bits: int) -> Column:
    return F.conv(F.substring(F.hex(key), 1, bits // 4), 16, 10).cast("long")


def build_filter(keys: DataFrame, column: str) -> KeyFilter:
    """The filter of a staged table of keys, which is read twice."""
    n_keys = keys.count()
    bits = next((b for b in SIZES if n_keys * SPARE <= 1 << b), SIZES[-1])
    at = _position(F.col(column), bits)
    return KeyFilter(stage(keys.groupBy(F.floor(at / _ROW).alias("filter_row")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(_ROW))).alias("filter_bits"))), bits)


def may_match(rows: DataFrame, column: str, key_filter: KeyFilter, name: str) -> DataFrame:
    """rows with a boolean column ``name``: false only where the key is in no row of the filter's table."""
    at = _position(F.col(column), key_filter.bits)
    inside = F.pmod(at, F.lit(_ROW))
    byte = F.conv(F.hex(F.substring(F.col("filter_bits"), (F.floor(inside / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(key_filter.rows), F.floor(at / _ROW) == F.col("filter_row"), "left")
    return joined.withColumn(name, F.coalesce(F.getbit(byte, (inside % 8).cast("int")) == 1, F.lit(False))).drop("filter_row", "filter_bits")


def without_keys(rows: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """rows whose binary key is not in gone (one binary column): only rows that the filter cannot clear are shuffled."""
    name, gone = gone.columns[0], stage(gone)
    marked = may_match(rows.withColumn("filter_key", key), "filter_key", build_filter(gone, name), "filter_hit")
    clear = marked.where("NOT filter_hit").select(*rows.columns)
    left = marked.where("filter_hit").join(gone.distinct(), F.col("filter_key") == F.col(name), "left_anti")
    return clear.unionByName(left.select(*rows.columns))
