"""Bloom filters sized by their keys, built in SQL and tested in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrow import prepare, private

#: Bits a key, for two hashes: about one false positive in 70. Smallest and largest filter, in bits of the address.
PER_KEY, LEAST, MOST = 16, 20, 28


def address_bits(keys: int) -> int | None:
    """Size of a filter for so many keys; None where it would be too large to broadcast."""
    bits = max(LEAST, int(PER_KEY * keys - 1).bit_length())
    return bits if bits <= MOST else None


def bit_columns(key: Column, bits: int) -> list[Column]:
    h = F.xxhash64(key)
    return [F.shiftrightunsigned(h, s).bitwiseAND((1 << bits) - 1) for s in (0, 32)]


def build(rows: DataFrame, key: str, bits: int) -> np.ndarray:
    """Words of 64 bits, at most 2**(MOST - 6) of them; so many rows reach the driver at most."""
    each = rows.select(F.explode(F.array(*bit_columns(F.col(key), bits))).alias("b"))
    words = each.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
    return out


def test(words: np.ndarray, first: pa.Array, second: pa.Array) -> np.ndarray:
    """Whether keys may be in the filter: no false negatives."""
    keep = np.ones(len(first), dtype=bool)
    for column in (first, second):
        b = column.to_numpy(zero_copy_only=False).astype(np.uint64)
        keep &= (words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) > 0
    return keep


def maybe(words: Broadcast, key: Column, bits: int) -> Column:
    @F.arrow_udf("boolean")
    def inside(first: pa.Array, second: pa.Array) -> pa.Array:
        return pa.array(test(words.value, first, second))

    return inside(*bit_columns(key, bits))


def _flag(rows: DataFrame, key: Column, ids: DataFrame, id_name: str) -> Column:
    """Whether a row's key may be among `ids`; true for all where there are too many for a filter."""
    prepare(rows.sparkSession)
    bits = address_bits(ids.count())
    if bits is None:
        return F.lit(True)
    words = rows.sparkSession.sparkContext.broadcast(build(ids, id_name, bits))
    return F.coalesce(maybe(words, key.cast("bigint"), bits), F.lit(False))


def split_by_id(rows: DataFrame, key: Column, ids: DataFrame, id_name: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key isn't among `ids` for sure, and rows whose key may be.

    Only the latter need a join, so the bulk of a table stays where it lies.
    """
    flag = private("may")
    marked = rows.withColumn(flag, _flag(rows, key, ids, id_name))
    return marked.where(~F.col(flag)).drop(flag), marked.where(F.col(flag)).drop(flag)


def among(rows: DataFrame, key: Column, ids: DataFrame, id_name: str) -> DataFrame:
    """Rows whose key is among `ids`, and a few others; too many keys for a filter are joined instead."""
    bits = address_bits(ids.count())
    if bits is None:
        other = private("id")
        return rows.join(ids.select(F.col(id_name).alias(other)).distinct(), key.eqNullSafe(F.col(other)), "left_semi")
    return split_by_id(rows, key, ids, id_name)[1]
