"""Small helpers around mapInArrow."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.runtime import ship

#: Texts handed to a Python worker at once, in bytes and rows.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4000


def prepare(spark: SparkSession) -> None:
    """Ship the code and bound Arrow batches by bytes, so that long texts don't pile up in a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def private(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def trim() -> None:
    """Give freed memory back to the system: idle workers of earlier stages share the machine with later ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back by hand
        return


def tidy(run: Callable) -> Callable:
    """A mapInArrow function that leaves its worker small."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow where `fn` yields dicts of columns for each incoming batch."""
    prepare(df.sparkSession)
    names = [f.split(":")[0].split()[0].strip("`") for f in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in fn(batch):
                    yield pa.RecordBatch.from_arrays([_array(out[n]) for n in names], names=names)

    return df.mapInArrow(tidy(run), schema)


def _fields(schema: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def _array(x) -> pa.Array:
    if isinstance(x, pa.Array):
        return x
    if isinstance(x, np.ndarray):
        return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)
    return pa.array(x)


def by_key(df: DataFrame, keys: list[str], fn: Callable[[tuple, pa.Table], Iterator[dict]], schema: str) -> DataFrame:
    """Apply `fn` to the rows of each key, one key at a time; integer keys without nulls.

    Keys must be made so that a key's rows are bounded. A shuffle brings them together and
    a worker holds one key's rows.
    """
    prepare(df.sparkSession)
    names = [f.split(":")[0].split()[0].strip("`") for f in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, dtype=bool)
            change[0] = True
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(change).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                now = tuple(int(c[a]) for c in columns)
                if now != key and held:
                    yield from finish(key, held)
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            yield from finish(key, held)

    def finish(key: tuple, held: list) -> Iterator[pa.RecordBatch]:
        for out in fn(key, pa.Table.from_batches(held)):
            yield pa.RecordBatch.from_arrays([_array(out[n]) for n in names], names=names)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), schema)


RUNS = "array<struct<at:bigint,upto:bigint>>"


def merged_runs(runs: Column) -> Column:
    """Runs [at, upto) of each row in order, those that meet or overlap as one; null stays null."""

    @F.arrow_udf(RUNS)
    def merge(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        at, upto = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("at", "upto"))
        sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((upto, at, row))
        at, upto, row = at[order], upto[order], row[order]
        # the largest end so far in the row: rows are set apart by more than any end
        far = int(upto.max(initial=0)) + 1
        reach = np.maximum.accumulate(upto + row * far) - row * far
        new = np.ones(len(at), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] > reach[:-1])
        heads = np.flatnonzero(new)
        tails = np.concatenate([heads[1:], [len(at)]]) - 1 if len(heads) else heads
        offsets = np.searchsorted(row[heads], np.arange(len(sizes) + 1)).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(at[heads]), pa.array(reach[tails])], names=["at", "upto"])
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(np.asarray(column.is_null())) if column.null_count else None)

    return merge(runs)
