"""Token ids as Parquet list columns, readable in part.

Layout of a store: `<path>/data` holds one row per document in ascending id order
(`doc_id`, `part`, `start_in_part`, `n_tokens`, `tokens array<int>`); `<path>/manifest`
has one row per data file with its first token's place in the whole stream. Token pages
are dictionary-coded (a vocabulary fits one dictionary page), the ascending columns are
delta-coded (format version 2), row groups hold about `row_group_mb`, pages carry column
and offset indexes. So ids, lengths and offsets are read without touching a token, and a
range of documents or of the stream reads only its pages.

Defined results: a null or empty text has only the end id; equal ids keep all their rows,
ordered by a hash of the text, and rows without an id come first; a very long text is encoded in
one worker and is one row; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.arrow import prepare, tidy
from quillstone.llm.encode import Encoder, encoder, packed

DATA_SCHEMA = "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, tokens array<int>"
#: Texts encoded at once.
STEP_BYTES = 1 << 20


def text_steps(column: pa.Array, size: int = STEP_BYTES) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of runs of about `size` bytes; nulls are empty."""
    begin, texts, held = 0, [], 0
    for i, t in enumerate(column):
        t = t.as_py() or ""
        texts.append(t)
        held += len(t)
        if held >= size:
            yield begin, texts
            begin, texts, held = i + 1, [], 0
    if texts:
        yield begin, texts


def encoded(enc: Encoder, texts: list[str], end_id: int) -> tuple[bytes, np.ndarray]:
    """All ids of the texts, each with `end_id` behind it, as unsigned 32-bit integers, and where each text begins (n + 1)."""
    end = packed([end_id])
    parts = [enc.encode(t) + end for t in texts]
    return b"".join(parts), np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)])


def id_lists(ids: bytes, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.Array.from_buffers(pa.int32(), len(ids) // 4, [None, pa.py_buffer(ids)]))


def write_store(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, row_group_mb: int = 32, page_kb: int = 128) -> None:
    """Encode all texts and write a store at `path`."""
    spark = docs.sparkSession
    prepare(spark)
    placed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, place = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in text_steps(batch.column(1)):
                ids, bounds = encoded(enc, texts, end_id)
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(np.full(n, part, dtype=np.int32)),
                        pa.array(bounds[:-1] + place),
                        pa.array(np.diff(bounds)),
                        id_lists(ids, bounds),
                    ],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "tokens"],
                )
                place += int(bounds[-1])

    options = {
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.block.size": str(row_group_mb << 20),
        "parquet.page.size": str(page_kb << 10),
        "parquet.dictionary.page.size": str(2 << 20),
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#start_in_part": "false",
    }
    placed.mapInArrow(tidy(run), DATA_SCHEMA).write.options(**options).parquet(f"{path}/data")
    ends = spark.read.schema(DATA_SCHEMA).parquet(f"{path}/data").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per data file
    ends.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("bigint")).select("part", "base", "n_tokens", "n_docs", "first_id", "last_id").coalesce(1).write.parquet(f"{path}/manifest")


def read_store(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, if asked for, tokens. Without tokens their pages aren't read."""
    data = spark.read.schema(DATA_SCHEMA).parquet(f"{path}/data")
    base = F.broadcast(spark.read.parquet(f"{path}/manifest").select("part", "base"))  # a row per data file
    return data.join(base, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", *(["tokens"] if tokens else []))


def read_documents(spark: SparkSession, path: str, first_id: int, last_id: int, tokens: bool = True) -> DataFrame:
    """Documents of an id range: other row groups and pages are skipped."""
    return read_store(spark, path, tokens).where(F.col("doc_id").between(first_id, last_id))


def read_stream(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """The rows that hold tokens [start, start + length) of the stream, cut to it."""
    manifest = spark.read.parquet(f"{path}/manifest").where((F.col("base") < start + length) & (F.col("base") + F.col("n_tokens") > start)).select("part", "base")
    first, last = manifest.agg(F.min("part"), F.max("part")).first()
    if first is None:
        return spark.createDataFrame([], "doc_id bigint, start bigint, tokens array<int>")
    # the numbers of the first and last file let the scan skip the row groups of all others
    rows = spark.read.schema(DATA_SCHEMA).parquet(f"{path}/data").where(F.col("part").between(first, last)).join(F.broadcast(manifest), "part")
    begin = F.col("base") + F.col("start_in_part")
    rows = rows.where((begin < start + length) & (begin + F.col("n_tokens") > start))
    skip = F.greatest(F.lit(0).cast("bigint"), start - begin)
    take = F.least(F.col("n_tokens"), start + length - begin) - skip
    return rows.select("doc_id", (begin + skip).alias("start"), F.slice("tokens", (skip + 1).cast("int"), take.cast("int")).alias("tokens"))


def crc_of_lists(column: pa.Array) -> pa.Array:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    ends = np.cumsum(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64))
    view, out, a = memoryview(flat.tobytes()), [], 0
    for b in ends.tolist():
        out.append(zlib.crc32(view[4 * a : 4 * b]))
        a = b
    return pa.array(out, pa.int64())


def checksums(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what a store holds."""
    prepare(store.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), crc_of_lists(b.column(3))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return store.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(tidy(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
