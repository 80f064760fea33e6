"""Best-fit packing of tokenised documents into sequences of one capacity.

Documents longer than the capacity are cut into full pieces and a remainder; everything
else stays whole. Only the number of pieces of each length (at most `capacity` rows)
reaches the driver, where `binpack` solves it; each piece then finds its place from its
rank among the pieces of its length. Ranks come from counts per input partition, so no
length, however common, is gathered in one task.

Defined results: a null or empty text has only the end id and is a piece of length 1;
equal ids and equal texts are all packed, and so are rows without an id; a very long text
is encoded in one worker and cut; an empty table packs nothing; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.arrow import prepare, tidy
from quillstone.llm.binpack import pack as pack_counts
from quillstone.llm.encode import encoder
from quillstone.llm.tokens import encoded, id_lists, text_steps
from quillstone.runtime import settle

CAPACITY = 2048
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, tokens: bool = False) -> DataFrame:
    """Pieces of at most `capacity` tokens; `nth` counts those of its length in its partition."""
    prepare(docs.sparkSession)
    names = [f.split()[0] for f in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for first, texts in text_steps(batch.column(1)):
                ids, bounds = encoded(enc, texts, end_id)
                sizes = np.diff(bounds)
                number = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), number)
                piece = np.arange(len(doc)) - (np.cumsum(number) - number)[doc]
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                raw = memoryview(ids)
                place = bounds[:-1][doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(place.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                run_start = np.searchsorted(length[order], length[order], "left")
                nth = np.empty(len(length), dtype=np.int64)
                nth[order] = np.arange(len(length)) - run_start + seen[length[order]]
                np.add.at(seen, length, 1)
                columns = [batch.column(0).slice(first, len(texts)).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, dtype=np.int32)), pa.array(nth)]
                if tokens:  # the pieces cover the ids in order
                    columns.append(id_lists(ids, np.concatenate([place, bounds[-1:]])))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *["tokens"] * tokens])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), _PIECES + ", tokens array<int>" * tokens)


class Places:
    """For each length and rank the sequence and offset that a packing gives it."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], capacity: int):
        entries: dict[int, list] = {}
        sequence = 0
        for pattern, times in patterns:
            ordered = sorted(pattern, reverse=True)
            starts = np.concatenate([[0], np.cumsum(ordered)]).tolist()
            for length, copies in Counter(ordered).items():
                entries.setdefault(length, []).append((copies * times, sequence, copies, starts[ordered.index(length)]))
            sequence += times
        self.sequences = sequence
        rows = [(length, *x) for length in sorted(entries) for x in entries[length]]
        self.table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        # ranks of all lengths on one line: those of length l begin at first[l]
        ends = np.cumsum(self.table[:, 1])
        self.begins = ends - self.table[:, 1]
        self.first = np.zeros(capacity + 1, dtype=np.int64)
        lengths, at = np.unique(self.table[:, 0], return_index=True)
        self.first[lengths] = self.begins[at]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        line = self.first[length] + rank
        row = np.searchsorted(self.begins, line, "right") - 1
        _, _, sequence, copies, offset = self.table[row].T
        within = line - self.begins[row]
        return sequence + within // copies, offset + within % copies * length


def assign(cut: DataFrame, capacity: int = CAPACITY, nodes: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to settled pieces, and beside each row the number of sequences and its lower bound."""
    spark = cut.sparkSession
    counts = settle(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[r.length] = r.n
    solved = pack_counts(histogram, capacity, nodes)
    held = spark.sparkContext.broadcast(Places(solved.patterns, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("base"))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "part", "nth")
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = held.value.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    placed = ranked.mapInArrow(tidy(run), f"{schema}, sequence_id bigint, offset bigint")
    return placed.withColumns({"n_sequences": F.lit(solved.bins).cast("bigint"), "least_sequences": F.lit(solved.bins if solved.proven else solved.bound).cast("bigint")})


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, tokens: bool = False, nodes: int = 20_000) -> DataFrame:
    """Pieces with their ids' checksum (and the ids), sequence and place in it; `n_sequences` of all and their lower bound."""
    cut = settle(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, tokens), "pieces", compression="zstd")
    placed = assign(cut, capacity, nodes)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "n_sequences", "least_sequences", *["tokens"] * tokens)
