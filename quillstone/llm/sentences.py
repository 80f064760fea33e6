"""Substring dedup on sliding sentence spans.

A sentence ends at a line break, or at `.`, `!` or `?` before white space; its words are runs of
letters and digits, ASCII case folded. From every sentence a span runs over the next ones until
it has `SENTENCES` sentences and `LEAST_WORDS` words, or, with `PAIR` sentences already, `ENOUGH_WORDS`
words; so it always has several sentences. Spans are hashed (64 bits) and joined over the whole
table; the first occurrence by (id, place) stays and every sentence under any other occurrence
goes. Repeats within one text count too.

One scan makes the spans; the least occurrence per hash is an aggregation with partial
results, written out, and spans that may have such a hash are joined with it, split by Spark
where a hash is very common.

Defined results: a null, empty or wordless text has no sentences; texts too short for a span
are kept; rows that share an id count as one document, the second row's repeats go only from the
place of its own sentences, and rows equal in id and text are one text, which doesn't repeat itself;
rows without an id are kept whole and remove nothing; a very long text is cut into sentences
in one worker; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import bloom
from quillstone.llm.arrow import map_batches, merged_runs, prepare, private
from quillstone.llm.kernel import ALNUM_WORDS, SPACE_WORDS, Chunk, chunks, mix, powers, prefix_hash, span_hash
from quillstone.runtime import settle

SENTENCES, LEAST_WORDS, PAIR, ENOUGH_WORDS = 3, 10, 2, 24


class Sentences:
    """Sentences of a chunk: text index, byte range (first to last word), and cumulative words; plus word hashes."""

    __slots__ = ("doc", "edges", "end", "start", "words")

    def __init__(self, chunk: Chunk):
        data = chunk.data
        starts, ends, first = chunk.words(ALNUM_WORDS)
        stop = np.zeros(len(data) + 1, dtype=np.int64)
        if len(data):
            point = (data == 0x2E) | (data == 0x21) | (data == 0x3F)
            blank = ~SPACE_WORDS[data]
            stop[1:-1] = point[:-1] & blank[1:]
            stop[1:] |= data == 0x0A
            stop[chunk.bounds] = 1
        number = np.cumsum(stop)[starts]
        new = np.concatenate([[True], number[1:] != number[:-1]]) if len(number) else np.zeros(0, dtype=bool)
        heads = np.flatnonzero(new)
        self.edges = np.concatenate([heads, [len(starts)]])
        self.start = starts[heads]
        self.end = ends[self.edges[1:] - 1] if len(heads) else starts
        self.doc = np.searchsorted(first, heads, "right") - 1
        self.words = span_hash(prefix_hash(data, fold=True), starts, ends)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First sentence, past last sentence and hash of every span."""
        n = len(self.doc)
        if not n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        i = np.arange(n)
        begun = self.edges[:-1]
        # the first sentence whose end brings the words to a number
        reach = lambda w: np.searchsorted(self.edges, begun + w, "left")
        upto = np.minimum(np.maximum(i + SENTENCES, reach(LEAST_WORDS)), np.maximum(i + PAIR, reach(ENOUGH_WORDS)))
        inside = upto <= n
        inside[inside] = self.doc[upto[inside] - 1] == self.doc[i[inside]]
        i, upto = i[inside], upto[inside]
        # hashes of word runs, by the same prefix sums as for bytes
        up, down = powers(len(self.words) + 1)
        prefix = np.zeros(len(self.words) + 1, dtype=np.uint64)
        np.cumsum(mix(self.words) * up[:-1], out=prefix[1:], dtype=np.uint64)
        a, b = self.edges[i], self.edges[upto]
        return i, upto, mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64))


_SPANS = "kind int, id bigint, tie bigint, place bigint, many int, h bigint"


def spans_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Kind 0: a text and its number of sentences (`place`). Kind 1: a span's first sentence, length and hash."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, ties = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for c in chunks(batch.column(1)):
            s = Sentences(c)
            first = np.searchsorted(s.doc, np.arange(len(c) + 1))
            i, upto, h = s.spans()
            row, rows = s.doc[i], np.arange(len(c))
            both = c.first + np.concatenate([rows, row])
            yield {
                "kind": np.repeat(np.array([0, 1], dtype=np.int32), [len(rows), len(row)]),
                "id": ids[both],
                "tie": ties[both],
                "place": np.concatenate([np.diff(first), i - first[row]]),
                "many": np.concatenate([np.zeros(len(rows)), upto - i]).astype(np.int32),
                "h": np.concatenate([np.zeros(len(rows), dtype=np.uint64), h]),
            }

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie")).where("id is not null"), run, _SPANS)


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tie (hash of the text), n_sentences and runs [first, past last) of sentences to remove."""
    found = settle(spans_of(docs, id_col, text_col), "spans", compression="zstd")
    spans = found.where("kind = 1").select("h", "id", "tie", "place", "many")
    least = settle(spans.groupBy("h").agg(F.min(F.struct("id", "place", "tie")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first"), "least")
    again = bloom.among(spans, F.col("h"), least, "h").join(least, "h").where(F.struct("id", "place", "tie") > F.col("first"))
    merged = merged_runs(F.collect_list(F.struct(F.col("place").alias("at"), (F.col("place") + F.col("many")).alias("upto"))))
    cut = again.groupBy("id", "tie").agg(merged.alias("runs"))
    texts = found.where("kind = 0").select("id", "tie", F.col("place").alias("n_sentences"))
    return texts.join(cut, ["id", "tie"], "left")


def summarise(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    runs = F.coalesce("runs", F.expr("cast(array() as array<struct<at:bigint,upto:bigint>>)"))
    lost = F.aggregate(runs, F.lit(0).cast("bigint"), lambda a, r: a + r["upto"] - r["at"])
    said = F.array_join(F.transform(runs, lambda r: F.concat_ws("-", r["at"].cast("string"), r["upto"].cast("string"))), ",")
    return found.select(F.col("id").alias(id_col), "n_sentences", lost.alias("n_removed"), F.size(runs).cast("bigint").alias("n_runs"), said.alias("removed_runs"), (lost > 0).alias("has_repeats"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows, repeated sentences cut from their texts; other columns unchanged."""
    prepare(docs.sparkSession)
    key, tie, cut_runs = private("id"), private("tie"), private("runs")
    cut = settle(repeated_sentences(docs, id_col, text_col).where("runs is not null").select(F.col("id").alias(key), F.col("tie").alias(tie), F.col("runs").alias(cut_runs)).distinct(), "cut")
    clear, doubtful = bloom.split_by_id(docs, F.col(id_col), cut, key)

    @F.arrow_udf("string")
    def kept(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = [t.as_py() for t in texts]
        for c in chunks(texts):
            s = Sentences(c)
            first = np.searchsorted(s.doc, np.arange(len(c) + 1))
            for i in range(len(c)):
                own = runs[c.first + i].as_py()
                if own and out[c.first + i] is not None:
                    raw, parts, at = c.data[c.bounds[i] : c.bounds[i + 1]].tobytes(), [], 0
                    begins = s.start[first[i] : first[i + 1]] - c.bounds[i]
                    for r in own:  # from a sentence's first word to the first word after the run
                        parts.append(raw[at : begins[r["at"]]])
                        at = int(begins[r["upto"]]) if r["upto"] < len(begins) else len(raw)
                    out[c.first + i] = b"".join([*parts, raw[at:]]).decode("utf-8", "ignore")
        return pa.array(out, pa.string())

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    met = doubtful.join(cut, (F.col(id_col).cast("bigint") == F.col(key)) & (F.xxhash64(text) == F.col(tie)), "left")
    return clear.unionByName(met.withColumn(text_col, kept(F.col(text_col).cast("string"), F.col(cut_runs))).select(docs.columns))
