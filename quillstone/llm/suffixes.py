"""Removal of repeated byte strings by longest-previous-factor arrays over buckets of suffixes.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document with a
smaller id: that is, if a suffix whose longest previous factor (the longest prefix that also
begins a suffix of a smaller id) has `LENGTH` bytes or more begins at most that far before it.
One suffix array of the whole corpus would be many times its size, so suffixes are first
dealt into buckets that strings with `LENGTH` equal bytes always share:

1. Every window of `LENGTH` bytes is named by its anchor, the least hash among its grams of
   `GRAM` bytes. Consecutive windows with one anchor make a stretch. One scan deals stretches
   (hash of the anchor, hash of the stretch) out by anchor. Equal stretches are stood for by the
   one with the least id; all bytes of the others are its copy (inside a block of texts at once).
2. Where an anchor has several different stretches, the bucket asks for the bytes of the first
   of each.
3. Those strings meet by anchor. Their suffixes are sorted; previous and next smaller positions
   (the nearest suffixes in order that a smaller id owns) with the common prefixes up to them give
   the longest previous factors, and those of `LENGTH` or more mark their bytes.
   Strings of an anchor with more than `CROWD` different stretches (the ends of a very common
   passage) stay packed, a row for each text. Their windows, stretches of one window, are dealt and
   judged like those of step 1, so a very common window is one entry for each block of texts.
4. Marked spans are merged per document and cut from its text.

Equal stretches are told by 84 bits of hashes (44 of the anchor, 40 of the stretch; for windows of
crowded anchors 44 of both, 40 of the window); all others by their bytes.

Defined results: a null or empty text has no bytes and keeps none; matches never cross
documents nor count within one; rows that share an id don't remove from each other; rows
without an id are kept whole and remove nothing; a text of more than `SEGMENT` bytes is read in
overlapping segments; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import bloom
from quillstone.llm.arrow import by_key, map_batches, merged_runs, prepare, tidy
from quillstone.llm.kernel import Chunk, chunks, mix, powers, prefix_hash, span_hash
from quillstone.runtime import settle

LENGTH, GRAM = 50, 24
CROWD = 2000
BLOCK_STRETCHES, BLOCK_TEXTS, BUCKET_STRETCHES, BUCKET_STRINGS, BUCKET_WINDOWS = 1_000_000, 20_000, 1_000_000, 50_000, 200_000
#: Bytes of a long text that are read at once.
SEGMENT = 4 << 20
_POSITION = np.uint64((1 << 24) - 1)
_LOW32, _LOW40 = np.uint64(0xFFFFFFFF), np.uint64((1 << 40) - 1)


def segments(column: pa.Array, length: int) -> Iterator[tuple[Chunk, int]]:
    """Runs of whole texts, and long texts in parts that share `length` - 1 bytes; where in its text a part begins."""
    for c in chunks(column):
        if len(c.data) <= SEGMENT + length:
            yield c, 0
            continue
        for i in range(len(c)):
            a, b = int(c.bounds[i]), int(c.bounds[i + 1])
            for s in range(a, max(b, a + 1), SEGMENT):
                part = c.data[s : min(b, s + SEGMENT + length - 1)]
                yield Chunk(part, np.array([0, len(part)]), c.first + i), s - a


class Stretches:
    """Stretches of a chunk: text index, first and last window start, anchor and stretch hashes."""

    __slots__ = ("anchor", "doc", "first", "last", "prefix", "whole")

    def __init__(self, chunk: Chunk, length: int = LENGTH, gram: int = GRAM):
        data, n = chunk.data, len(chunk.data)
        self.prefix = prefix_hash(data)
        if n < length:
            self.doc = self.first = self.last = np.zeros(0, dtype=np.int64)
            self.anchor = self.whole = np.zeros(0, dtype=np.uint64)
            return
        _, down = powers(n + 1)
        grams = mix((self.prefix[gram:] - self.prefix[:-gram]) * down[: n - gram + 1])
        width = length - gram + 1
        least = (grams & ~_POSITION) | (np.arange(len(grams), dtype=np.uint64) & _POSITION)
        size = 1
        while 2 * size <= width:  # minima of runs of 2, 4, 8, .. grams
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if width > size:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        starts = np.arange(len(least), dtype=np.int64)
        at = starts + ((least & _POSITION).astype(np.int64) - starts) % (1 << 24)
        valid = np.ones(len(least) + length, dtype=bool)
        inner = chunk.bounds[1:-1]
        if len(inner):
            across = (inner[:, None] - np.arange(1, length)[None, :]).ravel()
            valid[across[across >= 0]] = False
        valid = valid[: len(least)]
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        ends = valid.copy()
        ends[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
        self.first, self.last = np.flatnonzero(begins), np.flatnonzero(ends)
        self.doc = np.searchsorted(chunk.bounds, self.first, "right") - 1
        place = at[self.first]
        self.anchor = grams[place]
        self.whole = (span_hash(self.prefix, self.first, self.last + length) ^ mix((place - self.first).astype(np.uint64))) & _LOW40


def pair_code(anchor: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A name for an anchor with its stretch."""
    return mix(mix(anchor & _LOW32) + (whole << np.uint64(20)) + (anchor >> np.uint64(52)))


_DEALT = "bucket bigint, block bigint, kind int, ids binary, sizes binary, a binary, c binary"
_NAMES = [f.split()[0] for f in _DEALT.split(", ")]
SETTLED, ASKED, CROWDED = 0, 1, 2


def _row(bucket: int, block: int, kind: int, doc: np.ndarray, a: bytes, c: bytes) -> tuple:
    """`doc` (ascending ids, one per entry) is packed as ids and counts."""
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(doc)]]))
    return bucket, block, kind, doc[starts].astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), a, c


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def _planes(v: np.ndarray) -> bytes:
    return (v & _LOW32).astype("<u4").tobytes() + (v >> np.uint64(32)).astype(np.uint8).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | (np.frombuffer(data, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32))


#: Ids, anchors and hashes of stretches of a batch, and how many texts they are from.
Parts = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]]


def stretches_of(length: int, gram: int) -> Parts:
    """All stretches of texts (id, text)."""

    def fn(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for chunk, _ in segments(batch.column(1), length):
            s = Stretches(chunk, length, gram)
            yield ids[chunk.first + s.doc], s.anchor, s.whole, len(chunk)

    return fn


def windows_of(length: int) -> Parts:
    """All windows of packed strings (id, body), as stretches of one window."""

    def fn(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        row, _, anchor, whole = packed_windows(batch.column(1), length)
        yield batch.column(0).to_numpy(zero_copy_only=False)[row], anchor, whole, batch.num_rows

    return fn


def pack_strings(data: np.ndarray, first: np.ndarray, upto: np.ndarray, base: int, anchor: np.ndarray) -> bytes:
    """Strings [first, upto) of a text as one value: places in the text, anchors, sizes, bytes."""
    head = (np.array([len(first)]), first - base, anchor.view(np.int64))
    return b"".join([*(x.astype("<i8").tobytes() for x in head), (upto - first).astype("<u4").tobytes(), *(data[a:b].tobytes() for a, b in zip(first.tolist(), upto.tolist(), strict=True))])


def packed_windows(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of packed strings in order: row, place in the text, anchor (of the string's anchor with the window), hash."""
    parts = []
    for b in column.to_pylist():
        n = int(np.frombuffer(b, "<i8", 1)[0])
        parts.append((np.frombuffer(b, "<i8", n, 8), np.frombuffer(b, "<u8", n, 8 + 8 * n), np.frombuffer(b, "<u4", n, 8 + 16 * n), np.frombuffer(b, np.uint8, -1, 8 + 20 * n)))
    first, anchor, size, data = (np.concatenate(x) for x in zip(*parts, strict=True))
    row, size = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts]), size.astype(np.int64)
    n = size - length + 1
    string = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[string] + within
    name = span_hash(prefix_hash(data), at, at + length)
    return row[string], first[string] + within, mix(name ^ mix(anchor)[string]), name & _LOW40


def deal(rows: DataFrame, parts: Parts, buckets: int) -> DataFrame:
    """Stretches by bucket of their anchor; repeats inside a block are settled at once (negative buckets, spread over many)."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = texts = 0

        def flush() -> Iterator[pa.RecordBatch]:
            name = (task << 32) | block
            doc, a, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, c, a))
            doc, a, c = doc[order], a[order], c[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            again = np.concatenate([[False], (doc[1:] == doc[:-1]) & ~new[1:]])
            late = (doc > least) & ~again
            if late.any():
                d, code = doc[late], pair_code(a[late], c[late])
                o = np.argsort(d, kind="stable")
                yield _batch([_row(-1 - (task * 31 + block) % 4096, name, SETTLED, d[o], code[o].astype("<u8").tobytes(), b"")])
            doc, a, c = doc[new], a[new], c[new]
            bucket = (mix(a) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((doc, bucket))
            doc, a, c = doc[order], a[order], c[order]
            bucket = bucket[order]
            heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            out = []
            for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)], strict=True):
                s, b = slice(x, y), int(bucket[x])
                # the anchor's top bits ride with its low ones, so that its code can be made again
                out.append(_row(b, name, 0, doc[s], (a[s] & _LOW32).astype("<u4").tobytes() + (a[s] >> np.uint64(52)).astype("<u2").tobytes(), _planes(c[s])))
                if len(out) == 8:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

        for batch in batches:
            for doc, anchor, whole, n in parts(batch) if batch.num_rows else ():
                held.append((doc, anchor, whole))
                count, texts = count + len(doc), texts + n
                if count >= BLOCK_STRETCHES or texts >= BLOCK_TEXTS:
                    if count:
                        yield from flush()
                    block += 1
                    held, count, texts = [], 0, 0
        if count:
            yield from flush()

    return rows.mapInArrow(tidy(run), _DEALT)


def judge_bucket(crowd: int):
    """Which stretches stand in an earlier document, and which strings are to be compared."""

    def fn(key: tuple, table: pa.Table) -> Iterator[dict]:
        if key[0] < 0:
            for i in range(table.num_rows):
                yield {n: table.slice(i, 1).column(n).combine_chunks() for n in _NAMES}
            return
        rows = table.select(["block", "ids", "sizes", "a", "c"]).to_pylist()
        counts = [np.frombuffer(r["sizes"], "<u4").astype(np.int64) for r in rows]
        doc = np.concatenate([np.repeat(np.frombuffer(r["ids"], "<i8"), n) for r, n in zip(rows, counts, strict=True)])
        totals = np.array([n.sum() for n in counts])
        a = np.concatenate([np.frombuffer(r["a"], "<u4", n).astype(np.uint64) | (np.frombuffer(r["a"], "<u2", n, 4 * n).astype(np.uint64) << np.uint64(52)) for r, n in zip(rows, totals.tolist(), strict=True)])
        c = np.concatenate([_unplanes(r["c"]) for r in rows])
        source = np.repeat(np.arange(len(rows)), totals)
        order = np.lexsort((doc, c, a))
        doc, a, c, source = doc[order], a[order], c[order], source[order]
        new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
        new_pair = new_anchor | np.concatenate([[True], c[1:] != c[:-1]])
        pair, anchor = np.cumsum(new_pair) - 1, np.cumsum(new_anchor) - 1
        least = doc[new_pair][pair]
        starts = np.flatnonzero(new_anchor)
        variants = np.add.reduceat(new_pair.astype(np.int64), starts)[anchor]
        mixed = (np.maximum.reduceat(doc, starts) > np.minimum.reduceat(doc, starts))[anchor]
        first = new_pair & (variants > 1) & mixed
        code = pair_code(a, c)
        for kind, chosen in ((SETTLED, doc > least), (ASKED, first & (variants <= crowd)), (CROWDED, first & (variants > crowd))):
            some = np.flatnonzero(chosen)
            some = some[np.lexsort((doc[some], source[some]))]
            edges = np.searchsorted(source[some], np.arange(len(rows) + 1))
            for i in np.flatnonzero(np.diff(edges)).tolist():
                own = some[edges[i] : edges[i + 1]]
                values = _row(key[0], rows[i]["block"], kind, doc[own], code[own].astype("<u8").tobytes(), b"")
                yield {n: pa.array([v], table.schema.field(n).type) for n, v in zip(_NAMES, values, strict=True)}

    return fn


def by_document(key: tuple, table: pa.Table) -> Iterator[dict]:
    """A block's answers per document id: codes of each kind."""
    ids, kinds, codes = [], [], []
    for r in table.select(["kind", "ids", "sizes", "a"]).to_pylist():
        n = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
        ids.append(np.repeat(np.frombuffer(r["ids"], "<i8"), n))
        kinds.append(np.full(len(ids[-1]), r["kind"]))
        codes.append(np.frombuffer(r["a"], "<u8"))
    doc, kind, code = np.concatenate(ids), np.concatenate(kinds), np.concatenate(codes)
    order = np.lexsort((kind, doc))
    doc, kind, code = doc[order], kind[order], code[order]
    names = np.unique(doc)
    step = 2000
    for i in range(0, len(names), step):
        part = names[i : i + step]
        out = {"id": pa.array(part)}
        for k, name in ((SETTLED, "settled"), (ASKED, "asked"), (CROWDED, "crowded")):
            own = kind == k
            edges_from = np.searchsorted(doc[own], part, "left")
            edges_to = np.searchsorted(doc[own], part, "right")
            values = code[own]
            out[name] = pa.array([values[x:y].tobytes() for x, y in zip(edges_from.tolist(), edges_to.tolist(), strict=True)], pa.binary())
        yield out


_ANSWERS = "id bigint, settled binary, asked binary, crowded binary"
_MARKS = "kind int, id bigint, tie bigint, g bigint, at bigint, upto bigint, body binary"


def mark(length: int, gram: int):
    """For texts with answers: settled spans (kind 0), strings to compare (1), all strings of crowded anchors in one row (2; `upto` counts their windows)."""

    def fn(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, ties = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        answers = [[np.frombuffer(x or b"", "<u8") for x in batch.column(k).to_pylist()] for k in (3, 4, 5)]
        for chunk, shift in segments(batch.column(1), length):
            s = Stretches(chunk, length, gram)
            code = pair_code(s.anchor, s.whole)
            edges = np.searchsorted(s.doc, np.arange(len(chunk) + 1))
            kinds = np.zeros((3, len(code)), dtype=bool)
            for i in range(len(chunk)):
                part = slice(edges[i], edges[i + 1])
                for k in range(3):
                    wanted = answers[k][chunk.first + i]
                    if len(wanted):
                        kinds[k, part] = np.isin(code[part], wanted)
            base = chunk.bounds[s.doc] - shift
            row = chunk.first + s.doc
            out: dict[str, list] = {n.split()[0]: [] for n in _MARKS.split(", ")}

            def add(kind: int, pick: np.ndarray, g: np.ndarray, at: np.ndarray, upto: np.ndarray, body: list) -> None:
                for n, v in zip(out, (np.full(len(at), kind, dtype=np.int32), ids[row[pick]], ties[row[pick]], g, at, upto), strict=False):
                    out[n].append(v)
                out["body"].append(pa.array(body, pa.binary()))

            whole = np.flatnonzero(kinds[0])
            if len(whole):  # neighbouring settled stretches overlap: one span for each run
                a, b = s.first[whole], s.last[whole] + length
                new = np.concatenate([[True], (a[1:] > b[:-1]) | (s.doc[whole][1:] != s.doc[whole][:-1])])
                heads = np.flatnonzero(new)
                tails = np.concatenate([heads[1:] - 1, [len(a) - 1]])
                pick = whole[heads]
                add(0, pick, np.zeros(len(pick), dtype=np.int64), a[heads] - base[pick], b[tails] - base[pick], [None] * len(pick))
            pick = np.flatnonzero(kinds[1] & ~kinds[0])
            if len(pick):
                raw = chunk.data
                add(1, pick, s.anchor[pick].view(np.int64), s.first[pick] - base[pick], s.last[pick] + length - base[pick], [raw[a:b].tobytes() for a, b in zip(s.first[pick].tolist(), (s.last[pick] + length).tolist(), strict=True)])
            pick = np.flatnonzero(kinds[2] & ~kinds[0])
            if len(pick):
                texts = np.split(pick, np.flatnonzero(np.diff(s.doc[pick])) + 1)
                bodies = [pack_strings(chunk.data, s.first[t], s.last[t] + length, int(base[t[0]]), s.anchor[t]) for t in texts]
                heads, none = np.array([t[0] for t in texts]), np.zeros(len(texts), dtype=np.int64)
                add(2, heads, none, none, np.array([int((s.last[t] - s.first[t] + 1).sum()) for t in texts]), bodies)
            if out["kind"]:
                done = {n: pa.array(np.concatenate(v)) for n, v in out.items() if n != "body"}
                yield done | {"body": pa.concat_arrays(out["body"])}

    return fn


def nearest_smaller(owner: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place the least of `common` back to the nearest place before with a smaller owner; 0 without one.

    `common[i]` belongs to places i - 1 and i. All places leap at once, each over what the place it has reached
    has already leapt over, so few rounds do.
    """
    n = len(owner)
    at, least = np.arange(-1, n - 1), common.astype(np.int64)
    open_ = np.flatnonzero(at >= 0)
    while len(open_ := open_[owner[at[open_]] >= owner[open_]]):
        to = at[open_]
        least[open_] = np.minimum(least[open_], least[to])
        at[open_] = at[to]
        open_ = open_[at[open_] >= 0]
    return np.where(at >= 0, least, 0)


def longest_previous(words: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix: how many of its bytes also begin a suffix of a smaller owner.

    `words` holds the suffixes as big-endian 64-bit columns, padded with zeros, `size` their lengths.
    """
    n = len(owner)
    order = np.lexsort((size, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1))))
    ordered, who, length = words[order], owner[order], size[order]
    differs = ordered[1:] != ordered[:-1]
    some = differs.any(axis=1)
    column = differs.argmax(axis=1)
    rows = np.flatnonzero(some)
    difference = ordered[1:][rows, column[rows]] ^ ordered[:-1][rows, column[rows]]
    common = np.zeros(n + 1, dtype=np.int64)  # bytes that neighbours share
    common[1:n] = 8 * words.shape[1]
    leading = np.zeros(len(rows), dtype=np.int64)
    for bits in (56, 48, 40, 32, 24, 16, 8):
        leading += (difference >> np.uint64(bits)) == 0
    common[1 + rows] = 8 * column[rows] + leading
    common[1:n] = np.minimum(common[1:n], np.minimum(length[1:], length[:-1]))
    before = nearest_smaller(who, common[:n])
    after = nearest_smaller(who[::-1], common[1:][::-1])[::-1]
    out = np.empty(n, dtype=np.int64)
    out[order] = np.maximum(before, after)
    return out


_HITS = "id bigint, tie bigint, at bigint, upto bigint"


def compare_strings(length: int):
    """Spans of strings whose suffixes have a longest previous factor of `length` or more."""

    def fn(key: tuple, table: pa.Table) -> Iterator[dict]:
        ids, ties, at = (table.column(n).to_numpy() for n in ("id", "tie", "at"))
        bodies = table.column("body").combine_chunks()
        bodies = bodies.chunk(0) if isinstance(bodies, pa.ChunkedArray) else bodies
        bounds = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
        data = np.frombuffer(bodies.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        n = np.diff(bounds) - length + 1
        string = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
        size = (bounds[1:] - bounds[:-1])[string] - within
        columns = -(-int(size.max()) // 8)
        padded = np.concatenate([data, np.zeros(8 * columns, dtype=np.uint8)])
        matrix = np.lib.stride_tricks.sliding_window_view(padded, 8 * columns)[bounds[string] + within]
        matrix[np.arange(8 * columns)[None, :] >= size[:, None]] = 0  # bytes behind the string aren't the suffix's
        factor = longest_previous(matrix.view(">u8").astype(np.uint64), size, ids[string])
        hit = np.flatnonzero(factor >= length)
        if len(hit):
            s, a = string[hit], at[string[hit]] + within[hit]
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (a[1:] > a[:-1] + length)])
            heads = np.flatnonzero(new)
            tails = np.concatenate([heads[1:] - 1, [len(s) - 1]])
            yield {"id": pa.array(ids[s[heads]]), "tie": pa.array(ties[s[heads]]), "at": pa.array(a[heads]), "upto": pa.array(a[tails] + length)}

    return fn


def settled_windows(length: int):
    """Spans of packed strings whose windows are among the settled ones of their id."""

    def fn(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        row, at, anchor, whole = packed_windows(batch.column(2), length)
        code, edges = pair_code(anchor, whole), np.searchsorted(row, np.arange(batch.num_rows + 1))
        hit = np.concatenate([np.isin(code[x:y], np.frombuffer(v, "<u8")) for x, y, v in zip(edges[:-1], edges[1:], batch.column(3).to_pylist(), strict=True)])
        row, at = row[hit], at[hit]
        if len(row):
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + length)])
            heads = np.flatnonzero(new)
            tails = np.concatenate([heads[1:] - 1, [len(row) - 1]])
            yield {"id": ids[row[heads]], "tie": ties[row[heads]], "at": at[heads], "upto": at[tails] + length}

    return fn


def by_id(answers: DataFrame, *names: str) -> DataFrame:
    """Answers of one id as one row: it may have had rows in several blocks."""
    together = answers.groupBy("id").agg(*(F.array_join(F.collect_list(F.hex(n)), "").alias(n) for n in names))
    return together.select("id", *(F.unhex(n).alias(n) for n in names))


def common_windows(crowds: DataFrame, length: int, crowd: int) -> DataFrame:
    """Spans of windows of packed strings (id, tie, body, and their number as `upto`) that a smaller id also holds."""
    count = crowds.agg(F.coalesce(F.sum("upto"), F.lit(0)).alias("n")).first().n
    buckets = max(1, -(-int(count) // BUCKET_WINDOWS))
    judged = by_key(deal(crowds.select("id", "body"), windows_of(length), buckets), ["bucket"], judge_bucket(crowd), _DEALT)
    answers = settle(by_key(judged, ["block"], by_document, _ANSWERS).where("octet_length(settled) > 0").select("id", "settled"), "windows")
    return map_batches(crowds.join(by_id(answers, "settled"), "id").select("id", "tie", "body", "settled"), settled_windows(length), _HITS)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """id, tie (hash of the text) and merged spans [start, end) in bytes of all documents that lose any."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    buckets = max(1, -(-int(size) * 2 // (length - gram + 2) // BUCKET_STRETCHES))
    judged = by_key(deal(rows.where("id is not null"), stretches_of(length, gram), buckets), ["bucket"], judge_bucket(crowd), _DEALT)
    answers = settle(by_key(judged, ["block"], by_document, _ANSWERS), "answers")
    _, doubtful = bloom.split_by_id(rows.where("id is not null"), F.col("id"), answers, "id")
    met = doubtful.join(by_id(answers, "settled", "asked", "crowded"), "id").select("id", "text", F.xxhash64("text").alias("tie"), "settled", "asked", "crowded")
    marks = settle(map_batches(met, mark(length, gram), _MARKS), "marks", compression="zstd")
    strings = marks.where("kind = 1")
    groups = max(1, -(-strings.count() // BUCKET_STRINGS))
    compared = by_key(strings.select(F.pmod(F.xxhash64("g"), F.lit(groups)).alias("part"), "id", "tie", "at", "body"), ["part"], compare_strings(length), _HITS)
    crowded = common_windows(marks.where("kind = 2"), length, crowd)
    spans = marks.where("kind = 0").select("id", "tie", "at", "upto")
    for more in (compared, crowded):
        spans = spans.unionByName(more.select("id", "tie", "at", "upto"))
    return spans.groupBy("id", "tie").agg(merged_runs(F.collect_list(F.struct("at", "upto"))).alias("spans"))


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_bytes, spans and kept bytes' digest and text for every row.

    `kept` is binary: a cut may fall inside a character.
    """
    spans = settle(repeated_spans(docs, id_col, text_col, **options).select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), "spans"), "spans")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    clear, doubtful = bloom.split_by_id(rows, F.col(id_col), spans, "_id")

    @F.arrow_udf("binary")
    def kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(texts, spans, strict=True):
            raw, parts, at = (t.as_py() or "").encode(), [], 0
            for s in own.as_py() or ():
                parts.append(raw[at : s["at"]])
                at = s["upto"]
            out.append(b"".join([*parts, raw[at:]]))
        return pa.array(out, pa.binary())

    none = F.expr("cast(array() as array<struct<at:bigint,upto:bigint>>)")
    joined = doubtful.join(spans, (F.col(id_col).cast("bigint") == F.col("_id")) & (F.xxhash64("text") == F.col("_tie")), "left")
    met = joined.select(id_col, "text", F.coalesce("spans", none).alias("spans"))
    met = met.select(id_col, "text", "spans", kept("text", "spans").alias("kept"))
    return clear.select(id_col, "text", none.alias("spans"), F.encode("text", "utf-8").alias("kept")).unionByName(met)


def summarise(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    lost = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["upto"] - s["at"])
    return done.select(id_col, F.octet_length("text").cast("bigint").alias("n_bytes"), lost.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
