"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words (ASCII A-Z folded; a word is a run of ASCII
letters, digits or characters above ASCII) joined by single spaces. Every window of
`width` consecutive benchmark words becomes a pattern ` w1 ... wn `; the automaton scans
each document once and reports all windows that occur, wherever they overlap. Word
numbers are mapped back to code-point offsets in the original text.

Memory: an automaton takes about 3 KB a benchmark word, so the benchmark is dealt into
automatons of at most about `shard_words` words. A worker holds one of them and a group of
texts at a time: it scans the group with one automaton after the other and unites what they
find, row by row. However many there are, texts are read once, nothing is shuffled and every
row is judged on its own. The driver passes the benchmark on shard by shard.

Defined results: a null or wordless document has no words and is clean; a null or
wordless item matches nothing; an item id given to several rows counts once; repeated
items all count; rows that share an id, or have none, are judged each on its own; a very
long text is scanned whole, in one worker; extra columns of either table are ignored; an
empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrow import prepare, tidy

WIDTH = 13
SHARD_WORDS = 50_000
#: Bytes of texts that several automatons scan before the next group is read.
GROUP_BYTES = 32 << 20
#: A document is contaminated when hit words are at least 1 / this of its words.
SHARE = 20

_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_ORIGINAL_WORD = re.compile(r"(?:[0-9A-Za-z]|[^\x00-\x7F])+")


def normalise(text: str | None) -> list[bytes]:
    """Lower-case words of a text as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_windows(items: list[tuple[object, str | None]], width: int = WIDTH) -> dict[str, list]:
    """Window -> ids of the items that hold it."""
    out: dict[str, set] = {}
    for item, text in items:
        words = normalise(text)
        size = min(len(words), width)
        for i in range(len(words) - size + 1 if words else 0):
            out.setdefault(" ".join(w.decode() for w in words[i : i + size]), set()).add(item)
    return {k: sorted(v, key=str) for k, v in out.items()}


def build(windows: dict[str, list]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for text, items in windows.items():
        a.add_word(f" {text} ", (text.count(" ") + 1, len(text) + 1, items))
    if windows:
        a.make_automaton()
    return a


_BUILT: dict[str, object] = {}


def automaton(key: str, items: Broadcast, width: int):
    """The automaton of a shard; a worker keeps the last one."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build(item_windows(items.value, width))
        items.__dict__.pop("_value", None)  # the texts aren't needed again
    return _BUILT[key]


def hits(joined: str, a) -> tuple[list[tuple[int, int]], set]:
    """Hit runs [first word, past last word) and ids of items that occur in words joined by blanks."""
    runs: list[tuple[int, int]] = []
    items: set = set()
    counted = upto = 0
    for end, (size, _, ids) in a.iter(joined):
        # spaces up to the window's closing one; matches come by ascending end
        counted += joined.count(" ", upto, end)
        upto = end
        runs.append((counted - size, counted))
        items.update(ids)
    return runs, items


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


Shards = list[tuple[str, Broadcast]]


def scan(texts: list[str | None], shards: Shards, width: int) -> list[tuple[int, list[tuple[int, int]], set]]:
    """For each text its number of words, merged hit runs, and ids of items that occur."""
    words = [normalise(t) for t in texts]
    found: list[tuple[list, set]] = [([], set()) for _ in texts]
    for key, items in shards:
        a = automaton(key, items, width)
        if len(a):
            for w, (runs, ids) in zip(words, found, strict=True):
                if w:
                    more, own = hits(f" {b' '.join(w).decode('utf-8', 'surrogatepass')} ", a)
                    runs.extend(more)
                    ids.update(own)
    return [(len(w), united(runs), ids) for w, (runs, ids) in zip(words, found, strict=True)]


def groups(batches: Iterator, size: Callable, several: bool) -> Iterator[list]:
    """Batches that are scanned together: one by one, or as many as `GROUP_BYTES` hold where there are several automatons."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += size(b)
        if not several or total >= GROUP_BYTES:
            yield held
            held, total = [], 0
    if held:
        yield held


def original_offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans of word runs in the unnormalised text."""
    at = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
    return [(at[s][0], at[e - 1][1]) for s, e in runs]


def benchmark_shards(benchmark: DataFrame, item_col: str, text_col: str, shard_words: int) -> Shards:
    """Items in shards of at most about `shard_words` words (or one longer item); the driver holds one at a time."""
    sc, out = benchmark.sparkSession.sparkContext, []
    shard, words = [], 0

    def close() -> None:
        ordered = sorted(shard, key=str)
        out.append((hashlib.sha256(repr(ordered).encode()).hexdigest(), sc.broadcast(ordered)))

    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").distinct()
    for r in rows.toLocalIterator():
        n = len(normalise(r.t))
        if shard and words + n > shard_words:
            close()
            shard, words = [], 0
        shard.append((r.i, r.t))
        words += n
    close()
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per document row: n_words, hit word runs, their spans in the text, and ids of the items found."""
    prepare(docs.sparkSession)
    shards = benchmark_shards(benchmark, item_col, item_text_col, shard_words)
    names = (id_col, "n_words", "runs", "spans", "items")
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches, lambda b: b.nbytes, len(shards) > 1):
            texts = [t.as_py() for b in held for t in b.column(1)]
            found = iter(zip(texts, scan(texts, shards, width), strict=True))
            for b in held:
                rows = [next(found) for _ in range(b.num_rows)]
                spans = [original_offsets(t, runs) if runs else [] for t, (_, runs, _) in rows]
                columns = ([n for _, (n, _, _) in rows], [runs for _, (_, runs, _) in rows], spans, [sorted(map(str, ids)) for _, (_, _, ids) in rows])
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names=names)

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return rows.mapInArrow(tidy(run), f"`{id_col}` bigint, n_words bigint, runs array<array<int>>, spans array<array<int>>, items array<string>")


def summarise(found: DataFrame, id_col: str = "doc_id", share: int = SHARE) -> DataFrame:
    """Counts, a digest of the item ids, and the verdict for each document."""
    hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + (r[1] - r[0]).cast("bigint"))
    return found.select(
        F.col(id_col),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, share: int = SHARE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents that aren't contaminated, with all their columns. The verdict is a column beside the row, so texts aren't shuffled."""
    prepare(docs.sparkSession)
    shards = benchmark_shards(benchmark, item_col, item_text_col, shard_words)

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for held in groups(batches, lambda b: b.nbytes, len(shards) > 1):
            found = iter(scan([t.as_py() for b in held for t in b], shards, width))
            for b in held:
                rows = [next(found) for _ in range(len(b))]
                hit = [sum(e - s for s, e in runs) for _, runs, _ in rows]
                yield pa.array([not (h > 0 and share * h >= n) for h, (n, _, _) in zip(hit, rows, strict=True)], pa.bool_())

    return docs.where(clean(F.col(text_col).cast("string")))
