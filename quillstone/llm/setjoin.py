"""Exact Jaccard join on word n-gram sets by vertical partitioning.

1. One scan gives each text its set size and a 128-bit fingerprint; texts with one set are
   one node from here on. The scan also finds n-grams that a share `HOT` of the texts of some
   block hold; the most common are numbered and put last in the global order.
2. A second scan deals all other n-grams of the nodes out by hash, packed by block
   of texts. Each bucket counts in how many texts an n-gram occurs and sends back the shared
   ones: the global order is (hot, frequency, hash), and n-grams of one text can't add to an overlap.
3. Texts whose shared n-grams can't reach the threshold drop out. Those that share an n-gram
   of their prefixes (the first n - ceil(t n) + 1 of the order) are candidates. Their connected
   groups are cut into blocks; a text goes to the pairs of its block with those blocks in which
   it has a candidate, so texts that hang together in a chain are not sent to all of the chain.
4. The global order is cut into `FRAGMENTS` of about equally many n-grams. Each text's part in a
   fragment goes to that fragment's task of its block pair, which counts partial overlaps of all
   pairs (a product of incidence matrices) and passes on those that the sizes and the n-grams
   missing there allow. They are packed by block pair, never a row for each pair of texts.
5. Partial counts are summed per pair. What comes out is a spanning forest of the links among a
   block pair's texts, so no link between components is lost, and for each text the number of
   documents that its links reach there.
6. Components of the forests are the classes of the result; a document's links are the other
   documents with its set and the sum of its text's numbers.

Hashes have 64 bits throughout, fingerprints 128; all that follows is exact on them.

Defined results: a null or wordless text has an empty set and is linked with nothing; equal texts
link to each other; rows that share an id are one document, linked with all that any of its texts
is linked with, and each row is returned with the size and the links of its own text; rows without
an id are not returned; a very long text is hashed in one worker, at some 60 bytes of memory a byte;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import bloom
from quillstone.llm.arrow import by_key, map_batches, prepare, private, tidy
from quillstone.llm.components import components
from quillstone.llm.kernel import SPACE_WORDS, chunks, mix, shingle_hashes, sorted_sets
from quillstone.runtime import settle

#: Share of a block's texts that makes an n-gram a candidate for the hot list, and the list's length.
HOT, HOT_MAX = 0.005, 1 << 16
#: A block ends at so many texts or n-grams; a bucket should hold about so many n-grams.
BLOCK_TEXTS, BLOCK_GRAMS, BUCKET_GRAMS = 4096, 1 << 20, 1_500_000
#: Texts of a group in one block; fragments of the global order; n-grams in one matrix.
GROUP_BLOCK, FRAGMENTS, COLUMNS = 512, 4, 4096
#: Frequencies above this are ordered by hash alone; hot n-grams come after all others.
FREQUENT, LAST = 1023, 1024


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap a set of n elements must have with any partner."""
    return -(-percent * n // 100)


def sets_of(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, ascending distinct hashes and offsets, chunk by chunk."""
    for c in chunks(column):
        yield c.first, *sorted_sets(*shingle_hashes(c, width, SPACE_WORDS, fold=True))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def profile(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows of kind 0: id, n, fingerprint. Rows of kind 1: an n-gram common in some block, its count there."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        texts = grams = 0

        def rows(kind: int, *columns) -> pa.RecordBatch:
            arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(arrays[0]), kind, dtype=np.int32)), *arrays], names=["kind", "a", "b", "c", "d"])

        def common() -> Iterator[pa.RecordBatch]:
            v, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= max(8, HOT * texts)
            if keep.any():
                yield rows(1, v[keep], n[keep], np.zeros(keep.sum()), np.zeros(keep.sum()))

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, v, o in sets_of(batch.column(1), width):
                n = np.diff(o)
                yield rows(0, ids[first : first + len(n)], n, _sums(mix(v), o), _sums(mix(v ^ np.uint64(0x5851F42D4C957F2D)), o))
                held.append(v)
                texts, grams = texts + len(n), grams + len(v)
                if texts >= BLOCK_TEXTS or grams >= BLOCK_GRAMS:
                    yield from common()
                    held, texts, grams = [], 0, 0
        if grams:
            yield from common()

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null").mapInArrow(tidy(run), "kind int, a bigint, b bigint, c bigint, d bigint")


_PACKED = "bucket bigint, block bigint, sizes binary, grams binary, extra binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    bucket, block, sizes, grams, extra = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(block, pa.int64()), pa.array(sizes, pa.binary()), pa.array(grams, pa.binary()), pa.array(extra, pa.binary())], names=[f.split()[0] for f in _PACKED.split(", ")])


def dealt(docs: DataFrame, id_col: str, text_col: str, width: int, reps: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """N-grams of the nodes by bucket and block; what a block is passes under negative buckets, spread over many."""
    hot_held = docs.sparkSession.sparkContext.broadcast(hot)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hot = hot_held.value
        task, block = TaskContext.get().partitionId(), 0
        nodes: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        texts = grams = 0

        def flush() -> Iterator[pa.RecordBatch]:
            name = (task << 32) | block
            n, v = np.concatenate(sizes), np.concatenate(sets)
            doc = np.repeat(np.arange(len(n)), n)
            at = np.searchsorted(hot, v)
            at[at == len(hot)] = 0
            common = hot[at] == v if len(hot) else np.zeros(len(v), dtype=bool)
            hot_sizes = np.bincount(doc[common], minlength=len(n)).astype("<u4")
            info = np.concatenate([np.concatenate(nodes).view(np.int64), n.astype("<i8")]).tobytes()
            yield _packed([(-1 - (task * 31 + block) % 4096, name, hot_sizes.tobytes(), at[common].astype("<u4").tobytes(), info)])
            doc, v = doc[~common], v[~common]
            if not len(v):
                return
            bucket = (mix(v) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            doc, v, bucket = doc[order], v[order], bucket[order]
            heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            out = []
            for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)], strict=True):
                out.append((int(bucket[x]), name, np.bincount(doc[x:y], minlength=len(n)).astype("<u4").tobytes(), v[x:y].astype("<u8").tobytes(), None))
                if len(out) == 16:
                    yield _packed(out)
                    out = []
            if out:
                yield _packed(out)

        for batch in batches:
            for _, v, o in sets_of(batch.column(0), width):
                some = np.flatnonzero(np.diff(o))
                nodes.append(_sums(mix(v), o)[some])
                sizes.append(np.diff(o)[some])
                sets.append(v)
                texts, grams = texts + len(some), grams + len(v)
                if texts >= BLOCK_TEXTS or grams >= BLOCK_GRAMS:
                    yield from flush()
                    block += 1
                    nodes, sets, sizes, texts, grams = [], [], [], 0, 0
        if texts:
            yield from flush()

    return bloom.among(rows, F.col("id"), reps, "rep").select("text").mapInArrow(tidy(run), _PACKED)


def _bytes(table: pa.Table, name: str) -> list[bytes]:
    return table.column(name).to_pylist()


def count_bucket(key: tuple, table: pa.Table) -> Iterator[dict]:
    """Keep a bucket's n-grams of two texts or more, with their frequencies (up to FREQUENT)."""
    if key[0] < 0:
        for i in range(table.num_rows):
            row = table.slice(i, 1)
            yield {n: row.column(n).combine_chunks() for n in ("bucket", "block", "sizes", "grams", "extra")}
        return
    grams = [np.frombuffer(x, "<u8") for x in _bytes(table, "grams")]
    every = np.concatenate(grams)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(ordered)]]))
    frequency = np.empty(len(every), dtype=np.int64)
    frequency[order] = np.repeat(lengths, lengths)
    blocks, sizes, at = table.column("block").to_pylist(), _bytes(table, "sizes"), 0
    for block, raw, own in zip(blocks, sizes, grams, strict=True):
        f = frequency[at : at + len(own)]
        at += len(own)
        keep = f > 1
        if keep.any():
            n = np.frombuffer(raw, "<u4").astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)[keep]
            yield {
                "bucket": pa.array([key[0]], pa.int64()),
                "block": pa.array([block], pa.int64()),
                "sizes": pa.array([np.bincount(doc, minlength=len(n)).astype("<u4").tobytes()], pa.binary()),
                "grams": pa.array([own[keep].tobytes()], pa.binary()),
                "extra": pa.array([np.minimum(f[keep], FREQUENT).astype("<u2").tobytes()], pa.binary()),
            }


_ABLE = "node bigint, n bigint, codes binary, often binary, prefix array<bigint>"


def assemble(percent: int, hot_held: Broadcast):
    """Join a block's hot and shared n-grams per text; keep texts that can have a partner, in the global order, with their prefix."""

    def fn(key: tuple, table: pa.Table) -> Iterator[dict]:
        rows = table.to_pylist()
        both = np.frombuffer(next(r for r in rows if r["bucket"] < 0)["extra"], "<i8")
        nodes, n = both[: len(both) // 2], both[len(both) // 2 :]
        docs, codes, often = [], [], []
        for r in rows:
            sizes = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
            docs.append(np.repeat(np.arange(len(sizes)), sizes))
            if r["bucket"] < 0:
                codes.append(hot_held.value[np.frombuffer(r["grams"], "<u4")])
                often.append(np.full(len(codes[-1]), LAST, dtype="<u2"))
            else:
                codes.append(np.frombuffer(r["grams"], "<u8"))
                often.append(np.frombuffer(r["extra"], "<u2"))
        doc, code, frequency = np.concatenate(docs), np.concatenate(codes), np.concatenate(often)
        least = need(n, percent)
        can = np.bincount(doc, minlength=len(n)) >= np.maximum(least, 1)
        keep = can[doc]
        doc, code, frequency = doc[keep], code[keep], frequency[keep]
        order = np.lexsort((code, frequency, doc))
        doc, code, frequency = doc[order], code[order], frequency[order]
        edges = np.searchsorted(doc, np.arange(len(n) + 1))
        for part in np.array_split(np.flatnonzero(can), max(1, len(code) // 200_000)):
            if len(part):
                own = [slice(edges[i], edges[i + 1]) for i in part.tolist()]
                yield {
                    "node": pa.array(nodes[part]),
                    "n": pa.array(n[part]),
                    "codes": pa.array([code[x].tobytes() for x in own], pa.binary()),
                    "often": pa.array([frequency[x].tobytes() for x in own], pa.binary()),
                    "prefix": pa.array([code[x][: x.stop - x.start - int(least[i]) + 1].view(np.int64) for x, i in zip(own, part.tolist(), strict=True)], pa.list_(pa.int64())),
                }

    return fn


def _cells(often: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Coarse places in the global order: frequency, and the hash's first four bits."""
    return often.astype(np.int64) * 16 + (codes >> np.uint64(60)).astype(np.int64)


def pivots(able: DataFrame, fragments: int) -> np.ndarray:
    """Where the global order is cut, so that fragments hold about equally many n-grams."""

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        cells = _cells(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2"), np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8"))
        cell, n = np.unique(cells, return_counts=True)
        yield {"cell": cell, "n": n}

    cells = map_batches(able.select("codes", "often"), count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()  # at most 16 x (LAST + 1) rows
    sums = np.cumsum(cells.column("n").to_numpy())
    if not len(sums):
        return np.zeros(0, dtype=np.int64)
    at = np.searchsorted(sums, sums[-1] * np.arange(1, fragments) / fragments)
    return np.unique(cells.column("cell").to_numpy()[at])


def in_fragments(able: DataFrame, cuts: np.ndarray) -> DataFrame:
    """Each text's part in every fragment, empty ones too."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        nodes, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        parts = []
        for c, o in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            codes = np.frombuffer(c, "<u8")
            edges = [0, *np.searchsorted(_cells(np.frombuffer(o, "<u2"), codes), cuts, "right").tolist(), len(codes)]
            parts += [c[8 * a : 8 * b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        many = len(cuts) + 1
        yield {"node": np.repeat(nodes, many), "n": np.repeat(n, many), "f": np.tile(np.arange(many, dtype=np.int32), len(nodes)), "part": pa.array(parts, pa.binary())}

    return map_batches(able.select("node", "n", "codes", "often"), run, "node bigint, n bigint, f int, part binary")


def meetings(able: DataFrame, group_block: int = GROUP_BLOCK) -> DataFrame:
    """Candidates: a row for each text and pair (i, j) of blocks of its group in which it, of block b, has a candidate."""
    starts = settle(able.select("node", F.explode("prefix").alias("g")).distinct(), "prefixes")
    least = settle(starts.groupBy("g").agg(F.min("node").alias("v"), F.count("*").alias("m")).where("m > 1").select("g", "v"), "least")
    near = components(starts.join(least, "g").select(F.col("node").alias("u"), "v"))
    members = near.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(near.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    sizes = settle(near.groupBy(F.col("v").alias("root")).agg((F.floor(F.count("*") / group_block) + 1).cast("int").alias("blocks")), "sizes")
    placed = settle(members.join(sizes, "root").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "placed")
    # in groups of several blocks: the blocks that hold one of a text's prefix n-grams
    held = settle(starts.join(placed.where("blocks > 1").select("node", "blocks", "b"), "node"), "held")
    blocks = settle(held.groupBy("g").agg(F.collect_set("b").alias("all")), "blocks")
    everywhere = F.size("all") == F.col("blocks")
    seen = held.join(blocks, "g").groupBy("node").agg(F.bool_or(everywhere).alias("everywhere"), F.array_distinct(F.flatten(F.collect_set(F.when(~everywhere, F.col("all"))))).alias("some"))
    partners = F.when(F.coalesce("everywhere", F.lit(False)), F.sequence(F.lit(0), F.col("blocks") - 1)).when(F.col("blocks") > 1, F.col("some")).otherwise(F.array("b"))
    sent = placed.join(seen, "node", "left").withColumn("c", F.explode(partners))
    return sent.select("root", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"), "b", "node")


def overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Overlap of every row set with every column set."""
    sets = rows + columns if rows is not columns else rows
    place = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = often[code] > 1
    place, code = place[keep], code[keep]
    code = (np.cumsum(often > 1) - 1)[code]
    order = np.argsort(code, kind="stable")
    place, code = place[order], code[order]
    total = np.zeros((len(rows), len(columns)), dtype=np.float32)
    width = int(code[-1]) + 1 if len(code) else 0
    for begin in range(0, width, COLUMNS):
        a, b = np.searchsorted(code, [begin, begin + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, width - begin)), dtype=np.float32)
        x[place[a:b], code[a:b] - begin] = 1
        total += x[: len(rows)] @ x[-len(columns) :].T
    return total.astype(np.int64)


def _sides(key: tuple, table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Texts of a block pair in the order of their nodes, and which are on either side."""
    table = table.sort_by("node")
    side = table.column("b").to_numpy()
    return table, np.flatnonzero(side == key[1]), np.flatnonzero(side == key[2])


def allowed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that each pair of set sizes needs; more than either if the sizes alone rule the pair out."""
    total = n[:, None] + m[None, :]
    return -(-percent * total // (100 + percent))


_PARTIAL = "root bigint, i int, j int, f int, nodes binary, n binary, b binary, held binary, at binary, many binary"


def partial_counts(percent: int):
    """Partial overlaps of a block pair in one fragment, those that can still lead to a link."""

    def fn(key: tuple, table: pa.Table) -> Iterator[dict]:
        table, left, right = _sides(key, table)
        if not len(left) or not len(right):
            return
        root, i, j, f = key
        n = table.column("n").to_numpy()
        parts = [np.frombuffer(c, "<u8") for c in table.column("part").to_pylist()]
        size = np.array([len(p) for p in parts])
        rows = [parts[k] for k in left.tolist()]
        both = overlaps(rows, rows if i == j else [parts[k] for k in right.tolist()])
        least = allowed(n[left], n[right], percent)
        # n-grams that are missing here are missing in all
        keep = (both > 0) & (size[left][:, None] - both <= n[left][:, None] - least) & (size[right][None, :] - both <= n[right][None, :] - least)
        if i == j:
            keep = np.triu(keep, 1)
        at = np.flatnonzero(keep)
        whole = 2 * len(at) >= keep.size  # most pairs: counts alone, without places
        counts = np.where(keep, both, 0).ravel() if whole else both.ravel()[at]
        yield {
            "root": np.array([root]),
            "i": pa.array([i], pa.int32()),
            "j": pa.array([j], pa.int32()),
            "f": pa.array([f], pa.int32()),
            **{c: pa.array([table.column(c).to_numpy().astype("<i8").tobytes() if not f else None], pa.binary()) for c in ("n", "b", "held")},
            "nodes": pa.array([table.column("node").to_numpy().astype("<i8").tobytes() if not f else None], pa.binary()),
            "at": pa.array([None if whole else at.astype("<u4").tobytes()], pa.binary()),
            "many": pa.array([counts.astype("<u4" if int(counts.max(initial=0)) > 65535 else "<u2").tobytes()], pa.binary()),
        }

    return fn


def summed_links(percent: int):
    """A spanning forest (u, v) of the links between two blocks of a group (or within one), from the sums of partial overlaps.

    Rows without v: u has links to `reached` documents there.
    """

    def fn(key: tuple, table: pa.Table) -> Iterator[dict]:
        _, i, j = key
        rows = table.to_pylist()
        first = next(r for r in rows if r["f"] == 0)
        nodes, n, side, held = (np.frombuffer(first[c], "<i8") for c in ("nodes", "n", "b", "held"))
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        both = np.zeros(len(left) * len(right), dtype=np.int64)
        for r in rows:
            places = np.frombuffer(r["at"], "<u4") if r["at"] is not None else slice(None)
            total = len(both) if r["at"] is None else len(places)
            both[places] += np.frombuffer(r["many"], "<u4" if len(r["many"]) == 4 * total else "<u2") if total else 0
        both = both.reshape(len(left), len(right))
        linked = (both > 0) & (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both))
        reached = np.zeros(len(nodes), dtype=np.int64)
        reached[left] += linked @ held[right]
        reached[right] += held[left] @ linked
        parent = list(range(len(nodes)))
        us, vs = [], []
        for a, b in np.argwhere(linked).tolist():
            a, b = int(left[a]), int(right[b])
            x, y = a, b
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
                us.append(int(nodes[a]))
                vs.append(int(nodes[b]))
        if us:
            yield {"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64()), "reached": pa.nulls(len(us), pa.int64())}
            some = np.flatnonzero(reached)
            yield {"u": pa.array(nodes[some]), "v": pa.nulls(len(some), pa.int64()), "reached": pa.array(reached[some])}

    return fn


def shared_grams(docs: DataFrame, reps: DataFrame, everything: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Nodes that can have a partner, with their shared n-grams in the global order and their prefix."""
    totals = reps.agg(F.count("*").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("grams")).first()
    common = everything.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") >= max(8, HOT / 2 * totals.texts)).orderBy(F.desc("n"), "a").limit(HOT_MAX).toArrow()  # a bounded list
    hot = np.sort(common.column("a").to_numpy().view(np.uint64))
    buckets = max(1, -(-int(totals.grams) // BUCKET_GRAMS))
    shared = by_key(dealt(docs, id_col, text_col, width, reps, hot, buckets), ["bucket"], count_bucket, _PACKED)
    able = by_key(shared, ["block"], assemble(percent, docs.sparkSession.sparkContext.broadcast(hot)), _ABLE)
    return settle(able.dropDuplicates(["node"]), "able")  # texts that share an id with a representative may stand in for a node again


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """id, n_shingles, rep (least id with this set), component_id and n_links of every row with an id.

    n_links is the number of other documents that the row's set is linked with.
    """
    everything = settle(profile(docs, id_col, text_col, width), "profile")
    texts = everything.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n"), F.col("c").alias("node"), F.col("d").alias("f2"))
    own = texts.where("n > 0").distinct()
    reps = settle(own.groupBy("n", "node", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("held")), "reps")
    able = shared_grams(docs, reps, everything, id_col, text_col, width, percent)
    held = reps.groupBy("node").agg(F.sum("held").alias("held"))
    met = settle(meetings(able).join(held, "node"), "met")
    dealt_out = met.join(in_fragments(able, pivots(able, FRAGMENTS)), "node")
    counts = by_key(dealt_out, ["root", "i", "j", "f"], partial_counts(percent), _PARTIAL)
    links = settle(by_key(counts, ["root", "i", "j"], summed_links(percent), "u bigint, v bigint, reached bigint"), "links")
    # texts of one id are one document
    several = settle(own.groupBy("id").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v < w").select("id", "v"), "several")
    joined = components(links.where("v is not null").select("u", "v").unionByName(own.join(several, "id").select(F.col("node").alias("u"), "v")))
    named = joined.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(joined.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    named = settle(named.join(reps.select("node", "rep"), "node"), "named")
    least = settle(named.groupBy("root").agg(F.min("rep").alias("component_id")), "components")
    named = named.select("node", "root").distinct().join(least, "root").select("node", "component_id")
    reached = links.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("reached").alias("reached"))
    linked = F.col("held") - 1 + F.coalesce("reached", F.lit(0))
    told = reps.join(named, "node", "left").join(reached, "node", "left").select("n", "node", "f2", "rep", F.coalesce("component_id", "rep").alias("component_id"), linked.alias("n_links"))
    some = texts.where("n > 0").join(settle(told, "told"), ["n", "node", "f2"]).select("id", "n", "rep", "component_id", "n_links")
    alone = texts.where("n = 0").select("id", "n", F.col("id").alias("rep"), F.col("id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    return some.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "rep", "component_id", "n_links")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """The rows whose id is the least of its component, with all their columns; rows without an id stay.

    Only rows whose id may be among those to drop are joined; the others stay where they lie.
    """
    found = classes(docs, id_col, text_col, width, percent)
    key = private("drop")
    drop = settle(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(key)).distinct(), "drop")
    clear, doubtful = bloom.split_by_id(docs, F.col(id_col), drop, key)
    return clear.unionByName(doubtful.join(drop, F.col(id_col).cast("bigint") == F.col(key), "left_anti"))
