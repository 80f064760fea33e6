"""Toxicity from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: compatibility forms (mathematical and full-width letters), accents, case,
homoglyphs (Cyrillic and Greek letters), invisible characters, and digits or signs that stand for
letters inside a word. The lexicon holds word
beginnings and whole words with their log-odds of standing in a toxic text; one automaton
finds all of them and the exception phrases, which cancel the entries inside them. The
weights found are normalised by length and a logistic curve turns them into a score.

Learning reads at most `max_rows` labelled texts (those whose id hashes lowest), so what it
collects is bounded by them: the entries and exceptions that pass the tests of evidence, and one
short row per labelled text. Scoring reads every text once, where it lies, without a shuffle. Only the text
enters a score.

Defined results: null and empty texts score like a text without entries; equal texts score
alike; a very long text is folded and scanned whole in one worker; labels that are null are not used, an id labelled twice counts as toxic if one label
says so; without toxic or without clean labels the lexicon is empty and every text gets the
share of toxic labels (0 if there are none); other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrow import map_batches, prepare
from quillstone.runtime import settle

#: Characters that look like Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "ⅰ": "i",
}
#: Digits and signs used for letters.
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "l"}
#: Characters that don't show.
INVISIBLE = "­​‌‍⁠﻿"

_FOLD = str.maketrans({**HOMOGLYPHS, **dict.fromkeys(INVISIBLE, None), **dict.fromkeys(map(chr, range(0x300, 0x370)), None)})
_SIGNS = "[" + re.escape("".join(SUBSTITUTIONS)) + "]"
_ANY_SUB = re.compile(_SIGNS)
#: A sign between letters, or one at the beginning of a word.
_INSIDE = re.compile(rf"(?<=[^\W\d_]){_SIGNS}+(?=[^\W\d_])|(?<![^\s\"'(]){_SIGNS}(?=[^\W\d_]{{2}})")
_SUB = str.maketrans(SUBSTITUTIONS)
_GAP = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Folded words of a text, each between single blanks."""
    if not text:
        return " "
    t = text.lower() if text.isascii() else unicodedata.normalize("NFKD", text).lower().translate(_FOLD)
    if _ANY_SUB.search(t):
        t = _INSIDE.sub(lambda m: m[0].translate(_SUB), t)
    return f" {_GAP.sub(' ', t).strip()} ".replace("  ", " ")


@dataclass
class Model:
    """What a score needs: entries and their weights, exception phrases, and the curve."""

    entries: dict[str, float] = field(default_factory=dict)  # " stem" or " word "
    exceptions: tuple[str, ...] = ()  # " two words "
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, w in self.entries.items():
            a.add_word(k, (len(k), w, k))
        for k in self.exceptions:
            a.add_word(k, (len(k), None, k))
        if len(a):
            a.make_automaton()
        return a


_BUILT: list = []


def built(model: Model):
    if not _BUILT or _BUILT[0] is not model:
        _BUILT[:] = [model, model.automaton()]
    return _BUILT[1]


def matches(folded: str, a) -> list[tuple[int, str, float]]:
    """(place, entry, weight) of entries that no exception phrase covers; one entry per word, the heaviest."""
    if not len(a):
        return []
    found: dict[int, tuple[float, str]] = {}
    covered: list[tuple[int, int]] = []
    for end, (size, weight, key) in a.iter(folded):
        start = end - size + 1
        if weight is None:
            covered.append((start, end))
        elif start not in found or found[start][0] < weight:
            found[start] = (weight, key)
    covered.sort()
    begins, reach = [b for b, _ in covered], list(accumulate((e for _, e in covered), max))  # how far the exceptions up to each go
    kept = []
    for s, (w, k) in sorted(found.items()):
        i = bisect_right(begins, s)
        if not i or reach[i - 1] <= s + 1:
            kept.append((s, k, w))
    return kept


def features(weight: float, words: int) -> tuple[float, float]:
    """The weight found, and the weight per length, both damped."""
    return math.log1p(weight), math.log1p(100 * weight / (words + 20))


def score_text(text: str | None, model: Model) -> tuple[float, float, int, int]:
    """Score, weight found, matches and words."""
    folded = fold(text)
    found = matches(folded, built(model))
    weight, words = sum(w for _, _, w in found), max(0, folded.count(" ") - 1)
    x, y = features(weight, words)
    b, u, v = model.curve
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, b + u * x + v * y)))), weight, len(found), words


def text_features(folded: str, stems: tuple[int, ...]) -> set[str]:
    """Whole words and word beginnings of a folded text."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in stems if len(w) >= n)
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, stems: tuple[int, ...] = (4, 5, 6), least: int = 5, z: float = 4.0, least_weight: float = 1.5, exceptions: tuple[str, ...] = ()) -> Model:
    """Learn entries, exception phrases and the curve from labelled texts."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("_id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("y"))
    picked = F.broadcast(known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows))  # at most max_rows short rows
    rows = settle(docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("text")).join(picked, "_id").select("y", "text").dropDuplicates(["y", "text"]), "labelled")  # copies would count as evidence again and again

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        n: dict[str, list[int]] = {}
        total = [0, 0]
        for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            total[y] += 1
            for f in text_features(fold(t.as_py()), stems):
                n.setdefault(f, [0, 0])[y] += 1
        n[""] = total
        yield {"f": list(n), "clean": pa.array([x[0] for x in n.values()], pa.int64()), "toxic": pa.array([x[1] for x in n.values()], pa.int64())}

    counts = map_batches(rows, count, "f string, clean bigint, toxic bigint").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean_n, toxic_n = totals.get(0, 0), totals.get(1, 0)
    if not clean_n or not toxic_n:
        share = toxic_n / max(1, clean_n + toxic_n)
        return Model(curve=(math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0))
    weight = F.log((F.col("toxic") + 0.5) / (toxic_n + 1)) - F.log((F.col("clean") + 0.5) / (clean_n + 1))
    scored = counts.where((F.col("f") != "") & (F.col("toxic") >= least)).withColumn("w", weight).withColumn("se", F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5)))
    chosen = scored.where((F.col("w") >= z * F.col("se")) & (F.col("w") >= least_weight))
    entries: dict[str, float] = {}
    seen, share = F.col("toxic") + F.col("clean"), toxic_n / (toxic_n + clean_n)
    evidence = F.col("toxic") * F.log(F.col("toxic") / (seen * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (seen * (1 - share)))).otherwise(0)
    # most evidence (likelihood ratio) first; among equals a word's beginning before the word, the longer before the shorter
    begun: set[str] = set()  # beginnings of the entries so far
    for r in chosen.orderBy(F.desc(F.round(evidence, 6)), F.col("f").endswith(" "), F.desc(F.length("f")), "f").collect():  # features of labelled texts
        if r.f not in begun and not any(r.f[:n] in entries for n in range(3, len(r.f) + 1)):
            entries[r.f] = round(r.w, 4)
            begun.update(r.f[:n] for n in range(3, len(r.f) + 1))
    model = Model(entries, tuple(f" {' '.join(fold(p).split())} " for p in exceptions))
    held = spark.sparkContext.broadcast(model)

    def contexts(batch: pa.RecordBatch) -> Iterator[dict]:
        a, n = built(held.value), Counter()
        for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            folded, seen = fold(t.as_py()), set()
            for at, _, _ in matches(folded, a):
                end = folded.index(" ", at + 1)
                before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
                if before >= 0 and before < at:
                    seen.add(folded[before : end + 1])
                if after > 0:
                    seen.add(folded[at : after + 1])
            n.update((p, y) for p in seen)
        yield {"p": pa.array([p for p, _ in n], pa.string()), "y": pa.array([y for _, y in n], pa.int32()), "n": pa.array(list(n.values()), pa.int64())}

    near = map_batches(rows, contexts, "p string, y int, n bigint").groupBy("p").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    # a phrase that stands in clean texts only, and often, excuses the entry in it
    excused = near.where((F.col("clean") >= 2 * least) & (F.col("toxic") == 0)).orderBy("p").collect()
    model = Model(entries, (*model.exceptions, *(r.p for r in excused)))
    final = spark.sparkContext.broadcast(model)

    def weigh(batch: pa.RecordBatch) -> Iterator[dict]:
        got = [score_text(t.as_py(), final.value) for t in batch.column(1)]
        yield {"y": batch.column(0), "w": pa.array([g[1] for g in got], pa.float64()), "n": pa.array([g[3] for g in got], pa.int64())}

    sample = map_batches(rows, weigh, "y int, w double, n bigint").toPandas()  # at most max_rows rows per id of three numbers
    return Model(entries, model.exceptions, fit(np.array([features(w, n) for w, n in zip(sample.w, sample.n, strict=True)]), sample.y.to_numpy()))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small ridge; slopes are never negative."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        pull = ridge * np.array([0.0, 1.0, 1.0])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-9), a.T @ (y - p) - pull * w)
        w = w + np.clip(step, -5, 5)
        w[1:] = np.maximum(w[1:], 0)
    return tuple(map(float, w))


def score_column(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A column with the score of a text."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([score_text(t.as_py(), held.value)[0] for t in texts], pa.float64())

    return score(F.col(text_col).cast("string"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", cutoff: float = 0.5) -> DataFrame:
    """The rows that score below the cutoff; all columns stay."""
    return docs.where(score_column(docs, model, text_col) < cutoff)
