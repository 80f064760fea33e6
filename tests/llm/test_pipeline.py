"""Stages of the pipeline against plain versions."""

import corpus_pipeline
import numpy as np

DDL = "doc_id bigint, text string"


def shingles(text, width):
    w = (text or "").lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def jaccard(a, b, width):
    x, y = shingles(a, width), shingles(b, width)
    return len(x & y) / len(x | y) if x and y else 0.0


def least_of_groups(rows, width, least):
    root = {i: i for i, _ in rows}
    for n, (i, x) in enumerate(rows):
        for j, y in rows[:n]:
            if jaccard(x, y, width) >= least:
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return {i for i, r in root.items() if i == r}


def changed(words, *places):
    return " ".join(f"new{k}" if k in places else w for k, w in enumerate(words))


def test_near_copies_stage(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(6):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 100)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, changed(words, 40, 70)), (10 * k + 2, changed(words, 20, 50, 80))]
    near, far = jaccard(rows[0][1], rows[1][1], 5), jaccard(rows[0][1], rows[2][1], 5)
    assert 0.8 <= near < 0.85 and far < 0.8 and jaccard(rows[0][1], rows[1][1], 3) < 0.9
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DDL), "").collect()}
    assert got == least_of_groups(rows, 5, 0.8) == {i for i, _ in rows if i % 10 != 1}
