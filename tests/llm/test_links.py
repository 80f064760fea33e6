"""Links of the n-gram join against brute force."""

import numpy as np

from quillstone.llm import setjoin


def test_number_of_links(spark):
    rng = np.random.default_rng(7)
    base = [f"v{x}" for x in range(120)]
    texts = []
    for _ in range(300):  # more than a block of a cluster; some are equal
        words = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 4)):
            words[p] = f"n{rng.integers(0, 40)}"
        texts.append(" ".join(words))
    rows = [*enumerate(texts), (1000, None), (1001, "on its own"), (1002, "On its OWN"), (1003, "quite another")]
    sets = {i: frozenset(zip(w, w[1:], w[2:], strict=False)) or frozenset([tuple(w)] if w else []) for i, x in rows if (w := (x or "").lower().split()) is not None}
    want = {i: sum(i != j and 100 * len(s & t) >= 90 * len(s | t) > 0 for j, t in sets.items()) for i, s in sets.items()}
    assert len(set(want.values())) > 10
    rows += [(1010, "one text of this id has words enough"), (1010, "on its own"), (1011, "One text of this id has words enough")]
    joined = {r.doc_id: r.component_id for r in setjoin.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert joined[1010] == joined[1011] == joined[1001] == joined[1002] == 1001
    rows = rows[:-3]
    found = setjoin.classes(spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string"))  # one row twice: one document
    assert {r.doc_id: r.n_links for r in found.collect()} == want


def test_chain_shuffles_in_proportion(spark):
    """5,000 texts that share rare n-grams with their neighbours only: as many copies as candidates, not as the chain squared."""
    words = [f"w{k}" for k in range(5000 * 8 + 40)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 40])) for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    everything = setjoin.settle(setjoin.profile(docs, "doc_id", "text", 3), "profile")
    reps = everything.where("kind = 0").selectExpr("a rep", "b n", "c node")
    able = setjoin.shared_grams(docs, reps, everything, "doc_id", "text", 3, 50)
    sent = setjoin.meetings(able, group_block=64)
    assert sent.select("root").distinct().count() == 1
    assert sent.count() <= 5000 * 2 * 8  # own block and those of the up to seven candidates on either side
    found = setjoin.classes(docs, percent=50).collect()
    # 30 of 46 n-grams are shared with the next text, 22 of 54 with the one after
    assert {r.component_id for r in found} == {0}
    assert {r.doc_id: r.n_links for r in found} == {k: 2 - (k in (0, 4999)) for k in range(5000)}


def test_blocks_and_fragments(spark, monkeypatch):
    """Many blocks and fragments give the links that one gives."""
    rng = np.random.default_rng(9)
    base = [[f"{t}_{x}" for x in range(60)] for t in range(3)]
    rows = []
    for k in range(240):
        words = list(base[k % 3])
        for p in rng.integers(0, 60, rng.integers(0, 3)):
            words[p] = f"n{rng.integers(0, 50)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, x in rows for w in [x.split()]}
    want = {i: sum(i != j and 100 * len(s & t) >= 90 * len(s | t) for j, t in sets.items()) for i, s in sets.items()}
    monkeypatch.setattr(setjoin, "FRAGMENTS", 7)
    monkeypatch.setattr(setjoin.meetings, "__defaults__", (16,))
    assert {r.doc_id: r.n_links for r in setjoin.classes(docs).collect()} == want
