"""Strings of very common anchors: a row for each text, whatever the number of their windows."""

import hashlib

import numpy as np

from quillstone.llm import suffixes

COMMON = "this passage of over fifty bytes stands in very many of the texts"


def test_crowds_stay_packed(spark, monkeypatch):
    """Against brute force, with ids that repeat, a text that repeats itself, and buckets of few windows."""
    rng = np.random.default_rng(4)
    noise = lambda n: "".join(rng.choice(list("abcé"), n))
    ends = [noise(30) for _ in range(9)]  # common continuations: windows of several variants
    rows = [(i // 2 if i < 8 else i, f"{noise(25)}{COMMON}{ends[i % 9][: i % 31]}{noise(20)}") for i in range(90)]
    rows += [(200, rows[5][1] + rows[70][1] + rows[5][1]), (201, COMMON), (202, None), (203, rows[33][1])]
    tables = {}
    keep = suffixes.settle

    def settle(df, label, **options):
        tables[label] = keep(df, label, **options)
        return tables[label]

    monkeypatch.setattr(suffixes, "settle", settle)
    monkeypatch.setattr(suffixes, "BUCKET_WINDOWS", 300)
    seen, want = {}, []
    windows = lambda raw: [raw[p : p + 50] for p in range(len(raw) - 49)]
    for i, x in rows:
        for w in windows((x or "").encode()):
            seen[w] = min(i, seen.get(w, i))
    for i, x in rows:
        raw = (x or "").encode()
        gone = {q for p, w in enumerate(windows(raw)) if seen[w] < i for q in range(p, p + 50)}
        want.append((i, len(raw), len(gone), sum(q - 1 not in gone for q in gone), hashlib.sha256(bytes(c for q, c in enumerate(raw) if q not in gone)).hexdigest()))
    for crowd in (3, 0, 2000):
        got = suffixes.summarise(suffixes.cut(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), crowd=crowd)).collect()
        assert sorted(map(tuple, got)) == sorted(want)
        made = {k: v.count() for k, v in tables.items()}
        if crowd < 2000:
            crowds = tables["marks"].where("kind = 2").count()
            assert 0 < crowds <= len(rows)
            assert made.get("shares", made.get("windows")) <= len(rows)
