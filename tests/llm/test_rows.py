"""Rows that share an id, or have none, when the benchmark has several automatons."""

from quillstone.llm import decontaminate


def test_sharded_benchmark_judges_rows(spark):
    x, y = " ".join(f"x{i}" for i in range(13)), " ".join(f"y{i}" for i in range(13))
    b = spark.createDataFrame([(1, x), (2, y)], "item_id bigint, text string")
    rows = [(1, f"{x} more"), (1, "clean words"), (1, "clean words"), (2, f"{x} {y}"), (None, y), (None, "clean too"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found, kept = [], []
    for size in (10**6, 13):
        out = decontaminate.find_contamination(docs, b, shard_words=size)
        assert out.columns == ["doc_id", "n_words", "runs", "spans", "items"]
        found.append(sorted(map(str, decontaminate.summarise(out).collect())))
        kept.append(sorted(((r.doc_id, r.text) for r in decontaminate.decontaminate(docs, b, shard_words=size).collect()), key=str))
    assert found[0] == found[1]
    assert kept[0] == kept[1] == sorted([rows[1], rows[2], rows[5], rows[6]], key=str)
