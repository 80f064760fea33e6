"""Repeated and missing ids, very long texts and clashing columns, for every operator on documents."""

import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, packing, quality, secrets, sentences, setjoin, suffixes, tokens
from quillstone.llm.queries import tokenizer_file

WORDS = " ".join(f"word{k}" for k in range(60))
LONG = " ".join(f"w{k % 9973} v{k}." for k in range(150_000))  # about 2 MB
ROWS = [(1, WORDS), (1, f"{WORDS} and more"), (1, WORDS), (None, WORDS), (None, None), (2, None), (3, ""), (4, LONG), (5, f"{LONG} tail")]
CLASHING = ("id", "text_hash", "n", "kind", "part", "node", "tie", "_id", "spans", "rank", "block", "h")


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(3)
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


def ids(df):
    return sorted((r.doc_id is not None, r.doc_id or 0) for r in df.select("doc_id").collect())


ALL = sorted((i is not None, i or 0) for i, _ in ROWS)
NAMED = [x for x in ALL if x[0]]


def test_sentences(odd):
    assert ids(sentences.without_repeats(odd)) == ALL
    lost = {r.doc_id: r.n_removed for r in sentences.summarise(sentences.repeated_sentences(odd)).collect() if r.doc_id in (4, 5)}
    assert lost[4] == 0
    assert lost[5] >= 149_990


def test_quality(odd):
    assert ids(quality.measure(odd)) == ALL


def test_setjoin(odd):
    found = setjoin.classes(odd)
    assert ids(found) == NAMED
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
    assert ids(setjoin.without_near_copies(odd)) == [x for x in ALL if x != (True, 5)]


def test_decontaminate(odd, spark):
    items = spark.createDataFrame([(1, WORDS)], "item_id bigint, text string")
    assert ids(decontaminate.decontaminate(odd, items)) == sorted([(False, 0), (True, 2), (True, 3), (True, 4), (True, 5)])
    assert ids(decontaminate.find_contamination(odd, items)) == ALL


def test_tokens(odd, spark, tmp_path):
    tokens.write_store(odd, f"file://{tmp_path}/s", tokenizer_file("byte_bpe_50k.json"))
    rows = tokens.read_store(spark, f"file://{tmp_path}/s").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == ALL
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_suffixes(odd):
    got = suffixes.summarise(suffixes.cut(odd)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == ALL
    lost = {r.doc_id: r.n_removed for r in got}
    assert (lost[4], lost[5]) == (0, len(LONG))
    assert lost[1] == 0  # rows of one id don't remove from each other


def test_packing(odd):
    got = packing.pack_documents(odd, tokenizer_file("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got if r.piece == 0) == ALL
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_secrets(odd):
    assert ids(secrets.summarise(secrets.scan(odd))) == ALL
    assert ids(secrets.without_secrets(odd)) == ALL
