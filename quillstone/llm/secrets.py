"""Secret scans over an incremental ledger of blobs.

Every version of every file is addressed by the sha256 of its content. A scan looks only
at (blob, rule set version) pairs that the ledger doesn't hold yet; findings are joined
back to all paths and versions that carry the blob.

Hashes decide which rows to scan, and a Bloom filter over the chosen row ids, sized by their
number, lets other copies skip the scan where they lie (too many ids for a filter are joined
instead). A false positive only scans a copy needlessly.

Defined results: a null text is an empty blob without secrets; equal texts share one scan
and all get its findings; row ids that repeat are versions of one path, told apart by blob, and
rows without an id are versions too; a very long text is scanned whole in one worker; an empty
table gives empty findings; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bloom
from quillstone.llm.arrow import map_batches, prepare, private
from quillstone.runtime import fresh_path, settle

#: A private key up to its end line or, if that is missing, over the headers and lines of base64 that follow (line ends may be escaped).
_KEY_LINES = r"(?:\s*(?:Proc-Type|DEK-Info):[^\n]*)*(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{16,}={0,2})+(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{1,15}={0,2}(?![^\s\\\"']))?"
_KEY = r"-----BEGIN ([A-Z ]*PRIVATE KEY-----)(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1|" + _KEY_LINES + r")?"
#: Kinds in the order of reports, each with its pattern, the group that must be long enough, and its least length.
RULES = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", _KEY, 0, 20),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("forge", r"(?:gh[pousr]_[A-Za-z0-9]{30,}|glpat-[A-Za-z0-9_-]{20,})", 0, 20),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
)
BASE_KINDS = ("assign", "access", "hex")
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]

_COMPILED = [(k, re.compile(p, re.ASCII), g, n) for k, p, g, n in RULES]
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: A text without any of these can't match the rule.
_NEEDS = {"assign": ("passw", "secret", "token", "apikey", "api_key"), "access": ("AKIA",), "pem": ("-----BEGIN ",), "jwt": ("eyJ",), "forge": ("gh", "glpat-"), "chat": ("xox",)}


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as listed."""
    if not text:
        return []
    found = []
    folded = text.lower()
    for order, (kind, pattern, group, least) in enumerate(_COMPILED):
        if kind == "hex":  # maximal runs, so a long run is one match of the plain pattern
            found += [(m.start(), order, kind, m.end()) for m in _LONG_HEX.finditer(text)]
            continue
        if not any(x in (folded if kind == "assign" else text) for x in _NEEDS[kind]):
            continue
        found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def scan_blobs(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(blob, spans) of the chosen (row id, blob) pairs; spans may be empty."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        ids, blobs, spans = [], [], []
        for i, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py() or ""
            if found := find_secrets(text):
                ids.append(i.as_py())
                blobs.append(hashlib.sha256(text.encode()).hexdigest())
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
        yield {"scan_id": pa.array(ids, pa.int64()), "blob": pa.array(blobs, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))}

    rows = docs.select(F.col(id_col).cast("bigint").alias("scan_id"), F.col(text_col).cast("string").alias("text"))
    found = map_batches(bloom.among(rows, F.col("scan_id"), chosen, "scan_id"), run, "scan_id bigint, blob string, spans array<struct<kind:string,start:bigint,end:bigint>>")
    # copies that a false positive let through fall away here: one row per blob
    return found.groupBy("blob").agg(F.first("spans").alias("spans"))


class Ledger:
    """Blobs scanned so far, by rule version, with their findings: two growing Parquet tables."""

    SEEN = "blob string, rules string"
    FINDINGS = "blob string, rules string, spans array<struct<kind:string,start:bigint,end:bigint>>"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "ledger")
        self.fresh = path is None

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def seen(self, rules: str) -> DataFrame:
        return self._read("seen", self.SEEN).where(F.col("rules") == rules).select("blob")

    def findings(self, rules: str) -> DataFrame:
        return self._read("findings", self.FINDINGS).where(F.col("rules") == rules).select("blob", "spans")

    def add(self, findings: DataFrame, blobs: DataFrame, rules: str) -> None:
        """Findings first: a run that dies between the two writes is repeated, not lost."""
        findings.select("blob", F.lit(rules).alias("rules"), "spans").write.mode("append").parquet(f"{self.path}/findings")
        blobs.select("blob", F.lit(rules).alias("rules")).write.mode("append").parquet(f"{self.path}/seen")


def scan(docs: DataFrame, ledger: Ledger | None = None, id_col: str = "doc_id", text_col: str = "text", rules: str = RULE_VERSION) -> DataFrame:
    """Row id, blob and spans (null if none) of every row; unseen blobs are scanned and enter the ledger."""
    spark = docs.sparkSession
    prepare(spark)
    ledger = ledger or Ledger(spark)
    paths = settle(docs.select(F.col(id_col).cast("bigint").alias(id_col), blob_id(F.col(text_col)).alias("blob")), "paths")
    # a row id may carry several versions, so (id, blob) pairs are chosen; copies of a blob share one row
    chosen = paths.groupBy("blob").agg(F.min(id_col).alias("scan_id"))
    if not ledger.fresh:
        chosen = chosen.join(ledger.seen(rules), "blob", "left_anti")
    chosen = settle(chosen, "chosen")
    ledger.add(scan_blobs(docs, chosen, id_col, text_col).dropDuplicates(["blob"]), chosen, rules)
    findings = ledger.findings(rules).dropDuplicates(["blob"])
    return paths.join(findings, "blob", "left")


def summarise(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, a digest of the base spans, and all spans as text."""
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)"))
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("bigint")
    return found.select(id_col, *(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(spans).alias("spans"))


def without_secrets(docs: DataFrame, ledger: Ledger | None = None, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows, each span of their blob's findings replaced by `mark`; other columns unchanged.

    Only rows whose id may be among those with findings are joined (and shuffled); the
    others pass through where they lie.
    """
    key, blob, spans, own = (private(n) for n in ("id", "blob", "spans", "own"))
    found = settle(scan(docs, ledger, id_col, text_col).where("size(spans) > 0").select(F.col(id_col).alias(key), F.col("blob").alias(blob), F.col("spans").alias(spans)).distinct(), "found")
    clear, doubtful = bloom.split_by_id(docs, F.col(id_col), found, key)
    cut = F.aggregate(
        F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e")))),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda a, x: F.struct(
            F.when(x["s"] >= a["at"], F.concat(a["out"], F.substring(F.col(text_col), (a["at"] + 1).cast("int"), (x["s"] - a["at"]).cast("int")), F.lit(mark))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], x["e"]).alias("at"),
        ),
        lambda a: F.concat(a["out"], F.substring(F.col(text_col), (a["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    touched = doubtful.withColumn(own, blob_id(F.col(text_col)))
    touched = touched.join(found, (F.col(id_col).cast("bigint") == F.col(key)) & (F.col(own) == F.col(blob)), "left")
    touched = touched.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(cut))
    return clear.unionByName(touched.select(docs.columns))
