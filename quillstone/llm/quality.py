"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a text when 100 * measure exceeds cutoff * size. For every stratum, rule and
cutoff of a fixed grid, labelled good texts give an exact binomial test of "this rejects more
than `alpha` of the good texts"; a cutoff is certified when that is refuted at level
`delta` divided by the number of strata times rules (Bonferroni). Within a stratum and rule the
cutoffs are tested from the most lenient on; a stricter one rejects no fewer good texts, so the
certified ones are a run from the start of that order, which keeps the level (fixed-sequence
testing). `alpha` is dealt evenly among the rules, so by the union bound all rules together reject at most
`alpha` of a stratum's good texts with probability 1 - `delta`. The good texts meant are those that
pass the base rules, which no label can save; equal texts of a stratum are one draw, since the
exact test needs independent ones. Among certified cutoffs the
one that rejects most bad texts less `price` times the good ones is used; a rule without one
stays off in that stratum.

Counts of repeated windows sort 64-bit hashes of three words inside each row: no shuffle, and
the work grows with a text's length times its logarithm. The only shuffles carry a few numbers
per document.

Defined results: a null text has no words and fails the base; texts without labels only get
verdicts; null strata form one stratum; labels that are null are not used and an id labelled
twice is good if one label says so, as are equal texts; a very long text is measured inside its row;
a stratum without good labels has no active rule; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.runtime import settle

#: ASCII white space: what separates words.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: name, measure, size, cutoffs in hundredths.
RULES = (
    ("symbols", "n_symbols", "n_words", (5, 10, 20, 30, 40, 50, 75, 100, 150, 200)),
    ("copied_lines", "n_dup_lines", "n_lines", (10, 20, 30, 40, 50, 60, 70, 80, 90)),
    ("repeated_words", "n_repeat_words", "n_words", (5, 10, 15, 20, 25, 30, 35, 40, 45)),
    ("long_words", "word_chars", "n_words", (600, 700, 800, 900, 1000, 1200, 1500, 2000)),
    ("short_words", "n_words", "word_chars", (20, 25, 30, 35, 40, 50, 60)),
)
STRATA_BROADCAST = 10_000


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def removed(text: Column, chars: str) -> Column:
    """How many of some characters a text has."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strata: Column | None = None) -> DataFrame:
    """Counts per document. `strata` names the group whose false rejections are limited."""
    stratum = F.coalesce((strata if strata is not None else F.lit("")).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col), stratum.alias("stratum"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = base.select(
        id_col,
        "stratum",
        F.xxhash64("text").alias("text_hash"),
        (F.length("text") - removed(F.col("text"), BLANKS)).alias("word_chars"),
        removed(F.col("text"), SYMBOLS).alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
        words_of(F.col("text")).alias("words"),
    )
    counted = split.select(
        id_col,
        "stratum",
        "text_hash",
        F.size("words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(
            F.size("words") >= 3,
            F.sort_array(F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")))),
        )
        .otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)"))
        .alias("windows"),
    )
    same = lambda x, i: F.coalesce(F.get("windows", i)["h"] == x["h"], F.lit(False))
    repeated = F.sort_array(F.transform(F.filter("windows", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    marked = counted.withColumn("starts", repeated).drop("windows")
    covered = F.aggregate("starts", F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")), lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).cast("bigint").alias("n")), lambda a: a["n"])
    return marked.withColumn("n_repeat_words", covered).drop("starts")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fires(rule: tuple, cutoff: Column | int) -> Column:
    _, top, size, _ = rule
    return 100 * F.col(top) > cutoff * F.col(size)


def log_gamma(x: Column) -> Column:
    """ln gamma for x >= 1: Stirling's series at x + 7, with the recurrence back."""
    z = x + 7
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    return series - sum((F.log(x + k) for k in range(1, 7)), F.log(x))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) where k < n p, else 1: summed downwards from k.

    Terms fall from k on; 20 standard deviations (and 200 terms) reach far below any
    level that is asked for.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    terms = F.least(k, 20 * F.sqrt(n * p) + 200).cast("int")
    total = F.aggregate(
        F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.expr("cast(array() as array<int>)")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, i: F.struct((a["t"] * (k - i + 1) * (1 - p) / ((n - k + i) * p)).alias("t"), (a["s"] + a["t"] * (k - i + 1) * (1 - p) / ((n - k + i) * p)).alias("s")),
        lambda a: a["s"],
    )
    return F.when(k < n * p, first * total).otherwise(F.lit(1.0))


def certify(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", alpha: float = 0.05, delta: float = 0.05, price: float = 20.0, rules: tuple = RULES) -> DataFrame:
    """stratum, rule, cutoff: the certified cutoffs in use, with the counts behind them."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("good"))
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    held = measured.where(~base_failed()).join(known, F.col(id_col) == F.col("_id")).groupBy("stratum", "text_hash", *counts).agg(F.max("good").alias("good"))
    tests = [(r, c) for r in rules for c in r[3]]
    count: Callable[[Column], Column] = lambda x: F.sum(x.cast("bigint"))
    sums = held.groupBy("stratum").agg(
        count(F.col("good") == 1).alias("n_good"),
        *(count((F.col("good") == 1) & fires(r, c)).alias(f"g{i}") for i, (r, c) in enumerate(tests)),
        *(count((F.col("good") == 0) & fires(r, c)).alias(f"b{i}") for i, (r, c) in enumerate(tests)),
    )
    every = F.array(*(F.struct(F.lit(r[0]).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"g{i}").alias("good"), F.col(f"b{i}").alias("bad")) for i, (r, c) in enumerate(tests)))
    rows = settle(sums.select("stratum", "n_good", F.explode(every).alias("x")).select("stratum", "n_good", "x.*"), "tests")
    level = delta / F.greatest(F.lit(1), F.col("n_tests"))
    n_tests = sums.agg((F.count("*") * len(rules)).alias("n_tests"))
    tested = rows.crossJoin(F.broadcast(n_tests)).withColumn("tail", binomial_tail(F.col("good"), F.col("n_good"), alpha / len(rules)))  # one row beside each
    gain = F.col("bad") - price * F.col("good")
    passed = tested.where((F.col("tail") <= level) & (gain > 0))
    return passed.groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "good", "bad", "n_good", "tail"), F.struct(gain.alias("g"), F.col("cutoff"))).alias("x")).select("stratum", "rule", "x.*")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", strata: Column | None = None, rules: tuple = RULES, **options) -> DataFrame:
    """Measures, base_failed and kept for every document."""
    measured = settle(measure(docs, id_col, text_col, strata), "measures")
    used = settle(certify(measured, labels, id_col, rules=rules, **options).groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r[0], F.col("cutoff"))).alias(f"cut_{r[0]}") for r in rules)), "cutoffs")
    if used.count() <= STRATA_BROADCAST:
        used = F.broadcast(used)
    out = measured.join(used, "stratum", "left").withColumn("base_failed", base_failed())
    rejected = F.lit(False)
    for r in rules:
        rejected = rejected | F.coalesce(fires(r, F.col(f"cut_{r[0]}")), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected)
