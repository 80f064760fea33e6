"""Text, date and number columns against values derived by hand."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as t


def value(spark, fn, text, kind="string"):
    return spark.createDataFrame([(text,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("fn", "text", "want"),
    [
        (t.clean_field, "** ab **", "ab"),
        (t.clean_field, "*a*b*", "a*b"),
        (t.clean_field, None, None),
        (t.drop_bidi, "a‏b", "ab"),
        (t.slash_date, "24/04/2025", "24/04/2025"),
        (t.slash_date, "05/04/2025", "04/05/2025"),
        (t.slash_date, "4/5/69", "05/04/1969"),
        (t.slash_date, "4/5/68", "05/04/2068"),
        (t.slash_date, "04/24/25 10:30AM", "24/04/2025 10:30"),
        (t.slash_date, "04/24/25 10:30 AM", "04/24/25 10:30 AM"),
        (t.slash_date, "", None),
        (t.is_arabic, "تحاليل", True),
        (t.is_arabic, "abc", False),
        (t.card_number, "id ACA-1234-00080-P02 x", "ACA-1234-00080-P02"),
        (t.card_number, "P02-00080-1234-ACA", "ACA-1234-00080-P02"),
        (t.dedupe_lines, "a\na\nb\na", "a\nb\na"),
        (t.dedupe_words, "a a b\n \nc  c", "a b\n \nc"),
        (t.clean_value, " : كشف (x) ", "كشف"),
        (t.clean_value, " - ", None),
        (t.price_text, "1,234.5", "1,234.500"),
        (t.price_text, "n/a", "n/a"),
        (t.amount, "1,000.5 /", 1000.5),
        (t.amount, "x", 0.0),
        (t.amount, "١٢.٥", 12.5),
        (t.quantity, "2", 2),
        (t.quantity, "1.0", 0),
        (t.first_time, "at 10.30", "10:30"),
        (t.file_name, "/a/01234567-89ab-4def-8123-456789abcdef_scan 1.pdf", "scan 1"),
        (t.file_name, "/a/scan.v2.pdf", "scan.v2"),
        (t.lacks_core_fields, "x", True),
    ],
)
def test_value(spark, fn, text, want):
    assert value(spark, fn, text) == want


@pytest.mark.parametrize(("text", "want"), [("ت الدخول: 24.04.2025", "2025-04-24"), ("ت الدخول: 31.02.2025", "31.02.2025"), ("none", None)])
def test_iso_date(spark, text, want):
    assert value(spark, lambda c: t.iso_date(c, r"ت\s*الدخول[:：]?\s*(\d{2}\.\d{2}\.\d{4})"), text) == want


@pytest.mark.parametrize(("cells", "want"), [(["", "عمليات جراحية", ""], True), (["", "غرفة 2", ""], False), (["ا", "ب"], False)])
def test_section_row(spark, cells, want):
    assert value(spark, t.is_section_row, cells, "array<string>") is want


def test_idempotent(spark):
    for fn in (t.dedupe_lines, t.drop_bidi, t.clean_field):
        for text in ("a\na\nb", " ** x *", "‏‏"):
            once = value(spark, fn, text)
            assert value(spark, fn, once) == once
