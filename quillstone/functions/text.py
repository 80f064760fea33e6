"""Text, date and number columns for multilingual (Arabic and Latin) documents.

All functions take and return columns and stay in the JVM. `rx` gives a pattern Unicode
classes (`(?U)`) and makes `.` stop only at line feeds (`(?d)`), as such documents need.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str) -> str:
    return f"(?Ud){pattern}"


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match."""
    return F.get(F.transform(F.array(text), lambda v: F.when(v.rlike(rx(pattern)), F.regexp_extract(v, rx(pattern), group))), 0)


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


#: Characters that count as white space at the ends of a field.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column, chars: str = WHITE) -> Column:
    """Without leading and trailing characters of a set (white space by default)."""
    return F.btrim(text, F.lit(chars))


def clean_field(text: Column) -> Column:
    """Without runs of asterisks and white space at either end."""
    return strip(F.regexp_replace(F.regexp_replace(text, rx(r"^\s*\*+\s*"), ""), rx(r"\s*\*+\s*$"), ""))


def field(text: Column, pattern: str, default: str | None = "") -> Column:
    """First capture (lines matter to ^ and $), cleaned; `default` without a match."""
    return F.coalesce(clean_field(capture(text, f"(?m){pattern}")), F.lit(default))


def plain_field(text: Column, pattern: str) -> Column:
    """First capture, stripped; null without a match."""
    return strip(capture(text, pattern))


def drop_bidi(text: Column) -> Column:
    """Without marks that only steer the direction of writing."""
    return F.regexp_replace(text, "[\\u200e\\u200f\\u202a-\\u202e]", "")


def iso_date(text: Column, pattern: str, default: str | None = None) -> Column:
    """A captured dd.MM.yyyy as an ISO date; what isn't a date stays as it is."""
    raw = capture(text, pattern)
    return let(raw, lambda v: F.coalesce(F.date_format(F.try_to_date(v, "dd.MM.yyyy"), "yyyy-MM-dd"), v, F.lit(default)))


#: Accepted orders of day, month and year, the first that fits wins; with a 12-hour time or without.
DATE_ORDERS = ("M/d/yy h:mma", "M/d/yyyy h:mma", "M/d/yy", "M/d/yyyy", "d/M/yy", "d/M/yyyy")


def _year_shape(fmt: str) -> str:
    year = r"\d{4}" if "yyyy" in fmt else r"\d{2}"
    return rf"^\d{{1,2}}/\d{{1,2}}/{year}" + (r"\s+\d{1,2}:\d{2}[AaPp][Mm]$" if "a" in fmt else "$")


def slash_date(text: Column) -> Column:
    """d/m/y or m/d/y (month first where both fit) as dd/MM/yyyy[ HH:mm]; otherwise unchanged.

    Two-digit years from 69 on lie in the 1900s.
    """
    def read(raw: Column) -> Column:
        tries = []
        for fmt in DATE_ORDERS:
            at = F.try_to_timestamp(F.when(raw.rlike(_year_shape(fmt)), F.upper(F.regexp_replace(raw, r"\s+", " "))), F.lit(fmt))
            if "yyyy" not in fmt:
                at = let(at, lambda x: F.when(F.year(x) >= 2069, x - F.expr("interval 100 years")).otherwise(x))
            tries.append(F.date_format(at, "dd/MM/yyyy HH:mm" if "a" in fmt else "dd/MM/yyyy"))
        return F.when(F.length(raw) > 0, F.coalesce(*tries, raw))

    return let(strip(text), read)


def is_arabic(text: Column) -> Column:
    """Whether there is a character of the Arabic block."""
    return text.rlike("[\\u0600-\\u06FF]")


_EASTERN = "٠١٢٣٤٥٦٧٨٩"
_NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def number(text: Column) -> Column:
    """A decimal number as double (Arabic-Indic digits too), else null."""
    plain = F.translate(strip(text), _EASTERN, "0123456789")
    return let(plain, lambda v: F.when(v.rlike(_NUMBER), v.try_cast("double")))


def clean_value(text: Column) -> Column:
    """Without separators at the ends or a closing parenthesis; null if nothing is left."""
    inner = strip(F.regexp_replace(strip(text, " \t:.-،"), rx(r"\s*\([^)]+\)\s*$"), ""))
    return let(inner, lambda v: F.when(~v.isin("", ":", "-", "–"), v))


def first_day(text: Column) -> Column:
    """First d/m/yyyy."""
    return capture(text, r"(\d{1,2}/\d{1,2}/\d{4})")


def first_time(text: Column) -> Column:
    """First h:mm or h.mm, with a colon."""
    return F.replace(capture(text, r"(\d{1,2}[:.]\d{2})"), F.lit("."), F.lit(":"))


def card_number(text: Column) -> Column:
    """An ACA number, turned round where it was read backwards."""
    straight = F.regexp_substr(text, F.lit("ACA-[0-9]{4}-[0-9]{5}-[A-Za-z0-9]{3}"))
    turned = F.regexp_substr(text, F.lit("[A-Za-z0-9]{3}-[0-9]{5}-[0-9]{4}-ACA"))
    return F.coalesce(straight, F.array_join(F.reverse(F.split(turned, "-")), "-"))


def price_text(text: Column) -> Column:
    """A number with grouped thousands and three decimals; other text unchanged."""
    return F.coalesce(F.format_number(number(F.replace(text, F.lit(","), F.lit(""))), 3), text)


def amount(text: Column) -> Column:
    """A number without separators, 0 where there is none."""
    return F.coalesce(number(F.translate(text, ", /", "")), F.lit(0.0))


def quantity(text: Column) -> Column:
    """An integer, 0 where there is none."""
    plain = F.translate(strip(text), _EASTERN, "0123456789")
    return let(plain, lambda v: F.coalesce(F.when(v.rlike(r"^[-+]?\d+$"), v.try_cast("int")), F.lit(0)))


def four_digit_year(text: Column) -> Column:
    """dd/MM/yy as dd/MM/yyyy."""
    at = F.try_to_date(F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), text), "d/M/yy")
    return F.coalesce(F.date_format(at, "dd/MM/yyyy"), text)


def day_first(text: Column) -> Column:
    """Yyyy-MM-dd as dd-MM-yyyy."""
    return F.coalesce(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "dd-MM-yyyy"), text)


def _run_heads(items: Column) -> Column:
    return let(items, lambda v: F.filter(v, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(v, i - 1))))


def dedupe_lines(text: Column) -> Column:
    """Without lines equal to the line before."""
    return F.array_join(_run_heads(F.split(text, "\n")), "\n")


def dedupe_words(text: Column) -> Column:
    """Without words equal to the word before in their line; blank lines stay as they are."""
    words = lambda line: F.filter(F.split(line, rx(r"\s+")), lambda w: w != "")
    kept = lambda line: F.array_join(
        F.aggregate(words(line), F.expr("cast(array() as array<string>)"), lambda acc, w: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == w), acc).otherwise(F.concat(acc, F.array(w)))), " "
    )
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.when(strip(line) == "", line).otherwise(kept(line))), "\n")


#: Fixed value: the totals line that is neither a section nor an entry.
GRAND_TOTAL = "المبلغ الإجمالي"


def is_section_row(cells: Column) -> Column:
    """One filled cell, with Arabic letters and no digit."""
    filled = F.filter(cells, lambda c: strip(c) != "")
    only = F.regexp_replace(F.get(filled, 0), "<[^>]*>", "")
    return (F.size(filled) == 1) & only.rlike("[ء-ي]") & ~only.rlike(r"(?U)\d")


def lacks_core_fields(text: Column) -> Column:
    """None of the fields that every header has."""
    return ~(text.contains("رقم الدخول") | text.contains("الرقم الطبي") | text.contains("المريض"))


def page_separator(mode: Column) -> Column:
    """The line before a page."""
    return F.when(mode == "idcard", "============ ID Card ===========").otherwise("===========page===========")


def file_name(path: Column) -> Column:
    """P5: stem of a path, without a 36-character task id and underscore in front."""
    stem = F.regexp_extract(path, "([^/]+)\\.[^./]*$", 1)
    return F.when((F.length(stem) > 37) & (F.substring(stem, 37, 1) == "_"), F.substring(stem, 38, 1 << 30)).otherwise(stem)


def preview(text: Column, n: int = 500) -> Column:
    """The first characters."""
    return F.left(text, F.lit(n))
