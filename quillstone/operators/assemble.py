"""Documents from the rows of many pages: carrying keys forward, merging sections, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import is_section_row, strip


def carry(df: DataFrame, column: str, partition: list[str], order: list[str], name: str | None = None) -> DataFrame:
    """The last value seen so far, in order."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name or column, F.last(column, ignorenulls=True).over(w))


def continuation_key(invoice_number: Column, medical_number: Column) -> Column:
    """What names a page's document: the invoice number, else the medical number; null on pages that go on."""
    said = lambda c: F.nullif(strip(c), F.lit(""))
    return F.coalesce(said(invoice_number), said(medical_number))


def name_sections(rows: DataFrame, cells: str, partition: list[str], order: list[str]) -> DataFrame:
    """Rows of one Arabic cell name the rows after them, and leave."""
    head = is_section_row(F.col(cells))
    named = rows.withColumn("_section", F.when(head, F.regexp_replace(F.get(F.filter(cells, lambda c: F.trim(c) != ""), 0), "<[^>]*>", ""))).withColumn("_head", head)
    return carry(named, "_section", partition, order, "section_name").where(~F.col("_head")).drop("_section", "_head")


def document_headers(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """A document's header is the first value seen of each field; later ones don't count."""
    place = F.struct(*order)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields))


def merge_sections(items: DataFrame, key: str, order: list[str], item: Column) -> DataFrame:
    """Items of one section name together, whatever page they are on, in order; repeats stay."""
    rows = items.select(key, "section_name", F.struct(*order, item.alias("item")).alias("x"))
    return rows.groupBy(key, "section_name").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias("items"))


def last_uncoded(items: DataFrame, keys: list[str], order: list[str], code: str, value: str) -> DataFrame:
    """The value of a section's last row if that row has no code, else null."""
    last = F.max_by(F.struct(code, value), F.struct(*order))
    return items.groupBy(*keys).agg(F.when(F.coalesce(last[code], F.lit("")) == "", last[value]).alias("section_subtotal"))


def labelled_total(items: DataFrame, keys: list[str], order: list[str], label: str, value: str, word: str = "الإجمالي") -> DataFrame:
    """The value of a section's last row that says it is the total."""
    return items.groupBy(*keys).agg(F.max_by(value, F.when(F.col(label).contains(word), F.struct(*order))).alias("section_subtotal"))


def net_total(grand: Column, section_sum: Column) -> Column:
    """The grand total if one is given, else the sum of section totals."""
    return F.coalesce(grand, section_sum)


def net_totals(rows: DataFrame, keys: list[str], grand: str, section_total: str, amount_due: str) -> DataFrame:
    """Net total per document: its one grand total, else (none, or several that differ) the sum of the section totals that are given; what is due is never computed."""
    one = F.when(F.count_distinct(grand) == 1, F.max(grand))
    return rows.groupBy(*keys).agg(net_total(one, F.sum(section_total)).alias("net_total"), F.max(amount_due).alias("amount_due"))


def last_nonzero(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row in which any value isn't zero."""
    some = F.exists(F.array(*(F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values)), lambda v: v != 0)
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.when(some, F.struct(*order))).alias("_x"))
    return picked.select(*keys, *(F.col("_x")[v].alias(v) for v in values))


#: Words of services that only inpatients get.
INPATIENT_WORDS = "جراح|عملي|إقامة|ايواء|إيواء|سرير|surgery|operation|stay|bed"


def outpatient(services: Column, admitted: Column, left: Column) -> Column:
    """A18 (aggregate): 0 if any service or a longer stay says inpatient, else 1."""
    words = F.coalesce(F.bool_or(F.lower(services).rlike(INPATIENT_WORDS)), F.lit(False))
    stayed = F.coalesce(F.bool_or(admitted != left), F.lit(False))
    return (1 - (words | stayed).cast("int")).alias("outpatient")
