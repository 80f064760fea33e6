"""Service, invoice and totals tables of scanned bills.

`html_table` takes any table by the mode of its document. The other functions take tables of one
kind and give a row for each entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.html import body_rows, data_texts, raw_headers, stripped_lines, table_rows
from quillstone.functions.text import GRAND_TOTAL, amount, let, number, price_text, quantity, strip

#: Column names by width of a service table.
SERVICE_COLUMNS = {
    8: ("company_price", "patient_price", "net_price", "time", "date", "qty", "service_name", "code"),
    10: ("company_price", "patient_price", "net_price", "time", "date", "unit_price", "qty", "unit", "service_name", "code"),
    11: ("company_price", "patient_price", "net_price", "time_to", "date_to", "time_from", "date_from", "operation_type", "qty", "service_name", "code"),
}
PRICES = ("company_price", "patient_price", "net_price", "unit_price")
#: Header texts of invoice tables.
INVOICE_HEADERS = {"القيمة": "price", "البيان": "service_name", "الرمز": "code", "ت": "qty", "أجل": "due_amount", "تقدي": "paid_amount"}
TOTAL_LABELS = ("الإجمالي", "المجموع")
NET_LABEL = "الصافي"




def fitted(cells: Column, width: Column | int) -> Column:
    """Cells padded with empty ones, or cut, to a width."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), F.lit(1), width)


def _data_rows(rows: Column) -> Column:
    """Data cells of the body's rows, with whether one spans columns."""
    return F.transform(body_rows(rows), lambda r: F.struct(r["spans"].alias("spans"), data_texts(r).alias("cells")))


def _said(cells: Column) -> Column:
    """P25: a row that says something, and isn't the grand total."""
    return F.exists(cells, lambda c: c != "") & ~F.array_join(cells, "").contains(GRAND_TOTAL)


def _entry(keys: Column, values: Column) -> Column:
    """A map in which the last of equal keys wins."""
    last = lambda k: F.size(keys) - F.array_position(F.reverse(keys), k)
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p, i: i == last(p["k"])))


def _typed(key: Column, cell: Column) -> Column:
    """Prices and quantities as the text of a number."""
    return F.when(key.isin(*PRICES), amount(cell).cast("string")).when(key == "qty", quantity(cell).cast("string")).otherwise(cell)


def _service_maps(heads: Column, rows: Column) -> Column:
    """H1, P25: entries by column names that go with the width, or by the table's own headers; those without a code are left out."""
    names = F.when(F.lit(False), heads)
    for width, known in SERVICE_COLUMNS.items():
        names = names.when(F.size(heads) == width, F.array(*map(F.lit, known)))

    def of(keys: Column) -> Column:
        real = F.filter(F.transform(rows, lambda r: r["cells"]), _said)
        return F.filter(F.transform(real, lambda c: _entry(keys, F.zip_with(keys, fitted(c, F.size(keys)), _typed))), lambda e: strip(F.coalesce(F.try_element_at(e, F.lit("code")), F.lit(""))) != "")

    return let(names.otherwise(heads), of)


def _invoice_maps(heads: Column, rows: Column) -> Column:
    """Entries by canonical header."""
    names = F.create_map(*(F.lit(x) for pair in INVOICE_HEADERS.items() for x in pair))

    def of(keys: Column) -> Column:
        total = lambda c: c.contains(TOTAL_LABELS[0]) | c.contains(TOTAL_LABELS[1])
        kept = F.filter(rows, lambda r: (F.size(r["cells"]) > 0) & ~r["spans"] & ~total(F.get(r["cells"], 0)) & (F.size(r["cells"]) == F.size(keys)))
        value = lambda k, c: F.when(F.lower(k) == "price", price_text(c)).otherwise(c)
        return F.transform(kept, lambda r: _entry(keys, F.zip_with(keys, r["cells"], value)))

    return let(F.transform(heads, lambda h: F.coalesce(F.element_at(names, h), h)), of)


def _totals(rows: Column) -> Column:
    """The first row of four cells whose last is the net label; amounts that aren't numbers are 0."""
    net = F.get(F.filter(rows, lambda r: (F.size(r["cells"]) == 4) & (strip(F.get(r["cells"], 3)) == NET_LABEL)), 0)["cells"]
    value = lambda i: F.coalesce(number(F.translate(F.get(net, i), " ,", "")), F.lit(0.0))
    return F.when(net.isNotNull(), F.struct(*(value(i).alias(n) for i, n in enumerate(("total", "paid", "amount_due")))))


def _parsed(df: DataFrame, html: str) -> DataFrame:
    """`_heads` and `_rows` of the first table; no rows without one."""
    read = table_rows(df, html)
    return read.withColumn("_heads", raw_headers(F.col("rows"))).withColumn("_rows", F.coalesce(_data_rows(F.col("rows")), F.expr("cast(array() as array<struct<spans:boolean,cells:array<string>>>)"))).drop("rows")


def html_table(df: DataFrame, html: str = "html", mode: str = "") -> DataFrame:
    """H1: the first table of a text by mode: add `category`, `columns`, `entries` (maps) and `footer` (totals).

    `invoice` gives entries by canonical header; `janzour` gives the totals of a table with four headers
    and service entries of any other width; other modes, and texts without a table, give no entries.
    """
    heads, rows = F.col("_heads"), F.col("_rows")
    none = F.expr("cast(array() as array<map<string,string>>)")
    parsed = _parsed(category(df, html), html)
    footer = (F.size(heads) == 4) & F.lit(mode == "janzour")
    entries = _invoice_maps(heads, rows) if mode == "invoice" else F.when(footer, none).otherwise(_service_maps(heads, rows)) if mode == "janzour" else none
    return parsed.withColumns({"columns": heads, "entries": entries, "footer": F.when(footer, _totals(rows))}).drop("_heads", "_rows")


def service_entries(df: DataFrame, width: int, html: str = "html") -> DataFrame:
    """One row per entry of tables with `width` header cells; other tables give none."""
    names = SERVICE_COLUMNS[width]
    parsed = _parsed(df, html).where(F.size("_heads") == width)
    cut = parsed.select(*df.columns, F.posexplode("_rows").alias("row_no", "row")).where(_said(F.col("row.cells"))).withColumn("cell", fitted(F.col("row.cells"), width))
    value = lambda i, n: amount(F.get("cell", i)) if n in PRICES else quantity(F.get("cell", i)) if n == "qty" else F.get("cell", i)
    return cut.where(strip(F.get("cell", names.index("code"))) != "").select(*df.columns, "row_no", *(value(i, n).alias(n) for i, n in enumerate(names)))


def raw_entries(df: DataFrame, html: str = "html") -> DataFrame:
    """H1: entries of service tables of any width, as maps; tables without a column `code` give none."""
    parsed = _parsed(df, html)
    return parsed.select(*df.columns, F.posexplode(_service_maps(F.col("_heads"), F.col("_rows"))).alias("row_no", "entry"))


def invoice_entries(df: DataFrame, html: str = "html") -> DataFrame:
    """One row per invoice entry, cells by canonical header in a map."""
    parsed = _parsed(df, html)
    return parsed.select(*df.columns, F.posexplode(_invoice_maps(F.col("_heads"), F.col("_rows"))).alias("row_no", "entry"))


def totals(df: DataFrame, html: str = "html") -> DataFrame:
    """Total, paid and amount_due of the first net row of a table with four headers; null without such a row."""
    parsed = _parsed(df, html).where(F.size("_heads") == 4).withColumn("_t", _totals(F.col("_rows")))
    return parsed.select(*df.columns, "_t.total", "_t.paid", "_t.amount_due")


def category(df: DataFrame, html: str = "html") -> DataFrame:
    """The last line of text before the first table, totals lines aside; empty without one."""
    lined = stripped_lines(df, html)
    at = F.array_position(F.transform("raw", lambda x: x.contains("<table")), True)
    before = lambda c: F.slice(c, F.lit(1), F.when(at > 0, at - 1).otherwise(F.size("raw")).cast("int"))
    seen = F.filter(F.zip_with(before("lines"), before("raw"), lambda p, r: F.when(~r.contains(GRAND_TOTAL), p)), lambda x: x.isNotNull() & (x != ""))
    return lined.withColumn("category", F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(""))).drop("lines", "raw")


def heading_of(df: DataFrame, html: str, table: str) -> DataFrame:
    """The nearest line of text above the line that holds a whole table; null if no line does."""
    lined = stripped_lines(df, html)
    at = F.array_position(F.transform("raw", lambda x: x.contains(strip(F.col(table)))), True)
    before = F.when(at > 1, F.slice("lines", F.lit(1), (at - 1).cast("int")))
    seen = F.filter(before, lambda x: (x != "") & ~x.contains(GRAND_TOTAL))
    return lined.withColumn("heading", F.try_element_at(seen, F.lit(-1))).drop("lines", "raw")
