"""HTML tables as nested rows: the one parsing step that needs Python, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.runtime import once, ship

ROW = pa.struct([("head", pa.bool_()), ("body", pa.bool_()), ("spans", pa.bool_()), ("cells", pa.list_(pa.string())), ("heads", pa.list_(pa.bool_()))])
ROWS_DDL = "array<struct<head:boolean,body:boolean,spans:boolean,cells:array<string>,heads:array<boolean>>>"
#: Ends of lines, as Python's splitlines has them.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
_PARTS = "table|thead|tbody|tfoot|tr|td|th"
_INLINE = "a|b|big|body|br|caption|center|col|colgroup|div|em|font|h[1-6]|head|hr|html|i|img|li|ol|p|s|small|span|strong|sub|sup|u|ul"
_ATTRIBUTE = r"""[ \t\n\r\f]+([a-z][a-z0-9_:.-]*)(?:=(?:"[^"<>]*"|'[^'<>]*'|[a-z0-9_%#.-]+))?"""
_ATTRIBUTES = "(?:" + _ATTRIBUTE.replace("([a-z]", "(?:[a-z]") + ")*"
_NAMES = re.compile(_ATTRIBUTE, re.IGNORECASE | re.ASCII)
#: A tag that can't be read in two ways, with the text behind it: end, start and attributes of a table's parts, or another tag.
_TAG = re.compile(rf"<(?:/({_PARTS})|({_PARTS})({_ATTRIBUTES})[ \t\n\r\f]*|/(?:{_INLINE})|(?:{_INLINE}){_ATTRIBUTES}[ \t\n\r\f]*/?)>([^<]*)", re.IGNORECASE | re.ASCII)
_BARE = re.compile(rf"</?(?:{_INLINE})>")


def _bare_cells(row: str, tag: str) -> list[str] | None:
    """Cells between the first start and the last end of a row that has only `tag` and inline tags, none with attributes."""
    cells = row.split(f"</{tag}><{tag}>")
    if row.count("<") > 2 * (len(cells) - 1):
        for i, c in enumerate(cells):
            if "<" in c:
                parts = _BARE.split(c)
                cells[i] = "".join([x.strip() for x in parts])
                if "<" in cells[i]:
                    return None
    return [c.strip() for c in cells]


class _Tables(HTMLParser):
    """Rows of the first table. A row knows whether it is in the first head or the first body,
    its cells, which of them are headers (`heads`, empty where none is), and whether a data cell
    spans columns. Text nodes of a cell are stripped and joined without a blank."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.depth, self.done, self.section, self.cell = 0, False, "", None
        self.begun: set[str] = set()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif not self.depth:
            return
        elif tag in ("thead", "tbody", "tfoot"):
            self.section = "" if tag in self.begun else tag
            self.begun.add(tag)
        elif tag == "tr":
            self.cell = None
            self.rows.append({"head": self.section == "thead", "body": self.section == "tbody", "spans": False, "cells": [], "heads": []})
        elif tag in ("td", "th") and self.rows:
            self.cell = []
            self.rows[-1]["cells"].append(self.cell)
            self.rows[-1]["heads"].append(tag == "th")
            if tag == "td" and any(k == "colspan" for k, _ in attrs):
                self.rows[-1]["spans"] = True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self.cell = None
        elif tag in ("thead", "tbody", "tfoot"):
            self.section = ""
        elif tag == "table" and self.depth:
            self.depth -= 1
            self.done = not self.depth

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data.strip())

    def read(self, html: str) -> bool:
        """Take a text of plain tags by whole rows or tags; False, with rows that don't count, where it holds anything else."""
        if "&" in html:
            return False
        at = html.find("<")
        while at >= 0:
            if self.depth and not self.done:
                tag = "td" if html.startswith("<tr><td>", at) else "th" if html.startswith("<tr><th>", at) else ""
                end = html.find(f"</{tag}></tr>", at) if tag else -1
                cells = _bare_cells(html[at + 8 : end], tag) if end >= 0 else None
                if cells is not None:
                    self.rows.append({"head": self.section == "thead", "body": self.section == "tbody", "spans": False, "cells": cells, "heads": [tag == "th"] * len(cells)})
                    self.cell = None
                    at = html.find("<", end + 10)
                    continue
            m = _TAG.match(html, at)
            if m is None:
                return False
            ends, begins, attributes, text = m.groups()
            if ends:
                self.handle_endtag(ends.lower())
            elif begins:
                self.handle_starttag(begins.lower(), [(k.lower(), None) for k in _NAMES.findall(attributes)] if attributes else [])
            if text:
                self.handle_data(text)
            at = html.find("<", m.end())
        return True

    def table(self) -> list[dict]:
        for r in self.rows:
            r["cells"] = [c if type(c) is str else "".join(c) for c in r["cells"]]
            if True not in r["heads"]:
                r["heads"] = []
        return self.rows


def parse_rows(html: str | None) -> list[dict] | None:
    if html is None:
        return None
    p = _Tables()
    if not p.read(html):
        p = _Tables()
        p.feed(html)
        p.close()
    return p.table()


def in_columns(tables: list[list[dict] | None]) -> pa.Array:
    """Tables as one Arrow array, built column by column."""
    rows = [r for t in tables for r in t or ()]
    ends = lambda parts: pa.array([0, *accumulate(len(p) for p in parts)], pa.int32())
    flat = lambda n: pa.ListArray.from_arrays(ends([r[n] for r in rows]), pa.array(list(chain.from_iterable(r[n] for r in rows)), ROW.field(n).type.value_type))
    columns = [flat(f.name) if pa.types.is_list(f.type) else pa.array([r[f.name] for r in rows], f.type) for f in ROW]
    return pa.ListArray.from_arrays(ends([t or () for t in tables]), pa.StructArray.from_arrays(columns, fields=list(ROW)), mask=pa.array([t is None for t in tables]))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data.strip())


def plain_text(html: str) -> str:
    """Text nodes, stripped and joined."""
    p = _Text()
    p.feed(html)
    p.close()
    return "".join(p.parts)


def table_rows(df: DataFrame, html: str) -> DataFrame:
    """Add `rows`: the first table's rows."""
    ship(df.sparkSession)

    @F.arrow_udf(ROWS_DDL)
    def rows(texts: pa.Array) -> pa.Array:
        return in_columns([parse_rows(t) for t in texts.to_pylist()])

    return df.withColumn("rows", once(rows)(F.col(html)))


def stripped_lines(df: DataFrame, html: str) -> DataFrame:
    """Add `raw`, the lines of an HTML text, and `lines`, each of them as plain text."""
    ship(df.sparkSession)

    @F.arrow_udf("array<string>")
    def plain(lines: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [plain_text(y) for y in x] for x in lines.to_pylist()], pa.list_(pa.string()))

    return df.withColumn("raw", F.split(html, LINE_END)).withColumn("lines", once(plain)(F.col("raw")))


def data_texts(row: Column) -> Column:
    """Data cells of a row, without its header cells."""
    return F.when(F.size(row["heads"]) == 0, row["cells"]).otherwise(F.filter(row["cells"], lambda c, i: ~F.get(row["heads"], i)))


def plain_table(rows: Column) -> Column:
    """H2: rows as lines, cells joined by blanks; empty without a table."""
    return F.coalesce(F.array_join(F.transform(rows, lambda r: F.array_join(r["cells"], " ")), "\n"), F.lit(""))


def raw_headers(rows: Column) -> Column:
    """Header cells of the first row of the head; none without a head."""
    first = F.get(F.filter(rows, lambda r: r["head"]), 0)
    return F.coalesce(F.filter(first["cells"], lambda c, i: F.coalesce(F.get(first["heads"], i), F.lit(False))), F.expr("cast(array() as array<string>)"))


def body_rows(rows: Column) -> Column:
    """Rows of the body, or all rows where the table has no body."""
    body = F.filter(rows, lambda r: r["body"])
    return F.when(F.size(body) > 0, body).otherwise(rows)


def register(spark: SparkSession) -> None:
    """The HTML functions for SQL: `html_rows(text)`, the first table's rows, and `html_text(text)`, text nodes joined."""
    ship(spark)

    @F.arrow_udf(ROWS_DDL)
    def html_rows(texts: pa.Array) -> pa.Array:
        return in_columns([parse_rows(t) for t in texts.to_pylist()])

    @F.arrow_udf("string")
    def html_text(texts: pa.Array) -> pa.Array:
        return pa.array([None if t.as_py() is None else plain_text(t.as_py()) for t in texts], pa.string())

    spark.udf.register("html_rows", html_rows)
    spark.udf.register("html_text", html_text)
