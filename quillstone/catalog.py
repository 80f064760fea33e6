"""Registered queries over the document-analytics operators, with their DuckDB SQL.

The tables hold no scanned documents, so many queries render text or HTML from their columns
and read it back: the SQL then selects the columns themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import geometry as g
from quillstone.functions import text as t
from quillstone.functions.html import plain_table, table_rows
from quillstone.operators import assemble, events, headers, models, pages, router, tables
from quillstone.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that must agree with it."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as pages: system turns are identity cards."""
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("pdf_name"), F.concat(F.lit("/in/"), F.col("conv_id"), F.lit(".pdf")).alias("pdf_path"), F.col("turn").alias("page_num"), F.when(F.col("role") == "system", "idcard").otherwise("janzour").alias("mode"), "role", "text")


# --- pages -----------------------------------------------------------------------------------


@query("""
SELECT CAST(conv_id AS VARCHAR) AS pdf_name, count(*) AS n_pages,
  string_agg(CASE WHEN role = 'system' THEN '============ ID Card ===========' ELSE '===========page===========' END || chr(10) || text, chr(10) ORDER BY turn) AS joined_text
FROM conversations GROUP BY conv_id""")
def q01_group_pages_join(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf).select("*", F.col("text").alias("result"), *(F.lit(None).cast("string").alias(c) for c in ("status", "reason", "error", "processed_path")))
    return pages.group_pages(p).select("pdf_name", long(F.size("pages")).alias("n_pages"), "joined_text")


@query("""
SELECT CAST(conv_id AS VARCHAR) AS pdf_name, count(*) FILTER (role = 'user') AS n_pages,
  coalesce(string_agg(turn || ':' || CASE WHEN role = 'system' THEN 'skipped' ELSE 'boom' END, ',' ORDER BY turn) FILTER (role <> 'user'), '') AS skipped
FROM conversations GROUP BY conv_id""")
def q02_group_skips(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("role")
    p = _pages(spark, sf).select("*", F.col("text").alias("result"), F.when(r == "system", "skipped").when(r == "assistant", "error").alias("status"), F.when(r == "system", "").alias("reason"), F.when(r == "assistant", "boom").alias("error"), F.lit(None).cast("string").alias("processed_path"))
    said = F.array_join(F.transform("skipped_pages", lambda s: F.concat_ws(":", s["page_num"].cast("string"), s["reason"])), ",")
    return pages.group_pages(p).select("pdf_name", long(F.size("pages")).alias("n_pages"), said.alias("skipped"))


@query("""
SELECT CAST(conv_id AS VARCHAR) AS pdf_name, count(*) AS n_pages, count(*) FILTER (role <> 'system') AS n_read, count(*) FILTER (role = 'system') AS n_skipped,
  coalesce(CAST(sum(length(text)) FILTER (role <> 'system') AS DOUBLE) / nullif(count(*) FILTER (role <> 'system'), 0), 0.0) AS chars_per_page
FROM conversations GROUP BY conv_id""")
def q03_page_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf).withColumn("status", F.when(F.col("role") == "system", "skipped")).withColumn("result", F.when(F.col("role") != "system", F.col("text")))
    counts = pages.page_counts(p, "pdf_name")
    chars = p.groupBy("pdf_name").agg(F.sum(F.length("result")).alias("chars"))
    return counts.join(chars, "pdf_name").select("pdf_name", "n_pages", "n_read", "n_skipped", pages.per_page(F.col("chars").cast("double"), F.col("n_read")).alias("chars_per_page"))


@query("""
SELECT CAST(conv_id AS VARCHAR) AS pdf_name, string_agg(text, chr(10) ORDER BY turn) AS joined_text FROM conversations GROUP BY conv_id""")
def q46_plain_join(spark: SparkSession, sf: str) -> DataFrame:
    return pages.joined_plain(_pages(spark, sf).withColumn("result", F.col("text")))


@query("""
SELECT conv_id, turn, role, CASE WHEN role <> 'system' THEN text END AS result FROM conversations""")
def q47_attach_results(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf).withColumn("page_uuid", pages.page_id(F.col("pdf_path"), F.col("page_num")))
    done = p.where("role <> 'system'").select("page_uuid", F.col("text").alias("result"))
    return pages.attach_results(p, done).select(F.col("pdf_name").cast("bigint").alias("conv_id"), F.col("page_num").alias("turn"), "role", "result")


@query("""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role AS job, length(text) AS result FROM conversations""")
def q48_zip_by_position(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("x"))
    both = c.select("conv_id", F.col("x.role").alias("jobs"), F.transform("x.n", lambda n: n.cast("bigint")).alias("results"))
    return pages.attach_by_position(both, "jobs", "results").withColumn("pos", long("pos"))


@query("""
SELECT page_id, 'p' || page_id || '.png' AS image_path FROM pages WHERE page_id % 3 = 0""")
def q49_existing_images(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id"), F.lit(".png")).alias("image_path"))
    return pages.existing_images(p, p.where("page_id % 3 = 0").select(F.col("image_path").alias("path"))).select("page_id", "image_path")


@query("""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'skipped' ELSE 'error' END AS status, CASE WHEN page_id % 3 = 0 THEN length(html) END AS n, CASE WHEN page_id % 3 = 2 THEN 'bad' END AS error FROM pages""")
def q50_page_stream(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    part = lambda k, s: p.where(f"page_id % 3 = {k}").select("page_id", F.lit(s).alias("status"), *([long(F.length("html")).alias("n")] if k == 0 else []), *([F.lit("bad").alias("error")] if k == 2 else []))
    return pages.page_stream(part(0, "ok"), part(1, "skipped"), part(2, "error"))


# --- text, dates and numbers -----------------------------------------------------------------


@query("""
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), chr(10)) AS kept FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def q04_dedupe_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.dedupe_lines(F.col("text")).alias("kept"))


@query(r"""
WITH w AS (SELECT doc_id, line, n, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))
SELECT doc_id, string_agg(CASE WHEN len(ws) = 0 THEN line ELSE array_to_string(list_filter(ws, lambda x, i: i = 1 OR x <> ws[i - 1]), ' ') END, chr(10) ORDER BY n) AS kept FROM w GROUP BY doc_id""")
def q05_dedupe_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.dedupe_words(F.col("text")).alias("kept"))


@query("SELECT doc_id, text AS plain FROM documents")
def q06_bidi_strip(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.concat(F.lit("‏"), F.replace("text", F.lit(" "), F.lit("‪ ‎")), F.lit("‮"))
    return table(spark, sf, "documents").select("doc_id", t.drop_bidi(marked).alias("plain"))


@query("SELECT p_partkey, p_name AS name FROM part")
def q07_clean_field(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", t.clean_field(F.concat(F.lit(" ** "), F.col("p_name"), F.lit(" *** \t"))).alias("name"))


@query("SELECT p_partkey, p_partkey % 2 = 0 AS arabic FROM part")
def q08_arabic_flag(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", t.is_arabic(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" تحاليل"))).otherwise(F.col("p_name"))).alias("arabic"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '31.02.2025' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def q09_date_dmy_iso(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("ت الدخول: "), F.when(F.col("o_orderkey") % 7 == 0, "31.02.2025").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")))
    return table(spark, sf, "orders").select("o_orderkey", t.iso_date(said, r"ت\s*الدخول[:：]?\s*(\d{2}\.\d{2}\.\d{4})").alias("day"))


@query("""
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%-m/%-d/%y') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 2 THEN strftime(o_orderdate, '%-d/%-m/%Y') ELSE strftime(o_orderdate, '%-d/%-m/') || (50 + o_orderkey % 50) END AS s FROM orders)
SELECT o_orderkey, coalesce(strftime(coalesce(try_strptime(s, '%m/%d/%y'), try_strptime(s, '%m/%d/%Y'), try_strptime(s, '%d/%m/%y'), try_strptime(s, '%d/%m/%Y')), '%d/%m/%Y'), s) AS day FROM s""")
def q10_slash_date(spark: SparkSession, sf: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    said = F.when(k % 4 == 0, F.date_format(d, "M/d/yy")).when(k % 4 == 1, F.date_format(d, "M/d/yyyy")).when(k % 4 == 2, F.date_format(d, "d/M/yyyy")).otherwise(F.concat(F.date_format(d, "d/M/"), (50 + k % 50).cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", t.slash_date(said).alias("day"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS long_year, strftime(o_orderdate, '%d-%m-%Y') AS day_first FROM (SELECT o_orderkey, o_orderdate + INTERVAL 10 YEAR AS o_orderdate FROM orders)""")
def q51_date_styles(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate") + F.expr("interval 10 years")
    return table(spark, sf, "orders").select("o_orderkey", t.four_digit_year(F.date_format(d, "dd/MM/yy")).alias("long_year"), t.day_first(F.date_format(d, "yyyy-MM-dd")).alias("day_first"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS price, CAST(l_quantity AS INTEGER) AS qty, format('{:,.3f}', l_extendedprice) AS price_text, 0.0::DOUBLE AS bad FROM lineitem""")
def q44_numbers(spark: SparkSession, sf: str) -> DataFrame:
    grouped = F.format_number("l_extendedprice", 2)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", t.amount(F.concat(F.lit(" "), grouped, F.lit(" /"))).alias("price"), t.quantity(F.col("l_quantity").cast("int").cast("string")).alias("qty"), t.price_text(grouped).alias("price_text"), t.amount(F.lit("x12d")).alias("bad"))


@query("""
SELECT c_custkey, 'ACA-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '-P02' AS card FROM customer""")
def q43_card_number(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")
    said = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("id ACA-"), a, F.lit("-"), b, F.lit("-P02 x"))).otherwise(F.concat(F.lit("P02-"), b, F.lit("-"), a, F.lit("-ACA")))
    return table(spark, sf, "customer").select("c_custkey", t.card_number(said).alias("card"))


@query("SELECT doc_id, doc_id % 2 = 0 AS lacking, left(text, 500) AS preview FROM documents")
def q52_core_fields(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.col("text"), F.lit("\nالرقم الطبي 7")))
    return table(spark, sf, "documents").select("doc_id", t.lacks_core_fields(said).alias("lacking"), t.preview(F.col("text")).alias("preview"))


@query("""
SELECT page_id, 'scan ' || page_id AS pdf_name FROM pages WHERE page_id % 2 = 0""")
def q40_filename(spark: SparkSession, sf: str) -> DataFrame:
    stem = F.concat(F.lit("scan "), F.col("page_id").cast("string"))
    task = F.lit("01234567-89ab-4def-8123-456789abcdef")
    name = F.concat(F.lit("/in/"), F.when(F.col("page_id") % 4 == 0, F.concat(task, F.lit("_"))).otherwise(""), stem, F.when(F.col("page_id") % 2 == 0, ".PDF").otherwise(".txt"))
    from quillstone.sources.files import only_pdfs

    return only_pdfs(table(spark, sf, "pages").withColumn("filename", name)).select("page_id", t.file_name(F.col("filename")).alias("pdf_name"))


# --- headers ---------------------------------------------------------------------------------


@query("""
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS invoice_number, CAST(o_custkey AS VARCHAR) AS file_number, c_name AS patient_name, strftime(o_orderdate, '%Y-%m-%d') AS admission_date, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS discharge_date, c_mktsegment AS company_name
FROM orders JOIN customer ON o_custkey = c_custkey""")
def q11_massara_header(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = lambda c: F.date_format(c, "dd.MM.yyyy")
    said = F.concat(F.lit("إيصال رقم: "), "o_orderkey", F.lit("\nرقم الملف: "), "o_custkey", F.lit("\nاسم المريض: "), "c_name", F.lit(" \nت الدخول: "), day("o_orderdate"), F.lit("\nت الخروج: "), day(F.col("o_orderdate") + F.expr("interval 3 days")), F.lit("\nالشركة: "), "c_mktsegment", F.lit("\n"))
    return o.select("o_orderkey", headers.massara_header(said).alias("h")).select("o_orderkey", "h.*")


@query("""
SELECT o_orderkey, round(o_totalprice, 2) AS total_price, CASE WHEN o_orderkey % 2 = 0 THEN 0.0::DOUBLE END AS price_paid, CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE '-' END AS paid_text FROM orders""")
def q12_massara_footer(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("الاجمالي: 1\n**الاجمالي:** "), F.format_number("o_totalprice", 2), F.lit(" دينار\n"), F.when(F.col("o_orderkey") % 2 == 0, "المدفوع: 0").otherwise("- المدفوع: 5"))
    return table(spark, sf, "orders").select("o_orderkey", headers.massara_footer(said).alias("f")).select("o_orderkey", F.round("f.total_price.num", 2).alias("total_price"), F.col("f.price_paid.num").alias("price_paid"), F.col("f.price_paid.raw").alias("paid_text"))


@query("""
SELECT o_orderkey, c_name AS patient_name, CAST(o_orderkey AS VARCHAR) AS entry_number, CAST(c_custkey AS VARCHAR) AS medical_number, c_mktsegment AS company_name,
  CASE WHEN day(o_orderdate) <= 12 AND month(o_orderdate) <= 12 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS admission_date, '18:48' AS admission_time, '12:32' AS discharge_time
FROM orders JOIN customer ON o_custkey = c_custkey""")
def q13_janzour_header(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    said = F.concat(F.lit("المريض: "), "c_name", F.lit("\nرقم الدخول: "), "o_orderkey", F.lit("\nالرقم الطبي: **"), "c_custkey", F.lit("**\nالجهة: "), "c_mktsegment", F.lit("\nالإقامة: من "), day, F.lit(" 18:48 إلى "), day, F.lit(" 12:32\n"))
    return o.select("o_orderkey", headers.janzour_header(said).alias("h")).select("o_orderkey", "h.patient_name", "h.entry_number", "h.medical_number", "h.company_name", "h.admission_date", "h.admission_time", "h.discharge_time")


@query("""
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS invoice_number, c_name AS patient_name, CAST(c_custkey AS VARCHAR) AS file_number, strftime(o_orderdate, '%d/%m/%Y') AS date, '10:30' AS time, CAST(NULL AS VARCHAR) AS agreement
FROM orders JOIN customer ON o_custkey = c_custkey""")
def q14_invoice_header(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    said = F.concat(F.lit("إيصال تفصيلي رقم: "), "o_orderkey", F.lit("\nاسم المريض: "), "c_name", F.lit("\nالرقم الطبي\n\n"), "c_custkey", F.lit("\nالتاريخ: "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" الساعة 10:30"))
    parsed = headers.invoice_header(o.select("o_orderkey", said.alias("text")))
    return parsed.select("o_orderkey", *(F.col(f"header.{n}").alias(n) for n in ("invoice_number", "patient_name", "file_number", "date", "time", "agreement")))


@query("""
SELECT c_custkey, c_name AS name, CAST(c_custkey + 100000 AS VARCHAR) AS id_number, CASE WHEN c_custkey % 3 > 0 THEN '2025-2026' END AS validity, c_mktsegment AS company FROM customer""")
def q15_idcard_parse(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.when(F.col("c_custkey") % 2 == 0, "اسم الموظف: ").otherwise("الاسم: "), "c_name", F.lit("\nالرقم الوطني: "), (F.col("c_custkey") + 100000).cast("string"), F.when(F.col("c_custkey") % 3 > 0, "\nصلاحية: 2025-2026").otherwise(""), F.lit("\nالمؤسسة: "), "c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", headers.id_card(said).alias("h")).select("c_custkey", "h.*")


# --- tables ----------------------------------------------------------------------------------


def _html(spark: SparkSession, sf: str, heads: list[str], cells: list[Column | str], extra: str = "") -> DataFrame:
    """Line items of each order as one HTML table; the last cell numbers the items of an order."""
    th = "".join(f"<th>{h}</th>" for h in heads)
    td = F.concat(F.lit("<tr>"), *(x for c in cells for x in (F.lit("<td>"), c, F.lit("</td>"))), F.lit("</tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", td.alias("r")))), lambda x: x["r"]), "\n")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit(f"<table>\n<thead><tr>{th}</tr></thead><tbody>"), rows, F.lit(f"{extra}</tbody></table>")).alias("html"))


def _code() -> Column:
    return F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))


_SQL_CODE = "l_linenumber || '-' || l_partkey || '-' || l_suppkey"


@query(f"""
SELECT l_orderkey, format('{{:,.3f}}', l_extendedprice) AS price, 'خدمة ' || l_returnflag AS service_name, {_SQL_CODE} AS code, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS qty FROM lineitem""")
def q16_table_invoice(spark: SparkSession, sf: str) -> DataFrame:
    html = _html(spark, sf, ["القيمة", "البيان", "الرمز", "ت"], [F.format_number("l_extendedprice", 2), F.concat(F.lit("خدمة "), "l_returnflag"), _code(), F.col("l_quantity").cast("int").cast("string")], "<tr><td colspan=3>x</td><td>1</td></tr><tr><td>المجموع</td><td></td><td></td><td></td></tr><tr><td>1</td></tr>")
    return tables.invoice_entries(html).select("l_orderkey", *(F.element_at("entry", n).alias(n) for n in ("price", "service_name", "code", "qty")))


def _service(spark: SparkSession, sf: str, width: int) -> DataFrame:
    money, n = F.format_number("l_extendedprice", 2), F.col("l_quantity").cast("int").cast("string")
    named = {"company_price": money, "patient_price": F.lit("5"), "net_price": F.lit("x"), "unit_price": money, "qty": n, "service_name": F.concat(F.lit("تحليل<br>"), "l_returnflag"), "code": _code()}
    cells = [named.get(c, F.lit(c)) for c in tables.SERVICE_COLUMNS[width]]
    blank = "<td></td>" * (width - 1)
    html = _html(spark, sf, [f"h{i}" for i in range(width)], cells, f"<tr>{blank}<td></td></tr><tr><td>المبلغ الإجمالي</td>{blank}</tr><tr><td>1</td></tr>")
    return tables.service_entries(html, width).drop("html", "row_no")


_SERVICE_SQL = "SELECT l_orderkey, l_extendedprice AS company_price, 5.0::DOUBLE AS patient_price, 0.0::DOUBLE AS net_price, {} CAST(l_quantity AS INTEGER) AS qty, 'تحليل' || l_returnflag AS service_name, " + _SQL_CODE + " AS code FROM lineitem"


@query(_SERVICE_SQL.format("'time' AS time, 'date' AS date,"))
def q17_table_service8(spark: SparkSession, sf: str) -> DataFrame:
    return _service(spark, sf, 8)


@query(_SERVICE_SQL.format("'time' AS time, 'date' AS date, l_extendedprice AS unit_price, 'unit' AS unit,"))
def q17_table_service10(spark: SparkSession, sf: str) -> DataFrame:
    return _service(spark, sf, 10)


@query(_SERVICE_SQL.format("'time_to' AS time_to, 'date_to' AS date_to, 'time_from' AS time_from, 'date_from' AS date_from, 'operation_type' AS operation_type,"))
def q17_table_service11(spark: SparkSession, sf: str) -> DataFrame:
    return _service(spark, sf, 11)


@query(f"SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS qty, {_SQL_CODE} AS code, 'last' AS blank, '' AS missing FROM lineitem WHERE l_linenumber <> 3")
def q53_table_raw(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("l_linenumber") != 3, _code()).otherwise(" ")
    html = _html(spark, sf, ["", "qty", "code", "", "missing"], [F.lit("first"), F.col("l_linenumber").cast("string"), code, F.lit("last")])
    return tables.raw_entries(html).select("l_orderkey", *(F.element_at("entry", n).alias(n or "blank") for n in ("qty", "code", "", "missing")))


@query("SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS total, CAST(sum(l_linenumber) AS DOUBLE) AS paid, 0.0::DOUBLE AS amount_due FROM lineitem GROUP BY l_orderkey")
def q18_table_totals(spark: SparkSession, sf: str) -> DataFrame:
    sums = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))
    row = F.concat(F.lit("<tr><td>"), F.format_number("n", 1), F.lit("</td><td>"), F.col("s").cast("string"), F.lit("</td><td>1/2</td><td> الصافي </td></tr>"))
    other = "<tr><td>9</td><td>9</td><td>9</td><td>الصافي بعد الخصم</td></tr><tr><td>7</td><td>7</td><td>7</td><td>الصافي</td><td>7</td></tr>"
    html = F.concat(F.lit(f"<table><thead><tr><th>a</th><th>b</th><th>c</th><th>d</th></tr></thead><tbody>{other}"), row, F.lit("<tr><td>8</td><td>8</td><td>8</td><td>الصافي</td></tr></tbody></table>"))
    return tables.totals(sums.select("l_orderkey", html.alias("html"))).drop("html")


@query("SELECT n_regionkey, string_agg(n_nationkey || ' ' || n_name, chr(10) ORDER BY n_nationkey) AS plain FROM nation GROUP BY n_regionkey")
def q19_table_plain(spark: SparkSession, sf: str) -> DataFrame:
    row = F.concat(F.lit("<tr><th> "), "n_nationkey", F.lit("</th><td>"), "n_name", F.lit(" </td></tr>"))
    html = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<p>x</p><table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]), ""), F.lit("</table><table><tr><td>y</td></tr></table>")).alias("html"))
    return table_rows(html, "html").select("n_regionkey", plain_table(F.col("rows")).alias("plain"))


_FLAGS = {"A": "عمليات", "N": "تحاليل", "R": "أدوية"}


@query(f"SELECT l_orderkey, {_SQL_CODE} AS code, CASE l_returnflag WHEN 'A' THEN 'عمليات' WHEN 'N' THEN 'تحاليل' ELSE 'أدوية' END AS section_name FROM lineitem")
def q20_section_rows(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    name = F.when(F.col("l_returnflag") == "A", _FLAGS["A"]).when(F.col("l_returnflag") == "N", _FLAGS["N"]).otherwise(_FLAGS["R"])
    items = li.select("l_orderkey", F.col("l_returnflag").alias("flag"), F.lit(1).alias("rank"), _code().alias("code"), F.array(F.lit("1"), F.lit("x"), _code()).alias("cells"))
    heads = li.select("l_orderkey", F.col("l_returnflag").alias("flag"), F.lit(0).alias("rank"), F.lit("").alias("code"), F.array(F.lit(""), F.concat(F.lit("<b>"), name, F.lit("</b>")), F.lit(" ")).alias("cells")).distinct()
    return assemble.name_sections(items.unionByName(heads), "cells", ["l_orderkey"], ["flag", "rank", "code"]).select("l_orderkey", "code", "section_name")


@query("SELECT p_partkey, p_name AS heading, p_name AS category FROM part")
def q21_nearest_heading(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit("<table><tr><td>"), F.col("p_partkey").cast("string"), F.lit("</td></tr></table>"))
    html = F.concat(F.lit("<h1>in\u2028tro</h1>\u000b<p><b>"), "p_name", F.lit("</b></p>\r\n<p> </p>\nالمبلغ الإجمالي 5\n"), body, F.lit("\nafter"))
    both = table(spark, sf, "part").select("p_partkey", html.alias("html"), F.concat(F.lit("\t"), body, F.lit("\n")).alias("body"))
    return tables.category(tables.heading_of(both, "html", "body")).select("p_partkey", "heading", "category")


# --- assembly --------------------------------------------------------------------------------


@query("""
WITH k AS (SELECT *, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS doc FROM orders)
SELECT o_custkey, doc, count(*) AS n_pages, arg_min(o_orderpriority, o_orderkey) AS priority FROM k WHERE doc IS NOT NULL GROUP BY o_custkey, doc""")
def q22_assemble_docs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("key", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")))
    carried = assemble.carry(o, "key", ["o_custkey"], ["o_orderkey"], "doc").where("doc is not null")
    heads = assemble.document_headers(carried, "doc", ["o_orderkey"], ["o_custkey", "o_orderpriority"])
    return carried.groupBy("doc").agg(F.count("*").alias("n_pages")).join(heads, "doc").select("o_custkey", "doc", "n_pages", F.col("o_orderpriority").alias("priority"))


@query(f"SELECT l_orderkey, l_returnflag AS section_name, count(*) AS n_items, string_agg({_SQL_CODE}, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS codes FROM lineitem GROUP BY ALL")
def q23_merge_sections(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("section_name", F.col("l_returnflag"))
    return assemble.merge_sections(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], _code()).select("l_orderkey", "section_name", long(F.size("items")).alias("n_items"), F.array_join("items", ",").alias("codes"))


@query("""
SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN n END AS uncoded, n AS labelled FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def q24_section_subtotal(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    last = li.groupBy("l_orderkey").agg(F.count("*").alias("value")).select("l_orderkey", F.lit(99).alias("at"), F.when(F.col("l_orderkey") % 2 == 1, "c").alias("code"), F.lit("الإجمالي").alias("label"), "value")
    rows = li.select("l_orderkey", F.col("l_linenumber").alias("at"), _code().alias("code"), F.lit("x").alias("label"), F.lit(0).cast("bigint").alias("value")).unionByName(last)
    a = assemble.last_uncoded(rows, ["l_orderkey"], ["at"], "code", "value").withColumnRenamed("section_subtotal", "uncoded")
    return a.join(assemble.labelled_total(rows, ["l_orderkey"], ["at"], "label", "value").withColumnRenamed("section_subtotal", "labelled"), "l_orderkey")


@query("""
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS BIGINT) END, s) AS net_total FROM orders JOIN (SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def q25_net_total_rule(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("s"))
    o = table(spark, sf, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select("o_orderkey", assemble.net_total(F.when(F.col("o_orderkey") % 2 == 0, long("o_custkey")), F.col("s")).alias("net_total"))


@query("""
SELECT l_orderkey, arg_max(l_discount, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FILTER (l_discount <> 0 OR l_tax <> 0) AS l_discount, arg_max(l_tax, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FILTER (l_discount <> 0 OR l_tax <> 0) AS l_tax FROM lineitem GROUP BY l_orderkey""")
def q26_footer_last_nonzero(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.last_nonzero(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["l_discount", "l_tax"])


@query("""
SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'A') OR bool_or(l_shipdate > TIMESTAMP '1998-01-01') THEN 0 ELSE 1 END AS outpatient FROM lineitem GROUP BY l_orderkey""")
def q27_outpatient_flag(spark: SparkSession, sf: str) -> DataFrame:
    service = F.when(F.col("l_returnflag") == "A", "غرفة عمليات").otherwise("تحليل")
    left = F.when(F.col("l_shipdate") > F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")), F.lit(2)).otherwise(F.lit(1))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(assemble.outpatient(service, F.lit(1), left))


# --- geometry and routing --------------------------------------------------------------------

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_SQL_KEYS = ", ".join(_KEYS)


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    x, y = (F.col("l_partkey") % 500).cast("int"), (F.col("l_suppkey") % 400 + 10 * F.col("l_linenumber")).cast("int")
    return li.withColumn("b", g.box(x, y, x + 10 * F.col("l_linenumber"), y + F.col("l_quantity").cast("int")))


_SQL_BOX = f"(SELECT {_SQL_KEYS}, CAST(l_partkey % 500 AS INTEGER) AS x1, CAST(l_suppkey % 400 + 10 * l_linenumber AS INTEGER) AS y1, CAST(l_partkey % 500 + 10 * l_linenumber AS INTEGER) AS x2, CAST(l_suppkey % 400 + 10 * l_linenumber + CAST(l_quantity AS INTEGER) AS INTEGER) AS y2 FROM lineitem)"


def _flat(name: str, b: Column) -> list[Column]:
    return [b[k].cast("int").alias(f"{name}_{k}") for k in ("x1", "y1", "x2", "y2")]


@query(f"SELECT {_SQL_KEYS}, CAST(x1 * 4 AS INTEGER) AS sx, CAST(y2 * 4 AS INTEGER) AS sy FROM {_SQL_BOX}")
def q28_bbox_rescale(spark: SparkSession, sf: str) -> DataFrame:
    scaled = g.rescale(F.array("b.x1", "b.y1", "b.x2", "b.y2"), F.lit(0.25))
    return _boxes(spark, sf).select(*_KEYS, F.get(scaled, 0).alias("sx"), F.get(scaled, 3).alias("sy"))


@query(f"""
SELECT {_SQL_KEYS}, least(greatest(x1, 0), 450) AS clip_x1, least(y2, 300) AS clip_y2, y1 AS below_y1, 450 AS below_x2, least(y2 + 50, 300) AS under_y1, greatest(0, y1 - 50) AS above_y2 FROM {_SQL_BOX}""")
def q29_crop_rects(spark: SparkSession, sf: str) -> DataFrame:
    b, w, h = F.col("b"), F.lit(450), F.lit(300)
    return _boxes(spark, sf).select(*_KEYS, g.clip(b, w, h)["x1"].alias("clip_x1"), g.clip(b, w, h)["y2"].alias("clip_y2"), g.below(b, w, h)["y1"].alias("below_y1"), g.below(b, w, h)["x2"].alias("below_x2"), g.under(b, w, h)["y1"].alias("under_y1"), g.above(b, w)["y2"].alias("above_y2"))


@query(f"""
SELECT {_SQL_KEYS}, greatest(0, x1 - CAST(trunc((x2 - x1) * 0.5) AS INTEGER)) AS wide_x1, greatest(0, y1 - CAST(trunc((y2 - y1) * 0.25) AS INTEGER)) AS wide_y1, least(499, x2 + CAST(trunc((x2 - x1) * 0.5) AS INTEGER)) AS wide_x2, least(399, y2 + CAST(trunc((y2 - y1) * 0.25) AS INTEGER)) AS wide_y2 FROM {_SQL_BOX}""")
def q30_barcode_expand(spark: SparkSession, sf: str) -> DataFrame:
    return _boxes(spark, sf).select(*_KEYS, *_flat("wide", g.widen(F.col("b"), F.lit(500), F.lit(400), 0.5, 0.25)))


@query("""
SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 180 WHEN 2 THEN 90 WHEN 3 THEN 270 ELSE 0 END AS INTEGER) AS turn, CAST(CASE WHEN p_partkey % 5 IN (0, 2) THEN 0 WHEN p_partkey % 5 = 4 THEN 0 ELSE 180 END AS INTEGER) AS flip FROM part""")
def q31_qr_orientation(spark: SparkSession, sf: str) -> DataFrame:
    s = (F.col("p_size") + 10).cast("double")
    put = lambda *ps: F.array(*(F.struct((s * x).alias("x"), (s * y).alias("y")) for x, y in ps))
    k = F.col("p_partkey") % 5
    points = F.when(k == 0, put((0, 0), (1, 0), (0, 1))).when(k == 1, put((1, 1), (0, 1), (1, 0))).when(k == 2, put((1, 0), (0, 0), (1, 1))).when(k == 3, put((0, 1), (0, 0), (1, 1))).otherwise(put((0, 0), (1, 1)))
    return table(spark, sf, "part").select("p_partkey", g.orientation(points).alias("turn"), g.upright(points).alias("flip"))


@query(f"""
WITH r AS (SELECT {_SQL_KEYS}, CAST(l_linenumber % 4 * 90 AS INTEGER) AS a, x1, y1, x2, y2 FROM {_SQL_BOX}),
q AS (SELECT {_SQL_KEYS}, a, CASE WHEN a IN (90, 270) THEN 1000 ELSE 800 END AS w, CASE WHEN a IN (90, 270) THEN 800 ELSE 1000 END AS h,
 CASE a WHEN 90 THEN y1 WHEN 180 THEN 800 - x2 WHEN 270 THEN 1000 - y2 ELSE x1 END AS qx1, CASE a WHEN 90 THEN y2 WHEN 180 THEN 800 - x1 WHEN 270 THEN 1000 - y1 ELSE x2 END AS qx2,
 CASE a WHEN 90 THEN 800 - x2 WHEN 180 THEN 1000 - y2 WHEN 270 THEN x1 ELSE y1 END AS qy1, CASE a WHEN 90 THEN 800 - x1 WHEN 180 THEN 1000 - y1 WHEN 270 THEN x2 ELSE y2 END AS qy2 FROM r)
SELECT {_SQL_KEYS}, CAST(greatest(0, qx1) AS INTEGER) AS card_x1, CAST(greatest(0, qy2 - 4 * (qy2 - qy1)) AS INTEGER) AS card_y1, CAST(least(w, qx1 + 6 * (qx2 - qx1)) AS INTEGER) AS card_x2, CAST(least(h, qy2) AS INTEGER) AS card_y2 FROM q""")
def q32_rotate_crop(spark: SparkSession, sf: str) -> DataFrame:
    turn = (F.col("l_linenumber") % 4 * 90).cast("int")
    return _boxes(spark, sf).select(*_KEYS, *_flat("card", g.card_crop(F.col("b"), F.lit(800), F.lit(1000), turn, 4.0, 6.0)))


@query("""
SELECT o_orderkey, CAST(count(*) FILTER ((x2 - x1) * (y2 - y1) < 3000) AS BIGINT) AS n_white FROM (SELECT l_orderkey AS o_orderkey, 0 AS x1, 0 AS y1, 10 * l_linenumber AS x2, CAST(l_quantity AS INTEGER) AS y2 FROM lineitem) GROUP BY o_orderkey""")
def q54_whitened(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(g.box(F.lit(0), F.lit(0), 10 * F.col("l_linenumber"), F.col("l_quantity").cast("int"))).alias("boxes"))
    return li.select("o_orderkey", long(F.size(g.whitened(F.col("boxes"), g.box(F.lit(0), F.lit(0), F.lit(100), F.lit(100))))).alias("n_white"))


@query(f"""
SELECT {_SQL_KEYS}, CAST(coalesce(lead(y1) OVER w - y2, 0) AS DOUBLE) AS gap FROM {_SQL_BOX} WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)""")
def q41_vertical_gap(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return _boxes(spark, sf).withColumn("next", F.lead("b").over(w)).select(*_KEYS, g.gap(F.col("b"), F.col("next")).alias("gap"))


@query("""
WITH RECURSIVE p AS (SELECT l_orderkey, list({'x': l_partkey % 100, 'y': l_suppkey % 100} ORDER BY l_partkey % 100, l_suppkey % 100) AS p FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey, p, 2 AS i, [p[1]] AS k FROM p
  UNION ALL SELECT l_orderkey, p, i + 1, CASE WHEN len(list_filter(k, lambda q: (q.x - p[i].x) * (q.x - p[i].x) + (q.y - p[i].y) * (q.y - p[i].y) <= 100)) > 0 THEN k ELSE list_append(k, p[i]) END FROM r WHERE i <= len(p))
SELECT l_orderkey, CAST(len(p) AS BIGINT) AS n, CAST(len(k) AS BIGINT) AS kept FROM r WHERE i = len(p) + 1""")
def q42_greedy_points(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((F.col("l_partkey") % 100).cast("double").alias("x"), (F.col("l_suppkey") % 100).cast("double").alias("y")))).alias("p"))
    return p.select("l_orderkey", long(F.size("p")).alias("n"), long(F.size(g.distinct_points(F.col("p")))).alias("kept"))


def _routed(spark: SparkSession, sf: str, template: str) -> DataFrame:
    """Every combination of seven labels, a code and a title, from the bits of a part's key."""
    k = F.col("p_partkey")
    bit = lambda i: k.bitwiseAND(1 << i) > 0
    made = F.filter(F.array(*(F.when(bit(i), F.struct(F.lit(x).alias("label"), F.lit(0.9).alias("score"), F.lit(1).alias("x1"))) for i, x in enumerate(router.LABELS))), lambda b: b.isNotNull())
    low = F.array(F.struct(F.lit("table").alias("label"), F.lit(0.1).alias("score"), F.lit(1).alias("x1")))
    titles = F.array(*(F.lit(x) for x in (router.STOCK_TITLE, "ورقة خروج", "إيصال تفصيلي رقم 5", router.SERVICE_LIST, "x")))
    rows = table(spark, sf, "part").select("p_partkey", router.usable(F.concat(low, made)).alias("boxes"), bit(7).alias("has_qr"), F.get(titles, (k / 7).cast("int") % 5).alias("title"))
    return router.route_pages(rows, template).select("p_partkey", "route.status", "route.mode", "route.keyword", "route.crop", "route.right", "route.footer_shift")


_SQL_BITS = """WITH f AS (SELECT p_partkey, p_partkey & 1 > 0 AS dt, p_partkey & 4 > 0 AS pt, p_partkey & 8 > 0 AS ft, p_partkey & 48 > 0 AS hd, p_partkey & 64 > 0 AS tb, p_partkey & 128 > 0 AS qr, CAST(floor(p_partkey / 7) AS INTEGER) % 5 AS c FROM part), r AS (SELECT p_partkey, CASE {} END AS x FROM f)
SELECT p_partkey, CASE WHEN x = 'skip' THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN x = 'skip' THEN NULL WHEN x LIKE 'card%' THEN 'idcard' ELSE split_part(x, '/', 1) END AS mode, CASE WHEN x = 'skip' THEN NULL WHEN x LIKE 'card%' THEN 'idcard' ELSE split_part(x, '/', 2) END AS keyword, CASE WHEN x = 'skip' THEN NULL WHEN x LIKE 'card%' THEN 'card' ELSE split_part(x, '/', 3) END AS crop,
  CASE x WHEN 'card58' THEN 5.8::DOUBLE WHEN 'card59' THEN 5.9::DOUBLE END AS right, x LIKE '%/below_title' OR x LIKE '%/under_header' AS footer_shift FROM r"""


@query(
    _SQL_BITS.format(
        "WHEN dt AND tb THEN CASE WHEN c = 0 THEN 'skip' ELSE 'janzour/janzour/below_title' END WHEN NOT hd OR NOT tb THEN CASE WHEN qr THEN 'card58' ELSE 'skip' END WHEN NOT pt THEN 'massara/massara/under_header' WHEN c = 0 THEN 'skip' ELSE 'massara/massara medicine/page'"
    )
)
def q33_router_default(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf, "default")


@query(
    _SQL_BITS.format(
        "WHEN hd AND NOT tb THEN CASE WHEN qr THEN 'card58' ELSE 'skip' END WHEN NOT hd THEN CASE WHEN qr THEN 'card59' ELSE 'skip' END WHEN dt THEN 'janzour/janzour/below_title' WHEN pt THEN CASE c WHEN 2 THEN 'janzour/receipt/page' WHEN 3 THEN 'janzour/janzour/below_title' ELSE 'skip' END WHEN ft THEN CASE WHEN c = 2 THEN 'janzour/receipt/page' WHEN qr THEN 'card58' ELSE 'skip' END ELSE 'skip'"
    )
)
def q33_router_janzour(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf, "janzour")


@query(_SQL_BITS.format("WHEN tb AND NOT dt AND NOT pt THEN 'massara/massara/under_header' WHEN dt OR tb THEN CASE WHEN c IN (0, 1) THEN 'skip' ELSE 'massara/massara medicine/page' END WHEN qr THEN 'card58' ELSE 'skip'"))
def q33_router_massara(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf, "massara")


_KEYWORDS = ("Janzour", "massara", "massara medicine", "IDCARD", "receipt", "medicine", "أدوية ومستلزمات من الايواء", "my idcard", "إيصال رقم 5", "massara janzour", "other", "MASSARA")


@query("""
WITH k(i, keyword, prompt, exact) AS (VALUES (0, 'Janzour', 'janzour', 'janzour'), (1, 'massara', 'massara', 'massara'), (2, 'massara medicine', 'massara', 'default'), (3, 'IDCARD', 'idcard', 'idcard'), (4, 'receipt', 'receipt', 'default'), (5, 'medicine', 'default', 'default'),
  (6, 'أدوية ومستلزمات من الايواء', 'default', 'medicine'), (7, 'my idcard', 'idcard', 'default'), (8, 'إيصال رقم 5', 'receipt', 'receipt'), (9, 'massara janzour', 'janzour', 'janzour'), (10, 'other', 'default', 'default'), (11, 'MASSARA', 'massara', 'massara'))
SELECT p_partkey, keyword, prompt, exact FROM part JOIN k ON p_partkey % 12 = i""")
def q34_prompt_lookup(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get(F.array(*map(F.lit, _KEYWORDS)), (F.col("p_partkey") % 12).cast("int"))
    return table(spark, sf, "part").select("p_partkey", k.alias("keyword")).select("p_partkey", "keyword", router.prompt_name(F.col("keyword")).alias("prompt"), router.exact_prompt_name(F.col("keyword")).alias("exact"))


@query("""
WITH k AS (SELECT p_partkey, ['janzour', 'safwa', 'massara', 'muasafat', 'musafat', NULL][CAST(p_partkey % 6 + 1 AS INTEGER)] AS template FROM part)
SELECT p_partkey, CASE WHEN template IN ('massara', 'muasafat', 'musafat') THEN 'massara' ELSE 'janzour' END AS family, template IS NOT NULL AS bypass FROM k""")
def q35_template_prompt(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get(F.array(*map(F.lit, router.TEMPLATES), F.lit(None)), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, sf, "part").select("p_partkey", router.template_family(k).alias("family"), router.skips_validation(k).alias("bypass"))


# --- events ----------------------------------------------------------------------------------


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'given' ELSE coalesce(nullif(CAST(json_extract_string(props, '$.k') AS VARCHAR), ''), '') END AS message, event_type AS event, CASE WHEN event_id % 3 = 0 THEN 'raw' END AS raw_text, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS extra_k, CAST(1 AS BIGINT) AS n_extra FROM events""")
def q36_event_payload(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    data = F.create_map(F.lit("message"), k, F.lit("k"), k, F.lit("raw_json"), F.lit("x"), F.lit("raw_text"), F.when(F.col("event_id") % 3 == 0, "raw").otherwise(""))
    none = F.lit(None).cast("string")
    rows = e.select(F.col("event_id").alias("task_id"), none.alias("filename"), none.alias("batch_id"), F.when(F.col("event_id") % 2 == 0, "given").otherwise("").alias("message"), F.col("event_type").alias("event"), data.alias("data"), none.alias("raw_text"), none.alias("validation_review"), none.alias("skipped"))
    return events.payload(rows).select(F.col("task_id").alias("event_id"), "message", "event", "data.raw_text", F.element_at("data.extra", "k").alias("extra_k"), long(F.size("data.extra")).alias("n_extra"))


@query("""
SELECT user_id AS task_id, arg_max(event_type, (ts, event_type)) AS event, max(ts) AS ts FROM events GROUP BY user_id""")
def q37_last_status(spark: SparkSession, sf: str) -> DataFrame:
    return events.latest(table(spark, sf, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("event"), "ts"))


@query("""
WITH e AS (SELECT user_id % 50 AS batch_id, user_id, event_type FROM events), b AS (SELECT batch_id, count(DISTINCT user_id) AS total, count(DISTINCT user_id) FILTER (event_type IN ('purchase', 'error')) AS done FROM e GROUP BY batch_id)
SELECT batch_id, total, done, total - done AS left, total <= done AS complete FROM b""")
def q38_batch_completion(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select((F.col("user_id") % 50).alias("batch_id"), F.col("user_id").alias("task_id"), F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type")).alias("event"))
    totals = e.groupBy("batch_id").agg(F.countDistinct("task_id").alias("total"))
    return events.batch_progress(e, totals)


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 72 HOUR")
def q39_cleanup_ttl(spark: SparkSession, sf: str) -> DataFrame:
    from quillstone.sources.files import expired

    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("modificationTime"))
    now = e.agg(F.max("modificationTime").alias("now"))
    return expired(e.crossJoin(F.broadcast(now)), F.col("now")).select("event_id")  # one row beside each


@query("""
SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {"k":' || json_extract_string(props, '$.k') || ',"none":null}' || chr(10) || chr(10) AS said, 'task_updates:' || user_id AS channel FROM events""")
def q45_sse(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumn("none", F.lit(None).cast("string"))
    wired = e.withColumn("data", events.wire(e.select("k", "none"))).withColumn("channel", events.channel(F.col("user_id").cast("string")))
    return events.subscribed(wired).select("event_id", events.sse(F.col("event_type"), F.col("data")).alias("said"), "channel")


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS VARCHAR) END AS k, CASE WHEN event_id % 2 = 1 THEN 'not json' END AS raw FROM events""")
def q55_json_or_raw(spark: SparkSession, sf: str) -> DataFrame:
    v = events.json_or_raw(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("not json"))
    return table(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), F.try_variant_get(v, "$.raw_response", "string").alias("raw"))


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a,b' ELSE '*' END AS origins, to_base64(encode(event_type)) AS encoded, 'storage/results/' || event_id || '.json' AS path, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_data FROM events""")
def q56_config_and_paths(spark: SparkSession, sf: str) -> DataFrame:
    from quillstone.sources.files import encoded, origins, result_path

    e = table(spark, sf, "events")
    conf = F.when(F.col("event_id") % 2 == 0, '["a","b"]').otherwise("oops")
    return e.select("event_id", F.array_join(origins(conf), ",").alias("origins"), encoded(F.encode("event_type", "utf-8")).alias("encoded"), result_path(F.col("event_id").cast("string")).alias("path"), long(F.size(events.as_data(F.when(F.col("event_id") % 3 > 0, F.col("event_type"))))).alias("n_data"))


# --- models and whole runs -------------------------------------------------------------------


def _images(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select((F.col("page_id") % 20).cast("string").alias("pdf_name"), F.concat(F.lit("/in/"), (F.col("page_id") % 20).cast("string")).alias("pdf_path"), F.col("page_id").alias("page_num"), F.encode("html", "utf-8").alias("image"))


@query("""
WITH p AS (SELECT page_id, html, [CAST('0x' || substr(sha256(html), 2 * i + 1, 2) AS INTEGER) FOR i IN range(32)] AS h FROM pages)
SELECT page_id AS page_num, CAST(h[32] % 5 AS BIGINT) AS n_boxes, CAST(h[1] % 2 AS BIGINT) AS n_codes, substr(html, 1, 11000) AS shown FROM p""")
def q57_models_offline(spark: SparkSession, sf: str) -> DataFrame:
    found = models.boxes(models.boxes(_images(spark, sf)), task="codes").withColumn("prompt", F.lit("p"))
    read = models.read_pages(found)
    return read.select("page_num", long(F.size("boxes")).alias("n_boxes"), long(F.size("codes")).alias("n_codes"), models.shown(F.col("result"), F.col("error")).alias("shown"))


@query("""
SELECT CAST(page_id % 20 AS VARCHAR) AS pdf_name, count(*) AS n_all, CAST(100 AS INTEGER) AS score, CAST(NULL AS VARCHAR) AS error FROM pages GROUP BY 1""")
def q58_document_run(spark: SparkSession, sf: str) -> DataFrame:
    from quillstone.plans import pipeline

    done = pipeline.run(_images(spark, sf))
    pages_read = F.size("pages") > 0
    return done.select("pdf_name", long(F.size("pages") + F.size("skipped_pages")).alias("n_all"), F.when(pages_read, F.col("validation.score")).otherwise(F.lit(100)).alias("score"), F.when(pages_read, F.col("validation.error")).alias("error"))


@query("""
SELECT o_custkey, CAST(coalesce(CASE WHEN count(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 7 END) = 1 THEN max(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 7 END) END, sum(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END)) AS BIGINT) AS net_total, CAST(NULL AS BIGINT) AS amount_due FROM orders GROUP BY o_custkey""")
def q59_net_totals(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    rows = o.select("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, long(F.col("o_custkey") % 7)).alias("grand"), F.when(F.col("o_orderkey") % 2 == 0, long("o_orderkey")).alias("section"), F.lit(None).cast("bigint").alias("due"))
    return assemble.net_totals(rows, ["o_custkey"], "grand", "section", "due")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'I' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'M' || o_custkey END AS key FROM orders""")
def q60_continuation_key(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("o_orderkey") % 3
    invoice = F.when(turn == 0, F.concat(F.lit("I"), "o_orderkey")).otherwise(" ")
    medical = F.when(turn < 2, F.concat(F.lit("M"), "o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", assemble.continuation_key(invoice, medical).alias("key"))


@query("""
WITH b AS (SELECT p_partkey, CAST(p_partkey % 900 AS INTEGER) AS y, p_partkey % 4 AS kind, CAST(p_partkey % 1100 AS INTEGER) AS f FROM part),
c AS (SELECT *, CASE kind WHEN 0 THEN y WHEN 1 THEN least(y + 70, 1000) ELSE 0 END AS y1 FROM b)
SELECT p_partkey, CASE WHEN kind = 3 THEN NULL ELSE y1 END AS y1, CASE WHEN kind = 3 THEN NULL WHEN kind < 2 THEN least(1000, y1 + greatest(0, f - 50)) ELSE 1000 END AS y2 FROM c""")
def q61_crop_plan(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    y, kind = (F.col("p_partkey") % 900).cast("int"), F.col("p_partkey") % 4
    at = lambda label, top: F.struct(F.lit(label).alias("label"), F.lit(0).alias("x1"), top.alias("y1"), F.lit(500).alias("x2"), (top + 20).alias("y2"))
    boxes = F.array(at("doc_title", y), at("header", y), at("footer", (F.col("p_partkey") % 1100).cast("int")))
    where = F.when(kind == 0, "below_title").when(kind == 1, "under_header").otherwise("page")
    route = F.struct(where.alias("crop"), F.lit(5.8).alias("right"), (kind < 2).alias("footer_shift"))
    none = F.expr("cast(array() as array<struct<label:string,x1:int,y1:int,x2:int,y2:int>>)")
    pages_ = part.select("p_partkey", boxes.alias("boxes"), none.alias("codes"), route.alias("route"), F.when(kind != 3, 600).alias("width"), F.lit(1000).alias("height"), F.lit(0).alias("turn"))
    return router.crop_plan(pages_).select("p_partkey", "crop.y1", "crop.y2")


@query("""
WITH p AS (SELECT page_id, [CAST('0x' || substr(sha256(html), 2 * i + 1, 2) AS INTEGER) FOR i IN range(2)] AS h FROM pages)
SELECT page_id AS page_num, CASE WHEN h[1] % 2 = 1 THEN 3 ELSE 0 END AS n_points, CASE WHEN h[1] % 2 = 0 THEN 0 ELSE [180, 270, 0, 90][h[2] % 4 + 1] END AS turn FROM p""")
def q62_finder_points(spark: SparkSession, sf: str) -> DataFrame:
    found = models.finder_points(models.boxes(_images(spark, sf), task="codes"))
    return found.select("page_num", F.size("points").alias("n_points"), g.orientation(F.col("points")).cast("int").alias("turn"))


@query("SELECT n_nationkey, n_name || 'x' AS said, CAST(1 AS BIGINT) AS n_rows FROM nation")
def q63_sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    from quillstone.functions import html

    html.register(spark)
    return table(spark, sf, "nation").selectExpr("n_nationkey", "concat('<table><tr><td> ', n_name, '</td></tr></table>\\n<p>x</p>') as doc").selectExpr("n_nationkey", "html_text(doc) as said", "cast(size(html_rows(doc)) as bigint) as n_rows")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN CAST(o_orderkey AS VARCHAR) END AS invoice_number, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_custkey AS VARCHAR) END AS file_number, o_clerk AS doctor_name FROM (SELECT o_orderkey, o_custkey, 'Dr' || o_custkey AS o_clerk FROM orders)""")
def q64_header_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """A value behind its label, before it, on the line above, or some lines below with a remark in parentheses."""
    o = table(spark, sf, "orders")
    k, number = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    said = F.when(k == 0, F.concat(F.lit("رقم الملف: "), number)).when(k == 1, F.concat(number, F.lit(" رقم الملف"))).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit("\nإيصال رقم")))
    below = F.concat(F.lit("\nالجهة: x\nالطبيب\n \n"), F.lit("Dr"), number, F.lit(" (استشاري)"))
    parsed = headers.invoice_header(o.select("o_orderkey", F.concat(said, below).alias("text")))
    return parsed.select("o_orderkey", "header.invoice_number", "header.file_number", "header.doctor_name")
