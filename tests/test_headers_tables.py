"""Headers and tables of the templates."""

from pyspark.sql import functions as F

from quillstone.functions.html import data_texts, parse_rows, plain_table, table_rows
from quillstone.operators import headers, tables


def frame(spark, text, name="text"):
    return spark.createDataFrame([(text,)], f"{name} string")


def test_footer(spark):
    f = frame(spark, "**الاجمالي:** 25,985.000 دينار\n- المتبقي: 5\nالإجمالي: 9").select(headers.massara_footer(F.col("text")).alias("f")).first().f
    assert f.total_price.num == 25985.0
    assert f.price_due.num is None
    assert f.price_due.raw == "-"
    assert f.price_paid is None
    assert frame(spark, "x").select(headers.massara_footer(F.col("text")).alias("f")).first().f is None


def test_janzour_header(spark):
    read = lambda text, **o: frame(spark, text).select(headers.janzour_header(F.col("text"), **o).alias("h")).first().h
    assert read("التاريخ: 24/04/2025").report_date == "24/04/2020"
    assert read("التاريخ: 24/04/2025", strict=True).report_date == "24/04/2025"
    h = read("الإقامة: من 24/04/2025 18:48 إلى 26/04/2025 12:32")
    assert (h.admission_date, h.admission_time, h.discharge_date, h.discharge_time) == ("24/04/2025", "18:48", "26/04/2025", "12:32")
    h = read("الإقامة: 2 أيام من 24/04/2025 18:48 إلى 26/04/2025 12:32")
    assert (h.admission_date, h.admission_time, h.discharge_date, h.discharge_time) == (None,) * 4


def test_invoice_header(spark):
    read = lambda text: headers.invoice_header(frame(spark, text)).first().header
    said = lambda text: {k: v for k, v in read(text).asDict().items() if v}
    got = said("إيصال تفصيلي رقم: 555\nاسم المريض: علي محمد\nالرقم الطبي\n12345\nالتاريخ: 24/04/2025 الساعة 10:30")
    assert got == {"invoice_number": "555", "patient_name": "علي محمد", "file_number": "12345", "date": "24/04/2025", "time": "10:30"}
    # before the label, on the line above, two lines below, behind another label, and in parentheses
    assert said("987 رقم الملف") == {"file_number": "987"}
    assert said("4711\nإيصال رقم") == {"invoice_number": "4711"}
    assert said("الطبيب\n \n\nسالم (استشاري)") == {"doctor_name": "سالم"}
    assert said("الطبيب\nالجهة: شركة") == {"company_name": "شركة"}
    # a line serves one key, a key keeps its first value, and a time is looked for anywhere
    assert said("التاريخ: 1/2/2025\nالتاريخ: 3/4/2025\nx 7.45") == {"date": "1/2/2025", "time": "7:45"}
    assert said("إيصال رقم: 5 الرقم الطبي: 6") == {"invoice_number": "5 الرقم الطبي: 6"}
    assert read(None) is None
    assert set(read("").asDict().values()) == {None}


HEAD8 = "<thead><tr>" + "<th>h</th>" * 8 + "</tr></thead>"


def entries(spark, rows, head=HEAD8):
    html = f"<table>{head}<tbody>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</tbody></table>"
    return tables.service_entries(frame(spark, html, "html"), 8).drop("html", "row_no").collect()


def test_service_table(spark):
    row = ["10.000", "5", "15", "10:30", "24/04/2025", "2", "تحليل", "BIO001"]
    got = entries(spark, [row, [*row[:7], ""], ["المبلغ الإجمالي", *row[1:]], [""] * 8])
    assert [g.asDict() for g in got] == [{"company_price": 10.0, "patient_price": 5.0, "net_price": 15.0, "time": "10:30", "date": "24/04/2025", "qty": 2, "service_name": "تحليل", "code": "BIO001"}]
    assert entries(spark, [row], head="") == []


def test_totals(spark):
    head = "<thead><tr>" + "<th>h</th>" * 4 + "</tr></thead>"
    html = f"<table>{head}<tr><td>1,000.5</td><td>500</td><td>x</td><td>الصافي</td></tr></table>"
    got = tables.totals(frame(spark, html, "html")).first()
    assert (got.total, got.paid, got.amount_due) == (1000.5, 500.0, 0.0)
    assert tables.totals(frame(spark, f"<table>{head}</table>", "html")).first().total is None
    # only four cells, only the label itself, only blanks and commas go
    rows = "<tr><td>1</td><td>1</td><td>1</td><td>الصافي بعد الخصم</td></tr><tr><td>2</td><td>2</td><td>2</td><td>الصافي</td><td>2</td></tr><tr><td>3</td><td>1/2</td><td>4 0</td><td> الصافي </td></tr>"
    got = tables.totals(frame(spark, f"<table>{head}{rows}</table>", "html")).first()
    assert (got.total, got.paid, got.amount_due) == (3.0, 0.0, 40.0)


def test_invoice_table(spark):
    html = "<p>كشف</p>\n<table><thead><tr><th>القيمة</th><th>البيان</th><th>الرمز</th><th>ت</th></tr></thead><tbody><tr><td>1,234.5</td><td>كشف</td><td>A1</td><td>2</td></tr><tr><td colspan=2>1</td><td>x</td><td>A</td><td>1</td></tr><tr><td>المجموع</td><td></td><td></td><td></td></tr></tbody></table>"
    got = tables.invoice_entries(frame(spark, html, "html")).collect()
    assert [g.entry for g in got] == [{"price": "1,234.500", "service_name": "كشف", "code": "A1", "qty": "2"}]
    assert tables.category(frame(spark, html, "html")).first().category == "كشف"


def test_cells(spark):
    assert parse_rows("<table><tr><td>A<br>B</td></tr></table>")[0]["cells"] == ["AB"]
    both = table_rows(frame(spark, "<table><tr><th>a</th><td>b</td></tr></table>", "html"), "html")
    assert both.select(data_texts(F.get("rows", 0))).first()[0] == ["b"]
    assert parse_rows("no table") == []
    got = table_rows(frame(spark, None, "html"), "html").select("rows", plain_table(F.col("rows")).alias("p")).first()
    assert got.rows is None
    assert got.p == ""


def test_headers_of_data_cells_dont_count(spark):
    head = "<thead><tr>" + "<td>h</td>" * 8 + "</tr></thead>"
    assert entries(spark, [["1"] * 8], head=head) == []


def test_repeated_headers_and_tables_without_a_code(spark):
    html = "<table><thead><tr><th></th><th>code</th><th></th></tr></thead><tbody><tr><td>a</td><td>c</td><td>b</td></tr><tr><td>a</td><td> </td><td>b</td></tr></tbody></table>"
    assert [r.entry for r in tables.raw_entries(frame(spark, html, "html")).collect()] == [{"": "b", "code": "c"}]
    assert tables.raw_entries(frame(spark, html.replace("code", "other"), "html")).collect() == []
    assert [r.entry for r in tables.invoice_entries(frame(spark, html, "html")).collect()] == [{"": "b", "code": "c"}, {"": "b", "code": " "[:0]}]


def test_lines_end_alike_everywhere(spark):
    table = "<table><tr><td>1</td></tr></table>"
    html = f"a\u2028b\x0bHEAD\r\n{table}\nafter"
    both = spark.createDataFrame([(html, f"\t{table}\n")], "html string, body string")
    got = tables.category(tables.heading_of(both, "html", "body")).first()
    assert (got.heading, got.category) == ("HEAD", "HEAD")


def test_any_table_by_mode(spark):
    row = ["10.000", "5", "15", "10:30", "24/04/2025", "2", "تحليل", "B1"]
    html = f"<p>Lab</p>\n<table>{HEAD8}<tbody><tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr></tbody></table>"
    read = lambda text, mode: tables.html_table(frame(spark, text, "html"), mode=mode).first()
    got = read(html, "janzour")
    assert (got.category, len(got["columns"]), got.footer) == ("Lab", 8, None)
    assert got.entries == [{"company_price": "10.0", "patient_price": "5.0", "net_price": "15.0", "time": "10:30", "date": "24/04/2025", "qty": "2", "service_name": "تحليل", "code": "B1"}]
    four = "<table><thead><tr>" + "<th>h</th>" * 4 + "</tr></thead><tr><td>1</td><td>2</td><td>3</td><td>الصافي</td></tr></table>"
    assert tuple(read(four, "janzour").footer) == (1.0, 2.0, 3.0)
    assert read(four, "janzour").entries == []
    assert read(four, "invoice").entries == [{"h": "الصافي"}]
    assert read(html, "").entries == read("no table", "invoice").entries == []
