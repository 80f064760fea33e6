"""Tables read by whole rows are what the standard parser makes of them."""

import random

import pytest

from quillstone.functions import html

ROW = "<tr>" + "".join(f"<td>{c}</td>" for c in (" 1,234.50", "5", "time", "تحليل<br>A", "1-2-3")) + "</tr>"
TABLE = "<table>\n<thead><tr>" + "<th>h</th>" * 5 + f"</tr></thead><tbody>{ROW}\n{ROW}<tr><td colspan=3>x</td><td></td></tr></tbody></table>"


def parsed(text):
    p = html._Tables()
    p.feed(text)
    p.close()
    return p.table()


def test_plain_tables_skip_the_parser(monkeypatch):
    want = parsed(TABLE)
    monkeypatch.setattr(html._Tables, "feed", lambda *_: pytest.fail("went through the parser"))
    got = html.parse_rows(TABLE)
    assert got == want
    assert [r["cells"] for r in got] == [["h"] * 5, *[["1,234.50", "5", "time", "تحليلA", "1-2-3"]] * 2, ["x", ""]]
    assert [r["spans"] for r in got] == [False, False, False, True]


def test_any_text_is_read_as_the_parser_reads_it():
    parts = "<table> </table> <TABLE\tborder=1> <thead> </thead> <tbody> </tbody> <tr> </tr> <tr\tclass='a'> <td> </td> <Td> <th> </th> <td\tcolspan=3> <td\ttitle='x\tcolspan\ty'> <th\tcolspan=2> <td/> </td\t> <br> <br/> <b> </b> <<br>b> <ſpan> <x-y> < > </ &amp; & <!-- <script> </script> <tr><td> </td></tr> </td><td> <tr><th> </th></tr> </th><th>".split(" ")
    parts += [ROW, " ", " x ", "\x1c", "\n", '<td a="', '">', "<td a=1colspan>", '<td a="b"colspan>', "<td colspan = 3>"]
    plain = [p for p in parts if p not in ("<", "</", "&amp;", "&", "<!--", "<script>", '<td a="')]
    chance, quick = random.Random(3), 0
    for i in range(6000):
        text = "<table>" * (i % 3 > 0) + "".join(chance.choices(plain if i % 2 else parts, k=chance.randrange(1, 25)))
        quick += html._Tables().read(text)
        assert html.parse_rows(text) == parsed(text), text
    assert quick > 300
