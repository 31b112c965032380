"""Visibility by the page's own styles, depth, and time that follows the page."""

import time

from tidemark.llm.html_text import extract_text, html_text
from tidemark.session import ship


def test_styles():
    pages = {
        "<style>.a .b{display:none}</style><div class=a><p><i class=b>no</i>x</p></div><i class=b>y</i>": "x\n\ny",
        "<style>.a > .b{display:none}</style><div class=a><p><i class=b>x</i></p><i class=b>no</i></div>": "x",
        "<style>#x{display:block} p{display:none}</style><p id=x>in<p>no": "in",
        "<style>p{display:none !important} #x{display:block}</style><p id=x>no</p>y": "y",
        "<style>@media print{.c{display:none}} @media screen{.d{display:none}}</style><b class=c>x</b><b class=d>no</b>": "x",
        "<style>@import 'a'; .e{visibility:hidden} .e .f{visibility:visible}</style><p class=e>no<b class=f>x</b>": "x",
        "<style>a:hover{display:none} [x]{display:none}</style><a x=1>x</a>": "x",
        "<table><tr style='visibility:hidden'><td>no<tr><td>x<td style='visibility:collapse'>no</table>": "x",
        "<p style='display:none'>no<p style='DISPLAY : None; color:red'>no<p>x": "x",
    }
    assert {k: html_text(k) for k in pages} == pages


def test_tables_at_any_depth_keep_their_columns():
    page = "<table><tr><td>a<td>b<tr><td colspan=2>" * 300 + "x" + "</table>" * 300
    lines = html_text(page).split("\n")
    assert [x for x in lines if x.strip()] == ["a  b"] * 300 + ["x"]


def test_time_follows_the_page():
    def took(n):
        began = time.process_time()
        assert html_text("<div>" * n + "x" + "</div>" * n) == "x"
        assert html_text("<p><b>" * n + "y").count("y") == 1
        assert html_text("<ul><li>" * n + "z").endswith("z")
        return time.process_time() - began

    took(500)
    small, large = took(2000), took(8000)
    assert large < 12 * max(small, 0.05)


def test_rows_repeat_and_tables_may_be_empty(spark):
    ship(spark)
    rows = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, "")], "page_id long, url string, html string")
    got = sorted(tuple(str(x) for x in r) for r in extract_text(rows.selectExpr("*", "1 AS text", "2 AS node")).collect())
    assert got == [("1", "u", "a"), ("1", "u", "a"), ("2", "None", "")]
    assert extract_text(rows.limit(0)).count() == 0 and extract_text(rows).count() == 3
