"""Grids of tables with spans against placing cell by cell over sets of places."""

import random

import pytest

from lorespark.sources.tables import Tables, html_tables, page_tables, parsed_tables, plain_tables, table_rows


def naive(rows):
    """place -> text, or why there is no grid; all cells' places are looked through each time."""
    filled = {}
    for r, row in enumerate(rows):
        after = 0
        for text, high, wide, _ in row:
            column = next(c for c in range(after, 1000) if (r, c) not in filled)
            after = column + wide
            if r + high > len(rows):
                return "rowspan_beyond_table"
            own = [(y, x) for y in range(r, r + high) for x in range(column, column + wide)]
            if set(own) & set(filled):
                return "overlapping_cells"
            filled |= dict.fromkeys(own, text)
    return filled or "no_cells"


def shown(rows):
    cell = lambda text, high, wide, head: f"<{'th' if head else 'td'} rowspan={high} colspan='{wide}'>{text}</{'th' if head else 'td'}>"
    return "<p>x</p><table><tbody>" + "".join("<tr>" + "".join(cell(*c) for c in row) + "</tr>" for row in rows) + "</tbody></table>"


def test_random_spans():
    rng, seen = random.Random(4), set()
    for n in range(1500):
        rows = [[(f"c{rng.randrange(9)}", rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3]), r == 0 and rng.random() < 0.8) for _ in range(rng.choice([0, 1, 2, 3]))] for r in range(rng.choice([1, 2, 4, 6]))]
        (got,) = html_tables(shown(rows))
        want = naive(rows)
        if isinstance(want, str):
            assert got["error"] == want and got["rows"] is None
            seen.add(want)
            continue
        width = max(c for _, c in want) + 1
        assert got["rows"] == [[want.get((r, c), "") for c in range(width)] for r in range(len(rows))]
        assert got["marked"] == (bool(rows[0]) and all(c[3] for c in rows[0]))
    assert seen == {"rowspan_beyond_table", "overlapping_cells", "no_cells"}


@pytest.mark.parametrize(
    ("html", "error"),
    [
        ("<table><tr><td>a<table></table></td></tr></table>", "nested_table"), ("<table><tr><td>a", "open_table"), ("<table><tr><td>a<td>b</tr></table>", "open_cell"), ("<table><tr><td>a</td><tr></table>", "open_row"),
        ("<table><tr><td rowspan=0>a</td></tr></table>", "bad_span"), ("<table><tr><td colspan='x'>a</td></tr></table>", "bad_span"), ("<table><tr><td colspan=257>a</td></tr></table>", "bad_span"),
        ("<table><tr>" + "<td colspan=200>a</td>" * 2 + "</tr></table>", "grid_too_large"), ("<table></table>", "no_cells"), ("<table>" + "<tr><td>a</td></tr>" * 10_001 + "</table>", "too_many_rows"),
    ],
)
def test_tables_without_a_grid(html, error):
    assert [t["error"] for t in html_tables(html)] == [error]


def test_headers_labels_and_several_tables(spark):
    one = "<table><thead><tr><th rowspan=2>a</th><th colspan=2>b &amp; c</th></tr><tr><th>b</th><th>b</th></tr></thead><tr><td>1</td><td>2<br>3</td><td> x  y <script>no()</script></td></tr></table>"
    two = "<table><tr><td>k</td><td></td><td>k</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>"
    pages = spark.createDataFrame([(1, one + two), (2, None), (3, "<p>none</p>"), (4, "<table><tr><td>a")], "page_id long, html string")
    got = page_tables(pages).orderBy("page_id", "table_no").collect()
    assert [(r["page_id"], r["table_no"], r["error"], r["header_rows"], r["marked"], r["header"]) for r in got] == [(1, 0, None, 2, True, ["a", "b & c > b", "b & c > b"]), (1, 1, None, 1, False, ["k", "", "k"]), (4, 0, "open_table", None, None, None)]
    rows = {(r["page_id"], r["table_no"], r["row"]): r["values"] for r in table_rows(page_tables(pages)).collect()}
    assert rows == {(1, 0, 0): {"a": "1", "1": "2 3", "2": "x y"}, (1, 1, 0): {"0": "1", "1": "2", "2": "3"}}


def test_plain_pages_are_scanned_as_the_parser_finds_them():
    """The parser took most of the time of a page of tables; a scan must find the same, or leave the page to it."""
    row = "<tr><td rowspan='2'>a  b</td><th colspan=\"3\">c</th></tr> <tr>x<td>\n1 > 0</td>y</tr>"
    plain = ["", "a", "<table></table>", f"<table>{row}</table>", f"a<table> <thead>{row}</thead> <tbody>{row}</tbody>q</table> <table>{row}</table>", "<table><tr></tr></table>", "<table><thead></thead><tr><td rowspan=1 colspan=02 colspan=3></td></tr></table>"]
    left = ["<table>", "<b>x</b>", "<table><tr><td>&amp;</td></tr></table>", "<table><tr><td rowspan=0>1</td></tr></table>", "<table><tr><td rowspan=999>1</td></tr></table>", "<table><tr><td>1<td>2</td></tr></table>", f"<table>{row}<thead>{row}</thead></table>", "<table><tr><td class=x>1</td></tr></table>", "</table>", f"<table>{row}<tr><td><table></table></td></tr></table>", "<TABLE></TABLE>", "<table><tr><td>1</th></tr></table>"]
    for html in plain + left:
        parser = Tables()
        parser.feed(html)
        parser.finish()
        assert plain_tables(html) == (parser.found if html in plain else None), html
        assert parsed_tables(html) == parser.found
    assert html_tables(plain[3], with_cells=False) == [t | {"cells": None} for t in html_tables(plain[3])]
