"""HTML tables: spans, optional end tags, nested tables, broken markup, members."""

from __future__ import annotations

import random

from barloom.sources.markup import index_members, page_tables, refreshed_universe


def tables_of(spark, *pages):
    rows = [(i, p) for i, p in enumerate(pages)]
    found = page_tables(spark.createDataFrame(rows, "page_id long, html string"))
    return {int(r.page_id): r for r in found.collect()}


def cells(row):
    return [(t.nth, t.header, t.cells) for t in row.rows]


def test_spans_and_optional_end_tags(spark):
    page = "<p>x<table><thead><tr><th>A<th colspan=2>B</thead><tr><td rowspan=2>1<td>2<td>3<tr><td>4 <b>five</b><td>&amp;<br>six<tr><td colspan='2'>7<td>8</table>"
    got = tables_of(spark, page)[0]
    assert cells(got) == [(0, ["A", "B", "B"], ["1", "2", "3"]), (0, ["A", "B", "B"], ["1", "4 five", "& six"]), (0, ["A", "B", "B"], ["7", "7", "8"])]
    assert (got.n_tables, got.n_unclosed, got.n_stray, got.n_bad_spans) == (1, 0, 0, 0)


def test_tables_inside_cells_and_scripts(spark):
    page = "<table><tr><td>out<table><tr><td>in</td></tr></table> again<script>'<td>no</td>'</script></td><td>z</td></tr></table>"
    assert cells(tables_of(spark, page)[0]) == [(0, [], ["out again", "z"]), (1, [], ["in"])]


def test_broken_markup_is_counted(spark):
    pages = [None, "", "<td>stray", "<table><td>no row", "<table><tr><td rowspan=x colspan=0>a", "<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d", "<table></table></table>", "<table><tr></tr><tr><td>a"]
    got = tables_of(spark, *pages)
    told = [(r.n_tables, r.n_unclosed, r.n_stray, r.n_bad_spans) for _, r in sorted(got.items())]
    assert told == [(0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 1, 0), (1, 1, 1, 0), (1, 1, 0, 2), (1, 1, 0, 0), (1, 0, 0, 0), (1, 1, 0, 0)]
    assert cells(got[5]) == [(0, [], ["a", "b"]), (0, [], ["a", "c"]), (0, [], ["a", "d"])]
    assert cells(got[7]) == [(0, [], []), (0, [], ["a"])]


def test_random_spans_like_a_drawn_grid(spark):
    """Tables drawn from rectangles that tile a grid give the grid back."""
    rng, pages, want = random.Random(6), [], []
    for _ in range(60):
        high, wide = rng.randrange(1, 7), rng.randrange(1, 7)
        grid, html, n = [[None] * wide for _ in range(high)], [[] for _ in range(high)], 0
        for r in range(high):
            for c in range(wide):
                if grid[r][c] is None:
                    w = 1
                    while c + w < wide and grid[r][c + w] is None and rng.random() < 0.4:
                        w += 1
                    h = 1
                    while r + h < high and rng.random() < 0.4:
                        h += 1
                    n += 1
                    for y in range(r, r + h):
                        for x in range(c, c + w):
                            grid[y][x] = f"t{n}"
                    html[r].append(f'<td rowspan="{h}" colspan="{w}">t{n}</td>')
        pages.append("<table>" + "".join(f"<tr>{''.join(x)}</tr>" for x in html) + "</table>")
        want.append(grid)
    got = tables_of(spark, *pages)
    for i, grid in enumerate(want):
        assert [t.cells for t in got[i].rows] == grid


def test_members(spark):
    head = "<tr><th>Symbol</th><th>Security</th><th>GICS Sector</th><th>GICS Sub-Industry</th></tr>"
    page = f"<table><tr><th>Other</th></tr><tr><td>x</td></tr></table><table>{head}<tr><td>brk.b</td><td>B &amp; H</td><td rowspan=2>Fin</td><td>Ins</td></tr><tr><td> ABC </td><td></td><td>Bank</td></tr><tr><td></td><td>none</td></tr><tr><td>ABC</td><td>again</td></tr></table><table>{head}<tr><td>LATER</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, "<p>nothing</p>"), (3, None)], "page_id long, html string")
    got = sorted(map(tuple, index_members(page_tables(df)).collect()))
    assert got == [("1", "ABC", None, "Fin", "Bank"), ("1", "BRK-B", "B & H", "Fin", "Ins")]


def test_a_universe_that_could_not_be_read_stays(spark):
    old = spark.createDataFrame([("x", "A"), ("x", "B"), ("y", "C")], "universe string, symbol string")
    new = spark.createDataFrame([("x", "B"), ("x", "D")], "universe string, symbol string")
    got = sorted(map(tuple, refreshed_universe(old, new).collect()))
    assert got == [("x", "A", False, False), ("x", "B", True, False), ("x", "D", True, True), ("y", "C", True, False)]
