"""Tables in HTML pages as rows of cells, and index members read from them."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of HTML for spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class _Table:
    """A table under construction: rows of cells (text parts, columns, rows, is header)."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int, bool]]] = []
        self.row_open = self.cell_open = False


class _Reader(HTMLParser):
    """Tables of one page in the order in which they begin; end tags of cells and rows
    may be missing, as HTML allows."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[_Table] = []
        self.open: list[_Table] = []
        self.stray = self.bad_spans = self.hidden = 0

    def _span(self, attrs: dict, name: str, most: int) -> int:
        told = (attrs.get(name) or "1").strip()
        if not told.isdigit() or (told == "0" and name == "colspan"):
            self.bad_spans += 1
            return 1
        return min(int(told), most) or most  # rowspan 0: to the end of the table

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            self.tables.append(_Table())
            self.open.append(self.tables[-1])
        elif tag in ("tr", "td", "th"):
            if not self.open:
                self.stray += 1
                return
            table = self.open[-1]
            table.cell_open = False
            if tag == "tr":
                table.rows.append([])
                table.row_open = True
                return
            if not table.row_open:
                self.stray += 1
                table.rows.append([])
                table.row_open = True
            attrs = dict(attrs)
            table.rows[-1].append(([], self._span(attrs, "colspan", MOST_COLUMNS), self._span(attrs, "rowspan", MOST_ROWS), tag == "th"))
            table.cell_open = True
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif self.open and tag == "table":
            self.open.pop()
        elif self.open and tag in ("td", "th", "tr"):
            self.open[-1].cell_open = False
            if tag == "tr":
                self.open[-1].row_open = False

    def handle_data(self, data: str) -> None:
        if not self.hidden and self.open and self.open[-1].cell_open:
            self.open[-1].rows[-1][-1][0].append(data)


def _grid(table: _Table) -> list[tuple[list[str | None], bool]]:
    """Rows of cell texts with spans resolved, and whether all own cells are headers;
    a place that no cell covers is None."""
    out, hanging = [], {}  # column -> (rows left, text)
    for cells in table.rows:
        row: dict[int, str] = {}
        for c, (left, text) in list(hanging.items()):
            row[c] = text
            if left == 1:
                del hanging[c]
            else:
                hanging[c] = (left - 1, text)
        at = 0
        for parts, columns, rows, _ in cells:
            text = " ".join("".join(parts).split())
            while at in row:
                at += 1
            for c in range(at, at + columns):
                if c not in row:
                    row[c] = text
                    if rows > 1:
                        hanging[c] = (rows - 1, text)
            at += columns
        wide = max(row, default=-1) + 1
        out.append(([row.get(c) for c in range(wide)], bool(cells) and all(h for *_, h in cells)))
    return out


ROWS = "nth int, row int, header array<string>, cells array<string>"


def page_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, rows, n_tables, n_unclosed, n_stray, n_bad_spans``, a row for each page.

    ``rows`` are those of all its tables (``nth``: which one, from 0; ``row`` in it) with the
    texts of their cells, spans resolved, entities and white space normalised; the
    header is the table's first row if it is made of header cells alone, else empty,
    and isn't among the rows.  Tables inside cells are tables of their own.  Broken
    markup is read as far as it goes and counted: tables that never end, cells
    outside rows or tables, spans that are no numbers.  A null page has no tables.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("nth", pa.int32()), ("row", pa.int32()), ("header", pa.list_(pa.string())), ("cells", pa.list_(pa.string()))]))
        for b in batches:
            rows, counts = [], []
            for text in b.column(1).to_pylist():
                reader = _Reader()
                reader.feed(text or "")
                reader.close()
                found = []
                for nth, table in enumerate(reader.tables):
                    grid = _grid(table)
                    header = grid[0][0] if grid and grid[0][1] else []
                    found += [{"nth": nth, "row": r, "header": header, "cells": cells} for r, (cells, _) in enumerate(grid[1:] if header else grid)]
                rows.append(found)
                counts.append((len(reader.tables), len(reader.open), reader.stray, reader.bad_spans))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(rows, kind), *(pa.array(c, pa.int32()) for c in zip(*counts))],
                names=[key, "rows", "n_tables", "n_unclosed", "n_stray", "n_bad_spans"]
            )

    chosen = pages.select(F.col(key).cast("string").alias(key), F.col(html).cast("string").alias(html))
    return chosen.mapInArrow(
        job,
        f"{key} string, rows array<struct<nth: int, row: int, header: array<string>, cells: array<string>>>, n_tables int, n_unclosed int, n_stray int, n_bad_spans int"
    )


def cell(name: str) -> Column:
    """The cell under the header ``name`` of a row ``t``; an empty one is null."""
    at = F.array_position("t.header", name).cast("int")
    return F.when(at > 0, F.nullif(F.trim(F.get("t.cells", at - 1)), F.lit("")))


def index_members(tables: DataFrame, key: str = "page_id") -> DataFrame:
    """Members of indices, ``key, symbol, name, sector, industry``, from the first table of each
    page that has a column Symbol.

    Symbols are upper case, with a hyphen for a dot; rows without one go.  Of rows
    that repeat a symbol of the page the first counts.
    """
    rows = tables.select(key, F.explode("rows").alias("t")).where(F.array_contains("t.header", "Symbol"))
    first = rows.withColumn("least", F.min("t.nth").over(Window.partitionBy(key))).where("t.nth = least")
    symbol = F.replace(F.upper(cell("Symbol")), F.lit("."), F.lit("-"))
    found = first.select(
        key, F.col("t.row").alias("row"), symbol.alias("symbol"), cell("Security").alias("name"), cell("GICS Sector").alias("sector"),
        cell("GICS Sub-Industry").alias("industry")
    )
    firsts = F.row_number().over(Window.partitionBy(key, "symbol").orderBy("row"))
    return found.where("symbol is not null").withColumn("k", firsts).where("k = 1").drop("k", "row")


def refreshed_universe(old: DataFrame, members: DataFrame) -> DataFrame:
    """``universe, symbol, is_current, is_new`` after a refresh from ``members(universe, symbol)``;
    a universe of which nothing was read keeps its members as they were."""
    from barloom.operators.scans import refresh_members

    read = members.select("universe").distinct()
    kept = old.join(read, "universe", "left_anti").select("universe", "symbol", F.lit(True).alias("is_current"), F.lit(False).alias("is_new"))
    return refresh_members(old.join(read, "universe", "left_semi"), members).unionByName(kept)
