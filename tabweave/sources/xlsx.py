"""Workbooks of the zipped XML kind: the most table-like sheet, its header row, its cells as texts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.normalize import distinct_names
from tabweave.session import scratch

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
Rows = list[list[str | None]]
#: A header has so many filled cells at least, fills such a share of the widest row, and no longer cell.
HEADER_CELLS, HEADER_SHARE, HEADER_CHARS, SCORED_ROWS = 4, 0.25, 200, 100


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _place(reference: str) -> int:
    at = 0
    for c in re.match("[A-Z]+", reference)[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


def sheets(data: bytes) -> Iterator[tuple[str, Rows]]:
    """Name and rows of each sheet, in the workbook's order; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [_texts(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = links[sheet.get(_LINK)].lstrip("/")
            rows: Rows = []
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{_MAIN}row":
                        continue
                    number = int(row.get("r", len(rows) + 1))
                    rows += [[] for _ in range(number - 1 - len(rows))]
                    cells: list[str | None] = []
                    for cell in row.iter(f"{_MAIN}c"):
                        at = _place(cell.get("r")) if cell.get("r") else len(cells)
                        cells += [None] * (at - len(cells))
                        value = cell.find(f"{_MAIN}v")
                        kind = cell.get("t")
                        if kind == "inlineStr":
                            cells.append(_texts(cell))
                        elif value is None or value.text is None:
                            cells.append(None)
                        else:
                            cells.append(shared[int(value.text)] if kind == "s" else {"1": "true", "0": "false"}[value.text] if kind == "b" else value.text)
                    rows.append(cells)
                    row.clear()
            yield sheet.get("name"), rows


def _filled(row: Sequence[str | None]) -> list[str]:
    return [c for c in row if c is not None and c.strip()]


def header_row(rows: Rows) -> int:
    """The first row with enough short labels and something below it; -1 if there is none."""
    width = max((len(r) for r in rows), default=0) or 1
    for i, row in enumerate(rows[:-1]):
        cells = _filled(row)
        if len(cells) >= HEADER_CELLS and len(cells) / width >= HEADER_SHARE and max(map(len, cells)) <= HEADER_CHARS and _filled(rows[i + 1]):
            return i
    return -1


def sheet_score(rows: Rows) -> int:
    """Cells of the header times rows below it, of which so many count at most."""
    at = header_row(rows)
    return 0 if at < 0 else len(_filled(rows[at])) * min(sum(bool(_filled(r)) for r in rows[at + 1 :]), SCORED_ROWS)


def fullest_sheet(found: list[tuple[str, Rows]]) -> tuple[str, Rows]:
    """The sheet with the most filled rows, the first of several."""
    return max(found, key=lambda s: sum(bool(_filled(r)) for r in s[1]))


def best_sheet(found: list[tuple[str, Rows]]) -> tuple[str, Rows]:
    """The sheet that looks most like a table, by sheet_score, or the fullest one if none does."""
    best = max(found, key=lambda s: sheet_score(s[1]))
    return best if sheet_score(best[1]) else fullest_sheet(found)


def table(data: bytes, sheet: str | None = None, header: int | None = None, choose: Callable[[list[tuple[str, Rows]]], tuple[str, Rows]] = fullest_sheet) -> tuple[list[str], Rows]:
    """Column names and rows of a workbook. Without a sheet `choose` takes one: the fullest for queries, best_sheet where
    files are looked at for the first time. Without a header row the first that looks like one is taken, else the first."""
    found = list(sheets(data))
    if not found:
        return [], []
    rows = dict(found)[sheet] if sheet is not None else choose(found)[1]
    at = header if header is not None else max(0, header_row(rows))
    if at >= len(rows):
        return [], []
    width = max(len(r) for r in rows[at:])
    names = distinct_names([*rows[at], *[None] * (width - len(rows[at]))])
    return names, [[*r, *[None] * (width - len(r))] for r in rows[at + 1 :] if _filled(r)]


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, header: int | None = None, choose: Callable[[list[tuple[str, Rows]]], tuple[str, Rows]] = fullest_sheet) -> DataFrame:
    """A workbook's table as texts; empty cells are null. A task reads the file, and the driver gets the names alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                names, rows = table(data, sheet, header, choose)
                for at in range(0, len(rows) + 1, 1000):
                    part = rows[at : at + 1000] if at else [names, *rows[:1000]]
                    place = range(at, at + len(part)) if at else range(-1, len(part) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(part, pa.list_(pa.string()))], names=["place", "cells"])

    path_of = f"{scratch(spark, 'workbook')}/t"
    spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "place long, cells array<string>").write.parquet(path_of)
    held = spark.read.parquet(path_of)
    names = held.where("place < 0").first().cells
    if not names:
        return spark.createDataFrame([], "column_1 string")
    return held.where("place >= 0").select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)))


def write_xlsx(found: dict[str, Sequence[Sequence[object]]]) -> bytes:
    """A workbook of inline texts and numbers, for exchange and tests."""
    from xml.sax.saxutils import escape, quoteattr

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        return f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    out = io.BytesIO()
    main, link = _MAIN.strip("{}"), _LINK[1 : _LINK.index("}")]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(found, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{link}/worksheet" Target="worksheets/s{i}.xml"/>' for i, _ in enumerate(found, 1)) + "</Relationships>")
        for i, rows in enumerate(found.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()
