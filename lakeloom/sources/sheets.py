"""Cells of workbooks: xlsx, ods, SpreadsheetML and HTML tables, chosen by their bytes (S-10, S-13 to S-16, J-25)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

CELLS = "sheet string, row int, col int, kind string, value string"
#: Columns of the widest sheet; a repeat that claims more is damage.
MOST_COLUMNS = 16_384


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attr(node: ET.Element, name: str, default: str | None = None) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), default)


def place(reference: str) -> tuple[int, int]:
    """Row and column, from 0, of a reference such as B3."""
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", reference.upper()).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


def xlsx(data: bytes) -> Iterator[tuple]:
    """Sparse cells by reference; shared strings are looked up, phonetic runs left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {n.lower(): n for n in z.namelist()}
        shared: list[str] = []
        if "xl/sharedstrings.xml" in names:
            for item in ET.fromstring(z.read(names["xl/sharedstrings.xml"])):
                hidden = {id(t) for r in item.iter() if _local(r.tag) == "rPh" for t in r.iter()}
                shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t" and id(t) not in hidden))
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read(names["xl/_rels/workbook.xml.rels"]))}
        for sheet in (e for e in ET.fromstring(z.read(names["xl/workbook.xml"])).iter() if _local(e.tag) == "sheet"):
            target = targets[_attr(sheet, "id")].lstrip("/")
            member = names[(target if target.startswith("xl/") else f"xl/{target}").lower()]
            for c in (e for e in ET.fromstring(z.read(member)).iter() if _local(e.tag) == "c"):
                kind, raw = c.get("t", "n"), next((v.text for v in c if _local(v.tag) == "v"), None)
                if kind == "inlineStr":
                    raw = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                elif kind == "s" and raw is not None:
                    raw = shared[int(raw)]
                if raw is not None:
                    yield (sheet.get("name"), *place(c.get("r")), {"s": "text", "str": "text", "inlineStr": "text", "b": "bool", "e": "error"}.get(kind, "number"), raw)


def _ods_rows(table: ET.Element, sheet: str) -> Iterator[tuple]:
    row = 0
    for r in (e for e in table.iter() if _local(e.tag) == "table-row"):
        found, col = [], 0
        for c in (e for e in r if _local(e.tag) in ("table-cell", "covered-table-cell")):
            times = int(_attr(c, "number-columns-repeated", "1"))
            text = "\n".join("".join(p.itertext()) for p in c if _local(p.tag) == "p")
            kind = {"float": "number", "currency": "number", "percentage": "number", "boolean": "bool", "date": "date"}.get(_attr(c, "value-type", ""), "text")
            if text:
                if col + times > MOST_COLUMNS:
                    raise ValueError(f"{col + times} columns")
                found += [(col + k, kind, _attr(c, "value") or text) for k in range(times)]
            col += times
        times = int(_attr(r, "number-rows-repeated", "1"))
        for k in range(times if found else 0):
            for col, kind, value in found:
                yield sheet, row + k, col, kind, value
        row += times


def ods(data: bytes) -> Iterator[tuple]:
    """Cells as saved; repeats are expanded where they hold something, trailing blanks never."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("content.xml"))
    for table in (e for e in root.iter() if _local(e.tag) == "table"):
        yield from _ods_rows(table, _attr(table, "name", ""))


def spreadsheetml(data: bytes) -> Iterator[tuple]:
    """Cells with their gaps (``Index``) and merges across."""
    for sheet in (e for e in ET.fromstring(data).iter() if _local(e.tag) == "Worksheet"):
        row = -1
        for r in (e for e in sheet.iter() if _local(e.tag) == "Row"):
            row = int(_attr(r, "Index", str(row + 2))) - 1
            col = -1
            for c in (e for e in r if _local(e.tag) == "Cell"):
                col = int(_attr(c, "Index", str(col + 2))) - 1
                for d in (e for e in c if _local(e.tag) == "Data"):
                    kind = {"Number": "number", "Boolean": "bool", "DateTime": "date", "Error": "error"}.get(_attr(d, "Type", ""), "text")
                    yield _attr(sheet, "Name", ""), row, col, kind, "".join(d.itertext())
                col += int(_attr(c, "MergeAcross", "0"))


def html(data: bytes) -> Iterator[tuple]:
    from lakeloom.operators.webpages import _Tables

    p = _Tables()
    p.feed(data.decode("utf-8", "replace"))
    for table, row, col, value, _ in p.cells:
        yield f"Table {table + 1}", row, col, "text", value


def cells(data: bytes) -> Iterator[tuple]:
    """Sheet, row, column, kind and value of the cells of a workbook of any of the formats."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = {n.lower() for n in z.namelist()}
        if "xl/workbook.xml" in names:
            return xlsx(data)
        if "content.xml" in names:
            return ods(data)
        raise ValueError("a ZIP archive that is no workbook")
    head = data[:4096].lstrip(b"\xef\xbb\xbf \t\r\n")
    if head.startswith(b"<?xml") and b"schemas-microsoft-com:office:spreadsheet" in head:
        return spreadsheetml(data)
    if b"<table" in data.lower():
        return html(data)
    raise ValueError("not a workbook")
