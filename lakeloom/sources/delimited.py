"""Tables in text files: delimited by a sniffed character or tabs, and JSON (S-48, S-49, S-51, S-52, S-56)."""

from __future__ import annotations

import csv
import io
import json

from lakeloom.operators.pytext import text_of

#: Bytes and rows that a table is read from; what is beyond makes it ``cut``.
MOST_BYTES, MOST_ROWS = 4 << 20, 5000
CELLS = "row int, col int, name string, value string, cut boolean"
DELIMITERS = ",;\t|"


def sniffed(text: str) -> str:
    """The delimiter that splits the first lines best: equally many times each before unequally, then more often; a comma where none does."""
    head = "\n".join(text.split("\n", 21)[:20])

    def merit(rank: int, d: str) -> tuple:
        counts = [len(row) - 1 for row in csv.reader(io.StringIO(head, newline=""), delimiter=d) if row]
        return (min(counts, default=0) > 0, len(set(counts)) == 1, min(counts, default=0), -rank)

    best = max(enumerate(DELIMITERS), key=lambda k: merit(*k))
    return best[1] if merit(*best)[0] else ","


def reader(delimiter: str | None = None, header: bool = True):
    """A reader of cells; without a delimiter it is sniffed. Row 0 is the first below the header."""

    def cells(data: bytes) -> list[tuple]:
        cut = len(data) > MOST_BYTES
        text = text_of(data[:MOST_BYTES])
        if text is None:
            raise ValueError("binary, not text")
        if cut:
            text = text[: text.rfind("\n") + 1] or text
        rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter or sniffed(text)) if r]
        names = rows.pop(0) if header and rows else []
        cut = cut or len(rows) > MOST_ROWS
        return [(i, j, names[j] if j < len(names) else str(j + 1), value, cut) for i, row in enumerate(rows[:MOST_ROWS]) for j, value in enumerate(row)]

    return cells


def _said(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def json_cells(data: bytes) -> list[tuple]:
    """Cells of a top-level array: of objects, whose keys are columns in order of first appearance, or of arrays or scalars."""
    rows = json.loads(text_of(data) or "")
    if not isinstance(rows, list):
        raise ValueError("no array at the top")
    names: dict[str, int] = {}
    out = []
    for i, row in enumerate(rows[:MOST_ROWS]):
        pairs = row.items() if isinstance(row, dict) else enumerate(row, 1) if isinstance(row, list) else [("value", row)]
        out += [(i, names.setdefault(str(name), len(names)), str(name), _said(value), len(rows) > MOST_ROWS) for name, value in pairs]
    return out


def json_pretty(data: bytes) -> list[tuple]:
    """The document with two spaces a level, keys in their order."""
    return [(json.dumps(json.loads(text_of(data) or ""), ensure_ascii=False, indent=2),)]
