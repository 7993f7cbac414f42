"""Readers by what a file is, not by its name alone, and settings with their bounds (X-01, X-02, X-04, X-07, X-08, S-61).

A registry is data: each entry names a reader, the suffixes and first bytes that it claims, and its priority, so a table of
entries may as well come from a JSON text. The choice is an expression; every chosen reader then runs over its own files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.sources import archives, binary, databases, delimited, documents, media, sheets, workflows


class Entry(NamedTuple):
    """A reader and what it claims; of several claims the highest priority wins, and bytes before suffixes at one priority."""

    name: str
    suffixes: tuple[str, ...]
    heads: tuple[bytes, ...] = ()
    priority: int = 0


#: Readers by name, with their columns; a describer's are ``label`` and ``value`` of facts.
READERS: dict[str, tuple[Callable[[bytes], Iterable[tuple]], str]] = {
    "database": (databases.objects, databases.OBJECTS),
    "archive": (archives.members, archives.MEMBERS),
    "sheet": (sheets.cells, sheets.CELLS),
    "document": (documents.blocks, documents.BLOCKS),
    "facts": (media.facts, media.FACTS),
    "delimited": (delimited.reader(), delimited.CELLS),
    "tabs": (delimited.reader("\t"), delimited.CELLS),
    "json": (delimited.json_cells, delimited.CELLS),
    "workflow": (workflows.items, workflows.ITEMS),
}

ENTRIES = (
    Entry("database", ("db", "sqlite", "sqlite3", "db3"), (b"SQLite format 3\0",), 10),
    Entry("sheet", ("xlsx", "ods"), (), 8), Entry("document", ("docx", "odt", "epub", "fb2", "rtf"), (b"{\\rtf",), 8),
    Entry("facts", ("png", "jpg", "jpeg", "mp3", "flac", "wav"), (b"\x89PNG", b"\xff\xd8\xff", b"ID3", b"fLaC", b"RIFF"), 6),
    Entry("archive", ("zip", "tar", "tgz", "gz", "bz2", "xz"), (b"PK\x03\x04", b"\x1f\x8b", b"BZh"), 4),
    Entry("delimited", ("csv",)), Entry("tabs", ("tsv", "tab")), Entry("json", ("json",)),
)


def entries_of(text: str) -> tuple[Entry, ...]:
    """Entries from JSON: a list of objects with ``name``, ``suffixes``, ``heads`` in hex and ``priority``."""
    found = tuple(Entry(e["name"], tuple(e.get("suffixes", ())), tuple(bytes.fromhex(h) for h in e.get("heads", ())), int(e.get("priority", 0))) for e in json.loads(text))
    if unknown := {e.name for e in found} - set(READERS):
        raise ValueError(f"unknown readers: {sorted(unknown)}")
    return found


def reader_of(path: Column, content: Column, entries: Iterable[Entry] = ENTRIES) -> Column:
    """The name of the reader that a file goes to; null where none claims it."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(content, 1, 32))
    claims = [(2 * e.priority + 1, e.name, head.startswith(h.hex().upper())) for e in entries for h in e.heads] + [(2 * e.priority, e.name, suffix.isin(*e.suffixes)) for e in entries if e.suffixes]
    out = None
    for _, name, claimed in sorted(claims, key=lambda c: -c[0]):
        out = F.when(claimed, name) if out is None else out.when(claimed, name)
    return F.lit(None).cast("string") if out is None else out


def read(files: DataFrame, name: str, entries: Iterable[Entry] = ENTRIES) -> DataFrame:
    """Rows of the files (``path``, ``content``) that go to one reader."""
    reader, schema = READERS[name]
    return binary.rows_of(files.where(reader_of(F.col("path"), F.col("content"), entries) == name), reader, schema)


class Setting(NamedTuple):
    """A parameter of a query: its kind (boolean, integer, choice, text), default and bounds."""

    kind: str
    default: object
    least: int | None = None
    most: int | None = None
    choices: tuple[str, ...] = ()

    def value(self, given: object = None) -> object:
        """What is given, within the bounds; the default where nothing or nonsense is."""
        if self.kind == "boolean":
            return given if isinstance(given, bool) else self.default
        if self.kind == "integer":
            try:
                n = int(given)
            except (TypeError, ValueError):
                return self.default
            return max(n if self.least is None else self.least, min(n, n if self.most is None else self.most))
        if self.kind == "choice":
            return given if given in self.choices else self.default
        return given if isinstance(given, str) and given else self.default


def settled(schema: dict[str, Setting], given: dict[str, object]) -> dict[str, object]:
    """All settings of a schema; given ones that it does not know raise."""
    if unknown := set(given) - set(schema):
        raise KeyError(f"unknown settings: {sorted(unknown)}")
    return {name: s.value(given.get(name)) for name, s in schema.items()}
