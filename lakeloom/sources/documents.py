"""Blocks of documents: docx, odt, epub, fb2 and rtf, chosen by their bytes (P-16, S-36, S-38 to S-41, W-14)."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from lakeloom.operators.webpages import markdown_of

BLOCKS = "seq int, kind string, level int, text string"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _value(node: ET.Element | None, name: str = "val") -> str | None:
    return None if node is None else next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _first(node: ET.Element, name: str) -> ET.Element | None:
    return next((e for e in node.iter() if _local(e.tag) == name), None)


def docx(data: bytes) -> Iterator[tuple]:
    """Paragraphs; heading by style name, list items by numbering, deleted text left out and inserted text kept."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    for p in (e for e in root.iter() if _local(e.tag) == "p"):
        gone = {id(t) for d in p.iter() if _local(d.tag) in ("del", "moveFrom") for t in d.iter()}
        parts = []
        for e in p.iter():
            if id(e) in gone:
                continue
            parts.append({"t": e.text or "", "tab": "\t", "br": "\n"}.get(_local(e.tag), ""))
        text = "".join(parts).strip()
        if not text:
            continue
        style = (_value(_first(p, "pStyle")) or "").lower()
        found = re.fullmatch(r"heading ?(\d)", style)
        if found:
            yield "heading", int(found[1]), text
        elif _first(p, "numPr") is not None:
            yield "item", int(_value(_first(p, "ilvl")) or 0) + 1, text
        else:
            yield "paragraph", 0, text


def _odt(root: ET.Element) -> Iterator[tuple]:
    def walk(node: ET.Element, depth: int) -> Iterator[tuple]:
        for e in node:
            tag = _local(e.tag)
            if tag == "h":
                yield "heading", int(_value(e, "outline-level") or 1), "".join(e.itertext()).strip()
            elif tag == "p":
                if text := "".join(e.itertext()).strip():
                    yield ("item" if depth else "paragraph"), depth, text
            elif tag not in ("tracked-changes", "annotation"):
                yield from walk(e, depth + (tag == "list"))

    body = _first(root, "text")
    return walk(body if body is not None else root, 0)


def fb2(data: bytes) -> Iterator[tuple]:
    def walk(node: ET.Element, depth: int) -> Iterator[tuple]:
        for e in node:
            tag = _local(e.tag)
            if tag == "title":
                yield "heading", min(6, max(1, depth)), " ".join("".join(e.itertext()).split())
            elif tag in ("p", "v", "subtitle", "text-author"):
                if text := " ".join("".join(e.itertext()).split()):
                    yield "paragraph", 0, text
            elif tag in ("body", "section", "epigraph", "cite", "poem", "stanza"):
                yield from walk(e, depth + (tag == "section"))

    return walk(ET.fromstring(data), 1)


def epub(data: bytes) -> Iterator[tuple]:
    """The pages of the spine in order, as Markdown blocks."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {n.lower(): n for n in z.namelist()}
        opf = _value(_first(ET.fromstring(z.read("META-INF/container.xml")), "rootfile"), "full-path")
        root = ET.fromstring(z.read(opf))
        items = {e.get("id"): e.get("href") for e in root.iter() if _local(e.tag) == "item"}
        for ref in (e for e in root.iter() if _local(e.tag) == "itemref"):
            member = posixpath.normpath(posixpath.join(posixpath.dirname(opf), items[ref.get("idref")]))
            for block in markdown_of(z.read(names[member.lower()]).decode("utf-8", "replace")).split("\n\n"):
                found = re.match(r"(#{1,6}) (.*)", block)
                if found:
                    yield "heading", len(found[1]), found[2]
                elif block:
                    yield "paragraph", 0, block


#: Groups of rtf whose text is not shown.
RTF_HIDDEN = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "object", "themedata", "listtable", "listoverridetable"}


def rtf(data: bytes) -> Iterator[tuple]:
    """Paragraphs of rich text: control words, escaped bytes, Unicode with its fallback skipped."""
    text, stack, hidden, skip, fallback, line = data.decode("latin-1"), [], False, 0, 1, []
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|([^\\{}\r\n]+)", text, re.I):
        word, number, byte, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append((hidden, fallback))
        elif brace == "}":
            hidden, fallback = stack.pop() if stack else (False, 1)
        elif symbol == "*" or (word and word in RTF_HIDDEN):
            hidden = True
        elif word == "uc":
            fallback = int(number or 1)
        elif word == "u" and not hidden:
            line.append(chr(int(number) % 65536))
            skip = fallback
        elif word in ("par", "line", "sect") and not hidden:
            yield "paragraph", 0, "".join(line).strip()
            line = []
        elif word == "tab" and not hidden:
            line.append("\t")
        elif byte and not hidden:
            if skip:
                skip -= 1
            else:
                line.append(bytes([int(byte, 16)]).decode("cp1252", "replace"))
        elif symbol and not hidden:
            line.append({"~": " ", "_": "-"}.get(symbol, symbol))
        elif plain and not hidden:
            line.append(plain[skip:])
            skip = max(0, skip - len(plain))
    if line:
        yield "paragraph", 0, "".join(line).strip()


def blocks(data: bytes) -> Iterator[tuple]:
    """Numbered blocks of a document of any of the formats; empty blocks are left out."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            found = docx(data) if "word/document.xml" in names else epub(data) if "META-INF/container.xml" in names else _odt(ET.fromstring(z.read("content.xml"))) if "content.xml" in names else None
        if found is None:
            raise ValueError("a ZIP archive that is no document")
    elif data.startswith(b"{\\rtf"):
        found = rtf(data)
    elif b"<FictionBook" in data[:4096]:
        found = fb2(data)
    elif b"office:document" in data[:4096]:
        found = _odt(ET.fromstring(data))
    else:
        raise ValueError("not a document")
    yield from ((i, *b) for i, b in enumerate(b for b in found if b[2]))


def roman(n: int) -> str:
    out = ""
    for value, letters in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += letters * (n // value)
        n %= value
    return out


def letters(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


class Numbering:
    """Counters of lists: per abstract list and level; a step drops deeper counters; ``%n`` shows a level's count or start."""

    def __init__(self, levels: dict[tuple[str, int], tuple[str, str, int]], abstract: dict[str, str], overrides: dict[tuple[str, int], int] | None = None):
        self.levels, self.abstract, self.overrides = levels, abstract, overrides or {}
        self.counts: dict[str, dict[int, int]] = {}
        self.met: set[str] = set()

    def label(self, list_id: str, level: int) -> str:
        kind = self.abstract[list_id]
        counts = self.counts.setdefault(kind, {})
        if list_id not in self.met:
            self.met.add(list_id)
            for (owner, at), start in self.overrides.items():
                if owner == list_id:
                    counts[at] = start - 1
        counts[level] = counts.get(level, self.levels[kind, level][2] - 1) + 1
        for deeper in [k for k in counts if k > level]:
            del counts[deeper]

        def shown(m: re.Match) -> str:
            at = int(m[1]) - 1
            form, _, start = self.levels.get((kind, at), ("decimal", "", 1))
            n = counts.get(at, start)
            return {"upperRoman": roman, "lowerRoman": lambda k: roman(k).lower(), "upperLetter": letters, "lowerLetter": lambda k: letters(k).lower(), "decimalZero": lambda k: f"{k:02d}"}.get(form, str)(n)

        return re.sub(r"%(\d)", shown, self.levels[kind, level][1])
