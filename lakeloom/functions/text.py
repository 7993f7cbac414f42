"""Paths, links, lines and marks of text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_hidden(path: Column) -> Column:
    """A dot-name, or below one (P-01)."""
    return F.exists(F.split(path, "/"), lambda s: s.startswith(".") & ~s.isin(".", ".."))


def is_dangerous(name: Column) -> Column:
    """Absolute, with a drive letter, or climbing by ``..`` (P-02)."""
    slashed = F.translate(name, "\\", "/")
    return slashed.startswith("/") | (F.substring(name, 2, 1) == ":") | F.array_contains(F.split(slashed, "/"), "..")


def normalised(name: Column) -> Column:
    """Slashes one way, no leading slash or ``./``, no trailing slash (P-03)."""
    return F.regexp_replace(F.regexp_replace(F.translate(name, "\\", "/"), "^(?:\\./|/)+", ""), "/+$", "")


def renamed(name: Column, source: str, target: str) -> Column:
    """A name at or under ``source`` moved to ``target`` (P-10)."""
    return F.when(name == source, target).when(name.startswith(source + "/"), F.concat(F.lit(target), F.substring(name, F.lit(len(source) + 1), F.length(name)))).otherwise(name)


def suffix(url: Column) -> Column:
    """The lower-case suffix of a URL's last segment, without its dot (P-06)."""
    return F.lower(F.regexp_extract(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), r"\.([A-Za-z0-9]+)$", 1))


#: Suffixes of pages; any other suffix is a file.
PAGES = ("html", "htm", "xhtml", "php", "asp", "aspx", "jsp", "cgi")


def is_page(url: Column, tag: Column) -> Column:
    """Whether a link leads to a page: from a, area or iframe, and of a page's suffix or none (P-06)."""
    return tag.isin("a", "area", "iframe") & (suffix(url).isin("", *PAGES))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def resolved(target: Column, folder: Column) -> Column:
    """A playlist's target: URLs stay, absolute paths stay, others join the folder (P-11)."""
    t = F.translate(target, "\\", "/")
    return F.when(target.contains("://"), target).when(t.startswith("/"), t).otherwise(F.concat(folder, F.lit("/"), t))


def cut_at_line(text: Column, most: int) -> Column:
    """At most ``most`` characters, ending at the last line break among them (P-17)."""
    head = F.substring(text, 1, most)
    return F.when(F.length(text) <= most, text).otherwise(F.coalesce(F.nullif(F.regexp_extract(head, r"(?s)^(.*)\n", 1), F.lit("")), head))


def blob_kind(data: Column) -> Column:
    """A blob's kind by its first bytes (P-15)."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "PNG").when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("47494638"), "GIF").when(head.startswith("25504446"), "PDF")
        .when(head.startswith("504B0304"), "ZIP").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WebP").when(head.startswith("1F8B"), "gzip").otherwise("binary")
    )


def is_binary(data: Column) -> Column:
    """A zero byte among the first 8000 (P-18)."""
    return F.instr(F.regexp_replace(F.hex(F.substring(data, 1, 8000)), "(..)", "$1 "), "00 ") > 0


def typed(text: Column) -> Column:
    """``number`` or ``text`` of a cell, spaces aside, and its value (F-14)."""
    bare = F.regexp_replace(text, "[ \xa0\u202f]", "")
    whole = bare.rlike(r"^[+-]?[0-9]{1,15}$")
    real = bare.rlike(r"^[+-]?[0-9]+[.,][0-9]+$") & (F.length(bare) <= 40)
    return F.struct(F.when(whole | real, "number").otherwise("text").alias("kind"), F.when(whole | real, F.replace(bare, F.lit(","), F.lit(".")).cast("double")).alias("num"))


def capped(text: Column, most: int = 32768) -> Column:
    """A text cut at ``most`` characters with an ellipsis (F-10)."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def md_escape(text: Column) -> Column:
    """Characters that mean something in Markdown behind a backslash (F-34)."""
    return F.regexp_replace(text, r"([\\`*_\[\]<>|])", r"\\$1")


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed (F-34)."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fence(text: Column) -> Column:
    """A code fence longer than any run of backticks in the text, three at least (F-38)."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def quoted(name: Column) -> Column:
    """An SQL identifier in quotes (F-39)."""
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def title_norm(text: Column) -> Column:
    """Letters and digits, lower case (F-40)."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def first_line(text: Column) -> Column:
    """The first line that is not blank, trimmed (F-43)."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1)), F.lit(""))


def decorations(text: Column) -> Column:
    """``HEAD -> main, tag: v1, origin/x`` as (kind, name) (F-41)."""
    part = lambda p: F.when(p.startswith("tag: "), F.struct(F.lit("tag").alias("kind"), F.regexp_replace(p, "^tag: ", "").alias("name"))).when(p.startswith("HEAD -> "), F.struct(F.lit("head").alias("kind"), F.regexp_replace(p, "^HEAD -> ", "").alias("name"))).when(p.contains("/"), F.struct(F.lit("remote").alias("kind"), p.alias("name"))).otherwise(F.struct(F.lit("branch").alias("kind"), p.alias("name")))
    return F.transform(F.filter(F.split(text, ",\\s*"), lambda p: p != ""), part)


def dehyphenated(text: Column) -> Column:
    """A hyphen at a line's end goes where the next line starts in lower case; other breaks become spaces (F-37)."""
    return squeezed(F.regexp_replace(F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2"), r"-\n", "-"))


def addition_diff(path: Column, body: Column, most: int = 2000) -> Column:
    """A new file as a diff of added lines, ``most`` at most (F-33)."""
    lines = F.split(F.regexp_replace(body, r"\n$", ""), "\n")
    shown = F.slice(lines, 1, most)
    head = F.concat(F.lit("--- /dev/null\n+++ b/"), path, F.lit("\n@@ -0,0 +1,"), F.size(shown).cast("string"), F.lit(" @@\n"))
    return F.concat(head, F.array_join(F.transform(shown, lambda x: F.concat(F.lit("+"), x)), "\n"))


def list_marker(text: Column) -> Column:
    """``bullet``, ``number``, ``letter`` or empty (P-20)."""
    return F.when(text.rlike(r"^\s*[-*•–]\s"), "bullet").when(text.rlike(r"^\s*[0-9]{1,3}[.)]\s"), "number").when(text.rlike(r"^\s*[a-z][.)]\s"), "letter").otherwise("")


def hex_dump(data: Column, most: int = 262144) -> Column:
    """Lines of sixteen bytes: offset, hex, printable characters (S-53)."""
    n = F.least(F.octet_length(data), F.lit(most))
    row = lambda k: F.struct(F.lpad(F.lower(F.hex(k * 16)), 8, "0").alias("offset"), F.rtrim(F.regexp_replace(F.lower(F.hex(F.substring(data, k * 16 + 1, F.least(F.lit(16), n - k * 16)))), "(..)", "$1 ")).alias("bytes"))
    return F.when(n == 0, F.array().cast("array<struct<offset:string,bytes:string>>")).otherwise(F.transform(F.sequence(F.lit(0), F.ceil(n / 16).cast("int") - 1), row))


#: Spaces of any width.
ANY_SPACE = "[\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000]"


def tidied(text: Column) -> Column:
    """A text as a sentence: soft hyphens and breaks gone, words that a line's end parted joined, any spaces single (F-37).

    A hyphen at a line's end goes where a small letter follows and stays before any other.
    """
    plain = F.regexp_replace(F.replace(text, F.lit("\u00ad"), F.lit("")), ANY_SPACE, " ")
    small = F.regexp_replace(plain, "(\\p{L})[-\u2010]\\s*\\n\\s*(\\p{Ll})", "$1$2")
    large = F.regexp_replace(small, "(\\p{L})[-\u2010]\\s*\\n\\s*(\\p{L})", "$1-$2")
    return F.trim(F.regexp_replace(F.regexp_replace(large, "[\r\n\t]+", " "), " {2,}", " "))


def leaf(target: Column) -> Column:
    """The last part of a path or URL."""
    of_url = F.regexp_extract(F.regexp_extract(target, r"^[^:]*://[^/?#]*([^?#]*)", 1), "([^/]*)$", 1)
    return F.when(target.contains("://"), F.coalesce(F.nullif(of_url, F.lit("")), target)).otherwise(F.regexp_extract(F.translate(target, "\\", "/"), "([^/]*)$", 1))


def file_title(text: Column) -> Column:
    """A title without what file names cannot hold; ``track`` where nothing is left (P-09)."""
    return F.coalesce(F.nullif(squeezed(F.regexp_replace(text, r'[/\\:*?"<>|]', "-")), F.lit("")), F.lit("track"))


def track_name(order: Column, title: Column, target: Column) -> Column:
    """A track as a file: two digits of its place, its title or its file's, and the file's own suffix (P-09)."""
    suffix = F.regexp_extract(leaf(target), r"^.+(\.[^.]*)$", 1)
    stem = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.substring(leaf(target), F.lit(1), F.length(leaf(target)) - F.length(suffix)))
    return F.concat(F.lpad(order.cast("string"), F.greatest(F.lit(2), F.length(order.cast("string"))), F.lit("0")), F.lit(" "), file_title(stem), suffix)


def trimmed_number(value: Column) -> Column:
    """At most four decimals, zeros at the end off (F-15)."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", value), "0+$", ""), r"\.$", "")


def table_cell(text: Column) -> Column:
    """A text in a Markdown table: bars escaped, breaks as spaces (F-38)."""
    return F.replace(F.regexp_replace(text, r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))


def role(name: Column, ordered: list[tuple[str, str]], otherwise: str = "other") -> Column:
    """The role of the first part of a list, in its order, that a name holds, whatever the case (P-12)."""
    low, out = F.lower(name), F.lit(otherwise)
    for part, of_it in reversed(ordered):
        out = F.when(low.contains(part), of_it).otherwise(out)
    return out


def fields(document: Column, most: int = 120) -> Column:
    """``key: value`` of a JSON object's own scalars, breaks as spaces, long ones cut with an ellipsis (P-13)."""
    members = F.map_entries(F.from_json(document, "map<string,string>"))
    plain = F.filter(members, lambda m: m["value"].isNotNull() & ~F.trim(m["value"]).rlike(r"^[\[{]"))
    one = lambda v: F.when(F.length(v) > most, F.concat(F.substring(v, 1, most - 1), F.lit("…"))).otherwise(v)
    return F.transform(plain, lambda m: F.concat(m["key"], F.lit(": "), one(F.regexp_replace(m["value"], r"[\r\n]+", " "))))
