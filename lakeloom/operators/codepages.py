"""Text whose code page nobody wrote down, or somebody did (F-29 to F-31, S-17).

Candidate readings of the same bytes are weighed by the kinds of their characters; a reading replaces the one at hand only where
it weighs more, and of equal ones the first stays.
"""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Readings in the order in which they are tried.
READINGS = ("utf-8", "cp866", "cp1251")
PLAYLIST_READINGS = ("utf-8", "cp1251", "latin-1")

#: Kinds of characters and the weight of one of each; any other weighs OTHER.
WEIGHTS = (
    (re.compile(r"[^\W_]|[ ._\-+()\[\]{}#@!,;'&~/]"), 2),  # letters, digits and what names are made of
    (re.compile("[─-▟]"), -4),  # boxes and blocks
    (re.compile("[\ud800-\udfff\x00-\x1f]"), -8),  # halves of pairs, control characters
)
OTHER = -3


def weight(text: str) -> int:
    """How much a text reads like a name that somebody typed."""
    counts = [(len(kind.findall(text)), w) for kind, w in WEIGHTS]
    return sum(n * w for n, w in counts) + OTHER * (len(text) - sum(n for n, _ in counts))


def reading(raw: bytes, codec: str) -> str | None:
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return None


def best_reading(raw: bytes, at_hand: str, wanted: str | None = None) -> str:
    """The weightiest reading of a name, or the one of a wanted code page where that is possible."""
    if wanted:
        return reading(raw, wanted) or at_hand
    choices = [at_hand, *(r for r in (reading(raw, c) for c in READINGS) if r is not None)]
    return max(choices, key=weight)  # the first of equals


def member_name(name: str, is_utf8: bool, wanted: str | None = None) -> str:
    """A ZIP member's name: believed where its flag says UTF-8 or it is ASCII, else read anew from its bytes."""
    return name if is_utf8 or name.isascii() else best_reading(name.encode("cp437"), name, wanted)


def playlist_text(raw: bytes, utf8: bool = False) -> str:
    """A playlist's text: UTF-8 where its kind says so, else the first reading that takes all of it."""
    found = (reading(raw, c) for c in (PLAYLIST_READINGS[:1] if utf8 else PLAYLIST_READINGS))
    return next((t for t in found if t is not None), None) or raw.decode("utf-8", "replace")


def declared_text(raw: bytes) -> str:
    """Markup in the charset of its mark or of its own words; without either UTF-8, or Windows-1251 where it is not."""
    for mark, codec in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if raw.startswith(mark):
            return raw.decode(codec, "replace")
    said = re.search(rb"""(?:charset\s*=\s*["']?|encoding\s*=\s*["'])([\w-]+)""", raw[:4096], re.I)
    try:
        return raw.decode(codecs.lookup(said[1].decode()).name, "replace")
    except (TypeError, LookupError):  # nothing said, or a name that nobody knows
        return reading(raw, "utf-8") or raw.decode("cp1251", "replace")


@F.pandas_udf(T.StringType())
def anew_read_names(raw: pd.Series) -> pd.Series:
    """Names whose bytes a format of old reads as code page 437."""
    return raw.map(lambda x: None if x is None else best_reading(bytes(x), bytes(x).decode("cp437")))


@F.pandas_udf(T.StringType())
def playlist_texts(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else playlist_text(bytes(x)))


@F.pandas_udf(T.StringType())
def declared_texts(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else declared_text(bytes(x)))


@F.pandas_udf(T.BinaryType())
def encoded(text: pd.Series, codec: pd.Series) -> pd.Series:
    """Text in a code page by name; what the page lacks is replaced."""
    return pd.Series([None if t is None else t.encode(c, "replace") for t, c in zip(text, codec, strict=True)])
