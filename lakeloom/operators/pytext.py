"""Text operators: Arrow-batched Pandas functions where a rule reads its own output or needs a codec (F-28, F-32, W-07), else SQL functions (F-48)."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """A unified diff with three lines of context; empty where the texts are equal."""
    return pd.Series(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "a", "b", n=3, lineterm="")) for x, y in zip(a, b, strict=True)])


#: Bytes that the guess of a codec looks at.
SAMPLE = 512


def codec_of(data: bytes) -> str | None:
    """The codec of a text without a mark, by its zero bytes: UTF-16 where over half of one parity is zero, ``holes`` where they
    are many on neither or on both alike, UTF-8 where there are none; null for binary data, which has a few."""
    head = np.frombuffer(data[:SAMPLE], np.uint8) == 0
    if head.sum() * 4 <= len(head):
        return None if b"\0" in data else "utf-8"
    pairs = head[: len(head) // 2 * 2].reshape(-1, 2).sum(axis=0)
    if pairs[0] == pairs[1] or 2 * pairs.max() <= len(head) // 2:
        return "holes"
    return "utf-16-be" if pairs[0] > pairs[1] else "utf-16-le"


def text_of(data: bytes | None) -> str | None:
    """Bytes as text with ``\\n`` at the ends of lines, or null where they are none.

    Single-byte line ends before the rest are lines of their own. A byte-order mark decides the codec, else :func:`codec_of` does; what the
    codec cannot read is replaced.
    """
    if data is None:
        return None
    lead = re.match(rb"(?:[\r\n](?=[^\0]))*", data).end()
    rest, marks = data[lead:], {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}
    codec = marks.get(rest[:2]) or codec_of(rest)
    if codec is None:
        return None
    if rest[:2] in marks:
        rest = rest[2:]
    if codec == "holes":
        rest, codec = rest.replace(b"\0", b""), "utf-8"
    text = rest.decode(codec, "replace").removeprefix("\ufeff" if codec == "utf-8" else "")
    return re.sub("\r\n?", "\n", data[:lead].decode("ascii") + text)


@F.pandas_udf(T.StringType())
def decoded(data: pd.Series) -> pd.Series:
    return data.map(lambda x: text_of(bytes(x)) if x is not None else None)


def paragraphs_of(text: str | None) -> list[str]:
    """Lines joined to paragraphs: a line goes on where what precedes it is 30 characters or more and does not end a sentence."""
    out: list[str] = []
    for line in (text or "").split("\n"):
        line = line.strip()
        if out and line and len(out[-1]) >= 30 and out[-1][-1] not in ".!?:;\"'":
            out[-1] = out[-1][:-1] + line if out[-1].endswith("-") else f"{out[-1]} {line}"
        elif line:
            out.append(line)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def joined_paragraphs(text: pd.Series) -> pd.Series:
    return text.map(paragraphs_of)


def recipes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``label`` and ``value`` of the fields of a generated picture's text block (F-48), in SQL functions.

    The last line holds ``key: value`` pairs with commas between them and quotes around values that have commas; it counts as such only
    where it names the steps and the sampler or the seed. Lines from ``Negative prompt:`` on are the negative prompt. Where a key comes
    twice, the last value stays. Networks are those that the prompt names with a weight; those of the hashes alone weigh ``?``.
    """
    text = F.trim(F.coalesce(F.col(text_col), F.lit("")), F.lit(" \t\r\n"))
    last = F.substring_index(text, "\n", -1)
    is_block = last.contains("Steps: ") & (last.contains("Sampler: ") | last.contains("Seed: "))
    body = F.when(is_block, F.when(F.instr(text, "\n") == 0, "").otherwise(F.regexp_extract(text, r"(?s)^(.*)\n", 1))).otherwise(text)
    begins = r"(^|\n)Negative prompt:[ \t]*"
    parts = F.split(body, begins, 2)
    negative = F.trim(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), begins, "$1"), F.lit(" \t\r\n"))
    prompt = F.trim(F.get(parts, F.lit(0)), F.lit(" \t\r\n"))

    def pair(field: Column) -> Column:
        value = F.trim(F.regexp_extract(field, r"(?s)^[^:]*:(.*)$", 1))
        bare = F.when(value.rlike(r'(?s)^".*"$') & (F.length(value) > 1), F.replace(F.substring(value, F.lit(2), F.length(value) - 2), F.lit('\\"'), F.lit('"'))).otherwise(value)
        return F.struct(F.trim(F.substring_index(field, ":", 1)).alias("label"), bare.alias("value"))

    # A comma separates where an even number of quotes follows it.
    fields = F.filter(F.split(F.when(is_block, last).otherwise(""), ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: x.contains(":"))
    rows = df.select(F.col(id_col).alias("id"), prompt.alias("prompt"), negative.alias("negative"), F.transform(fields, pair).alias("pairs"))
    said = F.filter("pairs", lambda p, i: ~F.exists(F.slice("pairs", i + 2, F.size("pairs")), lambda q: q["label"] == p["label"]))
    tags = r"<lora:([^:>]+):([^>]+)>"
    weighted = F.zip_with(F.regexp_extract_all("prompt", F.lit(tags), F.lit(1)), F.regexp_extract_all("prompt", F.lit(tags), F.lit(2)), lambda n, w: F.struct(F.concat(F.lit("LoRA "), n).alias("label"), w.alias("value")))
    rows = rows.withColumn("said", said).withColumn("weighted", weighted)
    hashes = F.flatten(F.transform(F.filter("said", lambda p: p["label"] == "Lora hashes"), lambda p: F.split(p["value"], ",")))
    hashed = F.transform(hashes, lambda h: F.struct(F.concat(F.lit("LoRA "), F.trim(F.substring_index(h, ":", 1))).alias("label"), F.lit("?").alias("value")))
    unknown = F.filter(hashed, lambda h: ~F.exists("weighted", lambda w: w["label"] == h["label"]) & (h["label"] != "LoRA "))
    own = F.array(F.struct(F.lit("Prompt").alias("label"), F.col("prompt").alias("value")), F.struct(F.lit("Negative").alias("label"), F.col("negative").alias("value")))
    everything = F.concat(own, F.filter("said", lambda p: p["label"] != "Lora hashes"), "weighted", unknown)
    return rows.select("id", F.explode(F.filter(everything, lambda p: p["value"] != "")).alias("f")).select("id", "f.label", "f.value")
