"""Spreadsheet number formats as Column expressions (F-02 to F-06).

A format code is read once, on the driver, into sections of tokens; each becomes an expression, so rows are formatted
inside the JVM. Rounding is half away from zero on the decimal form of the number, and no zero is negative.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.numbers import from_serial

#: Languages that write a comma before decimals, and the space between groups of digits.
COMMA_LANGUAGES = ("ru", "de", "fr", "es", "it", "pt", "pl", "uk", "cs", "nl", "sv", "fi", "da", "nb", "tr")
GROUP = "\u202f"
MOST_DECIMALS = 30

TOKEN = re.compile(r'"([^"]*)"|\\(.)|_(.)|\*(.)|\[\$([^\]-]*)(?:-[^\]]*)?\]|\[(h+|m+|s+)\]|\[[^\]]*\]|([0#?][0#?,]*(?:\.[0#?]*)?|\.[0#?]+)(E[+-]0+)?|(/ *(?:\d+|[0#?]+))|(%)|(AM/PM|A/P)|([ymdhs]+)|(.)', re.I | re.S)


class Part(NamedTuple):
    """One part of a format code."""

    parts: list[tuple[str, str]]  # kind and text: literal, number, exponent, fraction, percent, date, elapsed
    bare: bool  # no placeholder at all: only its literals are shown

    def of(self, kind: str) -> list[str]:
        return [text for k, text in self.parts if k == kind]


def sections(code: str) -> list[str]:
    """A code cut at semicolons that stand outside quotes and after no backslash."""
    return re.findall(r'((?:"[^"]*"|\\.|[^;"\\])*)(?:;|$)', code)[: len(re.findall(r';(?=(?:[^"]*"[^"]*")*[^"]*$)', code)) + 1]


def parsed(code: str) -> Part:
    parts: list[tuple[str, str]] = []
    for m in TOKEN.finditer(code):
        quoted, escaped, blank, fill, money, elapsed, number, exponent, under, percent, half, date, other = m.groups()
        if number is not None:
            parts.append(("number", number))
            if exponent:
                parts.append(("exponent", exponent))
        elif under:
            parts.append(("fraction", under[1:].strip()))
        elif elapsed:
            parts.append(("elapsed", elapsed.lower()))
        elif date:
            parts.append(("date", date.lower()))
        elif percent:
            parts.append(("percent", "%"))
            parts.append(("literal", "%"))
        elif blank or half:
            parts.append(("literal", " " if blank else ""))
        else:
            parts.append(("literal", next((x for x in (quoted, escaped, money, other) if x is not None), "")))
    kinds = {k for k, _ in parts}
    return Part(parts, not kinds & {"number", "fraction", "date", "elapsed"})


def bare_number(value: Column, comma: bool = False) -> Column:
    """At most fifteen significant digits, whole numbers below 1e15 bare."""
    size = F.abs(value)
    places = F.lit(14) - F.floor(F.log10(F.when(size > 0, size).otherwise(1.0))).cast("int")
    # Fixed notation where it needs no exponent, else C's form of one.
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.15f", value), "0+$", ""), r"\.$", "")
    exact = F.round(value.cast("decimal(38,18)"), 15)
    short = F.element_at(F.array(*[F.round(exact, k).cast("string") for k in range(16)]), F.least(F.greatest(places, F.lit(0)), F.lit(15)) + 1)
    plain = F.when(F.instr(short, ".") > 0, F.regexp_replace(F.regexp_replace(short, "0+$", ""), r"\.$", "")).otherwise(short)
    power = F.regexp_replace(F.regexp_replace(F.format_string("%.14e", value), r"\.?0+e", "e"), r"e([+-])0?(\d{2,})$", "e$1$2")
    text = F.when(value == 0, "0").when((size >= 1e15) | (size < 1e-4), power).when(size >= 1e14, fixed).otherwise(plain)
    return F.replace(text, F.lit("."), F.lit(",")) if comma else text


def decimal_text(value: Column, decimals: int, least: int = 0, grouped: bool = False, comma: bool = False, whole_digits: int = 1) -> Column:
    """A number with ``least`` to ``decimals`` decimals, half away from zero, groups of three digits apart if asked for."""
    decimals = min(decimals, MOST_DECIMALS)
    rounded = F.round(F.abs(value).cast("string").cast("decimal(38,15)"), min(decimals, 15))
    text = rounded.cast("string")
    whole = F.substring_index(text, ".", 1)
    after = F.rpad(F.when(F.instr(text, ".") > 0, F.substring_index(text, ".", -1)).otherwise(""), decimals, "0") if decimals else F.lit("")
    if least < decimals:
        after = F.concat(F.substring(after, 1, least), F.regexp_replace(F.substring(after, least + 1, decimals), "0+$", ""))
    whole = F.when(whole == "0", "").otherwise(whole) if not whole_digits else F.when(F.length(whole) < whole_digits, F.lpad(whole, whole_digits, "0")).otherwise(whole)
    if grouped:
        whole = F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", GROUP)
    point = "," if comma else "."
    out = F.when(after == "", whole).otherwise(F.concat(whole, F.lit(point), after)) if decimals else whole
    return F.when((value < 0) & (rounded != 0), F.concat(F.lit("-"), out)).otherwise(out)


def fraction(value: Column, bounded: str) -> Column:
    """Whole part and nearest fraction, of a fixed denominator or of one of so many digits; walked down the tree of fractions."""
    size = F.abs(value)
    whole = F.floor(size)
    rest = size - whole
    if bounded.isdigit():
        top, under = F.round(size * int(bounded)), F.lit(int(bounded)).cast("double")
        return F.concat(F.when(value < 0, "-").otherwise(""), F.when(top == 0, "0").otherwise(F.concat(top.cast("long").cast("string"), F.lit("/"), under.cast("long").cast("string"))))
    most = 10 ** len(bounded) - 1
    nearest = F.array_min(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda q: F.struct(F.abs(rest - F.round(rest * q) / q).alias("off"), q.alias("q"), F.round(rest * q).cast("long").alias("p"))))
    carried = nearest["p"] == nearest["q"]
    whole = F.when(carried, whole + 1).otherwise(whole).cast("string")
    shown = F.when(carried | (nearest["p"] == 0), whole).when(whole == "0", F.concat(nearest["p"].cast("string"), F.lit("/"), nearest["q"].cast("string"))).otherwise(F.concat(whole, F.lit(" "), nearest["p"].cast("string"), F.lit("/"), nearest["q"].cast("string")))
    return F.concat(F.when((value < 0) & (shown != "0"), "-").otherwise(""), shown)


def _dated(value: Column, section: Part, date1904: bool) -> Column:
    """A date as year-month-day and a time as h:mm(:ss), whatever their order in the code; hours above a day where in brackets."""
    said = "".join(section.of("date"))
    seconds = F.round(value * 86400).cast("long")
    if section.of("elapsed"):
        clock = [F.floor(seconds / 3600).cast("string"), F.lpad((F.floor(seconds / 60) % 60).cast("string"), 2, "0"), F.lpad((seconds % 60).cast("string"), 2, "0")]
        unit = section.of("elapsed")[0][0]
        if unit == "m":
            clock = [F.floor(seconds / 60).cast("string"), clock[2]]
        elif unit == "s":
            clock = [seconds.cast("string")]
        elif "s" not in said:
            clock = clock[:2] if "m" in said else clock[:1]
        return F.concat_ws(":", *clock)
    at = from_serial(value + 1462 if date1904 else value)
    has_time = "h" in said or "s" in said
    has_date = "y" in said or "d" in said or ("m" in said and not has_time)
    shown = " ".join(["yyyy-MM-dd"] * has_date + ["HH:mm:ss" if "s" in said else "HH:mm"] * has_time)
    return F.date_format(at, shown)


def shown_by(section: Part, value: Column, comma: bool, date1904: bool) -> Column:
    """A value by one section, its sign included."""
    literal = lambda: F.lit("".join(section.of("literal")))
    if section.bare:
        return literal()
    if section.of("date") or section.of("elapsed"):
        return _dated(value, section, date1904)
    value = value * 100 ** len(section.of("percent")) if section.of("percent") else value
    out: list[Column] = []
    if section.of("fraction"):
        shown = fraction(value, section.of("fraction")[0])
        done = False
        for k, (kind, text) in enumerate(section.parts):
            if kind in ("number", "fraction"):
                out += [] if done else [shown]
                done = True
            elif kind == "literal" and not (text == " " and any(x == "fraction" for x, _ in section.parts[k:])):
                out.append(F.lit(text))
        return F.concat(*out)
    done = False
    for k, (kind, text) in enumerate(section.parts):
        if kind == "literal":
            out.append(F.lit(text))
        elif kind == "number" and not done:
            done = True
            whole, _, after = text.partition(".")
            thousands = len(whole) - len(whole.rstrip(","))
            scaled = value / 1000**thousands if thousands else value
            decimals, least, digits = len(after), after.count("0"), whole.count("0")
            if k + 1 < len(section.parts) and section.parts[k + 1][0] == "exponent":
                exponent = section.parts[k + 1][1]
                text_e = F.format_string(f"%.{decimals}e", scaled)
                power = F.substring_index(text_e, "e", -1).cast("int")
                sign = F.when(power < 0, "-").otherwise("+" if exponent[1] == "+" else "")
                mantissa = F.substring_index(text_e, "e", 1)
                out.append(F.concat(F.replace(mantissa, F.lit("."), F.lit("," if comma else ".")), F.lit("E"), sign, F.lpad(F.abs(power).cast("string"), max(1, exponent.count("0")), "0")))
            else:
                out.append(decimal_text(scaled, decimals, least, "," in whole.rstrip(","), comma, digits))
    signed = F.concat(*out)
    # The sign of a number stands before what precedes it.
    return F.when(signed.rlike("^[^0-9]+-[0-9]"), F.concat(F.lit("-"), F.regexp_replace(signed, "^([^0-9]*?)-(?=[0-9])", "$1"))).otherwise(signed) if section.parts and section.parts[0][0] == "literal" else signed


def formatted(value: Column, code: str, language: str = "en", date1904: bool = False) -> Column:
    """A number as a format code shows it: one section for all, or sections of positive, negative and zero numbers."""
    comma = language.split("-")[0].lower() in COMMA_LANGUAGES
    value = value.cast("double")
    if code.strip().lower() in ("general", "@", ""):
        return bare_number(value, comma)
    parts = [parsed(s) for s in sections(code)]
    by = [shown_by(p, value if k != 1 else F.abs(value), comma, date1904) for k, p in enumerate(parts[:3])]
    if len(by) == 1:
        return F.when(value.isNotNull(), by[0])
    out = F.when(value.isNull(), None).when(value < 0, by[1])
    return (out.when(value == 0, by[2]) if len(by) > 2 else out).otherwise(by[0])
