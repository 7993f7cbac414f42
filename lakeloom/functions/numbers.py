"""Sizes, spreadsheet numbers, dates and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separator of groups of digits in spreadsheet numbers: a narrow no-break space.
GROUP = "\u202f"


def _units(size: Column, names: list[str], step: int, plain: str) -> Column:
    out = F.concat(size.cast("long").cast("string"), F.lit(plain))
    for k, name in enumerate(names, 1):
        # One decimal by whole numbers, halves to the even digit.
        tenths, rest, unit = (size.cast("long") * 10 - F.pmod(size.cast("long") * 10, F.lit(step**k))) / step**k, F.pmod(size.cast("long") * 10, F.lit(step**k)), step**k
        tenths = tenths.cast("long") + F.when((rest * 2 > unit) | ((rest * 2 == unit) & (tenths.cast("long") % 2 == 1)), 1).otherwise(0)
        scaled = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
        out = F.when(size >= step**k, F.concat(scaled, F.lit(name))).otherwise(out)
    return out


def human_size(size: Column) -> Column:
    """Bytes as ``n B`` or one decimal of KB, MB, GB, TB (F-01)."""
    return _units(size, [" KB", " MB", " GB", " TB"], 1024, " B")


def human_size_short(size: Column) -> Column:
    """Bytes as a bare number or one decimal with K, M, G, T (F-01)."""
    return _units(size, ["K", "M", "G", "T"], 1024, "")


def human_size_decimal(size: Column) -> Column:
    """Bytes in powers of a thousand up to PB (F-01)."""
    return _units(size, [" kB", " MB", " GB", " TB", " PB"], 1000, " bytes")


def grouped(value: Column, decimals: int = 2, comma: bool = False) -> Column:
    """A number rounded half away from zero, digits in groups of three, no negative zero (F-02, F-04, F-21)."""
    rounded = F.round(value.cast("decimal(30,10)"), decimals)
    text = F.format_number(F.abs(rounded), decimals)
    whole = F.regexp_replace(F.substring_index(text, ".", 1), ",", GROUP)
    rest = F.concat(F.lit("," if comma else "."), F.substring_index(text, ".", -1)) if decimals else F.lit("")
    return F.concat(F.when(rounded < 0, "-").otherwise(""), whole, rest)


def percent(value: Column) -> Column:
    """``0%`` (F-02)."""
    return F.concat(F.round(value.cast("decimal(30,10)") * 100, 0).cast("decimal(30,0)").cast("string"), F.lit("%"))


def from_serial(serial: Column, date1904: bool = False) -> Column:
    """A spreadsheet's day number as a timestamp without zone; null outside 0 to 2958466 (F-06).

    Days under 60 count from 1899-12-31, as the calendar of these numbers has a 29th of February 1900.
    """
    days = F.floor(serial)
    ms = F.round((serial - days) * 86_400_000).cast("long")
    base = F.lit("1904-01-01") if date1904 else F.when(serial < 60, "1899-12-31").otherwise("1899-12-30")
    at = F.unix_millis(F.to_timestamp(base)) + days.cast("long") * 86_400_000 + ms
    return F.when((serial >= 0) & (serial <= 2_958_466), F.timestamp_millis(at).cast("timestamp_ntz"))


def column_letters(number: Column) -> Column:
    """A column's number from 1 as letters: 1 is A, 27 AA (F-07, F-13); up to seven letters."""
    rest, out = number.cast("long"), F.lit("")
    for _ in range(7):
        out = F.when(rest > 0, F.concat(F.char(F.pmod(rest - 1, F.lit(26)) + 65), out)).otherwise(out)
        rest = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(0)
    return out


def column_index(reference: Column) -> Column:
    """The column of a cell reference such as AB12, from 0 (F-07)."""
    letters = F.split(F.upper(F.regexp_extract(reference, "^([A-Za-z]+)", 1)), "")
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


def row_index(reference: Column) -> Column:
    """The row of a cell reference, from 0 (F-07)."""
    return F.regexp_extract(reference, "([0-9]+)$", 1).cast("long") - 1


def roman(number: Column) -> Column:
    """Capital Roman numerals from 1 to 3999, else the number itself (F-13)."""
    digits = [("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "M", "MM", "MMM", "", "", "", "", "", "")]
    n = number.cast("int")
    parts = [F.element_at(F.array(*map(F.lit, d)), (F.floor(n / 10**k) % 10).cast("int") + 1) for k, d in enumerate(digits)]
    return F.when(n.between(1, 3999), F.concat(*reversed(parts))).otherwise(number.cast("string"))


def mode_bits(mode: Column) -> Column:
    """Permission bits as ``rwxr-xr-x`` (F-11)."""
    return F.concat(*[F.when(mode.bitwiseAND(F.lit(1 << (8 - k))) != 0, "rwx"[k % 3]).otherwise("-") for k in range(9)])


def ratio_percent(packed: Column, size: Column) -> Column:
    """Packed over size in whole percent, rounded half to even; empty for size 0 (F-12)."""
    return F.when(size > 0, F.concat(F.bround(packed.cast("decimal(30,6)") * 100 / size, 0).cast("long").cast("string"), F.lit("%"))).otherwise("")


def clock_minutes(seconds: Column) -> Column:
    """``m:ss`` with unbounded minutes, empty at zero and below (F-16)."""
    s = seconds.cast("long")
    return F.when(s > 0, F.format_string("%d:%02d", F.floor(s / 60), s % 60)).otherwise("")


def clock_hours(seconds: Column) -> Column:
    """Rounded seconds as ``m:ss`` or ``h:mm:ss``, empty at zero and below (F-16)."""
    s = F.bround(seconds, 0).cast("long")
    with_hours = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return F.when(s <= 0, "").when(s >= 3600, with_hours).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def shutter(seconds: Column) -> Column:
    """An exposure time as ``1/n s`` below a second, else ``n s`` (F-17)."""
    return F.when(seconds <= 0, "").when(seconds < 1, F.concat(F.lit("1/"), F.bround(1 / seconds, 0).cast("long").cast("string"), F.lit(" s"))).otherwise(F.concat(F.regexp_replace(F.format_string("%.1f", seconds), r"\.0$", ""), F.lit(" s")))


def degrees(d: Column, m: Column, s: Column, reference: Column) -> Column:
    """Degrees, minutes and seconds as a decimal, south and west negative, six places (F-18)."""
    return F.round((d + m / 60 + s / 3600) * F.when(F.upper(reference).isin("S", "W"), -1).otherwise(1), 6)


def megapixels(width: Column, height: Column) -> Column:
    return F.round(width.cast("double") * height / 1e6, 1)


def ago(seconds: Column) -> Column:
    """Just now to 90 s, minutes to 5400 s, hours beyond (F-22)."""
    return F.when(seconds < 90, "just now").when(seconds < 5400, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" minutes ago"))).otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" hours ago")))


def srgb(v: Column) -> Column:
    """Linear light as an sRGB value, both 0 to 1 (F-23)."""
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    """Components of 0 to 1 as ``#rrggbb`` (F-45)."""
    byte = lambda v: F.lpad(F.lower(F.hex(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) * 255, 0).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), byte(r), byte(g), byte(b))


def blend(a: Column, b: Column, mode: str) -> Column:
    """Blend modes over whole numbers of 0 to 255 (F-24)."""
    if mode == "multiply":
        return F.floor(a * b / 255)
    if mode == "screen":
        return 255 - F.floor((255 - a) * (255 - b) / 255)
    if mode == "overlay":
        return F.when(a < 128, F.floor(2 * a * b / 255)).otherwise(255 - F.floor(2 * (255 - a) * (255 - b) / 255))
    if mode == "difference":
        return F.abs(a - b)
    raise ValueError(f"unknown mode {mode}")


def synchsafe(b0: Column, b1: Column, b2: Column, b3: Column) -> Column:
    """Four bytes of seven bits each as a number (F-27)."""
    return F.shiftleft(b0, 21).bitwiseOR(F.shiftleft(b1, 14)).bitwiseOR(F.shiftleft(b2, 7)).bitwiseOR(b3)


def rk(value: Column) -> Column:
    """A packed number of whole form: the low bits tell whether it is whole and in hundredths (F-08)."""
    whole = F.shiftright(value, 2).cast("double")
    return F.when(value.bitwiseAND(F.lit(1)) != 0, whole / 100).otherwise(whole)


def filmic(value: Column) -> Column:
    """A film-like shoulder for bright light (F-23)."""
    v = value * 0.6
    return (v * (2.51 * v + 0.03)) / (v * (2.43 * v + 0.59) + 0.14)


def displayed(value: Column, exposure: float = 0.0, film: bool = False) -> Column:
    """Light as 0 to 255: exposure in stops, the view, the display's curve; nothing and less is 0, no number too (F-23)."""
    lit = value * 2.0**exposure
    lit = filmic(lit) if film else lit
    dark = value.isNull() | F.isnan(value) | (value <= 0)
    return F.when(dark, 0).when((value == float("inf")) | (lit >= 1), 255).otherwise(F.floor(srgb(lit) * 255 + 0.5)).cast("int")


def extended(data: Column) -> Column:
    """The number in ten bytes of extended precision; 0 where they are too few or no finite number (F-27)."""
    part = lambda at, n: F.conv(F.hex(F.substring(data, at, n)), 16, 10).cast("double")
    head = part(1, 2)
    exponent = head % 32768
    mantissa = part(3, 4) * 4294967296.0 + part(7, 4)
    sign = F.when(head >= 32768, -1.0).otherwise(1.0)
    return F.when((F.octet_length(data) < 10) | (exponent == 32767) | ((exponent == 0) & (mantissa == 0)), 0.0).otherwise(sign * mantissa * F.pow(F.lit(2.0), exponent - 16446))


def read_cost(height: Column, lines: Column, step: Column, values_per_line: Column, rate: Column) -> Column:
    """Cost of reading every ``step``-th line of a picture in blocks of ``lines``: a block with one such line is decoded whole (A-23)."""
    kept = F.when(step <= lines, F.ceil(height / lines)).otherwise(F.ceil(height / step))
    return (kept * lines * values_per_line * rate).cast("double")
