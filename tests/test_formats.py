"""Number formats by known results, and readers of databases and delimited files on damaged and cut input."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import formatcodes as fc
from lakeloom.operators import codepages
from lakeloom.sources import databases, delimited, registry, sheets

N = " "
SHOWN = [
    ("General", 0.1 + 0.2, "en", "0.3"), ("General", -3.5, "ru", "-3,5"), ("General", 1e15, "en", "1e+15"), ("General", 123456789012345.0, "en", "123456789012345"), ("General", 0.00001, "en", "1e-05"),
    ("0.00", 2.675, "en", "2.68"), ('"Total: "0.0', 3.25, "en", "Total: 3.3"), ("#,##0.00", 1234567.891, "ru", f"1{N}234{N}567,89"), ('#,##0.00 "₽"', 1500, "ru", f"1{N}500,00 ₽"), ("[$€-407] #,##0.00", 12.5, "de", "€ 12,50"),
    ("0%", 0.256, "en", "26%"), ("dd.mm.yyyy", 46266, "ru", "2026-09-01"), ("yyyy-mm-dd h:mm", 46266.5, "en", "2026-09-01 12:00"), ("h:mm", 0.75, "en", "18:00"), ("[h]:mm:ss", 1.5, "en", "36:00:00"), ("mmm-yy", 46266, "en", "2026-09-01"),
    ("yyyy-mm-dd", 1, "en", "1900-01-01"), ("yyyy-mm-dd", 61, "en", "1900-03-01"), ("#,##0;(#,##0)", -1234, "en", f"(1{N}234)"), ('0.00;-0.00;"—"', 0, "en", "—"), ('0.00 "₽";-0.00 "₽"', -12, "ru", "-12,00 ₽"),
    ("# ?/?", 1.75, "en", "1 3/4"), ("# ??/??", 3.14159, "en", "3 14/99"), ("?/16", 0.3, "en", "5/16"), ("0.00E+00", 12345.0, "en", "1.23E+04"), ("0.##", 2.5, "en", "2.5"), ("0.00", -0.001, "en", "0.00"), ("000", 7, "en", "007"), ("#,##0,", 1234567.0, "en", f"1{N}235"),
]


def test_format_codes(spark):
    row = spark.range(1).select(*[fc.formatted(F.lit(float(v)), code, language).alias(f"c{i}") for i, (code, v, language, _) in enumerate(SHOWN)]).first()
    assert [(s[0], row[i]) for i, s in enumerate(SHOWN)] == [(s[0], s[3]) for s in SHOWN]
    assert spark.range(1).select(fc.formatted(F.lit(0.0), "yyyy-mm-dd", date1904=True)).first()[0] == "1904-01-01"
    assert spark.range(1).select(fc.formatted(F.lit(None).cast("double"), "0.0")).first()[0] is None


def test_databases(spark, tmp_path):
    with pytest.raises(ValueError, match="not a database"):
        databases.objects(b"")
    con = sqlite3.connect(tmp_path / "wal.db")
    con.executescript('PRAGMA journal_mode = WAL; CREATE TABLE "a""b" (x, y); INSERT INTO "a""b" VALUES (1.5, NULL), (\'t\', x\'00\'); PRAGMA wal_checkpoint(TRUNCATE);')
    con.close()
    data = (tmp_path / "wal.db").read_bytes()
    assert databases.objects(data) == [('a"b', "table", 0)]
    assert databases.page_reader('a"b', 5)(data) == [(0, 0, "real", "1.5"), (0, 1, "null", None), (1, 0, "text", "t"), (1, 1, "blob", "binary · 1 B")]
    facts = spark.createDataFrame([(bytearray(data),), (bytearray(b"short"),)], "d binary").select(databases.facts_of_header(F.col("d")).alias("f")).collect()
    assert facts[0]["f"]["wal"] is True and facts[0]["f"]["page_size"] * facts[0]["f"]["pages"] == len(data) and facts[1]["f"] is None


def test_delimited():
    assert [delimited.sniffed(t) for t in ("a,b\n1,2", "a;b,c\n1;2", "x\ty\n1\t2", "plain", "", '"a;b",c\n1,2')] == [",", ";", "\t", ",", ",", ","]
    rows = delimited.reader()("﻿k;v\r\n1;\"x\ny\"\r\n\r\n2;z;extra".encode())
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [(0, 0, "k", "1"), (0, 1, "v", "x\ny"), (1, 0, "k", "2"), (1, 1, "v", "z"), (1, 2, "3", "extra")]
    many = delimited.reader(",")(("h\n" + "1\n" * (delimited.MOST_ROWS + 1)).encode())
    assert len(many) == delimited.MOST_ROWS and all(r[4] for r in many)
    with pytest.raises(ValueError, match="binary"):
        delimited.reader()(b"\x01" * 20 + b"\0")
    assert [r[:4] for r in delimited.json_cells(b'[{"a": 1}, {"b": [2], "a": null}, [3], "x"]')] == [(0, 0, "a", "1"), (1, 1, "b", "[2]"), (1, 0, "a", None), (2, 2, "1", "3"), (3, 3, "value", "x")]
    with pytest.raises(ValueError, match="no array"):
        delimited.json_cells(b"{}")


def test_code_pages():
    name = "Отчёт за август.txt"
    for page in ("cp866", "cp1251", "utf-8"):
        raw = name.encode(page)
        assert codepages.best_reading(raw, raw.decode("cp437")) == name
        assert codepages.member_name(raw.decode("cp437"), False) == name
    raw = "Отчёт.txt".encode("cp866")
    assert codepages.best_reading(raw, raw.decode("cp437"), "cp1251") == raw.decode("cp1251")
    assert codepages.best_reading(b"\xff\xfe", "as it is", "utf-8") == "as it is"
    assert codepages.member_name("notes.txt", False) == "notes.txt" and codepages.member_name("Отчёт", True) == "Отчёт"
    assert codepages.declared_text('<meta charset="koi8-r">ё'.encode("koi8-r")).endswith("ё")
    assert codepages.declared_text("\ufeffё".encode("utf-16")).endswith("ё") and codepages.declared_text("ё".encode("cp1251")) == "ё" and codepages.declared_text(b"charset=nobody x") == "charset=nobody x"
    assert codepages.playlist_text("ё".encode("cp1251")) == "ё" and codepages.playlist_text(b"") == "" and codepages.playlist_text(b"\xff", utf8=True) == "\ufffd"


def test_registry(spark):
    own = registry.entries_of('[{"name": "tabs", "suffixes": ["txt"], "priority": 3}, {"name": "json", "heads": ["5b"], "priority": 3}]')
    files = spark.createDataFrame([("a.txt", bytearray(b"x")), ("b.txt", bytearray(b"[1]")), ("c", None)], "path string, content binary")
    got = {r[0]: r[1] for r in files.select("path", registry.reader_of(F.col("path"), F.col("content"), own)).collect()}
    assert got == {"a.txt": "tabs", "b.txt": "json", "c": None}
    assert [r["value"] for r in registry.read(files, "json", own).collect()] == ["1"]
    with pytest.raises(ValueError, match="unknown readers"):
        registry.entries_of('[{"name": "nobody"}]')
    schema = {"hidden": registry.Setting("boolean", False), "rings": registry.Setting("integer", 3, 1, 6), "by": registry.Setting("choice", "size", choices=("size", "name")), "title": registry.Setting("text", "all")}
    assert registry.settled(schema, {}) == {"hidden": False, "rings": 3, "by": "size", "title": "all"}
    assert registry.settled(schema, {"hidden": True, "rings": "9", "by": "age", "title": ""}) == {"hidden": True, "rings": 6, "by": "size", "title": "all"}
    with pytest.raises(KeyError):
        registry.settled(schema, {"other": 1})


def test_wide_repeats():
    import io
    import zipfile

    def sheet(times):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("content.xml", f'<o:d xmlns:o="o" xmlns:t="t" xmlns:x="x"><t:table t:name="T"><t:table-row><t:table-cell t:number-columns-repeated="{times}"><x:p>r</x:p></t:table-cell></t:table-row></t:table></o:d>')
        return list(sheets.ods(out.getvalue()))

    assert len(sheet(3000)) == 3000
    with pytest.raises(ValueError, match="columns"):
        sheet(1_000_000)
