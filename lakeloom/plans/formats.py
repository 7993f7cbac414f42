"""Readers of formats over files made here, whose rows are known."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import zipfile
import zlib

from pyspark.sql import functions as F

from lakeloom.plans.registry import query
from lakeloom.sources import archives, binary, documents, listings, media, sheets, workflows


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def _read(spark, files: dict[str, bytes], reader, schema: str):
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    return binary.rows_of(rows, reader, schema)


@query("SELECT * FROM (VALUES ('a.zip', 'x/y.txt', 5, false), ('a.zip', '../bad', 1, true), ('b.tgz', 'd/e.txt', 3, false), ('junk', NULL, NULL, NULL)) v(path, name, size, refused)")
def archive_members(spark, d):
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("./d/e.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    files = {"a.zip": _zip({"x/y.txt": "hello", "../bad": "x"}), "b.tgz": tar.getvalue(), "junk": b"nothing"}
    return _read(spark, files, archives.members, archives.MEMBERS).select("path", "name", "size", "refused")


def _workbooks() -> dict[str, bytes]:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    xlsx = _zip({
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>word</t><rPh><t>no</t></rPh></si></sst>",
        "xl/worksheets/s.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
    })
    ods = _zip({"content.xml": '<o:d xmlns:o="o" xmlns:t="t" xmlns:x="x"><t:table t:name="T"><t:table-row><t:table-cell t:number-columns-repeated="2"><x:p>r</x:p></t:table-cell><t:table-cell o:value-type="float" o:value="7"><x:p>7,0</x:p></t:table-cell><t:table-cell t:number-columns-repeated="16000"/></t:table-row></t:table></o:d>'})
    xml = b'<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet ss:Name="W"><Table><Row ss:Index="2"><Cell ss:MergeAcross="1"><Data ss:Type="String">a</Data></Cell><Cell><Data ss:Type="Number">1</Data></Cell></Row></Table></Worksheet></Workbook>'
    html = b"<html><table><tr><th colspan=2>h</th><td>i</td></tr><tr><td>j<table><tr><td>inner</td></tr></table></td></tr></table></html>"
    return {"b.xlsx": xlsx, "b.ods": ods, "b.xml": xml, "b.html": html}


@query("SELECT * FROM (VALUES ('b.xlsx', 'S', 0, 0, 'text', 'word'), ('b.xlsx', 'S', 0, 2, 'number', '2.5'), ('b.xlsx', 'S', 2, 1, 'text', 'in'), ('b.ods', 'T', 0, 0, 'text', 'r'), ('b.ods', 'T', 0, 1, 'text', 'r'), ('b.ods', 'T', 0, 2, 'number', '7'), ('b.xml', 'W', 1, 0, 'text', 'a'), ('b.xml', 'W', 1, 2, 'number', '1'), ('b.html', 'Table 1', 0, 0, 'text', 'h'), ('b.html', 'Table 1', 0, 2, 'text', 'i'), ('b.html', 'Table 1', 1, 0, 'text', 'jinner')) v(path, sheet, row, col, kind, value)")
def workbook_cells(spark, d):
    return _read(spark, _workbooks(), sheets.cells, sheets.CELLS).drop("failure")


@query("SELECT * FROM (VALUES ('d.docx', 0, 'heading', 1, 'Top'), ('d.docx', 1, 'paragraph', 0, 'kept'), ('d.docx', 2, 'item', 2, 'point'), ('d.odt', 0, 'heading', 2, 'H'), ('d.odt', 1, 'item', 1, 'i'), ('d.fb2', 0, 'heading', 2, 'T'), ('d.fb2', 1, 'paragraph', 0, 'p'), ('d.epub', 0, 'heading', 1, 'E'), ('d.epub', 1, 'paragraph', 0, 'q'), ('d.rtf', 0, 'paragraph', 0, 'né'), ('d.rtf', 1, 'paragraph', 0, 'b€')) v(path, seq, kind, level, text)")
def document_blocks(spark, d):
    w = 'xmlns:w="w"'
    docx = _zip({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t>kept</w:t></w:r></w:ins></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>point</w:t></w:r></w:p></w:body></w:document>'})
    odt = _zip({"content.xml": '<o:d xmlns:o="o" xmlns:x="x"><o:text><x:h x:outline-level="2">H</x:h><x:list><x:list-item><x:p>i</x:p></x:list-item></x:list></o:text></o:d>'})
    fb2 = b"<FictionBook><body><section><title><p>T</p></title><p>p</p></section></body></FictionBook>"
    epub = _zip({"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><item id="a" href="a.html"/><itemref idref="a"/></p>', "o/a.html": "<h1>E</h1><p>q</p>"})
    rtf = rb"{\rtf1{\fonttbl hidden}n\'e9\par b\u8364 ?}"
    return _read(spark, {"d.docx": docx, "d.odt": odt, "d.fb2": fb2, "d.epub": epub, "d.rtf": rtf}, documents.blocks, documents.BLOCKS).drop("failure")


@query("SELECT * FROM (VALUES ('api', 'api', 'link', 1), ('api', 'api', 'lost', 1), ('api', 'api', 'node', 2), ('godot', 'godot', 'link', 2), ('godot', 'godot', 'node', 3), ('godot', 'godot', 'signal', 1), ('lite', 'litegraph', 'link', 2), ('lite', 'litegraph', 'node', 2), ('n8n', 'n8n', 'link', 1), ('n8n', 'n8n', 'lost', 1), ('n8n', 'n8n', 'node', 2), ('n8n', 'n8n', 'note', 1), ('red', 'node-red', 'jump', 1), ('red', 'node-red', 'link', 1), ('red', 'node-red', 'node', 3), ('red', 'node-red', 'note', 1), ('red', 'node-red', 'tab', 2)) v(path, format, item, n)")
def workflow_items(spark, d):
    lite = {"nodes": [{"id": 1, "type": "A", "outputs": [{"name": "o"}]}, {"id": 2, "type": "B", "inputs": [{"name": "i"}]}], "links": [[1, 1, 0, 2, 0, "T"], [2, 1, 0, 9, 0, "T"]]}
    api = {"1": {"class_type": "A", "inputs": {}}, "2": {"class_type": "B", "inputs": {"x": ["1", 0], "y": ["9", 0], "z": [1.5, 2]}}}
    n8n = {"nodes": [{"id": "i", "name": "a", "type": "t"}, {"id": "j", "name": "b", "type": "t"}, {"id": "k", "name": "s", "type": "n.stickyNote"}], "connections": {"a": {"main": [[{"node": "b", "index": 0}, {"node": "zz"}]]}}}
    red = [{"id": "t", "type": "tab"}, {"id": "u", "type": "tab"}, {"id": "1", "type": "f", "z": "t", "wires": [["2", "3"]]}, {"id": "2", "type": "f", "z": "t", "wires": []}, {"id": "3", "type": "f", "z": "u", "wires": []}, {"id": "c", "type": "comment", "z": "t"}]
    godot = '[gd_scene]\n[node name="R" type="Node"]\n[node name="a" parent="."]\n[node name="b" parent="a"]\n[connection signal="s" from="a" to="." method="m"]\n'
    files = {"lite": lite, "api": api, "n8n": n8n, "red": red}
    data = {k: json.dumps(v).encode() for k, v in files.items()} | {"godot": godot.encode(), "plain": b'{"a": 1}'}
    return _read(spark, data, workflows.items, workflows.ITEMS).groupBy("path", "format", "item").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('p.png', 'picture', 'Size', '3×2'), ('p.png', 'text', 'parameters', 'x'), ('p.png', 'exif', 'Make', 'Cam'), ('s.mp3', 'tags', 'Title', 'T'), ('s.flac', 'sound', 'Channels', 'stereo'), ('s.flac', 'sound', 'Seconds', '2.000'), ('s.flac', 'tags', 'Artist', 'A'), ('s.wav', 'sound', 'Seconds', '0.500')) v(path, grp, label, value)")
def media_facts(spark, d):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    tiff = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHI", 0x010F, 2, 4) + b"Cam\0" + struct.pack("<I", 0)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"parameters\0x") + chunk(b"eXIf", tiff) + chunk(b"IEND", b"")
    frame = b"TIT2" + struct.pack(">I", 2) + b"\0\0" + b"\0T"
    mp3 = b"ID3\x03\0\0" + bytes([0, 0, 0, len(frame)]) + frame
    info = bytes(10) + ((44100 << 44) | (1 << 41) | (15 << 36) | 88200).to_bytes(8) + bytes(16)
    field = b"ARTIST=A"
    vorbis = struct.pack("<I", 0) + struct.pack("<I", 1) + struct.pack("<I", len(field)) + field
    flac = b"fLaC" + b"\0" + len(info).to_bytes(3) + info + b"\x84" + len(vorbis).to_bytes(3) + vorbis
    wav = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 4000) + bytes(4000)
    return _read(spark, {"p.png": png, "s.mp3": mp3, "s.flac": flac, "s.wav": wav}, media.facts, media.FACTS).drop("failure")


@query("SELECT * FROM (VALUES ('-rw-r--r--', 12, 'a b.txt', NULL, DATE '2025-12-30'), ('lrwxrwxrwx', 3, 'l', 'to', DATE '2026-01-02'), ('drwxr-xr-x', 0, 'd', NULL, DATE '2019-03-04')) v(mode, size, name, target, day)")
def ftp_lines(spark, d):
    lines = ["-rw-r--r-- 1 u g 12 Dec 30 10:20 a b.txt", "lrwxrwxrwx 1 u g 3 Jan  2 00:00 l -> to", "drwxr-xr-x 2 u g 0 Mar 4 2019 d", "total 8"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    return rows.select(listings.unix_list_line(F.col("line"), F.lit("2026-01-05").cast("date")).alias("e")).where("e IS NOT NULL").select("e.*")


@query("SELECT * FROM (VALUES ('abcdef1234', 'abcdef1', 'Ann', TIMESTAMP '2024-01-01 00:00:00', ['p1', 'p2'], 'fix'), ('0123456789', '0123456', 'Bob', TIMESTAMP '2023-12-31 23:59:59', []::VARCHAR[], 'first')) v(hash, short, author, \"when\", parents, subject)")
def commit_log(spark, d):
    log = "abcdef1234\u001fAnn\u001f1704067200\u001fp1 p2\u001ffix\u001e\n0123456789\u001fBob\u001f1704067199\u001f\u001ffirst\u001e\n"
    return listings.commits(spark.createDataFrame([(log,)], "text string"))


@query("SELECT * FROM (VALUES (1, 'One', 5, 'a.mp3'), (2, '', 0, 'b.mp3')) v(ord, title, seconds, target)")
def keyed_playlist(spark, d):
    text = "[playlist]\nFile7=b.mp3\nLength7=-1\nFile1=a.mp3\nTitle1=One\nLength1=5\nTitle9=none\n"
    return listings.keyed_playlist(spark.createDataFrame([(text,)], "text string"))


@query("SELECT * FROM (VALUES ('a,b\n1,2', ',', 'python'), ('a;b,c\n1;2', ';', 'sql'), ('x\ty\n1\t2', chr(9), NULL)) v(sample, sep, lang)")
def sniffed(spark, d):
    rows = spark.createDataFrame([("a,b\n1,2", "x.py"), ("a;b,c\n1;2", "y.SQL"), ("x\ty\n1\t2", "z")], "sample string, path string")
    return rows.select("sample", listings.delimiter(F.col("sample")).alias("sep"), listings.language(F.col("path")).alias("lang"))
