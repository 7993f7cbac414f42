"""Golden vectors of the column functions and the sequential text operators."""

from __future__ import annotations

import datetime
import random
import time

from pyspark.sql import functions as F

from lakeloom.functions import numbers as nm, text as tx
from lakeloom.operators import duplicates, pagelayout, pytext, ranges, reconcile, trees, webpages


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_numbers(spark):
    lit = F.lit
    assert one(spark, nm.grouped(lit(1234567.891), comma=True)) == "1\u202f234\u202f567,89"
    assert one(spark, nm.grouped(lit(-0.001))) == "0.00"
    assert one(spark, nm.grouped(lit(2.675))) == "2.68"
    assert one(spark, nm.percent(lit(0.256))) == "26%"
    assert one(spark, nm.from_serial(lit(46266.5))) == datetime.datetime(2026, 9, 1, 12)
    assert one(spark, nm.from_serial(lit(1.0))) == datetime.datetime(1900, 1, 1)
    assert one(spark, nm.from_serial(lit(61.0))) == datetime.datetime(1900, 3, 1)
    assert one(spark, nm.from_serial(lit(0.0), True)) == datetime.datetime(1904, 1, 1)
    assert one(spark, nm.from_serial(lit(-1.0))) is None
    assert one(spark, nm.rk(lit((1234 << 2) | 2))) == 1234
    assert one(spark, nm.rk(lit((1234 << 2) | 3))) == 12.34
    assert one(spark, nm.column_index(lit("AB12"))) == 27
    assert one(spark, nm.row_index(lit("AB12"))) == 11
    assert one(spark, nm.human_size(lit(1536))) == "1.5 KB"
    assert one(spark, nm.clock_hours(lit(3661.4))) == "1:01:01"
    assert one(spark, nm.synchsafe(lit(0), lit(0), lit(2), lit(1))) == 257
    assert one(spark, nm.hex_colour(lit(1.0), lit(0.5), lit(0.0))) == "#ff8000"


def test_text(spark):
    assert one(spark, tx.fence(F.lit("a ```` b"))) == "`````"
    assert one(spark, tx.dehyphenated(F.lit("exam-\nple of A-\nB"))) == "example of A-B"
    assert one(spark, tx.is_binary(F.lit(b"ab\x00c"))) is True
    assert one(spark, tx.is_binary(F.lit(b"\x10\x0a"))) is False
    assert one(spark, tx.first_line(F.lit("\n  \n x \ny"))) == "x"


def test_python_text():
    assert pytext.text_of("né\r\n".encode("utf-16-le")) == "né\n"
    assert pytext.text_of("\ufeffné\r".encode("utf-16-be")) == "né\n"
    assert pytext.text_of(b"\r\n" + "né".encode("utf-16-le")) == "\nné"
    assert pytext.text_of(b"\x01" * 9 + b"\x00") is None
    assert pytext.text_of(b"ab\x00\x00cd\x00\x00") == "abcd"
    assert pytext.text_of("\ufeffé".encode()) == "é" and pytext.text_of(b"") == "" and pytext.text_of(None) is None
    assert pytext.paragraphs_of("a line that is long enough to go\non here.\nNew") == ["a line that is long enough to go on here.", "New"]
    assert webpages.markdown_of("<title>t</title><h1>A</h1><ul><li>x<li>y</ul><p><a href='https://e/'>z</a>") == "# A\n\n- x\n\n- y\n\n[z](https://e/)"


def test_recipes(spark):
    text = 'a <lora:x:0.5>\nNegative prompt: b\nSteps: 2, Seed: 3, Model: "p, q", Lora hashes: "x: 1, y: 2"'
    df = spark.createDataFrame([(1, text), (2, "only a prompt\nof two lines"), (3, None), (4, "Steps: 1, Seed: 2")], "id bigint, text string")
    got = {(r["id"], r["label"]): r["value"] for r in pytext.recipes(df, "id", "text").collect()}
    assert got == {
        (1, "Prompt"): "a <lora:x:0.5>", (1, "Negative"): "b", (1, "Steps"): "2", (1, "Seed"): "3", (1, "Model"): "p, q", (1, "LoRA x"): "0.5", (1, "LoRA y"): "?",
        (2, "Prompt"): "only a prompt\nof two lines", (4, "Steps"): "1", (4, "Seed"): "2",
    }


def test_links(spark):
    html = """<base href="/b/c"><a href="x?q#f">1</a><img srcset="p.png 1x, ../q.png 2x" data-src="//cdn.example/r.png"><link imagesrcset="s.png 3x"><a href="mailto:a@b">m</a>
      <style>i{background:url('t.png')}</style><script>var a = "url(no.png)"</script><a href="https://h.example/a/">self</a><a href="x?q">again</a><form action="no"></form><object data="./u/../v.pdf">"""
    df = spark.createDataFrame([(1, "https://h.example/a/", html), (2, None, None)], "page_id bigint, url string, html string")
    got = [(r["seq"], r["tag"], r["target"], r["same_host"]) for r in webpages.links(df).orderBy("seq").collect()]
    assert got == [
        (0, "a", "https://h.example/b/x?q", True), (1, "img", "https://h.example/b/p.png", True), (2, "img", "https://h.example/q.png", True), (3, "img", "https://cdn.example/r.png", False),
        (4, "link", "https://h.example/b/s.png", True), (5, "style", "https://h.example/b/t.png", True), (6, "a", "https://h.example/a/", True), (7, "object", "https://h.example/b/v.pdf", True),
    ]
    names = [(r["name"], r["is_page"]) for r in webpages.resources(webpages.links(df)).orderBy("seq").collect()]
    assert names[:4] == [("x?q", True), ("p.png", False), ("q.png", False), ("cdn.example · r.png", False)]


def test_url_resolution(spark):
    """The examples of RFC 3986, section 5.4, fragments aside."""
    from lakeloom.functions import urls

    base = "http://a/b/c/d;p?q"
    want = {
        "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q", ";x": "http://a/b/c/;x",
        "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
        "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/../h": "http://a/b/c/h", "g?y/../x": "http://a/b/c/g?y/../x",
    }
    got = {r["ref"]: r["out"] for r in spark.createDataFrame([(r,) for r in want], "ref string").select("ref", urls.joined(F.lit(base), F.col("ref")).alias("out")).collect()}
    assert got == want


def test_duplicates_edges(spark):
    rows = [("a", "x" * 1023), ("b", "x" * 1023), ("c", "y" * 1024), ("d", "y" * 1024), ("e", "z" * 65536 + "1"), ("f", "z" * 65536 + "2"), ("g", None)]
    got = duplicates.duplicate_sets(spark.createDataFrame(rows, "path string, text string"), "path", "text").collect()
    assert [(r["first_path"], r["size"], r["copies"], r["wasted"]) for r in got] == [("c", 1024, 2, 1024)]


def test_reconcile_edges(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    schema = "path string, size bigint, modified timestamp_ntz"
    left = spark.createDataFrame([("same", 1, at(0)), ("slack", 1, at(0)), ("late", 1, at(0)), ("size", 1, at(0)), ("left", 1, None)], schema)
    right = spark.createDataFrame([("same", 1, at(0)), ("slack", 1, at(2)), ("late", 1, at(3)), ("size", 2, at(0)), ("right", 1, None)], schema)
    got = {r["path"]: r["state"] for r in reconcile.reconcile(left, right, hide_equal=False).collect()}
    assert got == {"same": "=", "slack": "=", "late": "≠", "size": "≠", "left": "<", "right": ">"}


def test_trees_edges(spark):
    nodes = trees.rollup(spark.createDataFrame([("a/x", 5), ("a/y", 0), ("b/z", 3)], "path string, size bigint"))
    got = {r["node"]: (r["size"], r["files"]) for r in nodes.collect()}
    assert got[""] == (8, 3) and got["a"] == (5, 2) and got["a/y"] == (0, 1)
    assert all(not r["is_rest"] and r["size"] > 0 for r in trees.top_rest(nodes).collect())
    assert [r["path"] for r in trees.topmost(spark.createDataFrame([("a",), ("a/b",), ("c/d",)], "path string")).orderBy("path").collect()] == ["a", "c/d"]


def test_merge_near(spark):
    assert one(spark, ranges.merge_near(F.array(*map(F.lit, (1.0, 1.5, 2.1, 3.2))), 1.0)) == [1.0, 2.1, 3.2]


def test_generations(spark):
    from lakeloom.operators import generations as g

    assert [g.as_said(v) for v in (None, True, 1.5, 2.0, {"a": 1}, " x ")] == ["", "yes", "1.5", "2", '{"a": 1}', "x"]
    loop = '{"1": {"class_type": "KSampler", "inputs": {"positive": ["2", 0]}}, "2": {"class_type": "TextEncode", "inputs": {"text": ["2", 0], "conditioning": ["2", 0]}}}'
    assert g.fields_of_graph(loop) == [("Nodes", "2")] and g.fields_of_graph("{") == [] and g.fields_of_graph("{}") == []
    rows = [
        (1, {"sd-metadata": '{"model_weights": "w", "image": {"prompt": "old", "seed": 3}}'}), (2, {"parameters": '{"sui_image_params": {"prompt": "swarm", "steps": 4}}'}), (3, {"parameters": '{"prompt": "f"}', "fooocus_scheme": "x"}),
        (4, {"parameters": '{"nothing": 1}'}), (5, {"Comment": "plain words"}), (6, None), (7, {"invokeai_metadata": "broken {", "Description": "a cat --v 6 --tile"}),
    ]
    got = {(r["id"], r["tool"], r["label"]): r["value"] for r in g.recognised(spark.createDataFrame(rows, "id int, carried map<string,string>"), "id", "carried").collect()}
    assert got == {
        (1, "InvokeAI", "Prompt"): "old", (1, "InvokeAI", "Seed"): "3", (2, "SwarmUI", "Prompt"): "swarm", (2, "SwarmUI", "Steps"): "4", (3, "Fooocus", "Prompt"): "f",
        (7, "Midjourney", "Prompt"): "a cat", (7, "Midjourney", "Version"): "6", (7, "Midjourney", "--tile"): "on",
    }


def test_settled_boxes():
    """Against plain pushing: the first obstacle by top, again and again; and a network of one column in seconds."""

    def plain(rows, reach, margin, gap):
        done, ys = [], []
        for x, y, h in rows:
            beside = sorted((top, bottom) for left, top, bottom in done if abs(left - x) < reach)
            while (under := next((bottom for top, bottom in beside if y < bottom + margin and top < y + h + margin), None)) is not None:
                y = under + gap
            done.append((x, y, y + h))
            ys.append(y)
        return ys

    rng = random.Random(4)
    for k in range(400):
        margin, gap = 8.0, rng.choice([8.0, 36.0, 11.0])
        x = [lambda: 0.0, lambda: rng.choice([0.0, 50.0, 108.0, -30.0]), lambda: rng.uniform(-200, 200)][k % 3]
        h = rng.choice([lambda: 5.0, lambda: rng.uniform(0, 40), lambda: rng.choice([-20.0, -8.0, 1.0, 30.0])])
        rows = sorted(((x(), float(rng.randrange(300)), h()) for _ in range(30)), key=lambda r: r[1])
        boxes = pagelayout._Boxes(108.0, margin, gap, min(r[2] for r in rows))
        assert [boxes.place(*r) for r in rows] == plain(rows, 108.0, margin, gap)
    boxes, began = pagelayout._Boxes(108.0, 8.0, 8.0, 5.0), time.monotonic()
    assert [boxes.place(0.0, k / 1000, 5.0) for k in range(30_000)] == [13.0 * k for k in range(30_000)] and time.monotonic() - began < 30
