"""Line classes of hard families against brute force."""

from __future__ import annotations

import random
import time
from collections import Counter

import pytest

from lakeloom.llm import linearrow, linededup, queries

STEPS = {"sql": linededup.NATIVE, "arrow": linearrow.ARROW}


@pytest.fixture(params=sorted(STEPS))
def steps(request):
    return STEPS[request.param]


def line_classes_of(spark, lines, steps):
    """Class of every line as the operator finds it, and the roots of brute force."""
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = {r["doc"]: r["cls"] for r in linededup.line_classes(docs, steps=steps).collect()}  # lines without a copy or near copy have no row
    sets = [{x[i : i + 9] for i in range(max(1, len(x) - 8))} for x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                root[find(i)] = find(j)
    return [got.get(i, -1 - i) for i in range(len(lines))], [find(i) for i in range(len(lines))]


def test_wide_bands(spark, steps):
    rng = random.Random(11)
    base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=98)) + "zz"
    variants = {base[:i] + c + base[i + 1 :] for i in range(9, 91) for c in "0123"}
    got, want = line_classes_of(spark, [base, *sorted(variants)], steps)
    assert len(set(want)) == 1
    assert max(Counter(got).values()) >= 0.99 * len(got)


def test_repetitive_and_contained_lines(spark, steps):
    rng = random.Random(12)
    rules = ["-" * n for n in range(1990, 2020)]
    cycle = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=49)) + "."
    cycles = [cycle * n for n in range(80, 110)]
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=600)) for _ in range(200)]
    contained = [x for i, t in enumerate(texts) for x in (f"{i}:{t}.", f"{i}:{t[:490]}")]
    lines = [*rules, *cycles, *contained]
    got, want = line_classes_of(spark, lines, steps)
    assert len(set(got[:30])) == len(set(got[30:60])) == 1
    pairs = range(60, len(lines), 2)
    assert all(want[i] == want[i + 1] for i in pairs)
    assert sum(got[i] == got[i + 1] for i in pairs) >= 0.98 * len(pairs)
    assert len(set(got)) >= len(set(want))


def test_wide_family_of_loose_copies(spark, steps, monkeypatch):
    """Lines of one family whose similarity lies about the threshold, over blocks of a few lines."""
    monkeypatch.setattr(linededup, "BLOCK", 20)
    monkeypatch.setattr(linearrow, "BLOCK", 20)
    monkeypatch.setattr(linearrow, "CHUNK", 500)
    monkeypatch.setattr(linearrow, "SMALL", 9)
    rng = random.Random(13)
    base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=120))
    family = set()
    while len(family) < 400:
        line = list(base)
        for _ in range(rng.choice((1, 2, 2))):
            line[rng.randrange(120)] = rng.choice("0123456789")
        family.add("".join(line).strip())
    lines = sorted(family)
    got, want = line_classes_of(spark, lines, steps)
    sets = [{x[i : i + 9] for i in range(len(x) - 8)} for x in lines]
    pairs = [(i, j) for i, a in enumerate(sets) for j in range(i) if len(a & sets[j]) >= 0.8 * len(a | sets[j])]
    assert len(pairs) > 400 and sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs)
    assert len(set(want)) <= len(set(got)) <= 1.03 * len(set(want))


def test_documents_of_one_id(spark, steps):
    """Rows of one id, or of none, with different texts are documents of their own."""
    x, y, z = ("a line that three of the documents hold, word by word", "a line that no other document holds at all", "one more line, found only here")
    rows = [(1, x, "a"), (7, x, "b"), (7, y, "c"), (None, z, "d"), (None, x + "\n" + y[::-1], "e"), (None, None, "f"), (8, x, "g"), (8, x, "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, of string")
    got = {r["of"]: r["text"] for r in linededup.deduplicated(docs, steps=steps).collect()}
    # A null id comes before all others.
    assert got == {"a": "", "b": "", "c": y, "d": z, "e": x + "\n" + y[::-1], "f": None, "g": "", "h": ""}
    found = sorted((r["id"] or 0, r["n_lines"], r["n_dropped"]) for r in linededup.decisions(docs, steps=steps).collect())
    assert found == sorted([(1, 1, 1), (7, 1, 1), (7, 1, 0), (0, 1, 0), (0, 2, 0), (0, 0, 0), (8, 1, 1), (8, 1, 1)])


def test_shingle_sets():
    """Hashes agree where shingles do, short lines and lines of other planes too."""
    lines = ["ab", "abcdefghi", "abcdefghij", "xabcdefghi", "中文" * 9, "🙂" * 30, "b", "-" * 300]
    sets = [set(s.tolist()) for s in linearrow.shingle_sets(lines, 9)]
    want = [{x[i : i + 9] for i in range(max(1, len(x) - 8))} for x in lines]
    assert [len(s) for s in sets] == [len(s) for s in want]
    assert [[len(a & b) for a in sets] for b in sets] == [[len(a & b) for a in want] for b in want]


def test_query_runs_no_python(spark, sf, monkeypatch):
    """Line de-duplication is asked for in DataFrame or SQL operations."""
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", None)
    assert queries.op3_line_dedup(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_long_lines_take_time_in_proportion(spark):
    """A line is not copied for each of its shingles; this took minutes while it was."""
    line = "".join(random.Random(14).choices("abcdefghijklmnopqrstuvwxyz ", k=600_000)).strip()
    texts = spark.createDataFrame([(1, line), (2, line[:-9] + "."), (3, line[::-1])], "lid bigint, line string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a bigint, b bigint")
    began = time.monotonic()
    sketches = linededup.sketched(texts, 9)
    assert [tuple(r) for r in linededup.decided(pairs, texts, sketches, 9, 0.8).collect()] == [(1, 2)]
    assert time.monotonic() - began < 45
