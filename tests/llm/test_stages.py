"""Each stage of the pipeline, op2 and op5 as queries, against plain brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import langid, linededup, mixing, pieces, queries, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    """Invented prose in two languages; copies, near copies, shared lines; ids that repeat, are null, or stand for different texts."""
    rng = random.Random(21)
    words = {"en": "the of and to in is that it was for on are with as his they be at one have this from".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()}

    def line(lang):
        return " ".join(rng.choice(words[lang]) + rng.choice("abcdefgh") * rng.randrange(3) for _ in range(rng.randrange(12, 30))) + "."

    rows = []
    shared = {lang: [line(lang) for _ in range(3)] for lang in words}
    for k in range(120):
        lang = "en" if k % 3 else "de"
        text = "\n".join([line(lang) for _ in range(rng.randrange(2, 6))] + rng.sample(shared[lang], rng.randrange(0, 2)))
        rows.append((k, text, lang, ["a", "b", None][k % 3], len(text)))
    rows += [(200 + k, rows[k][1], *rows[k][2:]) for k in range(8)]  # copies
    rows += [(300 + k, rows[k + 20][1] + " tail", *rows[k + 20][2:]) for k in range(8)]  # near copies
    rows += [(7, rows[50][1][::-1], "en", "a", 1), (None, rows[51][1].upper(), "en", "b", 2), (None, line("en") + "\n" + line("en"), "en", "c", 3), (None, None, None, None, None), (9, "", None, "a", 0), rows[3], rows[3]]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def multiset(df):
    return Counter(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in df.collect())


def roots_of(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def slow_scores(model, text):
    """Mean scores of a text's subwords, one at a time in whole numbers."""
    flat = re.sub(r"[^\w]|[\d_]", " ", text.lower()) if text else ""
    points = [ord(c) for c in re.sub(" +", " ", f" {flat} ")]
    if not any(chr(p).isalpha() for p in points):
        return None
    total, n, mask = np.zeros(len(model.langs)), 0, 0xFFFFFFFF
    for order in langid.ORDERS:
        for i in range(len(points) - order + 1):
            h = points[i] * 0x9E3779B1 & mask
            for p in points[i + 1 : i + order]:
                h = ((h ^ h >> 15) * 0x85EBCA6B + p * 0x9E3779B1) & mask
            total += model.scores[(h ^ h >> 16) & (langid.BUCKETS - 1)]
            n += 1
    z = (total / n + model.bias) / model.temperature
    e = np.exp(z - z.max())
    return e / e.sum()


def test_language(spark, docs, sf):
    model = langid.fitted(docs)
    assert model.langs == ("de", "en")
    want = Counter()
    for row in ROWS:
        p = slow_scores(model, row[1])
        if p is not None and p.max() >= model.threshold:
            want[row] += 1
    assert multiset(corpus_pipeline.language(spark, docs, sf)) == want
    found = {(r["id"], r["lang_pred"]): r["score"] for r in langid.identified(docs.where("doc_id < 100"), model).collect()}
    for row in ROWS[:40]:
        p = slow_scores(model, row[1])
        assert found[row[0], model.langs[int(p.argmax())]] == pytest.approx(p.max(), abs=1e-5)


def test_language_calibration(spark):
    """Held-out rows of the driver's: few right ones are rejected, and the scores mean what they say."""
    sf = "/root/testdata/sf0.01"
    labelled = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op5_language_id(spark, sf).join(labelled, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    right = np.array([r["lang"] == r["lang_pred"] for r in got])
    score = np.array([r["score"] for r in got])
    assert right.mean() > 0.95 and abs(score.mean() - right.mean()) < 0.05
    assert np.mean([r["rejected"] for r, ok in zip(got, right, strict=True) if ok]) < 0.02


def test_training_lowers_the_loss():
    texts = [r[1] for r in ROWS if r[2] and r[1]]
    langs = [r[2] for r in ROWS if r[2] and r[1]]
    model = langid.train(texts, langs)
    loss = lambda m: -np.mean([math.log(max(1e-12, slow_scores(m, t)[m.langs.index(lang)])) for t, lang in zip(texts[:30], langs[:30], strict=True)])
    flat = model._replace(scores=np.zeros_like(model.scores), bias=np.zeros_like(model.bias))
    assert loss(model) < 0.2 < loss(flat)
    assert 0 <= model.threshold <= 0.5 and model.temperature > 0


def test_lines(spark, docs, sf):
    places = []  # one place a row that differs in id or text
    for row in dict.fromkeys((r[0], r[1]) for r in ROWS if r[1]):
        for pos, raw in enumerate(row[1].split("\n")):
            if x := raw.strip(linededup.BLANK):
                places.append((row, pos, x))
    lines = sorted({x for *_, x in places})
    sets = [{x[i : i + 9] for i in range(max(1, len(x) - 8))} for x in lines]
    root = dict(zip(lines, roots_of(len(lines), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])), strict=True))
    kept = {}
    for (doc, text), pos, x in places:
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        key = (doc is not None, doc or 0, h - (1 << 64) if h >= 1 << 63 else h, pos)
        if root[x] not in kept or key < kept[root[x]][0]:
            kept[root[x]] = key, (doc, text, pos)
    stays = {place for _, place in kept.values()}
    want = Counter()
    for doc, text, *rest in ROWS:
        if text is None:
            continue
        left = "\n".join(raw for pos, raw in enumerate(text.split("\n")) if not raw.strip(linededup.BLANK) or (doc, text, pos) in stays)
        if left.strip(linededup.BLANK):
            want[doc, left, *rest[:2], len(left)] += 1
    assert multiset(corpus_pipeline.lines(spark, docs, sf)) == want


def slow_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_copies(spark, docs, sf):
    prints = [slow_print(r[1]) for r in ROWS]
    root = roots_of(len(ROWS), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    got = multiset(corpus_pipeline.near_copies(spark, docs, sf))
    assert sum(got.values()) == len(set(root)) and set(got) <= set(ROWS)
    for group in set(root):
        members = [r for r, x in zip(ROWS, root, strict=True) if x == group]
        stays = [r for r in dict.fromkeys(members) if r in got]
        assert len(stays) == 1  # one row of each group, of its smallest id
        ids = [r[0] for r in members if r[0] is not None]
        assert stays[0][0] == (min(ids) if ids else None)


def test_simhash_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [slow_print(r["text"]) for r in rows]
    root = roots_of(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = {}
    for r, x in zip(rows, root, strict=True):
        least[x] = min(least.get(x, r["doc_id"]), r["doc_id"])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash(spark, sf).collect()}
    assert got == {r["doc_id"]: (f"{p:016x}", least[x]) for r, p, x in zip(rows, prints, root, strict=True)}


def test_mix(spark, docs, sf):
    size = [len(WORD.findall(r[1] or "")) for r in ROWS]
    of_source = Counter()
    for r, n in zip(ROWS, size, strict=True):
        of_source[r[3]] += n
    order = sorted(of_source, key=lambda s: (s is None, s or ""))
    weight, cap, target = {s: k % 3 + 1 for k, s in enumerate(order)}, {s: 3.0 * of_source[s] for s in order}, {}
    left, open_ = float(sum(size)), list(order)
    while open_:  # what exceeds a cap is shared anew
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if cap[s] <= level * weight[s]]
        if not full:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in full:
            target[s] = cap[s]
            left -= cap[s]
            open_.remove(s)
    want = Counter()
    for s in order:
        shift = int(hashlib.md5(f"17:{mixing_key(s)}".encode()).hexdigest()[:8], 16) / 4294967296.0
        ratio = target[s] / of_source[s] if of_source[s] else 0.0

        def tie(text):
            h = xxhash.xxh64_intdigest(text.encode(), 42) if text is not None else 42
            return h - (1 << 64) if h >= 1 << 63 else h

        mine = [(n, (r[0] if r[0] is not None else tie(r[1])) % mixing.BUCKETS, r[0] is not None, r[0] or 0, tie(r[1]), r) for r, n in zip(ROWS, size, strict=True) if r[3] == s]
        for k, (*_, r) in enumerate(sorted(mine, key=lambda m: m[:5]), 1):
            want[r] += math.floor(ratio * k + shift) - math.floor(ratio * (k - 1) + shift)
    assert multiset(corpus_pipeline.mix(spark, docs, sf)) == +want


def mixing_key(source):
    return "1" if source is None else "0" + source


def slow_pieces(lattice, text):
    """Best segmentation by plain dynamic programming over the whole marked text."""
    s = pieces.MARK + text.replace(" ", pieces.MARK)
    best = [(0.0, 0, ())] + [None] * len(s)
    for end in range(1, len(s) + 1):
        ways = []
        for start, ids, score in lattice.edges_to(s, end):
            ways.append((best[start][0] + score, -best[start][1] - len(ids), start, ids))
        score, count, start, ids = max(ways, key=lambda w: (w[0], w[1], -w[2]))
        best[end] = (score, -count, (best[start][2], ids))
    out, path = [], best[-1][2]
    while path:
        out = [*path[1], *out]
        path = path[0]
    return best[-1][0], out


def test_encode(spark, docs, sf):
    lattice = pieces.Lattice(P.path("piece_bpe_32k.model"))
    some = docs.where("doc_id < 25 OR doc_id IS NULL OR text = ''")
    got = corpus_pipeline.encode(spark, some, sf).collect()
    want = Counter()
    for r in ROWS:
        if r[0] is None or r[0] < 25 or r[1] == "":
            score, ids = slow_pieces(lattice, r[1] or "")
            want[r[0], score, tuple(ids)] += 1
    assert Counter((r["doc_id"], r["score"], tuple(r["ids"])) for r in got) == want
    assert all(r["exact"] and r["n_pieces"] == len(r["ids"]) for r in got)


def test_run_is_its_stages(spark, sf, tmp_path, docs):
    """The pipeline's rows come from all stages in turn."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where(F.col("exact")).count() == out.count() > 60
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "mix", "encode"]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_learning_stays_off_the_driver(spark, docs, monkeypatch):
    """The model is learnt in a worker; the driver gets the model alone."""
    where = lambda rows: langid.Model((str(os.getpid()), str(len(rows))), np.zeros((1, 2), np.float32), np.zeros(2), 1.0, 0.0)
    monkeypatch.setattr(langid, "learnt", where)
    process, n = langid.fitted(docs).langs
    assert int(process) != os.getpid() and int(n) > 1
