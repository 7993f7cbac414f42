"""Operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import oracle
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import common, components, langid, linearrow, linededup, pieces, queries, quality, rans, secretscan, simhash, tokencount, tokenfile, vecdedup


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, sf, name):
    assert oracle.differences(queries.QUERIES[name](spark, sf), oracle.connection(sf), queries.ORACLES[name]) == ""


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(70)] + [(600, 600 + i) for i in range(1, 80)]
    truth = union(700, pairs)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {n: truth[n] for p in pairs if p[0] != p[1] for n in p}


def test_position_sets_cover():
    from itertools import combinations

    for least in range(1, 9):
        sets = simhash.position_sets(least)
        assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), max(least, 1)))


def test_simhash_links(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = [int(b) for b in base]
    for b in base:
        for flips in (1, 3, 4, 5, 8):
            x = int(b)
            for bit in rng.choice(64, flips, replace=False):
                x ^= 1 << int(bit)
            prints.append(x)
    prints = sorted(set(prints))
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    truth = union(len(prints), pairs)
    for block in (simhash.BLOCK, 3):  # the second deals nearly every posting in blocks
        links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), 4, block)
        at = {s: i for i, s in enumerate(signed)}
        found = [(at[r["a"]], at[r["b"]]) for r in links.collect()]
        assert union(len(prints), found) == truth


def test_fingerprint(texts):
    import xxhash

    for t in list(texts.values())[:20] + ["", "One two", "É A b C d"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
        assert simhash.fingerprint_of(t) == sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


@pytest.mark.parametrize("steps", [linededup.NATIVE, linearrow.ARROW], ids=["sql", "arrow"])
def test_line_dedup_recall(spark, docs, texts, steps):
    blank = linededup.BLANK
    lines = sorted({x.strip(blank) for t in texts.values() for x in t.split("\n") if x.strip(blank)})
    sets = [{x[i : i + 9] for i in range(max(1, len(x) - 8))} for x in lines]
    where: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = []
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in where[g] if j < i)
        pairs += [(i, j) for j, n in shared.items() if n >= 0.8 * (len(s) + len(sets[j]) - n)]
    truth = union(len(lines), pairs)
    got = {}
    for r in linededup.line_classes(docs, steps=steps).collect():
        got.setdefault(texts[r["doc"]].split("\n")[r["pos"]].strip(blank), set()).add(r["cls"])
    assert set(got) <= set(lines) and all(len(v) == 1 for v in got.values())
    cls = [next(iter(got[x])) if x in got else -1 - i for i, x in enumerate(lines)]  # lines without a copy have no row
    linked = sum(cls[i] == cls[j] for i, j in pairs)
    assert linked >= 0.95 * len(pairs)
    assert len(set(cls)) >= len(set(truth))  # nothing is linked that brute force does not link


def test_token_counts(texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    counter, library = tokencount.PrefixCounter(path), Tokenizer.from_file(path)
    some = [*texts.values(), "don't 'rex x'll !'s <|endoftext|>a<|startoftext|> İΣς ½²", "<|endoftext", ""]
    assert [counter.count(t) for t in some] == [len(e) for e in library.encode_batch(some, add_special_tokens=False)]
    for t in [x[:250] for x in some[:25]] + some[-3:]:
        normal = "".join(s for s, _ in counter.segments(t))
        table = counter.prefix_counts(t)
        assert len(table) == len(normal) + 1
        if t.lower() == normal and len(t) == len(normal):
            assert table == [len(library.encode(t[:i], add_special_tokens=False)) for i in range(len(t) + 1)]
        for budget in (0, 3, 17):
            assert counter.longest_within(t, budget) == (table[-1], max(i for i, c in enumerate(table) if c <= budget))


def test_language_held_out(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    assert zlib.crc32(b"5") % 3 == 1 or not spark.range(5, 6).select(langid.held_out("id")).first()[0]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(60, 16))
    rows, k = [], 0
    for c in centre:
        for _ in range(rng.integers(1, 30)):
            rows.append((k, (c + rng.normal(scale=rng.choice([0.0, 0.08, 0.15]), size=16)).tolist(), int(k % 2)))
            k += 1
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    got = {r["id"]: r for r in vecdedup.near_duplicates(df).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.97 * near.sum()
    recall, true = vecdedup.audit(vecdedup.near_duplicates(df))
    assert recall >= 0.97 and true > 500


def test_vectors_over_many_clusters(spark, monkeypatch):
    """Three labels, clusters of hundreds, every level of centroids; links told by identity of pairs through components of single pairs."""
    monkeypatch.setattr(vecdedup, "PER_CLUSTER", 40)
    monkeypatch.setattr(vecdedup, "SAMPLE", 900)
    rng = np.random.default_rng(6)
    rows = []
    for label, families in ((0, 150), (1, 60), (2, 8)):
        for c in rng.normal(size=(families, 24)):
            for _ in range(int(rng.choice([1, 2, 5, 40]))):
                rows.append((len(rows), (c + rng.normal(scale=rng.choice([0.02, 0.1, 0.14]), size=24)).tolist(), label))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    found = vecdedup.near_duplicates(df)
    got = {r["id"]: r for r in found.collect()}
    links = np.array([got[i]["n_links"] for i in range(len(rows))])
    comp = np.array([got[i]["component"] for i in range(len(rows))])
    a, b = np.nonzero(np.triu(near))
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.95 * near.sum()
    assert (comp[a] == comp[b]).mean() >= 0.95
    truth = union(len(rows), list(zip(a.tolist(), b.tolist(), strict=True)))
    assert all(truth[c] == truth[i] for i, c in enumerate(comp.tolist()))
    recall, true = vecdedup.audit(found)
    assert recall >= 0.95 and true > 100
    assert vecdedup.audit(found.limit(0)) == (None, 0)


def test_vectors_in_blocks():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 8)) * 0.03 + np.eye(8)[rng.integers(0, 8, 900)]
    ids, side = np.arange(900), np.arange(900) % 2
    links, _, _ = vecdedup.links_in_task(ids, v, np.ones(900, np.int64), np.zeros(900, np.int64), np.zeros(900, np.int64), 0, True, side, 0.98)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (side[:, None] != side[None, :])
    assert links.sum() >= 0.95 * near.sum() and (links <= near.sum(axis=1)).all()


def test_nbest_against_all_segmentations():
    lattice = pieces.Lattice(P.path("piece_bpe_32k.model"))

    def every(s):
        if not s:
            return [(0.0, ())]
        firsts = [e for k in range(1, len(s) + 1) for e in lattice.edges_to(s[:k], k) if not e[0]]
        return [(score + rest, ids + more) for (_, ids, score), k in zip(firsts, [k for k in range(1, len(s) + 1) for e in lattice.edges_to(s[:k], k) if not e[0]], strict=True) for rest, more in every(s[k:])]

    for word in ("▁there", "▁▁éx", "🙂ab", "▁onst!!"):
        truth = sorted(every(word), key=lambda v: (-v[0], len(v[1])))
        best = lattice.nbest(word, 5)
        assert [b[0] for b in best] == [t[0] for t in truth[:5]] and len(best[0][1]) == len(truth[0][1])
    text = "the end\nof it"
    assert lattice.nbest_of_text(text, 3)[0][0] == lattice.best(text)[1]
    assert lattice.nbest_of_text(text, 2)[1][0] == lattice.best(text)[1] - lattice.best(text)[2]


def test_long_stretches():
    rng = random.Random(8)
    lattice = pieces.Lattice(P.path("piece_bpe_32k.model"))
    for s in ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100_000)), "".join(rng.choices("ABCDEFabcdefghij0123456789+/", k=100_000)), "a" * 20_000):
        ids, score, margin = lattice.best(s)
        assert lattice.decode(np.frombuffer(ids, "<u4")) == s and margin >= 0
        whole = lattice.best(s[:3000])
        two = lattice.nbest_of_text(s[:3000], 2)
        assert two[0][0] == whole[1] and two[0][0] - two[1][0] == whole[2]
    once = pieces.WINDOW
    try:  # windows end anywhere
        text = "the window of a long stretch" + s[:100] + "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé中", k=3000))
        want = pieces.Lattice(P.path("piece_bpe_32k.model")).best(text)
        pieces.WINDOW = 37
        assert pieces.Lattice(P.path("piece_bpe_32k.model")).best(text) == want
    finally:
        pieces.WINDOW = once


def test_pieces_round_trip(texts):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lattice, library = pieces.Lattice(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in [*texts.values(), "", "  a  b ", "🙂\n\n中文 ▁x"]:
        ids = np.frombuffer(lattice.best(t)[0], "<u4")
        assert lattice.decode(ids) == t
        if "▁" not in t:
            assert library.decode(ids.tolist()) == t


def test_rans_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1023, 1025, rans.BLOCK + 7):
        for ids in (rng.integers(0, 50257, n), rng.zipf(1.3, n) % 50257, np.full(n, 1 << 31)):
            ids = ids.astype("<u4")
            data = rans.write_file([7], [n], ids)
            file = rans.TokenFile(data)
            assert file.doc_ids == [7] and file.lengths == [n] and np.array_equal(file.all(), ids) and np.array_equal(file.all(threads=3), ids)
    ids = (rng.zipf(1.3, 3 * rans.BLOCK + 99) % 50257).astype("<u4")
    data = bytearray(rans.write_file([1], [len(ids)], ids))
    second = int(rans.TokenFile(bytes(data)).checkpoints[1][1])
    start = len(data) - len(rans.TokenFile(bytes(data)).payloads)
    data[start + second - 9] ^= 1  # within the first block
    file = rans.TokenFile(bytes(data))
    for k in (3, 1, 2):  # each from its checkpoint, in any order
        assert np.array_equal(file.block(k), ids[k * rans.BLOCK : (k + 1) * rans.BLOCK])
    assert np.array_equal(file.ids(rans.BLOCK + 5, rans.BLOCK), ids[rans.BLOCK + 5 : 2 * rans.BLOCK + 5])
    with pytest.raises(ValueError, match="block 0: payload checksum"):
        file.all()


def test_token_files(spark, docs, texts):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    start, truth = 0, []
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        truth.append((i, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    got = sorted(tuple(r) for r in tokenfile.read_corpus(tokenfile.write_corpus(docs, path)).collect())
    assert got == truth
    odd = [chr(i) + " x" + chr(i) + "a1" for i in range(1, 0x260)] + ["<|endoftext|> a  b\n\n c'll 中文  \xa0é"]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenfile.Encoder(path).encode(odd)] == [e.ids for e in library.encode_batch(odd, add_special_tokens=False)]


def test_secret_spans(spark):
    text = 'é token = "abcdef1" secret=token: abcdef123 AKIA' + "A" * 16 + " " + "0a" * 13 + " api_key: x12345"
    rows = [(1, text, "a"), (2, text, "b"), (3, "Zz9kLmN0pQ" + "q1W" * 5, "c"), (4, None, None)]
    got = {r["id"]: r for r in secretscan.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    truth = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        truth += [("assign", m.start(), m.end())] * (len(m[2]) >= 6)
    truth += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert sorted((s["kind"], s["start"], s["end"]) for s in got[1]["base"]) == sorted(truth)
    assert [s["kind"] for s in got[3]["spans"]] == ["mixed"] and got[4]["spans"] == []


def test_quality_brute_force(spark, docs, texts):
    for r in quality.measured(docs).select("doc_id", "quality").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
        assert (r["quality"]["n_words"], r["quality"]["n_repeat_words"]) == (len(words), len(covered))


def test_spanning_stars():
    a, b = common.spanning_stars(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(3, 1), (5, 1), (9, 8)]


def test_two_best_come_from_agendas(monkeypatch):
    """The rows' two best segmentations: both forms of the agenda against the lattice's queue, stretch by stretch, and no result without a search."""
    rng = random.Random(6)
    lattice = pieces.Lattice(P.path("piece_bpe_32k.model"))
    stretches = ["▁" + "".join(rng.choices("abcdeéthinos", k=k)) for k in (*range(1, 40), 120, 300)] + ["▁▁▁", "🙂x", "a" * 100]
    want = [lattice.nbest(s, 2) for s in stretches]
    for short in (pieces.SHORT, 0, 1000):
        monkeypatch.setattr(pieces, "SHORT", short)
        for (ids, score, lead), best in zip(lattice.search(stretches), want, strict=True):
            assert (np.frombuffer(ids, "<u4").tolist(), score) == (list(best[0][1])[::1], best[0][0])
            assert lead == (best[0][0] - best[1][0] if len(best) > 1 else float("inf"))
    searched = []
    monkeypatch.setattr(pieces.Lattice, "_two_best", lambda self, paths, f=pieces.Lattice._two_best: searched.append(1) or f(self, paths))
    lattice.best("never met before: qzxv")
    assert searched


def test_remembered_stretches_stay(monkeypatch):
    """What is met again after the worker lets go of old stretches is not searched again."""
    monkeypatch.setattr(pieces, "REMEMBERED", 40)
    lattice = pieces.Lattice(P.path("piece_bpe_32k.model"))
    searched = []
    monkeypatch.setattr(pieces.Lattice, "search", lambda self, s, f=pieces.Lattice.search: searched.extend(s) or f(self, s))
    for k in range(12):
        assert lattice.best(f"often word{k}")[0] == pieces.Lattice(P.path("piece_bpe_32k.model")).best(f"often word{k}")[0]
    assert searched.count("▁often") == 12 + 1  # once by the lasting lattice
    assert len(lattice.known) + len(lattice.older) < 20
