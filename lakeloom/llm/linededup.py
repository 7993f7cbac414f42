"""Fuzzy line de-duplication by MinHash, in DataFrame and SQL functions alone unless other steps are given.

1. Every line with a word becomes a 64-bit id; exact copies are one line from here on.
2. The shingles of a line are exploded by position, some to a row, and hashed inside generated code. The
   signature has ``BANDS * ROWS`` minima over all of them, taken with map-side combining.
3. Equal bands make candidates, in three rounds that compare only lines which are not yet connected: every line
   meets the smallest line of each of its bands; then the line nearest to it in each band; then all others.
   A wide band is dealt as pairs of blocks. Pairs left out are within one component already.
4. The Jaccard similarity of whole shingle sets decides each candidate. Before texts are joined, most pairs that
   cannot reach it go by a bound that loses none (:func:`_close`).
5. Components of the decided pairs by distributed union-find, and in each the first line in order of
   (id, position) is kept.

Lines are compared without white space at their ends. A line of fewer characters than a shingle is
its own only shingle. Should two different lines share an id (a second hash tells), neither links
with anything: a collision keeps lines and never removes one.

In SQL functions the whole took 499 CPU seconds a GB in a run of the check tool, of which the minima over exploded shingles alone
take about a third. :mod:`linearrow` has the four dear steps in Arrow batches; a caller chooses by ``steps``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import forget, hot_keys, join_split, let, stored, tidy
from lakeloom.llm.components import components

SHINGLE, SIMILARITY = 9, 0.8
BANDS, ROWS = 8, 3
SEED = 23
#: Lines of a block of a wide band, 64-bit words of a sketch, shingles of an exploded row.
BLOCK, SKETCH, TOGETHER = 256, 8, 4
BLANK = " \t\n\x0b\x0c\r"


class Steps(NamedTuple):
    """The steps that have two forms."""

    read: Callable[..., tuple[DataFrame, DataFrame]]
    texts_of: Callable[..., DataFrame]
    sketched: Callable[..., DataFrame]
    other_pairs: Callable[..., tuple[DataFrame, str]]
    decided: Callable[..., DataFrame]


def line_id(line: Column) -> Column:
    return F.xxhash64(line)


def lines_of(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    """``pos`` (from 0) and ``line`` (trimmed) of all lines that have a word, and the columns ``more``."""
    rows = docs.select(*more, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "raw"))
    return rows.withColumn("line", F.trim(F.col("raw"), F.lit(BLANK))).where("line <> ''").drop("raw")


def _hash(units: str, i: str, k: int) -> str:
    """Hash of the shingle of ``k`` UTF-16 units at ``i``; binary substrings cost the shingle, not the line."""
    return f"xxhash64(substring({units}, 2 * ({i}) + 1, {2 * k}))"


def _grams(units: Column, k: int) -> Column:
    """The hashes of a line's shingles in their order. The units are bound once: read from a row anew for each shingle, the whole line would be copied each time."""
    starts = lambda u: F.sequence(F.lit(1), F.greatest(F.octet_length(u) - 2 * k, F.lit(0)) + 1, F.lit(2))
    return let(units, lambda u: F.transform(starts(u), lambda i: F.xxhash64(F.substring(u, i, F.lit(2 * k)))))


def read(docs: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of all distinct lines, and the places of all lines: ``doc``, ``of`` (hash of the whole text), ``pos``, ``lid``."""
    places = lines_of(docs, text_col, F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("of"))
    return signatures(docs, text_col, k), places.select("doc", "of", "pos", line_id(F.col("line")).alias("lid"))


def texts_of(docs: DataFrame, text_col: str, ids: DataFrame) -> DataFrame:
    """``lid`` and ``line`` of the lines whose ids are asked for."""
    lines = lines_of(docs, text_col).select(line_id(F.col("line")).alias("lid"), "line")
    return lines.join(ids, "lid", "left_semi").dropDuplicates(["lid"])


def signatures(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """``lid``, ``n`` (places) and the bands ``b0``, ``b1``, ... of every distinct line, lines that share an id left out."""
    base = lines_of(docs, text_col).select(line_id(F.col("line")).alias("lid"), F.xxhash64(F.lit(1), F.col("line")).alias("other"), F.encode("line", "UTF-16BE").alias("units"))
    base = base.withColumn("last", F.greatest(F.expr(f"octet_length(units) div 2 - {k}"), F.lit(0)).cast("int"))
    grams = base.select("lid", "other", "units", "last", F.explode(F.expr(f"sequence(0, last, {TOGETHER})")).alias("i"))
    each = range(TOGETHER)
    grams = grams.select("lid", "other", "i", *[F.expr(_hash("units", f"least(i + {j}, last)", k)).alias(f"a{j}") for j in each])
    # Orders of the shingles: three hashes, each rotated by eight bits at a time, for a rotation costs less than a hash.
    grams = grams.select("*", *[F.xxhash64(f"a{j}").alias(f"b{j}") for j in each], *[F.xxhash64(F.lit(SEED), F.col(f"a{j}")).alias(f"c{j}") for j in each])
    turned = lambda h, r: F.col(h) if not r else F.shiftleft(F.col(h), r).bitwiseOR(F.shiftrightunsigned(F.col(h), 64 - r))
    orders = [F.least(*[turned(f"{h}{j}", r) for j in each]) for r in range(0, 64, 8) for h in "abc"][: BANDS * ROWS]
    mins = [F.min(o).alias(f"m{j}") for j, o in enumerate(orders)]
    sig = grams.groupBy("lid").agg(F.count_if(F.col("i") == 0).alias("n"), F.min("other").alias("lo"), F.max("other").alias("hi"), *mins).where("lo = hi")
    return sig.select("lid", "n", *[F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]).alias(f"b{b}") for b in range(BANDS)])


def banded(sig: DataFrame) -> DataFrame:
    """``band``, ``k`` (its number), ``lid`` and ``low``, the band's smallest line id, of every line that shares a band."""
    spread = sig.select("lid", F.posexplode(F.array(*[f"b{b}" for b in range(BANDS)])).alias("k", "band"))
    lows = spread.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("lid").alias("low")).where("size > 1")
    return spread.join(lows, "band").select("band", "k", "lid", "low")


def first_pairs(members: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of every line with the smallest of each of its bands."""
    return members.where("lid <> low").select(F.col("low").alias("a"), F.col("lid").alias("b")).distinct()


def sketched(texts: DataFrame, k: int) -> DataFrame:
    """``lid``, ``n`` (distinct shingles) and the words ``w0``, ``w1``, ... of each line: a shingle toggles one bit."""
    each = texts.select("lid", F.explode(F.array_distinct(_grams(F.encode("line", "UTF-16BE"), k))).alias("h"))
    words = [F.expr(f"bit_xor(if((h >> 6) & {SKETCH - 1} = {w}, shiftleft(1L, cast(h & 63 as int)), 0L))").alias(f"w{w}") for w in range(SKETCH)]
    return each.groupBy("lid").agg(F.count(F.lit(1)).alias("n"), *words)


def _apart(x, y, words: int = SKETCH) -> Column:
    """Bits in which two sketches differ, or their first words; ``x`` and ``y`` give a word's column."""
    return reduce(lambda a, b: a + b, (F.bit_count(x(w).bitwiseXOR(y(w))) for w in range(words)))


def _close(nx: Column, ny: Column, apart: Column, similarity: float) -> Column:
    """Whether two sets of these sizes, whose sketches differ in ``apart`` bits, can reach the similarity.

    Two sets differ in at least as many shingles as their sketches in bits, so the greatest common part is (nx + ny - apart) / 2.
    A little less is asked of it, for rounding.
    """
    s = F.lit(similarity - 1e-9)
    return (nx >= s * ny) & (ny >= s * nx) & (nx + ny - apart >= s * (nx + ny + apart))


def near_by_sketch(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs that can reach the similarity."""
    end = lambda c: sketches.select(F.col("lid").alias(c), F.col("n").alias(f"n{c}"), *[F.col(f"w{w}").alias(f"{c}{w}") for w in range(SKETCH)])
    apart = _apart(lambda w: F.col(f"a{w}"), lambda w: F.col(f"b{w}"))
    return pairs.join(end("a"), "a").join(end("b"), "b").where(_close(F.col("na"), F.col("nb"), apart, similarity)).select("a", "b")


def members_by_band(members: DataFrame, sig: DataFrame, roots: DataFrame, sketches: DataFrame, block: int) -> DataFrame:
    """The lines, other than the lowest, of each band whose lines ``roots`` does not connect yet, with sketch, bands, root and block."""
    own = members.join(roots, members.lid == roots.node, "left").select("band", "k", "lid", "low", F.coalesce("root", "lid").alias("root"))
    mixed = own.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("size > 2 AND r0 <> r1")
    mixed = mixed.select("band", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    lines = sketches.join(sig.drop("n"), "lid")
    own = own.where("lid <> low").drop("low").join(mixed, "band").join(lines, "lid")
    return own.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "lid"), "blocks").cast("int"))


def other_pairs(members: DataFrame, sig: DataFrame, roots: DataFrame, sketches: DataFrame, similarity: float, all_of_them: bool) -> tuple[DataFrame, str]:
    """The stored table, and its path, of pairs ``a`` < ``b`` of a band whose lines ``roots`` does not connect already and whose
    sketches allow the similarity.

    Either all such pairs, each in the first band that its lines share, or for each line and block the nearest by sketch, so that few
    rows connect most of what belongs together. A band is dealt as pairs of blocks of about BLOCK lines; a pair of blocks is
    compared within one row, and no task holds all of a wide band.
    """
    own = members_by_band(members, sig, roots, sketches, BLOCK)
    line = F.struct("root", "lid", "n", *[f"w{w}" for w in range(SKETCH)], F.array(*[f"b{b}" for b in range(BANDS)]).alias("bands"))
    blocks, path = stored(own.groupBy("band", "k", "block", "blocks").agg(F.collect_list(line).alias("lines")), "line-blocks")
    left = blocks.select("band", "k", F.col("lines").alias("xs"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("block"))
    both = left.join(blocks.select("band", "block", F.col("lines").alias("ys")), ["band", "block"])

    word = lambda line: lambda w: line[f"w{w}"]

    def near(x: Column, y: Column) -> Column:
        """Half of the sketches settles most pairs: fewer bits differ in it than in all."""
        close = lambda words: _close(x["n"], y["n"], _apart(word(x), word(y), words), similarity)
        ok = (x["root"] != y["root"]) & close(SKETCH // 2) & close(SKETCH)
        if all_of_them:
            earlier = F.exists(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: (b < F.col("k")) & (x["bands"][b] == y["bands"][b]))
            return ok & ~earlier
        return ok

    def nearest(x: Column) -> Column:
        """How alike the sketches are, in thousandths, and the line, of the nearest; null where none is near."""
        n = lambda y: x["n"] + y["n"]
        alike = lambda y: let(_apart(word(x), word(y)), lambda apart: F.floor(1000 * (n(y) - apart) / (n(y) + apart)))
        return F.array_max(F.transform(F.filter("ys", lambda y: near(x, y)), lambda y: F.struct(alike(y).alias("alike"), y["lid"].alias("lid"))))

    if all_of_them:
        met = F.flatten(F.transform("xs", lambda x: F.transform(F.filter("ys", lambda y: near(x, y)), lambda y: F.struct(x["lid"].alias("x"), y["lid"].alias("y")))))
    else:
        met = F.filter(F.transform("xs", lambda x: F.struct(x["lid"].alias("x"), nearest(x)["lid"].alias("y"))), lambda p: p["y"].isNotNull())
    pairs = both.select(F.explode(met).alias("p")).select(F.least("p.x", "p.y").alias("a"), F.greatest("p.x", "p.y").alias("b")).distinct()
    out = stored(pairs, "line-pairs")
    forget(members.sparkSession, path)
    return out


def decided(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs whose whole shingle sets reach the similarity."""
    side = lambda c: texts.join(sketches.select("lid", "n"), "lid").select(F.col("lid").alias(c), F.encode("line", "UTF-16BE").alias(f"u{c}"), F.col("n").alias(f"n{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect(_grams(F.col("ua"), k), _grams(F.col("ub"), k)))
    return both.where(let(common, lambda c: c >= F.lit(similarity) * (F.col("na") + F.col("nb") - c))).select("a", "b")


NATIVE = Steps(read, texts_of, sketched, other_pairs, decided)


def hooked(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, a linked line that it is connected with: enough to skip most of what is connected, in two joins."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("low"))
    return low.join(low.select(F.col("node").alias("low"), F.col("low").alias("root")), "low").select("node", "root")


def line_roots(docs: DataFrame, sig: DataFrame, text_col: str, k: int, similarity: float, steps: Steps) -> DataFrame:
    """``node`` and ``root`` of every line that is linked."""
    spark = docs.sparkSession
    members, members_path = stored(banded(sig), "line-members")
    texts, texts_path = stored(steps.texts_of(docs, text_col, members.select("lid").distinct()), "line-texts")
    sketches, sketches_path = stored(steps.sketched(texts, k), "line-sketches")
    pairs, pairs_path = stored(near_by_sketch(first_pairs(members), sketches, similarity), "line-pairs")
    links, links_path = stored(steps.decided(pairs, texts, sketches, k, similarity), "line-links")
    roots, roots_path = stored(hooked(links), "line-roots")
    for all_of_them in (False, True):
        forget(spark, pairs_path)
        pairs, pairs_path = steps.other_pairs(members, sig, roots, sketches, similarity, all_of_them)
        links = links.unionByName(steps.decided(pairs, texts, sketches, k, similarity))
        after, after_path = stored(components(links), "line-roots")
        forget(spark, roots_path)
        roots, roots_path = after, after_path
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    for path in (pairs_path, links_path, members_path, texts_path, sketches_path):
        forget(spark, path)
    return roots


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, steps: Steps = NATIVE) -> DataFrame:
    """``doc``, ``of`` (hash of the whole text), ``pos``, ``cls`` (class id) and ``kept`` of every line that the corpus holds a copy or near copy of.

    The kept line of a class is the first by (doc, of, pos), a null id before all others. Rows of one id with different texts are
    documents of their own, null ids too; rows equal in id and text are one document, whose rows keep and lose the same lines.
    """
    spark = docs.sparkSession
    found, places = steps.read(docs, id_col, text_col, k)
    sig, sig_path = stored(found, "line-bands")
    roots = line_roots(docs, sig, text_col, k, similarity, steps)
    of_line = sig.select("lid", "n").join(roots, F.col("lid") == F.col("node"), "left").where("n > 1 OR root IS NOT NULL")
    of_line, _ = stored(of_line.select("lid", "n", F.coalesce("root", "lid").alias("cls")), "line-classes")
    forget(spark, sig_path)
    at, _ = stored(join_split(places, of_line.select("lid", "cls"), "lid", hot_keys(of_line, "lid"), F.xxhash64("doc", "of", "pos")).drop("lid"), "line-places")
    tidy(spark)
    first = at.groupBy("cls").agg(F.min(F.struct("doc", "of", "pos")).alias("first"))
    kept = first.select(F.col("first.doc").alias("kdoc"), F.col("first.of").alias("kof"), F.col("first.pos").alias("kpos"))
    same = F.col("doc").eqNullSafe(F.col("kdoc")) & (F.col("of") == F.col("kof")) & (F.col("pos") == F.col("kpos"))
    return at.join(kept, same, "left").select("doc", "of", "pos", "cls", F.col("kof").isNotNull().alias("kept"))


def dropped(docs: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """``__doc``, ``__of`` and ``__dropped`` (positions, ascending) of every document that loses lines."""
    gone = line_classes(docs, id_col, text_col, **how).where("NOT kept")
    return gone.groupBy(F.col("doc").alias("__doc"), F.col("of").alias("__of")).agg(F.array_sort(F.collect_set("pos")).alias("__dropped"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``id``, ``n_lines`` (lines with a word), ``n_dropped`` and ``dropped`` (their positions, ascending) of every row of ``docs``.

    A null or empty text has no lines and drops none. Which copy stays is told at :func:`line_classes`. Very long lines count
    whole. Other columns are not read. An empty table gives an empty one.
    """
    found = dropped(docs, id_col, text_col, **how)
    n_lines = F.size(F.filter(F.split(F.col(text_col), "\n", -1), lambda line: F.trim(line, F.lit(BLANK)) != ""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("of"), F.greatest(F.coalesce(n_lines, F.lit(0)), F.lit(0)).cast("long").alias("n_lines"))
    out = rows.join(found, F.col("id").eqNullSafe(F.col("__doc")) & (F.col("of") == F.col("__of")), "left")
    gone = F.coalesce("__dropped", F.array().cast("array<int>"))
    return out.select("id", "n_lines", F.size(gone).cast("long").alias("n_dropped"), gone.alias("dropped"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with each text's dropped lines taken out; lines without a word and all other columns stay as they are."""
    found = dropped(docs, id_col, text_col, **how)
    rows = docs.join(found, docs[id_col].eqNullSafe(found["__doc"]) & (F.xxhash64(docs[text_col]) == found["__of"]), "left")
    gone = F.col("__dropped")
    kept = F.array_join(F.filter(F.split(docs[text_col], "\n", -1), lambda line, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(gone.isNull(), docs[text_col]).otherwise(kept)
    return rows.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
