"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most
``d`` bits share at least ``m = 8 - d`` of them in place. The index has a posting for a few
sets of byte positions chosen so that any ``m`` shared positions contain one of the sets
(Turan's construction of 20 triples for m = 4), so no link is missed while a posting
stays 2**24 values wide. In a posting, the shared positional bytes of each pair are
tallied, pairs with at least ``m`` are retained and verified by their differing bits.

Copies first collapse to one fingerprint. A posting of many fingerprints is dealt in
blocks: each pair of blocks is a task of bounded memory. Tasks give a spanning forest of
the links that they verify, never the pairs themselves, so no link between different
texts is lost and the rows that leave a task never exceed those that entered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import slices, spanning_stars, stored, texts_in_batches
from lakeloom.llm.components import components

SEED = 42
#: Fingerprints of a posting above this are dealt in blocks of about this many.
BLOCK = 2048
#: Rows that a task holds at once, besides one group.
CHUNK = 200_000


def fingerprint_of(text: str | None, shingle: int = 4) -> int:
    """Fingerprint of a text as an unsigned number: ASCII-lower-cased words, ``shingle``-word shingles with repeats, XXH64."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[i:j], SEED) for i, j in zip(starts, stops, strict=True)]
    tally = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        tally += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * tally > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint's 64 bits as a signed long) of every document, and the ``carry`` columns (``carry_0``, ...).

    A null or wordless text has the fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint_of(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(fps)], names=[*names, "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return texts_in_batches(rows).mapInArrow(run, f"{schema}, fp bigint")


def position_sets(least: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which any ``least`` positions out of 8 contain one."""
    if least < 4:
        return list(combinations(range(8), max(1, least)))
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    inside = {(0, 0, 0), (1, 1, 1), (0, 0, 1), (1, 1, 2), (0, 2, 2)}
    return [t for t in combinations(range(8), 3) if tuple(sorted(group[p] for p in t)) in inside]


def _posting_keys(fp: Column, least: int) -> Column:
    mask = lambda t: sum(255 << (8 * p) for p in t)
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return F.array(*[F.struct(F.lit(i).alias("set"), fp.bitwiseAND(F.lit(signed(mask(t)))).alias("bytes")) for i, t in enumerate(position_sets(least))])


def _verified(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Of the pairs x[i], y[i]: tally of shared positional bytes reached and differing bits within the limit."""
    tally = (x.view(np.uint8).reshape(-1, 8) == y.view(np.uint8).reshape(-1, 8)).sum(axis=1)
    hit = np.flatnonzero(tally >= 8 - bits)
    return hit[np.bitwise_count(x[hit] ^ y[hit]) <= bits]


def _within(fp: np.ndarray, other: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of two blocks, a stripe of rows at a time."""
    found_a, found_b = [fp[:0]], [fp[:0]]  # a block may be empty on one side
    left, right = fp.view(np.uint8).reshape(-1, 8), np.ascontiguousarray(other.view(np.uint8).reshape(-1, 8).T)
    for at in range(0, len(fp), 256):
        tally = np.zeros((min(256, len(fp) - at), len(other)), np.uint8)
        for p in range(8):
            tally += left[at : at + 256, p, None] == right[p][None, :]
        i, j = np.nonzero(tally >= 8 - bits)
        ok = np.bitwise_count(fp[at + i] ^ other[j]) <= bits
        found_a.append(fp[at + i[ok]])
        found_b.append(other[j[ok]])
        if sum(map(len, found_a)) > 1_000_000:
            a, b = spanning_stars(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b = [a], [b]
    return np.concatenate(found_a), np.concatenate(found_b)


def _forest_of_chunk(group: np.ndarray, side: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside the groups of one chunk; ``group`` is ascending."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    out_a, out_b = [], []
    small = np.repeat(sizes <= 48, sizes) & (side == 2)
    for step in range(1, 48):
        near = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
        if not len(near):
            break
        hit = near[_verified(fp[near], fp[near + step], bits)]
        out_a.append(fp[hit])
        out_b.append(fp[hit + step])
    for s, n in zip(starts, sizes, strict=True):
        if n > 1 and not small[s]:
            mine, sides = fp[s : s + n], side[s : s + n]
            a, b = _within(mine[sides != 1], mine[sides != 0], bits)
            out_a.append(a)
            out_b.append(b)
    if not out_a:
        return fp[:0], fp[:0]
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    keep = a != b
    return spanning_stars(a[keep], b[keep])


def links_of_groups(rows: DataFrame, bits: int) -> DataFrame:
    """Spanning links ``a``, ``b`` inside each group of ``rows`` (set, bytes, lo, hi, side, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(last: bool):
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            new = np.zeros(len(cols[0]), bool)
            new[0] = True
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            cut = len(new) if last else int(np.flatnonzero(new)[-1])
            held[:] = [] if last else [[c[cut:] for c in cols]]
            a, b = _forest_of_chunk(np.cumsum(new)[:cut], cols[4][:cut], cols[5][:cut].view(np.uint64), bits) if cut else (cols[5][:0],) * 2
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(h[0]) for h in held) >= CHUNK:
                yield flush(False)
        if held:
            yield flush(True)

    keys = ["set", "bytes", "lo", "hi"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "side", "fp").mapInArrow(run, "a bigint, b bigint")


def fingerprint_links(prints: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Links between the distinct fingerprints of ``prints`` (column ``fp``): a spanning forest of each posting's links."""
    if not 0 <= bits <= 7:
        raise ValueError("bits must be from 0 to 7: eight positional bytes guarantee nothing beyond")
    postings = prints.select("fp", F.explode(_posting_keys(F.col("fp"), 8 - bits)).alias("k")).select("k.set", "k.bytes", "fp")
    wide = postings.groupBy("set", "bytes").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    dealt = postings.join(wide, ["set", "bytes"], "left").withColumn("blocks", F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int"))
    mine = F.pmod(F.hash("fp"), F.col("blocks"))
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    rows = dealt.select("set", "bytes", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), side.alias("side"), "fp")
    return links_of_groups(rows, bits)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4, shingle: int = 4) -> DataFrame:
    """``id``, ``fp`` and ``component`` (smallest id reachable over links, itself included) of every row of ``docs``.

    Rows with a null or wordless text have fingerprint zero and link like any other. A null id
    never becomes a component's id unless all its ids are null. Repeated rows keep one result row
    each. Other columns of ``docs`` are neither read nor returned. No rows give no rows.
    """
    marked, _ = stored(fingerprints(docs, id_col, text_col, shingle), "prints")
    prints, _ = stored(marked.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct-prints")
    found = components(fingerprint_links(prints, bits))
    linked = prints.join(found, prints.fp == found.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    of_root = linked.groupBy("root").agg(F.min("least_id").alias("component"))
    per_print = linked.join(of_root, "root").select("fp", "component")
    return marked.join(per_print, "fp").select("id", "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4, shingle: int = 4) -> DataFrame:
    """``docs`` with one row of each group of linked fingerprints left, whole and unchanged.

    The row that stays has the group's smallest id (a null id only where all are null); of rows of that id the one of the smallest
    fingerprint, and of these, which have the same id and practically the same text, the first as stored. Null and wordless texts
    are one group. Groups are told apart by their fingerprints and not by ids, so ids may repeat or be null.
    """
    carry = tuple(docs.columns)
    numbered = fingerprints(docs, id_col, text_col, shingle, carry).withColumn("row", F.monotonically_increasing_id())
    marked, _ = stored(numbered, "marked-rows")  # numbers are fixed once written
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "fp", "row")).alias("first")
    prints, _ = stored(marked.groupBy("fp").agg(first), "distinct-prints")
    found = components(fingerprint_links(prints.select("fp"), bits))
    linked = prints.join(found, prints.fp == found.node, "left").select(F.coalesce("root", "fp").alias("root"), "first")
    kept = linked.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return marked.join(kept, "row").select(*[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
