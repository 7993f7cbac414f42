"""The dear steps of line de-duplication in Arrow batches: signatures, sketches, pairs of wide bands and decisions.

They stand in for the SQL functions of the same names in :mod:`linededup` where these exceed the check's budget, and
give the same columns. Hashes differ, so the two forms may miss different ones of the few links that MinHash misses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import slices, stored, texts_in_batches
from lakeloom.llm.linededup import BANDS, BLANK, BLOCK, ROWS, SEED, SKETCH, Steps, members_by_band

#: Characters whose shingles are hashed at once, characters of texts gathered at once, and rows of pairs held at once.
STRETCH, GATHER, CHUNK = 1 << 17, 1 << 20, 100_000
#: Lines of a group that are compared by shifting, and lines of a stripe of a larger group.
SMALL, STRIPE = 64, 64


def shingles(lines: list[str], k: int, kind: type, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all lines in turn, and where each line's begin; a shorter line is its own only shingle."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(kind)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    n = np.maximum(sizes - (k - 1), 1)
    padded = np.r_[points, np.zeros(k, kind)]
    h = np.zeros(len(points), kind)
    for j in range(k):
        h = h * kind(factor) + padded[j : j + len(points)]
    heads = np.cumsum(sizes) - sizes
    for i in np.flatnonzero(sizes < k).tolist():
        x = 0
        for c in points[heads[i] : heads[i] + sizes[i]].tolist() + [0] * (k - int(sizes[i])):
            x = (x * factor + c) & (2 ** (8 * h.itemsize) - 1)
        h[heads[i]] = x
    starts = np.cumsum(n) - n
    return h[np.repeat(heads - starts, n) + np.arange(int(n.sum()))], starts


def stretches(lines: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of lines of about STRETCH characters."""
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    at = 0
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRETCH, "right")))
        yield at, to
        at = to


def band_keys(lines: list[str], k: int) -> np.ndarray:
    """Band keys of each line: one row of BANDS signed 64-bit numbers, each of the minima of ROWS orders of all shingles."""
    rng = np.random.default_rng(SEED)
    turns = (rng.integers(0, 1 << 32, (BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    out = np.empty((len(lines), BANDS), np.uint64)
    for at, to in stretches(lines):
        h, starts = shingles(lines[at:to], k, np.uint32, 0x9E3779B1)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h ^= h >> np.uint32(shift)
            h *= np.uint32(factor)
        for b in range(BANDS):
            key = np.full(to - at, b + 1, np.uint64)
            for r in range(ROWS):
                turn, shift = turns[b * ROWS + r]
                low = np.minimum.reduceat((h ^ shift) * turn, starts).astype(np.uint64)
                key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            out[at:to, b] = key
    return out.view(np.int64)


def _lines(texts: list[str], at: int) -> tuple[dict[str, int], list[int], list[int], list[int], int]:
    """Distinct lines of about GATHER characters of texts from ``at`` on, numbered; text, position and number of each line; the next text."""
    numbers: dict[str, int] = {}
    rows, places, which = [], [], []
    gathered = 0
    while at < len(texts) and gathered < GATHER:
        for pos, raw in enumerate(texts[at].split("\n")):
            if line := raw.strip(BLANK):
                rows.append(at)
                places.append(pos)
                which.append(numbers.setdefault(line, len(numbers)))
        gathered += len(texts[at])
        at += 1
    return numbers, rows, places, which, at


def _ids(lines, seed: int = 42) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), seed) for line in lines], np.uint64).view(np.int64)


def read(docs: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """As :func:`linededup.read`; texts are read once, and places and bands come from one written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, at = b.column(2).to_pylist(), 0
            while at < len(texts):
                numbers, rows, places, which, at = _lines(texts, at)
                if not rows:
                    continue
                lines, take, rows = list(numbers), np.array(which), pa.array(rows, pa.int64())
                bands = band_keys(lines, k)
                cols = [b.column(0).take(rows), b.column(1).take(rows), pa.array(places, pa.int32()), *(pa.array(_ids(lines, seed)[take]) for seed in (42, 7))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(bands[take, j]) for j in range(BANDS))], names=["doc", "of", "pos", "lid", "other", *(f"b{j}" for j in range(BANDS))])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("of"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    table, _ = stored(texts_in_batches(rows).mapInArrow(run, f"doc {kind}, of bigint, pos int, lid bigint, other bigint, " + ", ".join(f"b{j} bigint" for j in range(BANDS))), "lines")
    sig = table.groupBy("lid").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("lo"), F.max("other").alias("hi"), *[F.min(f"b{j}").alias(f"b{j}") for j in range(BANDS)])
    return sig.where("lo = hi").drop("lo", "hi"), table.select("doc", "of", "pos", "lid")


#: Bits of the filter that the texts' pass holds, whatever the input: 8 MB.
FILTER_BITS = 26


def texts_of(docs: DataFrame, text_col: str, ids: DataFrame) -> DataFrame:
    """As :func:`linededup.texts_of`; a filter of fixed size keeps most other lines, and repeats within a batch, out of the shuffle."""
    slot = F.col("lid").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = ids.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(lid & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    held[words.column(0).to_numpy()] = words.column(1).to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value.view(np.uint64)
        for b in slices(batches):
            texts, at = b.column(0).to_pylist(), 0
            while at < len(texts):
                numbers, *_, at = _lines(texts, at)
                lines = list(numbers)
                lid = _ids(lines)
                at_word = (lid & ((1 << FILTER_BITS) - 1)) >> 6
                keep = np.flatnonzero(bits[at_word] >> (lid & 63).astype(np.uint64) & np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(lid[keep]), pa.array([lines[i] for i in keep.tolist()], pa.string())], names=["lid", "line"])

    lines = texts_in_batches(docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL")).mapInArrow(run, "lid bigint, line string")
    return lines.join(ids, "lid", "left_semi").dropDuplicates(["lid"])


def shingle_sets(lines: list[str], k: int) -> list[np.ndarray]:
    """Each line's distinct shingles as ascending 64-bit hashes."""
    out = []
    for at, to in stretches(lines):
        h, starts = shingles(lines[at:to], k, np.uint64, 0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        ends = np.r_[starts[1:], len(h)]
        for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
            h[i:j].sort()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[starts] = True
        distinct = h[new]
        cuts = np.cumsum(new)[ends - 1]
        out += np.split(distinct, cuts[:-1])
    return out


def sketched(texts: DataFrame, k: int) -> DataFrame:
    """``lid``, ``n`` (distinct shingles) and the words ``w0``, ``w1``, ... of each line: a shingle toggles one bit."""
    width = 64 * SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column(1).to_pylist(), k)
            n = np.array([len(s) for s in sets])
            bit = np.repeat(np.arange(len(sets)) * width, n) + (np.concatenate(sets) & np.uint64(width - 1)).astype(np.int64)
            bits = (np.bincount(bit, minlength=len(sets) * width) & 1).astype(np.uint8).reshape(len(sets), width)
            words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(words[:, w]) for w in range(SKETCH))], names=["lid", "n", *(f"w{w}" for w in range(SKETCH))])

    return texts.select("lid", "line").mapInArrow(run, "lid bigint, n bigint, " + ", ".join(f"w{w} bigint" for w in range(SKETCH)))


def near_in_chunk(group: np.ndarray, number: np.ndarray, side: np.ndarray, lid: np.ndarray, root: np.ndarray, n: np.ndarray, words: np.ndarray, bands: np.ndarray, similarity: float, all_of_them: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unlike roots inside the groups of one chunk that can reach the similarity; ``group`` is ascending.

    Either all of them whose group is the first band that both share, or for each line the one most alike.
    """
    words = words.view(np.uint64)  # numpy counts the bits of a signed number's absolute value
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    best, partner = np.full(len(group), -1.0), np.zeros(len(group), np.int64)
    s = similarity - 1e-9

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        unlike = root[i] != root[j]
        i, j = i[unlike], j[unlike]
        apart = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
        total = n[i] + n[j]
        ok = (n[i] >= s * n[j]) & (n[j] >= s * n[i]) & (total - apart >= s * (total + apart))
        i, j = i[ok], j[ok]
        if all_of_them:
            earlier = ((bands[i] == bands[j]) & (np.arange(BANDS) < number[i][:, None])).any(axis=1)
            found.append((lid[i[~earlier]], lid[j[~earlier]]))
            return
        alike = (total - apart)[ok] / (total + apart)[ok]
        for x, y in ((i, j), (j, i)):
            order = np.argsort(alike, kind="stable")  # of repeated lines the last assignment, the most alike, stays
            x, y, a = x[order], y[order], alike[order]
            better = a > best[x]
            best[x[better]], partner[x[better]] = a[better], lid[y[better]]

    small = np.repeat(sizes <= SMALL, sizes) & (side == 2)
    for step in range(1, SMALL):
        near = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
        if not len(near):
            break
        meet(near, near + step)
    for at, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        if size > 1 and not small[at]:
            rows = np.arange(at, at + size)
            left, right = rows[side[rows] != 1], rows[side[rows] != 0]
            for x in range(0, len(left), STRIPE):
                i, j = np.meshgrid(left[x : x + STRIPE], right, indexing="ij")
                once = (i < j) if side[at] == 2 else np.ones(i.shape, bool)
                meet(i[once], j[once])
    if not all_of_them:
        has = np.flatnonzero(best >= 0)
        found.append((lid[has], partner[has]))
    a, b = (np.concatenate([lid[:0], *(f[k] for f in found)]) for k in (0, 1))
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pair[0], pair[1]


def other_pairs(members: DataFrame, sig: DataFrame, roots: DataFrame, sketches: DataFrame, similarity: float, all_of_them: bool) -> tuple[DataFrame, str]:
    """As :func:`linededup.other_pairs`: tasks hold whole pairs of blocks and compare them in arrays."""
    own = members_by_band(members, sig, roots, sketches, BLOCK)
    own = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("with"), 2).when(F.col("block") < F.col("with"), 0).otherwise(1)
    keys = ["band", "lo", "hi"]
    rows = own.select("band", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "k", side.alias("side"), "lid", "root", "n", *[f"w{w}" for w in range(SKETCH)], *[f"b{b}" for b in range(BANDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(last: bool) -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            new = np.zeros(len(cols[0]), bool)
            new[0] = True
            for c in cols[:3]:
                new[1:] |= c[1:] != c[:-1]
            cut = len(new) if last else int(np.flatnonzero(new)[-1])
            held[:] = [] if last else [[c[cut:] for c in cols]]
            if not cut:
                return pa.RecordBatch.from_arrays([pa.array(cols[5][:0])] * 2, names=["a", "b"])
            number, sides, lid, root, n = (c[:cut] for c in cols[3:8])
            words, bands = (np.stack([c[:cut] for c in part], axis=1) for part in (cols[8 : 8 + SKETCH], cols[8 + SKETCH :]))
            a, b = near_in_chunk(np.cumsum(new)[:cut], number, sides, lid, root, n, words, bands, similarity, all_of_them)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(h[0]) for h in held) >= CHUNK:
                yield flush(False)
        if held:
            yield flush(True)

    return stored(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint").distinct(), "line-pairs")


def decided(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs whose whole shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, y, tx, ty = (b.column(i).to_pylist() for i in range(4))
            lines = dict(zip(x + y, tx + ty, strict=True))
            sets = dict(zip(lines, shingle_sets(list(lines.values()), k), strict=True))
            keep = []
            for p, q in zip(x, y, strict=True):
                common = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                keep.append(common >= similarity * (len(sets[p]) + len(sets[q]) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: texts.select(F.col("lid").alias(c), F.col("line").alias(f"t{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


ARROW = Steps(read, texts_of, sketched, other_pairs, decided)
