"""Near-duplicate embeddings over a robust-pruned flat graph.

Vectors are compared within a label only. Copies collapse first. Centroids, fitted on a bounded sample, cut
each label into clusters; every vector goes to its two nearest, so clusters overlap. A cluster is a task of
bounded size (a larger one is dealt as pairs of blocks, so nothing is left out). Within a task the
members fall again into small overlapping shards; a graph is built on each by robust pruning (a neighbour is
dropped where a kept one is closer to it by a factor) and the shards' adjacency lists are united. Each
member then searches the flat graph greedily from the shards' medoids, and goes on expanding as long as
vectors within range turn up. What is found is verified by the cosine in double precision.

A task gives each member's number of links and a spanning forest of them, never all pairs: a pair that meets
in several tasks counts in the one that both ends name first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import forget, spanning_stars, stored
from lakeloom.llm.components import components

#: Vectors that the centroids are fitted on, the numbers of centroids to choose from, and members of a task.
SAMPLE, LEVELS, PER_CLUSTER, BLOCK = 32_768, (1, 8, 64, 512, 4096), 600, 768
#: Vector lengths with centroids of their own, the most frequent ones; vectors of other lengths are dealt as pairs of blocks.
WIDTHS = 64
#: Degree, candidates, pruning factor, width of the search, members of a shard, seeds.
DEGREE, CANDIDATES, ALPHA, WIDTH, PER_SHARD, SEED = 24, 48, 1.2, 24, 256, 11
#: Vectors that the audit searches for by brute force: so many of all, and so many of those found to have links.
AUDIT = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def centroids(vectors: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means over unit vectors."""
    rng = np.random.default_rng(SEED)
    k = max(1, min(k, len(vectors)))
    at = vectors[rng.choice(len(vectors), k, replace=False)]
    for _ in range(rounds):
        own = (vectors @ at.T).argmax(axis=1)
        total = np.zeros_like(at)
        np.add.at(total, own, vectors)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        at = np.where(size > 0, total / np.where(size > 0, size, 1), at)
    return at


def nearest(vectors: np.ndarray, at: np.ndarray, n: int = 2) -> np.ndarray:
    """The ``n`` nearest centroids of each vector, nearest first; the nearest again where there are fewer."""
    near = vectors @ at.T
    if at.shape[0] <= n:
        out = np.argsort(-near, axis=1, kind="stable")
        return np.concatenate([out, np.repeat(out[:, :1], n - out.shape[1], axis=1)], axis=1)
    top = np.argpartition(-near, n - 1, axis=1)[:, :n]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def pruned(vectors: np.ndarray) -> np.ndarray:
    """Robust-pruned neighbours of each member of a shard, -1 where fewer."""
    n = len(vectors)
    near = vectors @ vectors.T
    np.fill_diagonal(near, -2)
    c = min(CANDIDATES, n - 1)
    cand = np.argsort(-near, axis=1, kind="stable")[:, :c]
    apart = 2 - 2 * np.take_along_axis(near, cand, 1)
    between = 2 - 2 * near[cand[:, :, None], cand[:, None, :]]
    alive = np.ones((n, c), bool)
    out = np.full((n, DEGREE), -1, np.int64)
    rows = np.arange(n)
    for d in range(min(DEGREE, c)):
        any_left = alive.any(axis=1)
        first = alive.argmax(axis=1)
        out[:, d] = np.where(any_left, cand[rows, first], -1)
        alive &= ALPHA * ALPHA * between[rows, first] > apart
        alive[rows, first] = False
    return out


def flat_graph(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """United adjacency lists (padded with -1) of overlapping shards, and the shards' medoids."""
    n = len(vectors)
    k = -(-n // PER_SHARD)
    at = centroids(vectors, k)
    own = nearest(vectors, at)
    ends: list[np.ndarray] = []
    medoids = []
    for s in range(len(at)):
        members = np.flatnonzero((own == s).any(axis=1))
        if not len(members):
            continue
        medoids.append(members[(vectors[members] @ at[s]).argmax()])
        for part in np.array_split(members, -(-len(members) // (4 * PER_SHARD))):
            if len(part) < 2:
                continue
            links = pruned(vectors[part])
            i, d = np.nonzero(links >= 0)
            ends.append(np.stack([part[i], part[links[i, d]]]))
    medoids = np.unique(np.array(medoids, np.int64))
    a, b = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
    # Every node is reached from a medoid: what is not hangs on the first medoid.
    reached, front = np.zeros(n, bool), medoids
    reached[front] = True
    both_a, both_b = np.r_[a, b], np.r_[b, a]
    while True:
        while True:
            grown = reached.copy()
            grown[both_b[reached[both_a]]] = True
            if grown.sum() == reached.sum():
                break
            reached = grown
        if reached.all():
            break
        lost = int(np.flatnonzero(~reached)[0])
        both_a, both_b = np.r_[both_a, medoids[0], lost], np.r_[both_b, lost, medoids[0]]
        reached[lost] = True
    pair = np.unique(both_a * n + both_b)
    a, b = pair // n, pair % n
    degree = np.bincount(a, minlength=n)
    lists = np.full((n, max(1, int(degree.max(initial=0)))), -1, np.int64)
    lists[a, np.arange(len(a)) - (np.cumsum(degree) - degree)[a]] = b
    return lists, medoids


def range_search(vectors: np.ndarray, lists: np.ndarray, medoids: np.ndarray, queries: np.ndarray, least: float) -> np.ndarray:
    """For each query the members seen within range: greedy from the medoids, then on through all that are within range."""
    found = np.zeros((len(queries), len(vectors)), bool)
    for at in range(0, len(queries), 192):
        q = queries[at : at + 192]
        score = np.full((len(q), len(vectors)), -2.0, np.float32)
        fresh = np.full_like(score, -2.0)
        score[:, medoids] = fresh[:, medoids] = q @ vectors[medoids].T
        active = np.arange(len(q))
        while len(active):
            best = fresh[active].argmax(axis=1)
            value = fresh[active, best]
            better = ((score[active] >= value[:, None]) & (fresh[active] <= -2)).sum(axis=1)
            go = (value > -2) & ((value >= least) | (better < WIDTH))
            active, best = active[go], best[go]
            if not len(active):
                break
            fresh[active, best] = -2
            next_to = lists[best]
            r, c = np.nonzero(next_to >= 0)
            node, row = next_to[r, c], active[r]
            new = score[row, node] <= -2
            node, row = node[new], row[new]
            value = np.maximum(np.einsum("ij,ij->i", q[row], vectors[node]), -1.5)
            score[row, node] = fresh[row, node] = value
        found[at : at + 192] = score >= least
    return found


def links_in_task(ids: np.ndarray, vectors: np.ndarray, weight: np.ndarray, mine: np.ndarray, other: np.ndarray, task: int, cross: bool, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of links of each member that this task answers for, and a forest of the verified links."""
    exact = unit(vectors.astype(np.float64))
    single = exact.astype(np.float32)
    lists, medoids = flat_graph(single)
    seen = range_search(single, lists, medoids, single, least - 1e-4)
    seen |= seen.T
    np.fill_diagonal(seen, False)
    if cross:
        seen &= side[:, None] != side[None, :]
    a, b = np.nonzero(np.triu(seen))
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 18):
        i, j = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
        keep[at : at + (1 << 18)] = np.einsum("ij,ij->i", exact[i], exact[j]) >= least
    a, b = a[keep], b[keep]
    # Shared clusters of a pair: this one, and perhaps the other; the lower number counts.
    lower = np.minimum(mine, other)
    upper = np.maximum(mine, other)
    both = (lower[a] == lower[b]) & (upper[a] == upper[b]) & (lower[a] != upper[a])
    counts = ~both | (lower[a] == task)
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a[counts], weight[b[counts]])
    np.add.at(links, b[counts], weight[a[counts]])
    u, v = spanning_stars(ids[a], ids[b])
    return links, u, v


def _some(rows: DataFrame, n: int, of: int, *by: str) -> DataFrame:
    """About ``n`` of the ``of`` rows, chosen by a hash of columns."""
    return rows.where(F.pmod(F.xxhash64(F.lit(SEED), *by), F.lit(1 << 40)) < F.lit(int(min(1.0, n / max(1, of)) * (1 << 40))))


def _fitted(distinct: DataFrame) -> dict[int, list[np.ndarray]]:
    """Centroids of each level that the vectors of a length need, by length; fitted on about SAMPLE distinct vectors of it."""
    sizes = distinct.groupBy("space", F.size("e").alias("w")).agg(F.count(F.lit(1)).alias("n")).groupBy("w").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    levels = {}
    for r in sizes.orderBy(F.desc("n"), "w").limit(WIDTHS).collect():
        upto = int(np.searchsorted(np.array(LEVELS[:-1]) * PER_CLUSTER, r["most"]))
        of_width = distinct.where(F.size("e") == r["w"]).select("e")
        got = _some(of_width, SAMPLE if upto else 1, r["n"], "e").collect()
        sample = unit(np.array(sorted(v["e"] for v in got) or [[1.0] * r["w"]], np.float64))
        levels[r["w"]] = [centroids(sample, k) for k in LEVELS[: upto + 1]]
    return levels


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """``id``, ``n_links`` and ``component`` of every row of ``vectors``, and its ``space`` (label and length) and vector ``e``.

    Vectors that are null, zero or hold null or non-finite numbers, and rows of a null label, link with nothing (null ``space``).
    Vectors of unlike lengths never link. Every row counts as a vector of its own, rows with equal ids or vectors too; ids
    are whole numbers. A null id links like any other and is a component's id only where it has no other. No rows give no rows;
    other columns are not read.
    """
    spark = vectors.sparkSession
    e = F.col("e")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("e"))
    sound = F.col("label").isNotNull() & e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows, _ = stored(rows.select("id", F.when(F.coalesce(sound, F.lit(False)), F.concat_ws(":", F.size("e"), "label")).alias("space"), F.when(sound, F.transform(e, lambda x: x + 0.0)).alias("e")), "vectors")
    distinct = rows.where("space IS NOT NULL").groupBy("space", "e").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    distinct, distinct_path = stored(distinct.withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors")  # numbers are fixed once written
    sizes = distinct.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    shared = spark.sparkContext.broadcast(_fitted(distinct))  # bounded by the levels

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, vec = b.column(3).to_numpy(), b.column(4).to_pylist()
            at = np.zeros((b.num_rows, 2), np.int64)
            width = np.array([len(v) for v in vec])
            level = np.searchsorted(np.array(LEVELS[:-1]) * PER_CLUSTER, n)
            for w in np.unique(width):
                if int(w) not in shared.value:
                    continue
                for k in np.unique(level[width == w]):
                    here = np.flatnonzero((width == w) & (level == k))
                    at[here] = nearest(unit(np.array([vec[i] for i in here], np.float64)), shared.value[int(w)][k])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(at[:, 0]), pa.array(at[:, 1])], names=["space", "rep", "copies", "e", "mine", "other"])

    dealt = distinct.join(sizes, "space").select("space", "rep", "copies", "n", "e")
    dealt = dealt.mapInArrow(deal, "space string, rep bigint, copies bigint, e array<double>, mine bigint, other bigint")
    dealt, dealt_path = stored(dealt.select("*", F.explode(F.array_distinct(F.array("mine", "other"))).alias("task")), "dealt-vectors")
    wide = dealt.groupBy("space", "task").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).cast("int").alias("blocks")).where("blocks > 1")
    # A task's members number up to two blocks; a wider cluster is cut in twice as many blocks and dealt by pairs.
    parts = dealt.join(wide, ["space", "task"], "left").withColumn("blocks", F.coalesce(F.col("blocks") * 2, F.lit(1)))
    parts = parts.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = parts.withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with"))

    def work(key, table):
        _, task, lo, hi = (k.as_py() for k in key)
        ids = table.column("rep").to_numpy()
        if len(ids) < 2:
            u = v = n = np.zeros(0, np.int64)
            who = ids[:0]
        else:
            raw = np.array(table.column("e").to_pylist(), np.float64)
            links, u, v = links_in_task(ids, raw, table.column("copies").to_numpy(), table.column("mine").to_numpy(), table.column("other").to_numpy(), task, lo != hi, table.column("block").to_numpy(), least)
            who, n = ids[links > 0], links[links > 0]
        return pa.table({"a": np.r_[who, u], "b": np.r_[who, v], "n": np.r_[n, np.zeros(len(u), np.int64)]})

    found, found_path = stored(parts.select("space", "task", "lo", "hi", "rep", "copies", "e", "mine", "other", "block").groupBy("space", "task", "lo", "hi").applyInArrow(work, "a bigint, b bigint, n bigint"), "vector-links")
    forget(spark, dealt_path)
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.where("a <> b").select("a", "b"))
    of_rep = distinct.select("rep", "least_id", "copies").join(counts, F.col("rep") == F.col("a"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    of_rep, of_rep_path = stored(of_rep.select("rep", "least_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "vector-roots")
    forget(spark, found_path)
    least_ids = of_rep.groupBy("root").agg(F.min("least_id").alias("component"))
    reps = distinct.select("space", "e", "rep").join(of_rep.join(least_ids, "root").select("rep", "n_links", "component"), "rep")
    linked = rows.where("space IS NOT NULL").join(reps, ["space", "e"]).select("id", "n_links", "component", "space", "e")
    alone = rows.where("space IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), "space", "e")
    out, _ = stored(linked.unionByName(alone), "vector-classes")
    forget(spark, distinct_path)
    forget(spark, of_rep_path)
    return out


def audit(found: DataFrame, least: float = 0.98, queries: int = AUDIT) -> tuple[float | None, int]:
    """Recall of the links of some vectors against all of ``found`` by brute force, and the number of their true links.

    About ``queries`` of all vectors are asked for, and as many of those with links, chosen by a hash of the vector. Where the vectors
    asked for have no true link, as in an empty table, the recall is null. Rows without a ``space`` have no links and are left out;
    equal vectors are asked for together.
    """
    rows = found.where("space IS NOT NULL").select("id", "n_links", "space", "e")
    n, linked = rows.agg(F.count(F.lit(1)), F.count_if(F.col("n_links") > 0)).first()
    some = _some(rows, queries, n, "e").unionByName(_some(rows.where("n_links > 0"), queries, linked, "space", "e"))
    asked = [(r["space"], np.array(r["e"]), r["n_links"]) for r in some.dropDuplicates(["space", "e"]).orderBy("space", "e").collect()]
    if not asked:
        return None, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(len(asked), np.int64)
        for b in batches:
            by: dict = {}
            for space, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(space, []).append(e)
            units = {k: unit(np.array(v, np.float64)) for k, v in by.items()}
            for i, (space, e, _) in enumerate(asked):
                if space in units:
                    tally[i] += int((units[space] @ (e / np.sqrt(e @ e)) >= least).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(asked))), pa.array(tally)], names=["k", "n"])

    truth = {r["k"]: r["n"] - 1 for r in rows.select("space", "e").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    true = sum(truth[i] for i in range(len(asked)))
    return (sum(min(a[2], truth[i]) for i, a in enumerate(asked)) / true if true > 0 else None), max(0, true)
