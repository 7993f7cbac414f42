"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are runs of 2, 3 and 4 characters of the lower-cased text, all that is not a letter read as one
space; they are hashed to buckets, whose embeddings are averaged over the whole text. Training is
stochastic gradient descent in numpy, a document at a step, over a bounded sample of labelled rows, of every
language as many. On rows of the sample that training leaves out, a temperature calibrates the probabilities
and a threshold is set under which a prediction is rejected.

As averaging and the softmax's weights are both linear, the trained model folds into one table of scores
per bucket and language; a worker looks up that table for each subword.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import slices, stored, texts_in_batches

#: Labelled rows that training gathers, dealt evenly among the languages, and those that each language may give at least.
SAMPLE, LEAST = 3000, 50
BUCKETS, WIDTH, ORDERS = 1 << 15, 16, (2, 3, 4)
EPOCHS, RATE, SEED = 4, 0.5, 7
#: Share of right predictions among the rows left out of training that may be rejected.
REJECT = 0.002
#: Characters looked up at once.
STRETCH = 1 << 20
UNDETERMINED = "und"


class Model(NamedTuple):
    langs: tuple[str, ...]
    scores: np.ndarray  # buckets by languages
    bias: np.ndarray
    temperature: float
    threshold: float


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def characters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of others than letters as one space, a space at both ends; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    points = np.where(is_letter, points, 32)
    keep = np.r_[True, is_letter[1:] | is_letter[:-1]]
    return np.concatenate([[32], points[keep], [32]]).astype(np.uint32)


def subwords(points: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the subwords of each order, a stretch of text at a time."""
    for at in range(0, max(1, len(points)), STRETCH):
        part = points[at : at + STRETCH + ORDERS[-1] - 1]
        last = at + STRETCH >= len(points)
        h = part * np.uint32(0x9E3779B1)
        for order in range(2, ORDERS[-1] + 1):
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + part[order - 1 :] * np.uint32(0x9E3779B1)
            if order in ORDERS:
                mixed = h ^ (h >> np.uint32(16))
                yield (mixed if last else mixed[:STRETCH]) & np.uint32(BUCKETS - 1)


def counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's subwords and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    if len(points):
        for buckets in subwords(points):
            total += np.bincount(buckets, minlength=BUCKETS)
    where = np.flatnonzero(total)
    return where, total[where]


def train(texts: list[str], langs: list[str]) -> Model:
    """A model of labelled texts."""
    return learnt([(*counted(characters(t)), lang) for t, lang in zip(texts, langs, strict=True)])


def learnt(examples: list[tuple[np.ndarray, np.ndarray, str]]) -> Model:
    """A model of the subword counts of labelled texts; with no text that has a letter, a model of no languages."""
    examples = [e for e in examples if len(e[0])]
    known = tuple(sorted({lang for _, _, lang in examples}))
    if not known:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rows = [(where, (counts / counts.sum()).astype(np.float32), known.index(lang)) for where, counts, lang in examples]
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(rows))
    cut = max(1, len(rows) - len(rows) // 5)
    fit, left_out = order[:cut], order[cut:]
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, len(known)), np.float32), np.zeros(len(known), np.float32)
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(fit):
            where, share, lang = rows[k]
            rate = RATE * (1 - done / steps)
            done += 1
            part = table[where]
            mean = share @ part
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[lang] -= 1
            back = weights @ p
            weights -= rate * np.outer(mean, p)
            bias -= rate * p
            # Each bucket's share of the mean is small; the embeddings' own rate makes up for that.
            table[where] = part - (rate * len(where) * share)[:, None] * back[None, :] * 0.1
    scores = table @ weights
    z = np.array([rows[k][1] @ scores[rows[k][0]] + bias for k in left_out]).reshape(-1, len(known))
    right = np.array([rows[k][2] for k in left_out], int)

    def chances(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = [0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0]
    loss = lambda t: -np.log(np.maximum(chances(t)[np.arange(len(right)), right], 1e-12)).mean()
    temperature = min(grid, key=loss) if len(right) else 1.0
    threshold = 0.0
    if len(right):
        p = chances(temperature)
        hit = p.argmax(axis=1) == right
        threshold = float(min(0.5, np.quantile(p.max(axis=1)[hit], REJECT))) if hit.any() else 0.0
    return Model(known, scores.astype(np.float32), bias.astype(np.float64), float(temperature), threshold)


def predict(model: Model, text: str | None) -> tuple[str, float]:
    """Language and calibrated probability; ``und`` and 0 for a null text or one without letters."""
    points = characters(text or "")
    if not len(points) or not model.langs:
        return UNDETERMINED, 0.0
    total, n = np.zeros(len(model.langs)), 0
    for buckets in subwords(points):
        total += model.scores[buckets].sum(axis=0, dtype=np.float64)
        n += len(buckets)
    z = (total / max(1, n) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    k = int(p.argmax())
    return model.langs[k], float(p[k])


def held_out(id_col: str):
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> DataFrame:
    """Labelled rows for training: ``h`` (hash of the text), ``lang``, ``buckets`` and ``counts`` (the subwords of a whole text), one row per different text.

    Of each language about ``most / languages`` texts are taken, and ``LEAST`` at least, by a hash of the text; a language that has
    fewer gives all. The rows are counted where they lie: what reaches the driver depends on ``most`` and not on the input.
    """
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"))
    keys, _ = stored(rows.select("lang", "h").distinct(), "labelled-texts")
    counts = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    each = max(LEAST, most // max(1, counts.count()))
    share = F.pmod(F.xxhash64(F.lit(SEED), F.col("h")), F.lit(1 << 30)) < F.ceil(F.lit(float(each << 30)) / F.col("n"))
    chosen = keys.join(counts, "lang").where(share).select("lang", "h")
    picked = rows.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"])  # about ``most`` rows of a label and a number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [counted(characters(t)) for t in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), *(pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "lang", "buckets", "counts"])

    return texts_in_batches(picked.select("h", "lang", "text")).mapInArrow(run, "h bigint, lang string, buckets array<int>, counts array<int>").where("size(buckets) > 0")


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> Model:
    """The model that the labelled rows of ``docs`` teach.

    Null texts, texts without a letter, null labels and held-out rows teach nothing; very long texts count whole, repeated ones once.
    An empty table, or one without labels, gives a model of no languages. One task learns, the sample is bounded; only the model
    reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            buckets, counts = batch.column(2), batch.column(3)
            cuts = buckets.offsets.to_numpy()
            where, n = buckets.values.to_numpy(), counts.values.to_numpy()
            examples += [(h, lang, where[i:j], n[i:j]) for h, lang, i, j in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        model = learnt([(w, c, lang) for _, lang, w, c in sorted(examples, key=lambda e: (e[1], e[0]))])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = sample(docs, id_col, text_col, lang_col, most).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else learnt([])


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The ``carry`` columns (as ``carry_0``, ...), ``id``, ``lang_pred``, ``score`` and ``rejected`` of every row.

    The text alone decides. A null text or one without letters is ``und``, score 0, rejected; so is everything
    under a model of no languages. A score under the model's threshold is rejected. Rows repeat as in ``docs``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some megabytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            found = [predict(m, t) for t in b.column("text").to_pylist()]
            names = [n for n in b.schema.names if n != "text"]
            cols = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([f[0] for f in found]), pa.array([f[1] for f in found]), pa.array([f[0] == UNDETERMINED or f[1] < m.threshold for f in found])],
                names=[*names, "lang_pred", "score", "rejected"],
            )

    carried = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).alias("id"), *carried, F.col(text_col).alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return texts_in_batches(rows).mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
