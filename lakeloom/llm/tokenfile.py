"""Token ids of a corpus in range-coded files, in ascending order of document id.

Documents are range-partitioned by id (and by their order where ids repeat) and sorted within partitions; each partition cuts its documents
into files of about ``FILE_IDS`` ids (whole documents, so a file is larger only where one document is).
A file is one value of the written table, in the shared folder, with the layout of ``rans``: the table
is the store that executors can reach on any file system, and each file in it decodes alone.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm import rans
from lakeloom.llm.bpewords import BYTE_LEVEL, special_splitter
from lakeloom.llm.common import input_bytes, slices, stored, texts_in_batches

#: Ids of a file; input bytes of a partition; pre-tokens that a worker remembers before it starts over.
FILE_IDS = 1 << 21
PARTITION_BYTES = 24 << 20
WORDS = 1_200_000
#: The same split for texts of characters under U+0250, whose letters, digits and spaces are few ranges.
LETTER, DIGIT, SPACE = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼-¾", "\\t-\\r \x85\xa0"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BEYOND = re.compile("[^\x00-\u024f]")


class Encoder:
    """Ids of texts as little-endian 32-bit numbers, by a byte-level BPE file of the tokenizers library.

    A text is cut at special strings and into pre-tokens, which BPE encodes one by one; the library encodes
    each pre-token the first time that it is met, all new ones of a batch at once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of the library's own cost twice the CPU time
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = special_splitter(list(added))
        self.special_ids = {s: np.array([i], "<u4").tobytes() for s, i in added.items()}
        self.word = regex.compile(BYTE_LEVEL)
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        split = self.word.findall if BEYOND.search(text) else LATIN.findall
        if not self.special or not (found := list(self.special.finditer(text))):
            return split(text)
        out, at = [], 0
        for m in found:
            out += split(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + split(text[at:])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 256):
            cut = [self.pieces(t) for t in texts[at : at + 256]]
            if len(self.known) > WORDS:
                self.known.clear()
            known = self.known
            new = list(set().union(*cut).difference(known))
            for w, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
                known[w] = self.special_ids.get(w) or array("I", e.ids).tobytes()
            for c in cut:
                yield b"".join(map(known.__getitem__, c))


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """The encoder of a file, kept in each worker from task to task."""
    return Encoder(path)


def partitions_for(docs: DataFrame) -> int:
    """Partitions such that one holds about ``PARTITION_BYTES`` of the input, by the plan's own statistics."""
    return int(min(max(input_bytes(docs) // PARTITION_BYTES + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 100_000))


def write_corpus(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written files: ``part``, ``seq`` (their order), ``n_ids`` and ``data``.

    Every row becomes a document of its ids and ``end_id``; a null text has the end alone. Null ids come first,
    rows of equal id in the order in which they are read, so that many of them fill many partitions. A very long text is a file of
    its own. An empty table gives no files.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = encoder_of(path), TaskContext.get().partitionId(), 0
        names: list = []
        lengths: list[int] = []
        held: list[bytes] = []

        def file() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            data = rans.write_file(names, lengths, ids)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "data": pa.array([data], pa.binary())})

        n = 0
        for b in slices(batches):
            for name, ids in zip(b.column(0).to_pylist(), encoder.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                names.append(name)
                held.append(ids + end)
                lengths.append(len(held[-1]) // 4)
                n += lengths[-1]
                if n >= FILE_IDS:
                    yield file()
                    n, seq, names, lengths, held = 0, seq + 1, [], [], []
        if names:
            yield file()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("at"))
    rows = rows.repartitionByRange(partitions_for(rows), "id", "at").sortWithinPartitions("id", "at").select("id", "text")
    return stored(texts_in_batches(rows).mapInArrow(run, "part int, seq int, n_ids bigint, data binary"), "token-files")[0]


def read_corpus(files: DataFrame, id_type: str = "bigint") -> DataFrame:
    """``id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document of the written files, all checksums verified.

    Files decode independently of each other; within a file any block does, from its checkpoint (:class:`rans.TokenFile`).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                file = rans.TokenFile(data.as_py())
                names, lengths, ids = file.doc_ids, file.lengths, file.all().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                sums = [zlib.crc32(ids[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, type=pa.int64() if id_type == "bigint" else None), pa.array(starts + base), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"]
                )

    # One row per file of about two million ids: the running sum over files is short beside the corpus.
    totals = files.select("part", "seq", "n_ids")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("part", "seq", "data").join(totals.select("part", "seq", before.alias("base")), ["part", "seq"])
    return placed.select("base", "data").mapInArrow(run, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
