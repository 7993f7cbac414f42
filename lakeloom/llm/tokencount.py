"""Exact token counts at every prefix by dynamic programming over BPE.

In BPE a sequence of tokens is an encoding if and only if each token encodes to itself and each
neighbouring pair, joined, encodes to the same pair. So for every prefix of a pre-token there is one
last token that fits the encoding of what precedes it, and the count at a prefix is the count before
its last token plus one. The table of counts answers how many tokens any prefix has, and which is the
longest prefix within a budget, without encoding again. A worker stores the table of every pre-token that it
meets; totals, truncations and the tables of whole texts are all read from these.

The vocabulary marks word ends, so two tables run side by side: over prefixes that go on, and over
prefixes that end here (the last token carries the mark). The second is the count of the prefix as a
text of its own. Pre-tokens add up; white space has no token.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.bpewords import WORD_END, byte_alphabet, special_splitter
from lakeloom.llm.common import slices, texts_in_batches

#: Pre-tokens and pairs of tokens that a worker remembers before it starts over.
WORDS, PAIRS = 800_000, 1_000_000
#: Below this all letters are composed already and lower-case one by one.
PLAIN = regex.compile("[^\x00-\u02ff]")

#: The end of a stretch that characters after it may join.
JOINED = re.compile(r"\S*\Z")

#: The same split over ASCII alone, lower-cased.
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")


class PrefixCounter:
    """Counts for a tokenizers file of BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not self.suffix or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        made = {a + b for a, b in self.rank}
        alphabet = byte_alphabet()
        self.tokens = {*made, *alphabet, *(c + self.suffix for c in alphabet)} & set(model["vocab"])
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.tokens)
        self.byte_of = str.maketrans({bytes([b]).decode("latin-1"): alphabet[b] for b in range(256)})
        self.library = Tokenizer.from_file(path)
        self.special = special_splitter([t["content"] for t in spec["added_tokens"]])
        self.word = regex.compile(WORD_END)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.tokens = frozenset(t for t in self.tokens if self.merged(self.symbols(t)) == [t])
        self.tables: dict[str, tuple[str, tuple[str, ...], bytes | array]] = {}
        self.totals = _Totals(self)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE over symbols: the earliest merge first, leftmost first."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best, at = min(((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))))
            if best == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.suffix)
        return [*body[:-1], body[-1] + token[len(body) :]]

    def fits(self, a: str, b: str) -> bool:
        """Whether tokens ``a``, ``b`` side by side encode to themselves."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged([*self.symbols(a), *self.symbols(b)]) == [a, b]
        return known

    def begun(self, s: str, upto: int) -> tuple[list[str], list[int]]:
        """Last token and count of the prefixes 0 to ``upto`` of byte characters ``s``, as beginnings."""
        last, counts = [""], [0]
        tokens, pairs, longest = self.tokens, self.pairs, self.longest
        for j in range(1, upto + 1):
            for i in range(max(0, j - longest), j):
                piece = s[i:j]
                if piece in tokens:
                    if not i or ((fit := pairs.get((last[i], piece))) is None and self.fits(last[i], piece)) or fit:
                        last.append(piece)
                        counts.append(counts[i] + 1)
                        break
        return last, counts

    def ended(self, s: str, j: int, last: list[str], counts: list[int]) -> int:
        """Count of the prefix ``j`` as a whole, given the tables of beginnings."""
        for i in range(max(0, j - self.longest), j):
            piece = s[i:j] + self.suffix
            if piece in self.tokens and (not i or self.fits(last[i], piece)):
                return counts[i] + 1
        return 0

    def as_bytes(self, word: str) -> str:
        return word.encode("utf-8").decode("latin-1").translate(self.byte_of)

    def table(self, word: str) -> tuple[str, tuple[str, ...], bytes | array]:
        """The stored table of a pre-token: its byte characters, and last token and count at each of its beginnings."""
        if (found := self.tables.get(word)) is None:
            s = self.as_bytes(word)
            last, counts = self.begun(s, len(s) - 1)
            found = self.tables[word] = s, tuple(last), bytes(counts) if counts[-1] < 256 else array("I", counts)
        return found

    def word_prefixes(self, word: str) -> list[int]:
        """Tokens of the first 1, 2, ... characters of a pre-token, each as a text of its own: one token after what its table has."""
        s, last, counts = self.table(word)
        out = [self.ended(s, j, last, counts) for j in accumulate(len(c.encode("utf-8")) for c in word)]
        if len(word) == 3 and word[0] == "'" and word != "'''" and word[1].isalpha():
            out[1] = out[0] + self.totals[word[1]]  # half a contraction is an apostrophe and a letter
        return out

    def forget(self) -> None:
        """Starts over where the stored tables are many."""
        if len(self.totals) > WORDS:
            self.totals.clear()
            self.tables.clear()

    def normal(self, text: str) -> str:
        """The text as the vocabulary's normalizer leaves it, white space aside."""
        return self.library.normalizer.normalize_str(text) if PLAIN.search(text) else text.lower()

    def words(self, part: str) -> list[str]:
        """The pre-tokens of a normalised stretch."""
        return ASCII_WORD.findall(part) if part.isascii() else self.word.findall(part)

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of a text and whether each is a special string."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield self.normal(text[at : m.start()]), False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield self.normal(text[at:]), False

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        total = 0
        for part, special in self.segments(text):
            total += 1 if special else sum(map(self.totals.__getitem__, self.words(part)))
        self.forget()
        return total

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of the first 0, 1, 2, ... characters of the normalised text.

        A special string counts as one token where it is complete; up to there its characters count as they are.
        """
        counts, total, before = [0], 0, ""  # before: what the next characters may join, back to white space
        for part, special in self.segments(text):
            if special:
                settled = total - self.count(before)
                counts += [settled + self.count(before + part[:k]) for k in range(1, len(part))]
                total, before = total + 1, ""
                counts.append(total)
                continue
            at = 0
            for m in self.word.finditer(part):
                counts += [total] * (m.start() - at)
                inside = self.word_prefixes(m.group())
                counts += [total + c for c in inside]
                total, at = total + inside[-1], m.end()
            counts += [total] * (len(part) - at)
            before = JOINED.search(part).group()
        self.forget()
        return counts

    def longest_within(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the text, and the characters of its longest prefix (normalised) of at most ``budget`` tokens.

        Counts at word ends come from the sums; in the word that crosses the budget its stored table decides.
        """
        total = chars = 0
        cut = None
        for part, special in self.segments(text):
            if special:
                total += 1
                if cut is None and total > budget:
                    cut = chars
            else:
                before = total
                total += sum(map(self.totals.__getitem__, self.words(part)))
                if cut is None and total > budget:
                    for found in self.word.finditer(part):
                        if before + self.totals[found.group()] > budget:
                            fit = [j + 1 for j, c in enumerate(self.word_prefixes(found.group())) if before + c <= budget]
                            cut = chars + found.start() + (fit[-1] if fit else 0)
                            break
                        before += self.totals[found.group()]
            chars += len(part)
        self.forget()
        return total, chars if cut is None else cut


class _Totals(dict):
    """Tokens of whole pre-tokens, read from their stored tables."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        s, last, counts = self.counter.table(word)
        out = self[word] = self.counter.ended(s, len(s), last, counts)
        return out


@lru_cache(2)
def counter_of(path: str) -> PrefixCounter:
    """The counter of a file, kept in each worker from task to task."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens`` and ``within`` of every row.

    ``within`` is the number of characters (of the normalised text) of the longest prefix of at most ``limit``
    tokens. A null text counts as an empty one; a very long one is read whole, in time in proportion. Rows, equal ones too, repeat as
    they do in ``docs``; other columns are not read. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [counter.longest_within(t, limit) for t in texts]
            cols = [b.column(0), b.column(2), *(pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_bytes", "n_tokens", "within"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return texts_in_batches(rows).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, within bigint")


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``counts``: the tokens of the first 0, 1, 2, ... characters of every (normalised) text, stored as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for b in slices(batches):
            tables = [counter.prefix_counts(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tables, pa.list_(pa.int32()))], names=["id", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts_in_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, f"id {kind}, counts array<int>")
