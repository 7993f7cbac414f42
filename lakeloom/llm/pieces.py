"""SentencePiece segmentation: N best by a forward Viterbi pass and a backward A-star search.

The lattice of a text has a node after each character and an edge for each piece that matches there,
weighted by the piece's score; a character that is no piece has one edge, ten under the least score, which
stands for its bytes. Forward Viterbi gives the best score from the start to each node. The search
runs backward from the end; what remains of a hypothesis is a path from the start to its node, for
which the Viterbi score is exact, so hypotheses leave the queue best first and no node is expanded
in vain. Equal scores prefer fewer pieces, then the hypothesis nearest the start, so ties never pile up.

Pieces have the space mark at their head or are made of marks, so the lattice falls into
independent stretches at the marks (and at characters that no longer piece holds). Each stretch is searched
once per worker, all new ones of a batch together in numpy arrays: a trie walk from all characters at once
gives the edges, the lattice is cut again wherever no edge crosses, and the Viterbi pass takes the nodes
at equal distance from their cut in one step, keeping the two best edges into each. The two best segmentations, which
the query reports, come from the backward search over these: each part has an agenda of open hypotheses, and a round takes
the best from the agendas of all parts at once (:meth:`Lattice._two_best`); long parts have a heap each. More than two
come from the queue of :meth:`Lattice.nbest`, which looks all edges up.

Memory is linear in the longest text of a batch (about 60 bytes a character); edges exist for WINDOW characters at a time.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import slices, texts_in_batches

MARK = "▁"
#: Characters of stretches that a worker remembers before it lets go of those not met since it last did.
REMEMBERED = 1_000_000
#: Characters whose edges are held at once.
WINDOW = 1 << 18
#: Characters of a part whose agenda is an array, and parts that are searched in the same rounds; a longer part has a heap.
SHORT, ABREAST = 48, 1 << 15


class Paths(NamedTuple):
    """Outcome of the forward pass over a run of stretches: of the node after each character, and of the independent parts."""

    first: np.ndarray  # whether no edge crosses into the character from before
    score: np.ndarray  # of the best way from the last cut to the node
    count: np.ndarray  # of pieces on the best way and on the one over the second best edge: two rows
    length: np.ndarray  # of the best and the second best edge: two rows
    piece: np.ndarray  # of these edges, -1 for a character's bytes: two rows
    loss: np.ndarray  # by entering over the second best edge, infinite where there is none
    heads: np.ndarray  # first characters of the independent parts
    ends: np.ndarray  # last characters


class Lattice:
    """Segmentation under the pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float, tuple[int]]] = {}
        self.byte_ids = np.zeros(256, np.uint32)
        self.texts: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.texts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.texts.append(b"")
            else:
                self.pieces[piece] = (i, model.get_score(i), (i,))
                self.texts.append(piece.replace(MARK, " ").encode("utf-8"))
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("pieces with a space mark inside are not supported")
        self.unknown = min(p[1] for p in self.pieces.values()) - 10.0
        self.longest = max(map(len, self.pieces))
        # Whole-number scores (ranks of merges) are added up exactly.
        self.kind = np.int64 if all(float(p[1]).is_integer() for p in self.pieces.values()) else np.float64
        self._plant()
        joined = {c for p in self.pieces if len(p) > 1 for c in p}
        alone = "\\n" if "\n" not in joined else ""
        self.stretch = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|{alone}" if alone else ""))
        mark = self.byte_ids[list(MARK.encode())].astype("<u4").tobytes()
        self.known: dict[str | None, tuple[bytes, float, float]] = {None: (mark, self.unknown, float("inf"))}
        self.older: dict[str | None, tuple[bytes, float, float]] = {}
        self.held = 0

    def _plant(self) -> None:
        """The trie of the pieces as arrays; inner children in a table with open addressing, keyed by node and character."""
        trie: dict[tuple[int, int], int] = {}
        of_node = {}
        for piece, (i, _, _) in self.pieces.items():
            node = 0
            for c in map(ord, piece):
                node = trie.setdefault((node, c), len(trie) + 1)
            of_node[node] = i
        self.piece_at = np.full(len(trie) + 1, -1, np.int32)
        self.piece_at[list(of_node)] = list(of_node.values())
        self.value = np.full(len(self.texts) + 1, self.unknown, self.kind)  # the last is the unknown character's
        for i, score, _ in self.pieces.values():
            self.value[i] = score
        self.roots = np.full(0x110000, -1, np.int32)
        bits = (4 * len(trie)).bit_length()
        self.shift, self.keys, self.children = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for (node, c), child in trie.items():
            if not node:
                self.roots[c] = child
                continue
            key = node << 21 | c
            slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
            while self.keys[slot] != -1:
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.children[slot] = key, child

    def _child(self, node: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Nodes that the characters lead to, -1 where they leave the trie."""
        key = node.astype(np.int64) << 21 | points
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        out, todo = np.full(len(key), -1, np.int32), np.arange(len(key))
        while len(todo):
            held = self.keys[slot]
            hit = held == key[todo]
            out[todo[hit]] = self.children[slot[hit]]
            on = ~hit & (held != -1)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def _edges(self, points: np.ndarray, stop: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece (-1: the character's bytes) of all edges from the characters lo to hi, longest first."""
        at, node = np.arange(lo, hi), self.roots[points[lo:hi]]
        single = np.full(hi - lo, -1, np.int32)
        single[node >= 0] = self.piece_at[node[node >= 0]]
        found = [(at, np.ones(hi - lo, np.int64), single)]
        for length in range(2, self.longest + 1):
            on = (node >= 0) & (at + length <= stop[at])
            at, node = at[on], node[on]
            if not len(at):
                break
            node = self._child(node, points[at + (length - 1)])
            here = np.where(node >= 0, self.piece_at[node], -1)
            is_piece = here >= 0
            found.append((at[is_piece], np.full(int(is_piece.sum()), length), here[is_piece]))
        return tuple(np.concatenate(c) for c in zip(*found[::-1], strict=True))

    def _paths(self, points: np.ndarray, heads: np.ndarray, n_bytes: np.ndarray) -> Paths:
        """Forward Viterbi over stretches that begin at ``heads``."""
        n = len(points)
        stop = np.repeat(np.r_[heads[1:], n], np.diff(np.r_[heads, n]))
        first = np.zeros(n, bool)
        first[heads] = True
        score, count = np.zeros(n, self.kind), np.zeros((2, n), np.int64)
        length, piece, loss = np.zeros((2, n), np.int8), np.zeros((2, n), np.int32), np.full(n, np.inf)
        lowest = np.iinfo(np.int64).min if self.kind is np.int64 else -np.inf
        for lo in range(0, n, WINDOW):
            hi = min(n, lo + WINDOW)
            start, long, which = self._edges(points, stop, max(0, lo - self.longest + 1), hi)
            end = start + long - 1  # the last character
            inner = (long > 1) & (end >= lo)
            steps = np.zeros(hi - lo + 1, np.int64)
            np.add.at(steps, np.clip(start[inner] + 1 - lo, 0, hi - lo), 1)
            np.add.at(steps, np.clip(end[inner] + 1 - lo, 0, hi - lo), -1)
            first[lo:hi] |= np.cumsum(steps[:-1]) == 0
            at = np.arange(lo, hi)
            level = at - np.maximum.accumulate(np.where(first[lo:hi], at, lo))
            here = (end >= lo) & (end < hi)
            start, long, which, end = start[here], long[here], which[here], end[here]
            order = np.argsort(level[end - lo] * np.int64(WINDOW) + (end - lo), kind="stable")
            start, long, which, end = start[order], long[order], which[order], end[order]
            own, more = self.value[which], np.where(which < 0, n_bytes[end], 1)
            fresh = first[start]
            new = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
            sizes = np.diff(np.r_[new, len(end)])
            of_group = level[end[new] - lo]
            cuts = np.searchsorted(of_group, np.arange(int(of_group[-1]) + 2))
            for k in range(len(cuts) - 1):
                a, b = cuts[k], cuts[k + 1]
                x, y = new[a], new[b - 1] + sizes[b - 1]
                g, size, node = new[a:b] - x, sizes[a:b], end[new[a:b]]
                before = start[x:y] - 1
                v = own[x:y] + np.where(fresh[x:y], 0, score[before])
                c = more[x:y] + np.where(fresh[x:y], 0, count[0, before])
                best, pick = self._pick(v, c, g, size)
                score[node], count[0, node], length[0, node], piece[0, node] = best, c[pick], long[x + pick], which[x + pick]
                two = np.flatnonzero(size > 1)
                if len(two):
                    v[pick] = lowest
                    rows = np.repeat(size > 1, size)
                    v, c, at_edge, size, node = v[rows], c[rows], np.flatnonzero(rows) + x, size[two], node[two]
                    second, pick = self._pick(v, c, np.cumsum(size) - size, size)
                    loss[node] = best[two] - second
                    count[1, node], length[1, node], piece[1, node] = c[pick], long[at_edge[pick]], which[at_edge[pick]]
        parts = np.flatnonzero(first)
        return Paths(first, score, count, length, piece, loss, parts, np.r_[parts[1:], n] - 1)

    @staticmethod
    def _pick(v: np.ndarray, c: np.ndarray, groups: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest value of each group, and the first row of those that have it with the least count."""
        best = np.maximum.reduceat(v, groups)
        c_tied = np.where(v == np.repeat(best, size), c, np.iinfo(np.int64).max)
        least = np.minimum.reduceat(c_tied, groups)
        return best, np.minimum.reduceat(np.where(c_tied == np.repeat(least, size), np.arange(len(v)), len(v)), groups)

    def _two_best(self, paths: Paths) -> tuple[np.ndarray, np.ndarray]:
        """The backward A-star search for two segmentations of each part: the nodes of the best, and its lead over the second (infinite: none).

        A hypothesis is a node, the rank of the edge into it (0 or 1) and the hypothesis that it goes on from. Its priority is exact, as the
        Viterbi score is: the loss against the best segmentation, then the number of pieces, then the nearness to the start. Taken from the
        agenda, it makes way for the second edge into its node and for the best edge into its own start; at the part's start it is a result.
        Two results need edges of no higher rank.
        """
        on, lead = np.zeros(len(paths.score), bool), np.full(len(paths.heads), np.inf)
        size = paths.ends - paths.heads + 1
        order = np.argsort(size, kind="stable")
        alone, short = np.searchsorted(size[order], (1, SHORT), "right").tolist()
        on[paths.ends[order[:alone]]] = True  # one character has one edge
        for a in range(alone, short, ABREAST):
            self._abreast(paths, order[a : min(short, a + ABREAST)], on, lead)
        for part in order[short:].tolist():
            self._by_heap(paths, part, on, lead)
        return on, lead

    def _abreast(self, paths: Paths, parts: np.ndarray, on: np.ndarray, lead: np.ndarray) -> None:
        """The search for short parts, a round for all of them at a time; a row of the agenda is a part's, a taken entry has infinite loss."""
        where = paths.ends[parts] * 2  # node and rank
        loss, total, at, origin = np.zeros((len(parts), 1)), paths.count[0, where >> 1][:, None], where[:, None], np.full((len(parts), 1), -1)
        results = np.zeros(len(parts), np.int8)
        taken_at, taken_from, made, last = [], [], 0, []
        most = np.iinfo(np.int64).max
        while len(parts):
            rows = np.arange(len(parts))
            if loss.shape[1] == 1:
                slot = np.zeros(len(parts), np.int64)
            else:
                tied = loss == loss.min(axis=1)[:, None]
                pieces = np.where(tied, total, most)
                slot = np.where(pieces == pieces.min(axis=1)[:, None], at, most).argmin(axis=1)
            now, n, code, source = loss[rows, slot], total[rows, slot], at[rows, slot], origin[rows, slot]
            node, rank = code >> 1, code & 1
            mine = made + rows
            made += len(rows)
            taken_at.append(node)
            taken_from.append(source)
            start = node - paths.length[rank, node]
            ended = start < paths.heads[parts]
            # The second edge into the node takes a new column, the best edge into its start the entry's own place.
            more = np.where(rank == 0, paths.loss[node], np.inf)
            loss, total = np.c_[loss, now + more], np.c_[total, n - paths.count[0, node] + paths.count[1, node]]
            at, origin = np.c_[at, node * 2 + 1], np.c_[origin, source]
            loss[rows, slot], at[rows, slot], origin[rows, slot] = np.where(ended, np.inf, now), start * 2, mine
            last.append(mine[ended & (results == 0)])
            second = ended & (results == 1)
            lead[parts[second]] = now[second]
            results += ended
            left = np.flatnonzero((results < 2) & (loss.min(axis=1) < np.inf))
            if len(left) < len(parts):
                parts, results = parts[left], results[left]
                loss, total, at, origin = loss[left], total[left], at[left], origin[left]
        if made:
            taken, source, k = np.concatenate(taken_at), np.concatenate(taken_from), np.concatenate(last)
            while len(k):
                on[taken[k]] = True
                k = source[k]
                k = k[k >= 0]

    def _by_heap(self, paths: Paths, part: int, on: np.ndarray, lead: np.ndarray) -> None:
        """The search for one long part."""
        head, end = int(paths.heads[part]), int(paths.ends[part])
        loss, (length, length2), (count, count2) = (x[..., head : end + 1].tolist() for x in (paths.loss, paths.length, paths.count))
        queue, results = [(0.0, count[-1], end - head, 0, -1)], 0
        taken_at, taken_from = [], []
        while queue and results < 2:
            now, n, node, rank, source = heapq.heappop(queue)
            mine = len(taken_at)
            taken_at.append(node)
            taken_from.append(source)
            if not rank and loss[node] < math.inf:
                heapq.heappush(queue, (now + loss[node], n - count[node] + count2[node], node, 1, source))
            start = node - (length2 if rank else length)[node]
            if start >= 0:
                heapq.heappush(queue, (now, n, start, 0, mine))
                continue
            results += 1
            if results == 2:
                lead[part] = now
                continue
            while mine >= 0:
                on[head + taken_at[mine]] = True
                mine = taken_from[mine]

    def search(self, stretches: list[str]) -> list[tuple[bytes, float, float]]:
        """Ids (32-bit, little-endian), score, and lead over the second best (infinite: none) of each stretch."""
        if not stretches:
            return []
        whole = "".join(stretches)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        n_bytes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        heads = np.cumsum(sizes) - sizes
        paths = self._paths(points, heads, n_bytes)
        on, leads = self._two_best(paths)
        nodes = np.flatnonzero(on)
        piece = paths.piece[0, nodes]  # the best segmentation has best edges alone
        n_ids = np.where(piece < 0, n_bytes[nodes], 1)
        ids = np.repeat(piece, n_ids)
        unknown = "".join(map(whole.__getitem__, nodes[piece < 0].tolist())).encode("utf-8", "surrogatepass")
        ids = ids.astype("<u4")
        ids[np.repeat(piece < 0, n_ids)] = self.byte_ids[np.frombuffer(unknown, np.uint8)]
        raw = ids.tobytes()
        cut = 4 * np.r_[0, np.cumsum(n_ids)][np.searchsorted(nodes, np.r_[heads, len(points)])]
        part = np.searchsorted(paths.heads, heads)
        score = np.add.reduceat(paths.score[paths.ends], part).astype(np.float64).tolist()
        lead = np.minimum.reduceat(leads, part).tolist()
        cut = cut.tolist()
        return [(raw[cut[i] : cut[i + 1]], score[i], lead[i]) for i in range(len(stretches))]

    def edges_to(self, s: str, end: int) -> list[tuple[int, tuple[int, ...], float]]:
        """Edges into a node: start, ids, score."""
        out = []
        for start in range(max(0, end - self.longest), end):
            if found := self.pieces.get(s[start:end]):
                out.append((start, found[2], found[1]))
        if s[end - 1] not in self.pieces:
            out.append((end - 1, tuple(int(self.byte_ids[b]) for b in s[end - 1].encode("utf-8", "surrogatepass")), self.unknown))
        return out

    def nbest(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Up to ``n`` best segmentations of one stretch of marked text, best first: score and ids.

        A hypothesis is a suffix of the text and the k-th best edge into its node; taken from the queue, it makes way
        for the next edge there and for the best edge into its own start. Edges are looked up at visited nodes only.
        """
        points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        n_bytes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        paths = self._paths(points, np.zeros(1, np.int64), n_bytes)
        part = np.cumsum(paths.first) - 1
        best = np.r_[0, paths.score + np.r_[0, np.cumsum(paths.score[paths.ends])][part]].tolist()
        count = np.r_[0, paths.count[0] + np.r_[0, np.cumsum(paths.count[0, paths.ends])][part]].tolist()

        @lru_cache(1 << 16)
        def into(at: int) -> list[tuple[float, int, int, tuple[int, ...], float]]:
            return sorted((-best[start] - score, count[start] + len(ids), start, ids, score) for start, ids, score in self.edges_to(s, at))

        queue = [(*into(len(s))[0][:2], len(s), 0, 0, 0.0, 0, None)]
        out, made = [], 0
        while queue and len(out) < n:
            _, _, at, _, k, score, pieces, path = heapq.heappop(queue)
            row = into(at)
            if k + 1 < len(row):
                made += 1
                heapq.heappush(queue, (row[k + 1][0] - score, row[k + 1][1] + pieces, at, made, k + 1, score, pieces, path))
            _, _, start, ids, value = row[k]
            path, score, pieces = (ids, path), score + value, pieces + len(ids)
            if start:
                made += 1
                edge = into(start)[0]
                heapq.heappush(queue, (edge[0] - score, edge[1] + pieces, start, made, 0, score, pieces, path))
            else:
                found: list[int] = []
                while path:
                    found += path[0]
                    path = path[1]
                out.append((score, tuple(found)))
        return out

    def stretches(self, text: str) -> list[str | None]:
        """The marked stretches of a text; a literal mark becomes its three bytes (None)."""
        if MARK not in text:
            return self.stretch.findall(MARK + text.replace(" ", MARK))
        out: list = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.append(None)
            out += self.stretch.findall((MARK if not k else "") + part.replace(" ", MARK))
        return out

    def best_of(self, texts: list[str]) -> Iterator[tuple[bytes, float, float]]:
        """For each text its ids (32-bit, little-endian), score, and how far the second best segmentation scores below (infinite: none)."""
        known = self.known
        cut = [self.stretches(t) for t in texts]
        unknown = set().union(*cut).difference(known)
        again = unknown.intersection(self.older)
        known.update((s, self.older[s]) for s in again)
        fresh = list(unknown - again)
        known.update(zip(fresh, self.search(fresh), strict=True))
        self.held += sum(map(len, unknown))
        for parts in cut:
            ids, scores, leads = zip(*map(known.__getitem__, parts), strict=True)
            yield b"".join(ids), sum(scores), min(leads)
        if self.held > REMEMBERED:
            self.older, self.known, self.held = known, {None: known[None]}, 0

    def best(self, text: str) -> tuple[bytes, float, float]:
        return next(iter([*self.best_of([text])]))

    def nbest_of_text(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a whole text, merged from those of its stretches."""
        best: list[tuple[float, list[int]]] = [(0.0, [])]
        for s in self.stretches(text):
            own = [(self.unknown, tuple(np.frombuffer(self.known[None][0], "<u4").tolist()))] if s is None else self.nbest(s, n)
            best = heapq.nsmallest(n, ((a + b, x + list(y)) for a, x in best for b, y in own), key=lambda v: (-v[0], len(v[1])))
        return best

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces with marks as spaces, bytes as they are, the leading space off."""
        data = b"".join(map(self.texts.__getitem__, ids.tolist()))
        return data.decode("utf-8", "surrogatepass")[1:]


@lru_cache(2)
def lattice_of(path: str) -> Lattice:
    """The lattice of a model file, kept in each worker from task to task."""
    return Lattice(path)


#: Texts that are segmented together.
TOGETHER = 256


def segmented(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id``, ``n_pieces``, ``score``, ``margin``, ``ids_crc32``, ``exact`` (decoding gives the text back), and ``ids`` if asked for.

    A null text counts as an empty one, whose only stretch is the leading mark. ``margin`` is null where
    there is one segmentation. Very long texts and stretches take time and memory in proportion. Rows, equal ones
    too, repeat as they do in ``docs``; other columns are not read. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path)
        for b in slices(batches, TOGETHER):
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [*lattice.best_of(texts)]
            ids = [np.frombuffer(f[0], "<u4") for f in found]
            cols = {
                "id": b.column(0),
                "n_pieces": pa.array([len(i) for i in ids], pa.int64()),
                "score": pa.array([f[1] for f in found], pa.float64()),
                "margin": pa.array([None if f[2] == float("inf") else f[2] for f in found], pa.float64()),
                "ids_crc32": pa.array([zlib.crc32(f[0]) for f in found], pa.int64()),
                "exact": pa.array([lattice.decode(i) == t for i, t in zip(ids, texts, strict=True)]),
            }
            if with_ids:
                cols["ids"] = pa.array([i.view(np.int32) for i in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, n_pieces bigint, score double, margin double, ids_crc32 bigint, exact boolean" + ", ids array<int>" * with_ids
    return texts_in_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, out)
