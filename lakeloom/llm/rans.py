"""Static range asymmetric numeral system over blocks of interleaved lanes.

A file holds one frequency table that all its blocks share. Each block codes up to ``BLOCK`` ids
with ``LANES`` independent 64-bit states taken in turn, so numpy steps all lanes at once; blocks are
independent of each other and carry a checkpoint (first id, byte offset) and checksums of their
payload and of their ids in the directory, so any block can be decoded and verified alone.

Layout, little-endian: magic ``LLR1``, header length, header (JSON, compressed: counts of ids, blocks,
documents), frequency table, document table, directory, payloads.
"""

from __future__ import annotations

import json
import struct
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np

MAGIC = b"LLR1"
BLOCK, LANES = 1 << 17, 1024
#: Bits of the frequencies' common denominator; lower bound of a state and bits of a renormalisation step.
SCALE, LOW, STEP = 22, 1 << 31, 32
#: Ids under this are tabulated; larger ones are searched for.
DENSE = 1 << 22


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and frequencies that sum to 2**SCALE, each at least 1."""
    if len(ids) and ids.max() < DENSE:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    whole = 1 << SCALE
    if len(symbols) > whole:
        raise ValueError("more distinct ids than the denominator holds")
    freq = np.maximum(1, counts * (whole / max(1, counts.sum()))).astype(np.int64)
    over = int(freq.sum()) - whole
    order = np.argsort(-freq, kind="stable")
    for k in order:
        if not over:
            break
        take = min(over, int(freq[k]) - 1) if over > 0 else over
        freq[k] -= take
        over -= take
    return symbols.astype(np.uint32), freq.astype(np.uint32)


class Coder:
    """Encodes and decodes blocks under one frequency table."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols, freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(freq) else np.zeros(0, np.uint64)
        self._slots = None
        self._places = None
        if len(symbols) and symbols[-1] < DENSE:
            self._places = np.zeros(int(symbols[-1]) + 1, np.uint32)
            self._places[symbols] = np.arange(len(symbols), dtype=np.uint32)

    def encode(self, ids: np.ndarray) -> bytes:
        at = self._places[ids] if self._places is not None else np.searchsorted(self.symbols, ids)
        lanes = min(LANES, max(1, len(ids)))
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        steps = -(-len(ids) // lanes)
        f_all, s_all = self.freq[at], self.start[at]
        for t in range(steps - 1, -1, -1):
            f, s = f_all[t * lanes : (t + 1) * lanes], s_all[t * lanes : (t + 1) * lanes]
            x = state[: len(f)]
            full = x >= (f << np.uint64(63 - SCALE))
            if full.any():
                words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                x = np.where(full, x >> np.uint64(STEP), x)
            q = x // f
            state[: len(f)] = (q << np.uint64(SCALE)) + (x - q * f) + s
        body = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        return struct.pack("<II", len(ids), lanes) + state.astype("<u8").tobytes() + body.tobytes()

    def decode(self, payload: bytes) -> np.ndarray:
        n, lanes = struct.unpack_from("<II", payload)
        state = np.frombuffer(payload, "<u8", lanes, 8).astype(np.uint64)
        body = np.frombuffer(payload, "<u4", offset=8 + 8 * lanes).astype(np.uint64)
        slots = self._slots
        if slots is None:
            slots = self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        out = np.empty(n, np.uint32)
        at, mask = 0, np.uint64((1 << SCALE) - 1)
        for t in range(-(-n // lanes)):
            width = min(lanes, n - t * lanes)
            x = state[:width]
            slot = x & mask
            k = slots[slot]
            out[t * lanes : t * lanes + width] = k
            x = self.freq[k] * (x >> np.uint64(SCALE)) + slot - self.start[k]
            low = x < LOW
            need = int(np.count_nonzero(low))
            if need:
                x[low] = (x[low] << np.uint64(STEP)) | body[at : at + need]
                at += need
            state[:width] = x
        return self.symbols[out] if n else out


def write_file(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A file of whole documents: ``ids`` holds ``lengths[i]`` ids of document ``doc_ids[i]``, one after another."""
    symbols, freq = frequencies(ids)
    coder = Coder(symbols, freq)
    payloads, directory, offset = [], [], 0
    for first in range(0, len(ids), BLOCK):
        part = ids[first : first + BLOCK]
        data = coder.encode(part)
        payloads.append(data)
        directory.append((first, offset, zlib.crc32(data), zlib.crc32(part.astype("<u4"))))
        offset += len(data)
    table = zlib.compress(symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    docs = zlib.compress(json.dumps([doc_ids, lengths]).encode(), 6)
    places = np.array(directory, dtype="<u8").reshape(-1, 4).tobytes()
    head = json.dumps({"ids": len(ids), "symbols": len(symbols), "table": len(table), "docs": len(docs), "blocks": len(directory)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, table, docs, places, *payloads])


class TokenFile:
    """A written file: document ids, lengths, and any block by its checkpoint, alone or on several threads."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack_from("<I", data, 4)
        head = json.loads(data[8 : 8 + n])
        at = 8 + n
        symbols, freq = np.frombuffer(zlib.decompress(data[at : at + head["table"]]), "<u4").reshape(2, -1)
        at += head["table"]
        self.doc_ids, self.lengths = json.loads(zlib.decompress(data[at : at + head["docs"]]))
        at += head["docs"]
        self.checkpoints = np.frombuffer(data, "<u8", 4 * head["blocks"], at).reshape(-1, 4)
        self.payloads, self.n_ids = memoryview(data)[at + self.checkpoints.nbytes :], head["ids"]
        self.coder = Coder(symbols, freq)

    def block(self, k: int) -> np.ndarray:
        """The ids of block ``k``, decoded from its checkpoint without any other block; a checksum that fails raises."""
        first, offset, of_payload, of_ids = self.checkpoints[k].tolist()
        after = self.checkpoints[k + 1].tolist() if k + 1 < len(self.checkpoints) else [self.n_ids, len(self.payloads)]
        payload = bytes(self.payloads[offset : after[1]])
        if zlib.crc32(payload) != of_payload:
            raise ValueError(f"block {k}: payload checksum")
        ids = self.coder.decode(payload)
        if len(ids) != after[0] - first or zlib.crc32(ids.astype("<u4")) != of_ids:
            raise ValueError(f"block {k}: id checksum")
        return ids

    def block_of(self, position: int) -> int:
        """The block that holds the id at a position."""
        return int(np.searchsorted(self.checkpoints[:, 0], position, "right")) - 1

    def ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from position ``first`` on, of which only the blocks that hold them are decoded."""
        if not n:
            return np.zeros(0, np.uint32)
        from_block = self.block_of(first)
        parts = [self.block(k) for k in range(from_block, self.block_of(first + n - 1) + 1)]
        skip = first - int(self.checkpoints[from_block][0])
        return np.concatenate(parts)[skip : skip + n]

    def all(self, threads: int = 1) -> np.ndarray:
        """All ids; blocks are decoded side by side where threads are given."""
        numbers = range(len(self.checkpoints))
        if threads > 1:
            with ThreadPoolExecutor(threads) as pool:
                parts = list(pool.map(self.block, numbers))
        else:
            parts = [self.block(k) for k in numbers]
        return np.concatenate([np.zeros(0, np.uint32), *parts])
