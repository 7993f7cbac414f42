"""Cutting texts into the pre-tokens of byte-level BPE vocabularies, with a bounded memory of pre-tokens per worker.

Pre-tokens are independent in BPE, and most texts repeat them, so each worker encodes a pre-token once.
"""

from __future__ import annotations

import os

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the split pattern of byte-level BPE with leading spaces.
BYTE_LEVEL = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Fixed value: the split pattern of the lower-cased vocabulary with word ends; white space is dropped.
WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def special_splitter(specials: list[str]):
    """A pattern that finds the special strings, longest first; None without any."""
    return regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
