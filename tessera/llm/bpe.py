"""Byte-level BPE ids of whole texts, from a tokenizer file (JSON) of the `tokenizers` library.

The file's vocabulary, read as ranks of byte strings, goes into tiktoken's encoder with the same pattern; its ids are those of
the file's own library (tests hold them together), at several times the speed. Long runs of white space, for which the
pattern backtracks without bound, are cut off and merged apart.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np

# Fixed value: the pattern that cuts a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space that is too long for the pattern. The classes of Python and of the pattern differ in \x1c to \x1f, which are not white space there.
LONG_RUN = re.compile(r"[^\S\x1c-\x1f]{10000,}")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable ones for themselves, the others from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids of texts as little-endian unsigned 32-bit integers.

    The strings of special tokens are ordinary text, or, with `added`, have ids of their own as in the library's default settings.
    """

    def __init__(self, path: str, added: bool = False) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        special = {t["id"] for t in told["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in told["model"]["vocab"].items() if i not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        made = [told["model"]["vocab"][a + b] for a, b in merges]
        if told["pre_tokenizer"]["type"] != "ByteLevel" or made != sorted(made):
            raise ValueError("only byte-level vocabularies whose ids follow their merges")
        if any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip")) or told["normalizer"]:
            raise ValueError("only added tokens that stand for their own strings")
        self._added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in told["added_tokens"]} if added else {}
        # the longest first, as the library takes the leftmost, then the longest
        self._cut = re.compile("|".join(re.escape(t) for t in sorted(self._added, key=len, reverse=True))) if self._added else None
        self._encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self._whole = tiktoken.Encoding("runs", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    @staticmethod
    @cache
    def shared(path: str, added: bool = False) -> Encoder:
        """The encoder of this worker process."""
        return Encoder(path, added)

    def _plain(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        out, at = [], 0
        for run in LONG_RUN.finditer(text):
            # the pattern takes a run but for its last character if more text follows it, which starts with that character
            end = run.end() - (run.end() < len(text))
            out += [self._encode(text[at : run.start()], disallowed_special=()), self._whole(text[run.start() : end], disallowed_special=())]
            at = end
        out.append(self._encode(text[at:], disallowed_special=()))
        return b"".join(ids.astype("<u4").tobytes() for ids in out)

    def _one(self, text: str) -> bytes:
        out, at = [], 0
        for found in self._cut.finditer(text) if self._cut else ():
            out += [self._plain(text[at : found.start()]), self._added[found[0]]]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        return [self._one(t) for t in texts]
