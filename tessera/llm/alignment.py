"""Alignment of two tokenizers' ids over the same bytes.

Both encode " " + text. The token ends of each side, in bytes, ascend; a merge of the two sequences finds the offsets where both
have one, which cut the tokens into groups. The two tokens that end there are linked. Documents are aligned in chunks of bounded
text: of a chunk only its distinct linked pairs leave it, with their numbers. Spark adds them up, finds the largest count of each
id on either side, and joins both back to the chunks' pairs; then each document sums up over its own links.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import Encoder, byte_letters
from tessera.llm.common import slices, table, text_or_empty, written

#: Characters of a chunk of documents (a longer text is a chunk of its own), and those that a task encodes at a time.
CHUNK_CHARS, SLICE_CHARS = 4 << 20, 1 << 19
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: A pair is a * 2**32 + b.
_LOW = (1 << 32) - 1


class Sides:
    """Both tokenizers, with the bytes of each of their ids."""

    def __init__(self, bpe: str, pieces: str) -> None:
        import sentencepiece

        self.bpe, self.pieces = Encoder.shared(bpe), sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = byte_letters()
        with open(bpe, encoding="utf-8") as file:
            told = json.load(file)
        vocabulary = told["model"]["vocab"] | {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes = [[b""] * (max(vocabulary.values()) + 1), []]
        special = {t["id"] for t in told["added_tokens"]}
        for piece, i in vocabulary.items():
            self.bytes[0][i] = piece.encode() if i in special else bytes(letters[c] for c in piece)
        for i in range(self.pieces.vocab_size()):
            piece = self.pieces.id_to_piece(i)
            one = _BYTE.fullmatch(piece)
            self.bytes[1].append(bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode())
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in self.bytes]
        n, m = map(len, self.bytes)
        ends = [("", ","), ("", "|"), ("", ","), ("", ";")]
        # "12,", "12|" of A and "12,", "12;" of B, one after the other
        self.told = np.array([f"{i}{end}".encode() for (_, end), size in zip(ends, (n, n, m, m), strict=True) for i in range(size)])

    @staticmethod
    @cache
    def shared(bpe: str, pieces: str) -> Sides:
        """The tokenizers of this worker process."""
        return Sides(bpe, pieces)

    def _encode(self, texts: list[str]) -> list[list[np.ndarray]]:
        a = [np.frombuffer(x, "<u4").astype(np.int64) for x in self.bpe.encode([" " + t for t in texts])]
        return [a, [np.array(x, np.int64) for x in self.pieces.encode(texts, num_threads=1)]]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of all texts in one array and the number of each text's, for each side; none where the bytes of a side differ from " " + text."""
        ids: list[list[np.ndarray]] = [[], []]
        counts: list[list[int]] = [[], []]
        for part in slices(np.array([len(t) for t in texts]), SLICE_CHARS):
            raw = [b" " + t.encode() if t else b"" for t in texts[part]]
            sides = self._encode(texts[part])
            good = np.array([bool(r) for r in raw])
            for own, known, sizes in zip(sides, self.bytes, self.sizes, strict=True):
                joined = b"".join(map(known.__getitem__, np.concatenate(own).tolist()))
                ends = np.cumsum([0, *(int(sizes[x].sum()) for x in own)])
                good &= [joined[s:e] == r for s, e, r in zip(ends, ends[1:], raw, strict=False)]
            for side in (0, 1):
                kept = [x if ok else x[:0] for x, ok in zip(sides[side], good, strict=True)]
                ids[side] += kept
                counts[side] += map(len, kept)
        return [np.concatenate(x) if x else np.empty(0, np.int64) for x in ids], [np.array(x, np.int64) for x in counts]

    def align(self, texts: list[str]) -> Alignment:
        """The groups and links of all texts."""
        return Alignment(self, *self.encode(texts))


class Alignment:
    """Groups of both sides' tokens, document after document."""

    def __init__(self, sides: Sides, ids: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.sides, (self.a, self.b), self.counts = sides, ids, counts
        # documents have the same bytes on either side, so offsets go on from one to the next, and no group spans two
        ends_a, ends_b = (np.cumsum(size[own]) for size, own in zip(sides.sizes, ids, strict=True))
        met = np.searchsorted(ends_b, ends_a)
        self.hit_a = ends_b[np.minimum(met, len(ends_b) - 1)] == ends_a if len(ends_b) else np.zeros(len(ends_a), bool)
        self.last_a, self.last_b = np.flatnonzero(self.hit_a), met[self.hit_a]
        self.hit_b = np.zeros(len(ends_b), bool)
        self.hit_b[self.last_b] = True
        document = np.repeat(np.arange(len(counts[0])), counts[0])
        self.document = document[self.last_a]
        self.n_groups = np.bincount(self.document, minlength=len(counts[0]))

    def pairs(self) -> np.ndarray:
        """The linked pair of each group."""
        return self.a[self.last_a] << 32 | self.b[self.last_b]

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups as a1,a2|b1;a3|b2 (none: an empty string)."""
        n, m = map(len, self.sides.bytes)
        group_a, group_b = np.cumsum(self.hit_a) - self.hit_a, np.cumsum(self.hit_b) - self.hit_b
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        starts_b = np.concatenate([[0], self.last_b + 1])[:-1] if len(self.last_b) else self.last_b
        codes[np.arange(len(self.a)) + starts_b[group_a]] = self.a + n * self.hit_a
        codes[np.arange(len(self.b)) + (self.last_a + 1)[group_b]] = 2 * n + self.b + m * self.hit_b
        ends = np.cumsum([0, *(self.counts[0] + self.counts[1])])
        told = (self.sides.told[codes[s:e]].tobytes().translate(None, b"\0")[:-1] for s, e in zip(ends, ends[1:], strict=False))
        return [hashlib.sha256(x).hexdigest() if x else "" for x in told]

    def groups(self) -> list[list[dict]]:
        """Each document's groups, as ids of both sides."""
        out: list[list[dict]] = [[] for _ in self.n_groups]
        a = b = 0
        for document, i, j in zip(self.document.tolist(), (self.last_a + 1).tolist(), (self.last_b + 1).tolist(), strict=True):
            out[document].append({"a": self.a[a:i].tolist(), "b": self.b[b:j].tolist()})
            a, b = i, j
        return out


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers, all first bytes, then all second ones and so on, so that their zeros pack well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _summaries(found: Alignment) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The distinct pairs of a chunk, their numbers, and each document's distinct links: steps to the next pair's place, then numbers."""
    pairs, place, often = np.unique(found.pairs(), return_inverse=True, return_counts=True)
    own, times = np.unique(found.document << 32 | place, return_counts=True)
    ends = np.cumsum([0, *np.bincount(own >> 32, minlength=len(found.n_groups))])
    places = own & _LOW
    return pairs, often, [_planes(np.concatenate([np.diff(places[s:e], prepend=0), times[s:e]])) for s, e in zip(ends, ends[1:], strict=False)]


def chunked(docs: DataFrame, bpe: str, pieces: str, key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """A row of each document (key as text, n_a, n_b, n_groups, groups_sha256, links) with its chunk; the first of a chunk has its distinct pairs too."""
    source = docs.select(F.col(key).cast("string").alias("key"), text_or_empty(text).alias("text"))
    schema = "key string, chunk bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary, pairs array<bigint>, often array<bigint>"
    schema += ", groups array<struct<a: array<int>, b: array<int>>>" * with_groups

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides, chunk = Sides.shared(bpe, pieces), TaskContext.get().partitionId() << 32
        for frame in frames:
            texts = frame["text"].tolist()
            for part in slices(np.array([len(t) for t in texts]), CHUNK_CHARS):
                found = sides.align(texts[part])
                pairs, often, links = _summaries(found)
                none = [None] * (len(links) - 1)
                out = {"key": frame["key"].iloc[part], "chunk": chunk, "n_a": found.counts[0], "n_b": found.counts[1], "n_groups": found.n_groups}
                out |= {"groups_sha256": found.digests(), "links": links, "pairs": [pairs, *none], "often": [often, *none]}
                yield pd.DataFrame(out | ({"groups": found.groups()} if with_groups else {}))
                chunk += 1

    return written(source.mapInPandas(run, schema), "aligned")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, count, and the largest count of any pair with the same id of A (a_most) and of B (b_most). pairs: pair, often."""
    counts = pairs.groupBy("pair").agg(F.sum("often").alias("count"))
    counts = counts.select("pair", "count", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(_LOW)).alias("b"))
    most = {side: counts.groupBy(side).agg(F.max("count").alias(f"{side}_most")) for side in ("a", "b")}
    return counts.join(most["a"], "a").join(most["b"], "b")


def aligned(docs: DataFrame, bpe: str, pieces: str, key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, if asked for) of every whole text.

    n_best has the links whose pair is the most frequent of its id of B, ties included, and count_sum the sum of the links' counts. Texts
    that are null or empty, or whose bytes either side changes, have no tokens: zeros, and '' for the digest. A very long text is a
    chunk of its own; repeated rows and null keys are rows like others; an empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    rows = chunked(docs, bpe, pieces, key, text, with_groups)
    pairs = rows.where(F.col("pairs").isNotNull()).select("chunk", F.posexplode(F.arrays_zip("pairs", "often")).alias("place", "own"))
    pairs = pairs.select("chunk", "place", F.col("own.pairs").alias("pair"), F.col("own.often").alias("often"))
    # a chunk names a pair once, so that the most frequent pair has as many rows as there are chunks
    told = pairs.join(pair_counts(pairs), "pair").select(F.col("chunk").alias("of"), "place", "count", (F.col("count") == F.col("b_most")).alias("best"))
    extra = ["groups"] if with_groups else []
    kept = rows.select("key", "chunk", "n_a", "n_b", "n_groups", "groups_sha256", "links", *extra)
    sums = ["n_best", "count_sum"]

    def summed(own: pa.Table, answers: pa.Table) -> pa.Table:
        place = answers["place"].to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = answers["count"].to_numpy(), answers["best"].to_numpy()
        out = []
        for links in own["links"].to_pylist():
            steps, times = _numbers(links).reshape(2, -1)
            at = np.cumsum(steps)
            out.append((int((best[at] * times).sum()), int((count[at] * times).sum())))
        table_ = own.drop_columns(["chunk", "links"])
        for i, name in enumerate(sums):
            table_ = table_.append_column(name, pa.array([x[i] for x in out], pa.int64()))
        return table_

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in kept.drop("chunk", "links").schema] + [f"{n} bigint" for n in sums]
    done = kept.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(summed, ", ".join(fields))
    return done.select(F.col("key").cast(kind).alias(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *sums, "groups_sha256", *extra)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids by the byte-level and the piece tokenizer, aligned."""
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
