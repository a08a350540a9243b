"""Language-model scores by deleted interpolation.

P(w | u v) mixes the maximum-likelihood estimates of the triple, of the pair, of the word and the uniform one; the weights
depend on the bucket of the context's frequency (of u v, or of v where u v was never seen) and are learned by
expectation-maximisation on held-out counts: a tenth of the training documents is held out, and its words are predicted from
the counts of the other nine.

The corpus's counts never meet in one place. Each task packs its documents into chunks; a chunk asks for the counts of
its distinct keys (hashes of words, pairs and triples) by sending them, with its own counts, to buckets of the key space; a
bucket adds up and answers each chunk in the order of its keys. A key travels at most once from each chunk, and a frequent
one is one entry of a chunk like any other, so that buckets are even. Keys and answers travel as packed arrays; chunks and
buckets have a fixed size, and tasks follow their numbers. The driver sees only totals and a table of the held-out words'
estimates in bins. Words are told apart by 64-bit hashes, pairs and triples by 56 bits of theirs (less is sent; of 10**13 different
triples one in 7,000 would share another's).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import released, slices, table, text_or_empty, written
from tessera.llm.words import SLICE_BYTES, U64, hashed, mix

#: Bytes of text of a chunk, and of the text whose keys a bucket has, about; and most partitions of a shuffle.
CHUNK_BYTES, BUCKET_BYTES, PARTITIONS = 6 << 20, 8 << 20, 100_000
#: One training document in so many is held out for the weights.
HELD = 10
#: Contexts are put in a bucket by the binary logarithm of their frequency; 0 has those never seen. Pairs have buckets after those of words.
FREQUENCIES = 24
#: Bins of an estimate's binary logarithm for the weights; the last has all below.
LOW_BINS = 40
ROUNDS = 60
#: Tokens that are mixed at a time.
SLICE_TOKENS = 1 << 17
#: The key of the end of a text, which is also the context of its first word, and that of the pair before its first word.
END, START = U64(0x5DEECE66D1CE4E5B), U64(0x2545F4914F6CDD1D)
#: Orders of keys: words, pairs, triples.
ORDERS = 3


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words, with an end after each text's, and the number of tokens of each text."""
    parts, counts = [], []
    sizes = np.array([len(t) for t in texts], np.int64)
    for part in slices(sizes, SLICE_BYTES):
        words, n = hashed(texts[part])
        parts.append(np.insert(words, np.cumsum(n), END))
        counts.append(n + 1)
    if not parts:
        return np.empty(0, U64), np.empty(0, np.int64)
    return np.concatenate(parts), np.concatenate(counts)


def gram_keys(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: the key of the pair of the token before it and itself, and that of the triple with the pair before it."""
    firsts = np.cumsum(counts) - counts
    before = np.roll(keys, 1)
    before[firsts] = END
    pairs = mix(before * U64(0x9E3779B97F4A7C15) + keys) >> U64(8)
    history = np.roll(pairs, 1)
    history[firsts] = START
    return pairs, mix(history * U64(0xD6E8FEB86659FD93) + keys) >> U64(8)


def _packed(docs: DataFrame, held: Column) -> DataFrame:
    """chunk, held, ids, blob: the documents of a task in chunks of CHUNK_BYTES about, those held out apart, compressed."""
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.col("trained").cast("int").alias("trained"), held.cast("int").alias("held"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        pools: tuple = ([], [])
        sizes = [0, 0]

        def chunk(kind: int) -> pd.DataFrame:
            ids, texts, trained = zip(*pools[kind], strict=True)
            head_ = np.array([[len(t) for t in texts], trained], np.int64).tobytes()
            pools[kind].clear()
            sizes[kind] = 0
            return pd.DataFrame({"held": [kind], "ids": [list(ids)], "blob": [squeeze(head_ + b"".join(texts))]})

        for batch in batches:
            for doc_id, text, trained, kind in zip(batch["doc_id"], batch["text"], batch["trained"], batch["held"], strict=True):
                pools[kind].append((doc_id, text, trained))
                sizes[kind] += len(text) + 64
                if sizes[kind] >= CHUNK_BYTES:
                    yield chunk(kind)
        for kind in (0, 1):
            if pools[kind]:
                yield chunk(kind)
        released()

    return source.mapInPandas(pack, "held int, ids array<string>, blob binary").withColumn("chunk", F.monotonically_increasing_id())


class _Keys:
    """The tokens of a chunk and the distinct keys of each order, with the place of each token's own among them."""

    def __init__(self, ids: list, blob: bytes, held: int) -> None:
        data, n = zstandard.ZstdDecompressor().decompress(blob), len(ids)
        sizes, trained = np.frombuffer(data, np.int64, 2 * n).reshape(2, n)
        ends = 16 * n + np.cumsum(sizes)
        texts = [data[end - size : end] for size, end in zip(sizes, ends, strict=True)]
        words, self.counts = tokens(texts)
        del texts, data
        self.ids, self.held = list(ids), bool(held)
        self.trained = np.repeat(trained > 0, self.counts)
        self.firsts = np.cumsum(self.counts) - self.counts
        pairs, triples = gram_keys(words, self.counts)
        self.keys, self.own = [], []
        raw = [np.append(words, END), pairs, triples]
        del words, pairs, triples
        while raw:
            keys, inverse = np.unique(raw.pop(0), return_inverse=True)
            self.keys.append(keys)
            self.own.append(inverse.astype(np.int32))
        self.own[0] = self.own[0][:-1]
        self.end = int(np.searchsorted(self.keys[0], END))

    def _by_bucket(self, order: int, buckets: int) -> Iterator[tuple[int, slice]]:
        """Each bucket that has keys of an order, with their places."""
        # a bucket is a range of keys, in which the differences of neighbours are small
        width = (1 << (56 if order else 64)) // buckets + 1
        starts = np.searchsorted(self.keys[order], np.array([min(width * i, (1 << 64) - 1) for i in range(buckets + 1)], U64))
        for bucket in np.flatnonzero(np.diff(starts)).tolist():
            yield bucket * ORDERS + order, slice(starts[bucket], starts[bucket + 1])

    def requests(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """For each bucket: the keys, and their counts in rows for the weights' estimates and in held-out rows."""
        for order, keys in enumerate(self.keys):
            counts = np.bincount(self.own[order][self.trained], minlength=len(keys)).astype(np.uint32)
            for bucket, own in self._by_bucket(order, buckets):
                yield bucket, _squeezed(np.diff(keys[own], prepend=U64(0))) + _planes(counts[own])

    def answers(self, rows: pd.DataFrame, buckets: int) -> list[np.ndarray]:
        """For each order: counts in all training rows, of a chunk that is held out in the estimates' rows."""
        expand = zstandard.ZstdDecompressor().decompress
        got = dict(zip(rows["bucket"], rows["blob"], strict=True))
        out = []
        for order, keys in enumerate(self.keys):
            counts = np.zeros((1 + self.held, len(keys)), np.int64)
            for bucket, own in self._by_bucket(order, buckets):
                counts[:, own] = _expanded(expand(got[bucket]), np.int64).reshape(1 + self.held, -1)
            out.append(counts)
        return out


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, so that those bytes that are mostly zero stand together and are compressed away."""
    return np.ascontiguousarray(np.ascontiguousarray(numbers).reshape(-1, 1).view(np.uint8).T).tobytes()


def _squeezed(numbers: np.ndarray) -> bytes:
    """How many 64-bit numbers there are, and their planes."""
    return struct.pack("<q", numbers.size) + _planes(numbers)


def _expanded(data: bytes, kind: type) -> np.ndarray:
    (n,) = struct.unpack_from("<q", data)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, 8).reshape(8, n).T).view(kind).ravel()


def _add_up(group: pd.DataFrame) -> pd.DataFrame:
    """A bucket's totals, as answers to its chunks; chunk -1 has the numbers of words and tokens of both kinds of rows."""
    squeeze, expand = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    bucket = int(group["bucket"].iloc[0])
    keys, counts = [], []
    for blob in group["blob"]:
        data = expand(blob)
        keys.append(np.cumsum(_expanded(data, U64), dtype=U64))
        n = len(keys[-1])
        counts.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, 8 + 8 * n).reshape(4, n).T).view(np.uint32).ravel())
    sizes = [len(x) for x in keys]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    held = np.repeat(group["held"].to_numpy() == 1, sizes)
    every = np.concatenate(counts)
    totals = [np.rint(np.bincount(inverse, x, len(distinct))).astype(np.int64) for x in (np.where(held, 0, every), every)]
    rows, at = [], 0
    for chunk, kind, n in zip(group["chunk"], group["held"], sizes, strict=True):
        own = inverse[at : at + n]
        rows.append((chunk, kind, bucket, squeeze(_squeezed(np.concatenate([t[own] for t in (totals if kind else totals[1:])])))))
        at += n
    if bucket % ORDERS == 0:
        rows.append((-1, -1, bucket, struct.pack(">4q", *(int(x) for t in totals for x in ((t > 0).sum(), t.sum())))))
    return pd.DataFrame(rows, columns=["chunk", "held", "bucket", "blob"])


def _number(digits: Column, i: int) -> Column:
    """The i-th 64-bit number of a big-endian byte string in hexadecimal."""
    return F.conv(F.substring(digits, 16 * i + 1, 16), 16, 10).cast("bigint")


def _estimates(own: _Keys, counts: list[np.ndarray], which: int, total: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of the tokens, with each token's bucket of the context, and a column of estimates from the triple, the pair and the word."""
    # row 0 has the estimates' rows, of a chunk that is held out; row -1 all
    words, pairs, triples = (c[which] for c in counts)
    level = lambda n: np.minimum(1 + np.log2(np.maximum(n, 1)).astype(np.int64), FREQUENCIES - 1)
    for begin in range(0, len(own.own[0]), SLICE_TOKENS):
        part = slice(begin, min(begin + SLICE_TOKENS, len(own.own[0])))
        word, pair, triple = (c[x[part]] for c, x in zip((words, pairs, triples), own.own, strict=True))
        earlier = np.maximum(np.arange(part.start, part.stop) - 1, 0)
        context, history = words[own.own[0][earlier]], pairs[own.own[1][earlier]]
        firsts = own.firsts[slice(*np.searchsorted(own.firsts, [part.start, part.stop]))] - part.start
        context[firsts] = history[firsts] = words[own.end]  # before a text's first word: as often as texts end
        bucket = np.where(history > 0, FREQUENCIES + level(history), np.where(context > 0, level(context), 0))
        yield part, bucket, np.stack([triple / np.maximum(history, 1), pair / np.maximum(context, 1), word / max(total, 1)])


def weights_of(bins: list[tuple[int, float, float, float, float]], uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """The weights (triple, pair, word, uniform) of each bucket of contexts by expectation-maximisation.

    bins: bucket, estimates of triple, pair and word, number of held-out tokens. A bucket without held-out tokens takes the
    weights of all together; estimates that a bucket's contexts don't have get no weight.
    """
    first = np.array([0.3, 0.3, 0.3, 0.1])
    there = np.ones((2 * FREQUENCIES, 4))
    there[:FREQUENCIES, 0] = there[0, 1] = 0.0
    rows = np.array(bins, float).reshape(-1, 5)
    out, every = np.tile(first, (2 * FREQUENCIES, 1)), first
    for bucket in [None, *range(2 * FREQUENCIES)]:
        own = rows if bucket is None else rows[rows[:, 0] == bucket]
        mixed = every
        if len(own):
            p, n = np.column_stack([own[:, 1:4], np.full(len(own), uniform)]), own[:, 4]
            mixed = first
            for _ in range(rounds):
                share = p * mixed
                share *= (n / share.sum(1))[:, None]
                mixed = np.maximum(share.sum(0) / n.sum(), 1e-6)
                mixed = mixed / mixed.sum()
        if bucket is None:
            every = mixed
        else:
            out[bucket] = mixed * there[bucket] / (mixed * there[bucket]).sum()
    return out


def scored(docs: DataFrame, trained: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all rows by a model of those for which `trained` holds.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score, for words [^\\x20\\x09-\\x0D]+ with A-Z lowered and
    an end after each text. base_score is the add-one unigram score, score the model's log10 probability.

    A null or empty text is the end alone; null keys are rows like others (and, as their hash is null, not trained on
    unless the condition says so); repeated rows count and are scored each; an empty table gives no rows; without
    training rows all counts are 0 and the model is uniform; other columns are ignored but for `trained`.
    """
    source = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"), F.coalesce(trained, F.lit(False)).alias("trained"))
    held = F.col("trained") & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(HELD)) == 0)
    packed = written(_packed(source, held), "packed")
    size = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint") + 64), F.lit(0))).first()[0]
    buckets = 1 + size // BUCKET_BYTES
    chunk_parts, bucket_parts = (int(min(PARTITIONS, n)) for n in (1 + size // CHUNK_BYTES, ORDERS * buckets))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for chunk, kind, ids, blob in zip(batch["chunk"], batch["held"], batch["ids"], batch["blob"], strict=True):
                rows = [(chunk, kind, bucket, squeeze(data)) for bucket, data in _Keys(ids, blob, kind).requests(buckets)]
                yield pd.DataFrame(rows, columns=["chunk", "held", "bucket", "blob"])
                released()

    asked = packed.select("chunk", "held", "ids", "blob").mapInPandas(ask, "chunk long, held int, bucket long, blob binary")
    answers = written(asked.repartition(bucket_parts, "bucket").groupBy("bucket").applyInPandas(_add_up, "chunk long, held int, bucket long, blob binary"), "answers")
    told_ = answers.where(F.col("chunk") == -1).select(F.hex("blob").alias("blob"))
    numbers = [F.sum(_number(F.col("blob"), i)).alias(f"n{i}") for i in range(4)]
    totals = [int(x or 0) for x in told_.agg(*numbers).first()]
    fit_words, fit_tokens, all_words, all_tokens = totals

    def with_answers(f, kinds: Column, schema: str) -> DataFrame:
        """f of each chunk with its answers; the two meet by chunk in as many tasks as there are chunks."""
        left = packed.where(kinds).select("chunk", "held", "ids", "blob").repartition(chunk_parts, "chunk")
        right = answers.where(kinds & (F.col("chunk") >= 0)).select("chunk", "bucket", "blob").repartition(chunk_parts, "chunk")

        def run(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            keys = _Keys(own["ids"].iloc[0], own["blob"].iloc[0], own["held"].iloc[0])
            counts = keys.answers(rows, buckets)
            released()
            out = f(keys, counts)
            del keys, counts
            released()
            return out

        return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInPandas(run, schema)

    def estimate(own: _Keys, counts: list[np.ndarray]) -> pd.DataFrame:
        parts = []
        for _, bucket, p in _estimates(own, counts, 0, fit_tokens):
            code = bucket
            for x in p:
                code = code * 64 + np.where(x > 0, 1 + np.clip(np.rint(-np.log2(np.maximum(x, 1e-30))), 0, LOW_BINS).astype(np.int64), 0)
            found, place = np.unique(code, return_inverse=True)
            sums = {name: np.bincount(place, x, len(found)) for name, x in zip(("triple", "pair", "word"), p, strict=True)}
            parts.append(pd.DataFrame({"code": found, "n": np.bincount(place, minlength=len(found)), **sums}))
        return pd.concat(parts)

    table_ = with_answers(estimate, F.col("held") == 1, "code long, n long, triple double, pair double, word double").groupBy("code")
    # 2 * FREQUENCIES * (LOW_BINS + 2)**3 rows at most, of which few occur
    bins = table_.agg(*[F.sum(c).alias(c) for c in ("n", "triple", "pair", "word")]).collect()
    mixture = weights_of([(r.code >> 18, r.triple / r.n, r.pair / r.n, r.word / r.n, r.n) for r in bins], 1.0 / (fit_words + 1))

    def tell(own: _Keys, counts: list[np.ndarray]) -> pd.DataFrame:
        seen = counts[0][-1][own.own[0]]
        base = np.log10((seen + 1) / (all_tokens + all_words + 1))
        model = np.empty(len(seen))
        for part, bucket, p in _estimates(own, counts, -1, all_tokens):
            mixed = mixture[bucket].T
            model[part] = np.log10((mixed[:3] * p).sum(0) + mixed[3] / (all_words + 1))
        add = lambda x: np.add.reduceat(x, own.firsts)
        return pd.DataFrame({"doc_id": pd.Series(own.ids, dtype=object), "n_tokens": own.counts, "n_known": add((seen > 0).astype(np.int64)), "base_score": add(base), "score": add(model)})

    told = with_answers(tell, F.lit(True), "doc_id string, n_tokens long, n_known long, base_score double, score double")
    told = told.withColumn("doc_id", F.col("doc_id").cast(source.schema["doc_id"].dataType))
    return told.withColumn("train_tokens", F.lit(all_tokens).cast("bigint"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of six sevenths of them."""
    seventh = F.crc32(F.col("doc_id").cast("string")) % 7
    found = scored(table(spark, sf_dir, "documents"), seventh != 2)
    return found.select("doc_id", F.coalesce(seventh == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
