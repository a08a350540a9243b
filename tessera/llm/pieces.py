"""SentencePiece encoding and decoding by a forward pass that common prefixes share.

A text is cut into marked words (▁ for the space before each). The distinct words of a batch are sorted, which is a
depth-first walk of their trie: a word keeps the forward scores and states of the prefix it has in common with the one before,
and goes on from there. The forward score is the highest sum of piece scores of a prefix (Viterbi), the state its last piece:

* of a unigram model, the piece with the highest sum of scores (Viterbi);
* of a BPE model, the one piece that ends there and that merging leaves apart from the state before it. Merging is
  consistent from left to right: a sequence of pieces is what merging makes of a word if and only if it leaves each two
  neighbours apart. So the result equals that of the merges, which a sum of scores would not.

Ids of words are kept in a bounded cache, as few words make up most of a corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import released, slices, table, text_or_empty

MARK = "▁"
_WORDS = re.compile("▁*[^▁]+|▁+")
#: Words and pairs of pieces that a worker keeps at most, and the longest word that is kept.
CACHE_WORDS, CACHE_PAIRS, CACHED_CHARS = 400_000, 500_000, 48
#: Ids of words that a worker keeps at most, about.
CACHE_IDS = 4 << 20
#: Characters that a task encodes at a time.
BATCH_CHARS = 4 << 20
#: What an unknown character costs in a unigram model, under the least score.
UNKNOWN_COST = 10.0


class Pieces:
    """A model's pieces, with encoding and decoding."""

    _shared: dict[str, Pieces] = {}

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        if proto.normalizer_spec.name not in ("identity", "") or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave texts as they are")
        self.bpe = proto.trainer_spec.model_type == 2
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unknown = model.unk_id()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(model.vocab_size())]
        self.ids = {model.id_to_piece(i): i for i in range(model.vocab_size()) if not special[i]}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes over the start of a word")
        self.automaton = ahocorasick.Automaton()
        for p, score in self.scores.items():
            self.automaton.add_word(p, (len(p), p, score))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ids))
        self.least = min(self.scores.values()) - UNKNOWN_COST
        self.bytes = {b: model.piece_to_id(f"<0x{b:02X}>") for b in range(256)} if proto.trainer_spec.byte_fallback else {}
        self.raw = [b""] * len(special)
        for piece, i in self.ids.items():
            self.raw[i] = piece.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.raw[self.unknown] = " ⁇ ".encode()
        self._forget()
        self.apart: dict[tuple[str, str], bool] = {}
        self.own: dict[str, bytes] = {}

    @classmethod
    def shared(cls, path: str) -> Pieces:
        """The pieces of this worker process."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _merged(self, text: str) -> list[str]:
        """The pieces that merging makes of a short string: the best-scored pair first, the leftmost of equal ones."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stay_apart(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > CACHE_PAIRS:
                self.apart.clear()
            known = self.apart[key] = self._merged(left + right) == ([left, right] if left else [right])
        return known

    def _ids(self, piece: str) -> bytes:
        known = self.own.get(piece)
        if known is None:
            i = self.ids.get(piece)
            found = [i] if i is not None else [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]
            known = self.own[piece] = np.array(found, "<u4").tobytes()
        return known

    def _walk(self, words: list[str]) -> Iterator[tuple[bytes, int, float]]:
        """The ids of sorted words, and how many pieces the best-scored segmentation of each has, with its score.

        last[i] is the last piece of the first i characters as merging leaves it (or as scores have it, in a unigram model); best[i] is the
        highest sum of scores of the first i characters and number[i] that segmentation's pieces: the forward pass (Viterbi).
        """
        apart, own, least, longest = self.apart, self.own, self.least, self.longest
        last, best, number, before = [""], [0.0], [0], ""
        for word in words:
            shared = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], best[shared + 1 :], number[shared + 1 :]
            now, hits = shared + 1, []
            # the pieces that end at each place, the longest first; a last one closes the word
            for place, hit in chain(self.automaton.iter(word, max(0, now - longest)), ((len(word), None),)):
                if place + 1 <= shared:
                    continue
                while now <= place:  # the places before this one are complete
                    if not hits or hits[-1][0] > 1:
                        hits.append((1, word[now - 1], least))
                    top, merged = -np.inf, None
                    for n, piece, score in hits:
                        left = now - n
                        total = best[left] + score
                        if total > top:
                            top, found, most = total, piece, number[left] + 1
                        if merged is None and self.bpe:
                            known = apart.get((last[left], piece))
                            if self._stay_apart(last[left], piece) if known is None else known:
                                merged = piece
                    last.append((word[now - 1] if merged is None else merged) if self.bpe else found)
                    best.append(top)
                    number.append(most)
                    now += 1
                    hits = []
                hits.append(hit)
            before, parts, end = word, [], len(word)
            while end:
                piece = last[end]
                parts.append(own.get(piece) or self._ids(piece))
                end -= len(piece)
            yield b"".join(reversed(parts)), number[-1], best[-1]

    def _forget(self) -> None:
        """Begin with no words kept: of each its place, and in arrays by place its ids (all in one), number of pieces and score."""
        self.place: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.starts, self.sizes, self.numbers = (np.empty(0, np.int64) for _ in range(3))
        self.best_scores = np.empty(0)

    def _learn(self, words: list[str]) -> None:
        """Walk sorted words and keep them."""
        found, numbers, scores = zip(*self._walk(words), strict=True)
        self.place.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), "<u4")])
        self.numbers = np.concatenate([self.numbers, np.array(numbers, np.int64)])
        self.best_scores = np.concatenate([self.best_scores, np.array(scores, float)])

    def segmented(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts, where each text's end, and the pieces and the score of each text's best-scored segmentation."""
        if len(self.place) > CACHE_WORDS or len(self.flat) > CACHE_IDS:
            self._forget()
        cut = []
        for text in texts:
            if not text:
                cut.append([])
                continue
            marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
            cut.append(_WORDS.findall(marked))
        fresh = set().union(*cut) if cut else set()
        fresh.difference_update(self.place)
        if fresh:
            self._learn(sorted(fresh))
        counts = np.array([len(words) for words in cut], np.int64)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        values = self.flat[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        last = np.cumsum(counts)
        numbers, scores = np.zeros(len(cut), np.int64), np.zeros(len(cut))
        some = np.flatnonzero(counts)
        if len(some):
            firsts = (last - counts)[some]
            numbers[some], scores[some] = np.add.reduceat(self.numbers[at], firsts), np.add.reduceat(self.best_scores[at], firsts)
        for word in fresh:
            if len(word) > CACHED_CHARS:
                del self.place[word]
        return values, ends[last], numbers, scores

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        values, ends, _, _ = self.segmented(texts)
        return [values[s:e].tobytes() for s, e in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that stands before the first word goes, and bytes that aren't UTF-8 are replaced."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encoded(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int), best_pieces and best_score of every row's whole text.

    The ids are the model's; best_score is the highest sum of piece scores that a segmentation of the text has, best_pieces that
    segmentation's number of pieces (the same as the ids' in a unigram model, but for characters in bytes). A null or empty text has no ids; null keys and repeated rows are kept; a very long word is walked once and not kept;
    an empty table gives no rows; other columns are ignored. A ▁ in a text counts as a space.
    """
    source = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"), F.char_length(text_or_empty(text)).alias("size"))
    kind = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.shared(model)
        for batch in batches:
            for part in slices(batch.column(2).to_numpy(), BATCH_CHARS):
                values, ends, numbers, scores = pieces.segmented(batch.column(1)[part].to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], lists, pa.array(numbers), pa.array(scores)], names=["doc_id", "ids", "best_pieces", "best_score"])
        released()

    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>, best_pieces bigint, best_score double")


def decoded(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """rows with a column decoded: the text of the ids (null: empty). One of that name is replaced."""
    others = [c for c in rows.columns if c != "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.shared(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            texts = [pieces.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])
        released()

    return rows.select(*others).mapInArrow(run, f"{schema}, decoded string")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and a CRC of what they decode to (the text's own, as the round trip is exact)."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    found = decoded(encoded(table(spark, sf_dir, "documents"), model), model)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", F.crc32("decoded").alias("decoded_crc32"), "best_pieces", "best_score")
