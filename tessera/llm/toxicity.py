"""Toxicity by a weighted lexicon.

Texts are folded (lower case, homoglyphs, digits that stand for letters), the lexicon's terms are found by an
Aho-Corasick automaton, terms inside exception phrases don't count, and the sum of weights is set against the length.
Terms, weights and exceptions are learned from labelled rows by smoothed log odds; a term is a whole word or the
beginning of words. A logistic curve, fitted on the same rows, turns the sum into a score from 0 to 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import dropped, table, text_or_empty, written

# Characters that look like Latin letters, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l", "ⅰ": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"

_FOLD = {ord(k): v for k, v in {**HOMOGLYPHS, **DIGITS}.items()}
_FOLD |= {ord(c): None for c in INVISIBLE}
_FOLD |= {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)}  # full-width forms
_FOLD |= {0xFF10 + int(d): v for d, v in DIGITS.items() if d.isdigit()}
_WORD = re.compile(r"[^\W\d_]+")

#: Rows of each label that lexicon and curve are learned from: a bounded sample, by the order of a hash of the key.
FIT_ROWS = 10_000
#: Least rows of a term or phrase, least log odds, and least log odds in standard errors of terms and of exceptions (of which
#: there is mostly no toxic row at all, so that their error is large).
MIN_ROWS, MIN_ODDS, MIN_Z, MIN_EXCEPTION_Z = 4, 1.5, 3.0, 1.0
#: Lengths of the beginnings of words that can be terms.
STEMS = (4, 5, 6)


def fold(text: str) -> str:
    """Lower case, without invisible characters, look-alikes and digits replaced by letters."""
    return text.lower().translate(_FOLD)


@dataclass(frozen=True)
class Lexicon:
    """Weights of words and of beginnings of words, exception phrases, and the curve from evidence to score."""

    words: dict[str, float]
    stems: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float] = (-3.0, 3.0)
    _automaton: list = field(default_factory=list, compare=False, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": []}

    def automaton(self) -> ahocorasick.Automaton:
        if not self._automaton:
            found = ahocorasick.Automaton()
            entries: dict[str, list[float]] = {}
            for kind, weights in enumerate((self.words, self.stems)):
                for term, weight in weights.items():
                    entries.setdefault(term, [0.0, 0.0, 0.0])[kind] = weight
            for phrase in self.exceptions:
                entries.setdefault(phrase, [0.0, 0.0, 0.0])[2] = 1.0
            for term, weights in entries.items():
                found.add_word(term, (len(term), *weights))
            found.make_automaton()
            self._automaton.append(found)
        return self._automaton[0]

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of what counts: the best term of each word, unless an exception phrase covers it."""
        automaton = self.automaton()
        if not len(automaton):
            return []
        best: dict[int, tuple[float, int]] = {}
        covered: list[tuple[int, int]] = []
        size = len(folded)
        for last, (n, word, stem, exception) in automaton.iter(folded):
            start, end = last - n + 1, last + 1
            if start and folded[start - 1].isalpha():
                continue
            whole = end == size or not folded[end].isalpha()
            if exception and whole:
                covered.append((start, end))
            weight = max(word if whole else 0.0, stem)
            if weight > best.get(start, (0.0, 0))[0]:
                best[start] = (weight, end)
        # a phrase covers a hit if it begins no later and ends no sooner: of those that begin no later, the farthest end tells
        out, covered, at, farthest = [], sorted(covered), 0, 0
        for start, (weight, end) in sorted(best.items()):
            while at < len(covered) and covered[at][0] <= start:
                farthest = max(farthest, covered[at][1])
                at += 1
            if farthest < end:
                out.append((start, end, weight))
        return out

    def evidence(self, text: str) -> float:
        """The weights of what counts against the length: their sum by the square root of the words in hundreds (one at least)."""
        total = sum(w for _, _, w in self.hits(fold(text)))
        return total / math.sqrt(max(1.0, (text.count(" ") + 1) / 100)) if total else 0.0

    def score(self, text: str) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(self.evidence(text))))))


def _odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> tuple[Column, Column]:
    """Smoothed log odds of a term, and its size in standard errors."""
    weight = F.log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - F.log((clean + 0.5) / (n_clean - clean + 0.5))
    error = F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5) + 1 / (n_toxic - toxic + 0.5) + 1 / (n_clean - clean + 0.5))
    return weight, weight / error


def _counted(rows: DataFrame, terms_of) -> DataFrame:
    """term, kind, toxic, clean: rows of each label that have the term, by partial counts in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
                counts[1 if label else 0].update(terms_of(text))
            terms = list(counts[0].keys() | counts[1].keys())
            toxic, clean = (pa.array([counts[k][t] for t in terms], pa.int64()) for k in (1, 0))
            kinds, names = pa.array([k for k, _ in terms], pa.int32()), pa.array([t for _, t in terms], pa.string())
            yield pa.RecordBatch.from_arrays([kinds, names, toxic, clean], names=["kind", "term", "toxic", "clean"])

    partial = rows.mapInArrow(count, "kind int, term string, toxic long, clean long")
    return partial.groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _terms(text: str) -> set[tuple[int, str]]:
    words = set(_WORD.findall(fold(text)))
    return {(0, w) for w in words if len(w) >= 3} | {(n, w[:n]) for w in words for n in STEMS if len(w) >= n}


def _fit_curve(evidence: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """A logistic curve of log(1 + evidence): ridge-regularised, by Newton steps, rows weighted."""
    x = np.stack([np.ones(len(evidence)), np.log1p(evidence)], 1)
    beta, ridge = np.array([-3.0, 1.0]), np.diag([1e-3, 1e-2]) * max(1.0, weights.sum() / 100)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, x.T @ (weights * (labels - p)) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from the rows of docs that `labels` marks (1 toxic, 0 clean; null marks are left out).

    At most fit_rows rows of each label, the first by a hash of the key, are used; their keys (a bounded number) are
    broadcast to the scan of docs, so that no text is shuffled; their texts are written once. Without toxic or clean rows the lexicon is empty.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    order = [F.xxhash64("key"), F.col("key")]
    sizes = {r.label: r.n for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon({}, {}, (), (-3.0, 0.0))
    chosen = [marks.where(F.col("label") == k).orderBy(*order).limit(fit_rows) for k in (0, 1)]
    rows = written(docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "key").select("text", "label"), "labelled")
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Lexicon({}, {}, (), (-3.0, 0.0))

    def marked(counts: DataFrame, *, toxic: bool) -> list[tuple[int, str, float]]:
        """All terms that mark a side, the surest first; the labelled rows bound their number."""
        side = "toxic" if toxic else "clean"
        least = MIN_Z if toxic else MIN_EXCEPTION_Z
        weight, z = _odds(F.col("toxic"), F.col("clean"), n[1], n[0])
        told = counts.where((F.col(side) >= MIN_ROWS) & (F.col(side) * n[int(not toxic)] > F.col("clean" if toxic else "toxic") * n[int(toxic)] * 3))
        told = told.select("kind", "term", weight.alias("weight"), z.alias("z"))
        kept = told.where(((F.col("weight") if toxic else -F.col("weight")) >= MIN_ODDS) & (F.abs("z") >= least)).collect()
        return [(r.kind, r.term, r.weight) for r in sorted(kept, key=lambda r: (-abs(r.z), r.kind, r.term))]

    terms = marked(_counted(rows, _terms), toxic=True)
    lexicon = Lexicon({t: w for k, t, w in terms if k == 0}, {t: w for k, t, w in terms if k})

    # phrases of a term and a neighbour that clean rows have are exceptions
    def phrases(text_: str) -> set[tuple[int, str]]:
        folded, found = fold(text_), set()
        for start, end, _ in lexicon.hits(folded):
            while end < len(folded) and folded[end].isalpha():
                end += 1
            after, before = end + 1, start - 1
            while after < len(folded) and folded[after].isalpha():
                after += 1
            while before > 0 and folded[before - 1].isalpha():
                before -= 1
            if after > end + 1 and folded[end].isspace():
                found.add((0, folded[start:after]))
            if 0 <= before < start - 1 and folded[start - 1].isspace():
                found.add((0, folded[before:end]))
        return found

    exceptions = tuple(t for _, t, _ in marked(_counted(rows, phrases), toxic=False))
    lexicon = Lexicon(lexicon.words, lexicon.stems, exceptions)

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return texts.map(lexicon.evidence)

    # evidence is rounded, so the curve is fitted on a bounded table
    points = rows.select(F.round(evidence("text"), 2).alias("x"), "label").groupBy("x", "label").agg(F.count("*").alias("n")).collect()
    dropped(rows)
    x, y, c = (np.array([p[i] for p in points], float) for i in range(3))
    share = sizes[1] / (sizes[0] + sizes[1])
    weights = c * np.where(y > 0, share / n[1], (1 - share) / n[0]) * (n[0] + n[1])
    return Lexicon(lexicon.words, lexicon.stems, exceptions, _fit_curve(x, y, weights))


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """docs with a column toxicity from 0 to 1 (one of that name is replaced).

    A null text counts as empty and gets the lowest score of the curve, as any text without a term; whole texts are
    read; rows, repeated ones too, and the other columns are kept; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = shared.value
        return texts.map(own.score)

    return docs.withColumn("toxicity", score(text_or_empty(text)))


def _quarter(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 4


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of all documents, learned from the labels of three quarters."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = learn(docs, labels.where(_quarter() != 2))
    return scored(docs.select("doc_id", "text"), lexicon).select(
        "doc_id", F.coalesce(_quarter() == 2, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted")
    )
