"""Helpers that the corpus operators share: shared scratch space, table reading, byte-bounded batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shared import cleared, dropped, shared_dir, written  # noqa: F401

#: Characters that separate words: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_columns(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on, so that an operator's own names clash with none (nor do repeated ones)."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def text_or_empty(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def released() -> None:
    """Give what this Python worker has freed back to the system, as it is kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.translate(_ASCII_LOWER)


_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to at most `most` (a single larger item has its own slice)."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += int(n)
    if begin < len(sizes):
        yield slice(begin, len(sizes))
