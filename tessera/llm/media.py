"""Media columns: texts as 8-bit WAV files, short-time Fourier transforms, and fingerprints of pairs of spectral peaks.

The first half stores any bytes losslessly as samples of a WAV file; the second reads such files by the wave module.
A peak is a frequency that is stronger than its two neighbours and than FLOOR times the mean of its frame; of the peaks
in each of a few bands of a frame the strongest is taken. It is paired with that of the next band that has one in its frame, and
with those of its band in the frames after it. A pair is coded by its band, both frequencies and the frames between; codes and
times are arrays.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_or_empty

#: Payloads are a positive multiple of this many bytes, filled up with FILL.
BLOCK, FILL = 576, b"\xff"
RATE = 8000
#: Samples of a frame and between the middles of frames: a block has seven frames.
FRAME, HOP = 192, 96
#: First frequency bins of the bands, and the end of the last (the outermost bins have one neighbour and are never peaks).
BANDS = (1, 8, 20, 44, 96)
#: How much stronger than the mean of its frame a peak is at least.
FLOOR = 1.0
#: Share of the sample before that is taken from each, so that steps (as to the filling) don't drown the rest.
EMPHASIS = 0.97
#: Frames from a peak to its partners of the same band.
STEPS = (1, 2)
#: Frames that are transformed at a time, and bytes of media in a batch.
FRAMES, BATCH_BYTES = 2048, 4 << 20
_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def wav(payload: bytes) -> bytes:
    """A mono file of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue()


def samples(media: bytes) -> bytes:
    """The samples of a mono file of 8-bit samples."""
    with wave.open(io.BytesIO(media), "rb") as file:
        if (file.getnchannels(), file.getsampwidth()) != (1, 1):
            raise ValueError("not a mono file of 8-bit samples")
        return file.readframes(file.getnframes())


def peaks(payload: bytes) -> np.ndarray:
    """The frequency bin of the strongest peak of each band (column) in each frame (row), the lowest of equal ones; 0 where there is none."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    x = np.diff(x, prepend=x[:1]) + (1 - EMPHASIS) * np.concatenate([x[:1], x[:-1]])
    x = np.pad(x, (HOP, max(HOP, FRAME - HOP - len(x))))  # the first samples have the middle of a frame, as the last have
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((len(frames), len(BANDS) - 1), np.int32)
    for i in range(0, len(frames), FRAMES):
        part = frames[i : i + FRAMES]
        size = np.abs(np.fft.rfft((part - part.mean(1, keepdims=True)) * _WINDOW, axis=1)).astype(np.float32)
        middle = size[:, 1:-1]
        high = (middle > size[:, :-2]) & (middle >= size[:, 2:]) & (middle > FLOOR * size.mean(1, keepdims=True) + 1e-4)
        only = np.where(high, middle, 0)
        for b, (first, end) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            band = only[:, first - 1 : end - 1]
            found = band.argmax(1)
            out[i : i + FRAMES, b] = np.where(band[np.arange(len(band)), found] > 0, first + found, 0)
    return out


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and codes of the pairs of peaks, by time, then step (0: a higher band), then band.

    A code has the band from bit 16 on, the frequency of the peak from bit 9, that of its partner from bit 2, and the step.
    """
    found = peaks(payload)
    frames, bands = found.shape
    higher = np.zeros_like(found)
    for b in range(bands - 2, -1, -1):
        higher[:, b] = np.where(found[:, b + 1] > 0, found[:, b + 1], higher[:, b + 1])
    times, codes = [], []
    for step, (one, other) in {0: (found, higher), **{n: (found[:-n], found[n:]) for n in STEPS if frames > n}}.items():
        time, band = np.nonzero((one > 0) & (other > 0))
        codes.append((band << 16 | one[time, band] << 9 | other[time, band] << 2 | step).astype(np.int32))
        times.append(time.astype(np.int32))
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.argsort(time, kind="stable")
    return time[order], code[order]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, raw -> doc_id, n_bytes, media, in batches of a bounded size."""
    for batch in batches:
        begin, held, total = 0, [], 0
        raw = batch.column(1)
        for i, value in enumerate(raw):
            data = value.as_buffer().to_pybytes()
            held.append((len(data), wav(data + FILL * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data)))))
            total += len(data)
            if total >= BATCH_BYTES or i == len(raw) - 1:
                sizes, files = zip(*held, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin : i + 1], pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])
                begin, held, total = i + 1, [], 0


TOLD = ("payload_bytes bigint", "payload_sha256 string", "tail_crc32 bigint", "media_bytes bigint", "media_sha256 string", "times array<int>", "codes array<int>")


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, media -> doc_id, n_bytes and what the file holds."""
    names = ["doc_id", "n_bytes", *(x.split()[0] for x in TOLD)]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))

    for batch in batches:
        if not batch.num_rows:
            continue
        told, times, codes = [], [], []
        for value in batch.column(2):
            file = value.as_buffer().to_pybytes()
            payload = samples(file)
            time, code = fingerprint(payload)
            told.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest()))
            times.append(time)
            codes.append(code)
        columns = [pa.array(x, t) for x, t in zip(zip(*told, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, lists(times), lists(codes)], names=names)


def _raw(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    source = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).cast("binary").alias("raw"))
    return source, f"doc_id {dict(source.dtypes)['doc_id']}, n_bytes bigint"


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8) and media: the bytes, filled up, as a WAV file.

    A null text counts as empty and gives one block; repeated rows and null keys are kept; an empty table gives no
    rows; other columns are ignored.
    """
    source, head = _raw(docs, key, text)
    return source.mapInArrow(_store, f"{head}, media binary")


def described(media: DataFrame) -> DataFrame:
    """What the stored files hold: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, times, codes.

    The payload is read back from the file; times and codes are its fingerprint. A null file fails, as does one of
    another format.
    """
    source = media.select("doc_id", "n_bytes", "media")
    return source.mapInArrow(_describe, f"doc_id {dict(source.dtypes)['doc_id']}, n_bytes bigint, {', '.join(TOLD)}")


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """described(stored(docs)) by one worker for each task: a file goes from the one to the other in its memory."""
    source, head = _raw(docs, key, text)
    return source.mapInArrow(lambda batches: _describe(_store(batches)), f"{head}, {', '.join(TOLD)}")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as WAV files, with their fingerprints (times and codes of pairs) and a digest of them: number and hash."""
    found = fingerprinted(table(spark, sf_dir, "documents"))
    return found.select(*found.columns[:-2], F.concat_ws(":", F.size("codes"), F.hex(F.xxhash64("times", "codes"))).alias("feature"), "times", "codes")
