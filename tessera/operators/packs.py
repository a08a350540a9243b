"""Stored packs of vectors for exact nearest neighbours by cosine, of which a search reads those that can matter.

Vectors of length one are dealt to centres that are learned from a bounded sample, and packed by centre. A pack has its mean direction
and the least cosine of its vectors to it, from which follows the highest cosine that any of them can have with a query: the angle between
query and mean less the pack's widest angle. The packs with a query's highest bounds are compared first; of the others those whose
bound reaches the k-th best of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.listing import top_of
from tessera.shared import written

#: Vectors that centres are learned from, at most; centres at most, and rounds.
SAMPLE, CENTRES, ROUNDS = 20_000, 256, 8
#: Vectors of a pack at most, packs of a query that are compared first, and queries that meet a pack at a time.
PACK, FIRST, QUERIES = 1024, 2, 512
#: How far a bound or score may be off by rounding.
SLACK = 2e-6


def _units(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which vectors have one: not null, of finite numbers, not of length zero."""
    there = vectors.map(lambda v: v is not None and len(v) > 0).to_numpy(bool)
    matrix = np.stack([np.asarray(v, np.float64) for v in vectors[there]]) if there.any() else np.empty((0, 0))
    norm = np.sqrt((matrix * matrix).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    there[there] = good
    return matrix[good] / norm[good, None], there


def _centres(vectors: DataFrame, most: int) -> np.ndarray:
    """Directions of groups of a sample, by spherical k-means: the first SAMPLE vectors by a hash of the key."""
    rows = vectors.where(F.col("vector").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()
    unit, _ = _units(rows["vector"])
    if not len(unit):
        return np.empty((0, 0))
    n = max(1, min(most, int(np.sqrt(len(unit)))))
    centres = unit[np.linspace(0, len(unit) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        nearest = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-30), centres)
    return centres


def build(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", centres: int = CENTRES) -> None:
    """Write packs of all vectors (of one width) over what is at a path.

    Vectors that are null, of no length, or not finite are in no pack. Keys are distinct. A centre that many vectors share has
    many packs, dealt over tasks by their keys' hashes.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    kind = dict(rows.dtypes)["id"]
    learned = rows.sparkSession.sparkContext.broadcast(_centres(rows, centres))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            unit, there = _units(frame["vector"])
            if len(unit):
                yield pd.DataFrame({"id": frame["id"].to_numpy()[there], "centre": (unit @ learned.value.T).argmax(1), "unit": [x.tobytes() for x in unit]})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in _and_none(frames):
            if frame is not None:
                held.append(frame)
            rows_ = pd.concat(held) if held else None
            if rows_ is None:
                continue
            whole = [own for _, own in rows_.groupby("centre", sort=False)]
            # the last centre may go on in the next batch
            held = [whole.pop()] if frame is not None else []
            for own in whole:
                for at in range(0, len(own), PACK):
                    part = own.iloc[at : at + PACK]
                    matrix = np.stack([np.frombuffer(x) for x in part["unit"]])
                    mean = matrix.sum(0)
                    norm = np.sqrt(mean @ mean)
                    mean = mean / norm if norm > 1e-12 else matrix[0]
                    yield pd.DataFrame({"ids": [part["id"].tolist()], "mean": [mean.tobytes()], "reach": [float((matrix @ mean).min())], "unit": [matrix.tobytes()]})

    dealt = rows.mapInPandas(deal, f"id {kind}, centre int, unit binary")
    order = ["centre", F.xxhash64("id")]
    packed = dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pack, f"ids array<{kind}>, mean binary, reach double, unit binary")
    packed.withColumn("pack", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)


def _and_none(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from frames
    yield None


def _bounded(queries: DataFrame, packs: DataFrame, kind: str) -> DataFrame:
    """query, pack, bound: the highest cosine that a vector of the pack can have with the query."""
    asked = queries.groupBy("chunk").agg(F.collect_list("query").alias("queries"), F.collect_list("unit").alias("units"))  # QUERIES or so in each
    width = packs.select((F.octet_length("mean") / 8).cast("int").alias("n")).first()

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), PACK):
                own = frame.iloc[at : at + PACK]
                yield pd.DataFrame({"packs": [own["pack"].tolist()], "means": [b"".join(own["mean"])], "reach": [own["reach"].tolist()]})

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                units = [np.frombuffer(x) for x in row.units]
                fits = [len(u) == width.n for u in units]
                if not any(fits):
                    continue
                unit = np.stack([u for u, ok in zip(units, fits, strict=True) if ok])
                means = np.frombuffer(row.means).reshape(-1, width.n)
                apart = np.arccos(np.clip(unit @ means.T, -1, 1)) - np.arccos(np.clip(np.asarray(row.reach), -1, 1))[None]
                best = np.where(apart > 0, np.cos(np.clip(apart, 0, np.pi)), 1.0)
                yield pd.DataFrame({"query": np.repeat(np.asarray(row.queries)[fits], len(means)), "pack": np.tile(np.asarray(row.packs), len(unit)), "bound": best.ravel()})

    # a stated set of queries, in blocks, against blocks of the packs' directions
    told = packs.select("pack", "mean", "reach").mapInPandas(gather, "packs array<long>, means binary, reach array<double>")
    return told.crossJoin(asked).mapInPandas(bound, f"query {kind}, pack long, bound double")


def _compared(pairs: DataFrame, queries: DataFrame, packs: DataFrame, k: int, kinds: tuple[str, str]) -> DataFrame:
    """query, id, score: the best k of each query and pack among pairs (query, pack), and those that rounding may put level."""
    wanted = pairs.select("query", "pack").join(queries, "query").select(F.col("pack").alias("of"), "chunk", "query", F.col("unit").alias("asked"))
    there = wanted.select("of", "chunk").distinct().toDF("pack", "part").join(packs.select("pack", "ids", "unit"), "pack")

    def best(held: pa.Table, asked: pa.Table) -> pa.Table:
        theirs_ = np.frombuffer(held["unit"][0].as_py())
        ids = held["ids"].combine_chunks().flatten()
        theirs = theirs_.reshape(len(ids), -1)
        ours = np.stack([np.frombuffer(x) for x in asked["asked"].to_pylist()])
        scores = ours @ theirs.T
        least = np.partition(scores, -k, axis=1)[:, -k] if k < scores.shape[1] else np.full(len(scores), -2.0)
        q, v = np.nonzero(scores >= least[:, None] - SLACK)
        return pa.Table.from_arrays([asked["query"].take(pa.array(q)), ids.take(pa.array(v)), pa.array(scores[q, v])], names=["query", "id", "score"])

    met = there.groupBy("pack", "part").cogroup(wanted.groupBy("of", "chunk")).applyInArrow(best, f"query {kinds[0]}, id {kinds[1]}, score double")
    return met.withColumn("score", F.round("score", 6))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """query, id, score, rank: the exact k nearest stored vectors of each query (query, vector), rounded to six digits; ties go by id."""
    packs = spark.read.parquet(path)
    asked = queries.select("query", F.col("vector").cast("array<double>").alias("vector"))
    kinds = dict(asked.dtypes)["query"], dict(packs.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def unit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own, there = _units(frame["vector"])
            yield pd.DataFrame({"query": frame["query"].to_numpy()[there], "unit": [x.tobytes() for x in own]})

    chunk = F.pmod(F.xxhash64("query"), F.lit(1 + queries.count() // QUERIES))
    asked = written(asked.mapInPandas(unit, f"query {kinds[0]}, unit binary").withColumn("chunk", chunk), "queries")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "pack"))
    bounds = written(_bounded(asked, packs, kinds[0]).withColumn("place", place), "bounds")
    best = [F.desc("score"), F.asc("id")]
    found = written(_compared(bounds.where(F.col("place") <= FIRST), asked, packs, k, kinds), "scored")
    least = top_of(found, ["query"], best, k).where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    rest = bounds.where(F.col("place") > FIRST).join(least, "query", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
    return top_of(found.unionByName(_compared(rest, asked, packs, k, kinds)), ["query"], best, k)
