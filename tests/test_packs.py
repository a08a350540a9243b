"""Stored packs of vectors against plain cosines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import packs

SCHEMA = "vec_id long, embedding array<double>"


def nearest(vectors, queries, k):
    out = {}
    unit = {i: np.asarray(v) / np.linalg.norm(v) for i, v in vectors if v is not None and len(v) and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    for q, v in queries:
        own = np.asarray(v) / np.linalg.norm(v)
        ranked = sorted((-round(float(own @ u), 6), i) for i, u in unit.items())[:k]
        out |= {(q, i): r for r, (_, i) in enumerate(ranked, 1)}
    return out


def test_nearest_are_exact_and_fewer_packs_are_read(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = [(i, (centres[i % 12] + 0.15 * rng.normal(size=16)).tolist()) for i in range(1500)]
    vectors += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, vectors[3][1]), (9004, (2 * np.asarray(vectors[3][1])).tolist())]
    path = str(tmp_path / "packs")
    packs.build(spark.createDataFrame(vectors, SCHEMA).repartition(4), path, centres=24)
    queries = [(q, vectors[q][1]) for q in range(0, 40, 3)] + [(100, rng.normal(size=16).tolist())]
    asked = spark.createDataFrame(queries, "query long, vector array<double>")
    for k in (1, 7, 2000):
        found = {(r.query, r.id): r["rank"] for r in packs.search(spark, path, asked, k).collect()}
        assert found == nearest(vectors, queries, k)
    # of the pairs of query and pack, those that are compared after the first
    compared = []
    plain = packs._compared
    monkeypatch.setattr(packs, "_compared", lambda pairs, *a: compared.append(pairs.count()) or plain(pairs, *a))
    packs.search(spark, path, asked, 7).count()
    every = len(queries) * spark.read.parquet(path).count()
    assert sum(compared) < every / 2
    assert spark.read.parquet(path).select(F.explode("ids")).count() == 1502


def test_no_vectors(spark, tmp_path):
    path = str(tmp_path / "none")
    packs.build(spark.createDataFrame([], SCHEMA), path)
    assert packs.search(spark, path, spark.createDataFrame([(1, [1.0])], "query long, vector array<double>"), 3).count() == 0
