"""Bundles are what they were made of, however often they go round."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.sources import bundles

COLUMNS = "id string, content string, scope string, sensitive boolean, updated_at double, tags array<string>, raw string"


def tables(spark):
    rows = [
        ("a", "plain\ntext 日本", "s1", False, 1.5, ["x", "y"], '{"tool":"other","n":[1,2.5,null],"deep":{"k":"v"}}'),
        ("b", "secret 🙂", "s2", True, 2.0, [], '{"n":7}'),
        ("c", "long " * 50, "s1", None, 3.0, None, "[1]"),
        ("d", "long " * 50, "s1", False, 4.0, None, None),
        ("e", None, "s2", True, 5.0, None, '"text"'),
        ("f", "", "s2", True, 6.0, None, "null"),
        ("g", "sensitive and long " * 20, "s2", True, 7.0, None, None),
    ]
    memories = spark.createDataFrame(rows, COLUMNS).withColumn("metadata", F.parse_json("raw")).drop("raw")
    return {
        "memories": memories,
        "entities": spark.createDataFrame([("e1", "Ann", ["a"], 3)], "id string, name string, aliases array<string>, mention_count long"),
        "relations": spark.createDataFrame([("e1", "uses", "e2", 0.5, None)], "subject_id string, predicate string, object_id string, confidence double, source_memory_id string"),
        "versions": spark.createDataFrame([(1, "old"), (2, "new\n")], "version_num long, content_md string"),
        "audit": spark.createDataFrame([(1, "{}")], "seq long, line string").limit(0),
    }


def plain(df):
    kinds = dict(df.dtypes)
    rows = df.select(*[F.to_json(c).alias(c) if kinds[c] == "variant" else F.col(c) for c in sorted(df.columns)]).collect()
    return sorted(repr(r) for r in rows)


def test_round_trips(spark, tmp_path):
    given = tables(spark)
    for passphrase in (None, "open sesame"):
        where = str(tmp_path / f"one-{passphrase is None}")
        manifest = bundles.export(spark, where, **given, passphrase=passphrase, spill=100)
        assert {k: v["rows"] for k, v in manifest["sections"].items()} == {"memories": 7, "entities": 1, "relations": 1, "audit": 0, "profile": 1}
        found = bundles.read(spark, where, passphrase)
        assert plain(found["memories"]) == plain(given["memories"])
        for name in ("entities", "relations", "audit"):
            assert plain(found[name]) == plain(given[name]) and sorted(found[name].columns) == sorted(given[name].columns)
        assert found["profile"].first().content_md == "new\n"
        again = str(tmp_path / f"two-{passphrase is None}")
        found["versions"] = found.pop("profile")
        bundles.export(spark, again, **found, passphrase=passphrase, spill=100)
        assert {k: plain(v) for k, v in bundles.read(spark, again, passphrase).items()} == {k: plain(v) for k, v in bundles.read(spark, where, passphrase).items()}
    assert spark.read.parquet(f"{where}/chunks").count() == 1  # equal contents are one


def test_sealed_contents_and_scopes(spark, tmp_path):
    where = str(tmp_path / "bundle")
    manifest = bundles.export(spark, where, tables(spark)["memories"], scopes=["s2"], passphrase="right")
    text = "".join(p.read_text() for p in (tmp_path / "bundle" / "memories").glob("part-*"))
    assert "secret" not in text and manifest["encryption"]["iterations"] == 600_000 and set(manifest["sections"]) == {"memories"}
    sealed = {r.id: r for r in bundles.read(spark, where)["memories"].collect()}
    assert set(sealed) == {"b", "e", "f", "g"} and sealed["b"].content is None and sealed["b"].cipher
    with pytest.raises(PySparkException):
        bundles.read(spark, where, "wrong")["memories"].collect()
    assert bundles.passphrase_key("p", b"salt", 1) == hashlib.pbkdf2_hmac("sha256", b"p", b"salt", 1, 32).hex()


def test_a_bundle_that_was_changed_is_refused(spark, tmp_path):
    where = str(tmp_path / "bundle")
    bundles.export(spark, where, tables(spark)["memories"])
    part = next(p for p in (tmp_path / "bundle" / "memories").glob("part-*") if p.stat().st_size)
    lines = part.read_text().splitlines()
    row = json.loads(lines[0])
    row["updated_at"] = 99
    part.write_text("\n".join([json.dumps(row), *lines[1:]]) + "\n")
    (part.parent / f".{part.name}.crc").unlink()
    with pytest.raises(ValueError, match="memories"):
        bundles.read(spark, where)


def test_a_compressed_bundle_is_smaller_and_reads_alike(spark, tmp_path):
    sizes, found = [], []
    for codec in ("none", "gzip"):
        path = tmp_path / codec
        bundles.export(spark, str(path), spark.range(3000).selectExpr("'m' || id AS id", "repeat('text ', 9) AS content", "'s' AS scope", "false AS sensitive").coalesce(2), compression=codec)
        sizes.append(sum(p.stat().st_size for p in (path / "memories").glob("part-*")))
        found.append(plain(bundles.read(spark, str(path))["memories"]))
    assert len(found[0]) == 3000 and found[0] == found[1] and sizes[1] * 5 < sizes[0]
