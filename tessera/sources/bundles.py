"""Bundles: all that a copy holds, as JSON lines by section with a manifest, to be read on another device.

Sections are folders that tasks write and read in parallel; contents beyond a size stand in a folder of their own, each under its hash.
Open metadata is a VARIANT column, so that fields of other tools come through unchanged. Sensitive contents are encrypted by a key
that is derived from a passphrase. The manifest has the rows and a checksum of each section, which a reader holds against what it
finds.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.sync import SPILL_BYTES

# Rounds of the key derivation, bytes of its salt and of the key.
ROUNDS, SALT_BYTES, KEY_BYTES = 600_000, 16, 32
VERSION = "tessera-1"


def passphrase_key(passphrase: str, salt: bytes, rounds: int = ROUNDS) -> str:
    """A key of 32 bytes in hexadecimal, by PBKDF2 with SHA-256."""
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, rounds, KEY_BYTES).hex()


def _checksum(lines: DataFrame) -> Column:
    """Of a section's lines, in whatever order and files they stand."""
    return F.coalesce(F.sum(F.crc32("value").cast("decimal(38,0)")), F.lit(0)).cast("string")


def _line(rows: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]))


def export(
    spark: SparkSession, path: str, memories: DataFrame, entities: DataFrame | None = None, relations: DataFrame | None = None, versions: DataFrame | None = None,
    audit: DataFrame | None = None, scopes: list[str] | None = None, passphrase: str | None = None, spill: int = SPILL_BYTES, compression: str = "none",
) -> dict:
    """Write a bundle to an empty path and return its manifest.

    memories: id, content, scope, sensitive and any other columns, of which VARIANT ones are open metadata; all rows, or those of some
    scopes. With a passphrase the contents of sensitive ones are encrypted. Of the profile's versions (version_num, content_md) the last
    is taken. Sections that are not given are left out; a table without rows is a section without lines.
    compression: of the sections' files, as Spark names it; a reader knows it by their names.
    """
    rows = memories if not scopes else memories.where(F.col("scope").isin(*scopes))
    secret = None
    if passphrase:
        salt = os.urandom(SALT_BYTES)
        secret = {"scheme": "passphrase-aesgcm", "kdf": "pbkdf2-hmac-sha256", "iterations": ROUNDS, "salt": base64.b64encode(salt).decode()}
        hidden = F.coalesce("sensitive", F.lit(False)) & F.col("content").isNotNull()
        sealed = F.base64(F.aes_encrypt("content", F.unhex(F.lit(passphrase_key(passphrase, salt))), F.lit("GCM")))
        rows = rows.withColumns({"cipher": F.when(hidden, sealed), "content": F.when(~hidden, F.col("content"))})
    big = F.octet_length("content") > spill
    name = F.sha2("content", 256)
    rows.where(big).select(name.alias("name"), "content").dropDuplicates(["name"]).write.parquet(f"{path}/chunks")
    told = rows.withColumns({"chunk": F.when(big, name), "content": F.when(~F.coalesce(big, F.lit(False)), F.col("content"))})
    sections = {"memories": told, "entities": entities, "relations": relations, "audit": audit}
    if versions is not None:
        sections["profile"] = versions.orderBy(F.desc("version_num")).limit(1)
    manifest: dict = {"version": VERSION, "encryption": secret, "sections": {}}
    for section, df in sections.items():
        if df is None:
            continue
        df.select(_line(df).alias("value")).write.text(f"{path}/{section}", compression=compression)
        n, total = spark.read.schema("value string").text(f"{path}/{section}").agg(F.count("*"), _checksum(df)).first()
        manifest["sections"][section] = {"rows": n, "checksum": total, "schema": T.StructType(sorted(df.schema, key=lambda f: f.name)).json()}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def read(spark: SparkSession, path: str, passphrase: str | None = None) -> dict[str, DataFrame]:
    """The sections of a bundle, each with the columns it was written with; memories with their contents in place.

    A section whose rows or checksum aren't the manifest's, and a passphrase that doesn't fit, are errors. Without a passphrase
    encrypted contents stay in `cipher`.
    """
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    out: dict[str, DataFrame] = {}
    for section, told in manifest["sections"].items():
        lines = spark.read.schema("value string").text(f"{path}/{section}")
        if tuple(lines.agg(F.count("*"), _checksum(lines)).first()) != (told["rows"], told["checksum"]):
            raise ValueError(f"the section {section} is not what the manifest says")
        out[section] = spark.read.schema(T.StructType.fromJson(json.loads(told["schema"]))).json(f"{path}/{section}")
    chunks = spark.read.schema("name string, content string").parquet(f"{path}/chunks")
    rows = out["memories"].join(chunks.select(F.col("name").alias("chunk"), F.col("content").alias("whole_")), "chunk", "left")
    rows = rows.withColumn("content", F.coalesce("content", "whole_")).drop("whole_", "chunk")
    if manifest["encryption"] and passphrase:
        key = passphrase_key(passphrase, base64.b64decode(manifest["encryption"]["salt"]), manifest["encryption"]["iterations"])
        opened = F.aes_decrypt(F.unbase64("cipher"), F.unhex(F.lit(key)), F.lit("GCM")).cast("string")
        rows = rows.withColumn("content", F.coalesce("content", opened)).drop("cipher")
    out["memories"] = rows
    return out
