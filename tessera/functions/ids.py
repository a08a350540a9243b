"""Keys and hashes of memories, chunks, entities and files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scope_hash(path: Column) -> Column:
    """First 12 hexadecimal digits of the SHA-1 of a root path."""
    return F.substring(F.sha1(path), 1, 12)


def fingerprint(body: Column) -> Column:
    """SHA-1 of a body's first 500 characters."""
    return F.sha1(F.substring(body, 1, 500))


def content_hash(content: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of a chunk."""
    return F.substring(F.sha2(content, 256), 1, 16)


def chunk_id(source: Column, start: Column, end: Column, hashed: Column, model: str) -> Column:
    """Stable id of a chunk under an embedding model."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit("markdown"), source, start.cast("string"), end.cast("string"), hashed, F.lit(model)), 256), 1, 16)


def entity_id(kind: Column, name: Column) -> Column:
    """entity:<type>:<name>, lowered, trimmed, spaces as underscores."""
    return F.concat(F.lit("entity:"), kind, F.lit(":"), F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_")))


def memory_node(slug: Column) -> Column:
    return F.concat(F.lit("memory:"), slug)


def kebab(text: Column, most: int = 60) -> Column:
    """Lower case, white space as hyphens, only a-z, 0-9 and hyphens; 'untitled' if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", "-"), "[^a-z0-9-]", "")
    return F.coalesce(F.nullif(F.btrim(F.substring(kept, 1, most), F.lit("-")), F.lit("")), F.lit("untitled"))


def dated_slug(title: Column, at: Column) -> Column:
    """Date, at most 40 safe characters of the title, and the epoch second."""
    safe = F.btrim(F.substring(F.regexp_replace(F.coalesce(F.nullif(title, F.lit("")), F.lit("untitled")), r"[^A-Za-z0-9_一-鿿-]+", "_"), 1, 40), F.lit("_"))
    return F.concat_ws("-", F.date_format(at, "yyyy-MM-dd"), F.coalesce(F.nullif(safe, F.lit("")), F.lit("untitled")), F.unix_timestamp(at.cast("timestamp")).cast("string"))
