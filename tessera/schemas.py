"""Columns of the tables and the closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
MEMORY_TYPES = ("session", "decision", "preference", "fact", "playbook", "warning")
LONG_TERM_TYPES = MEMORY_TYPES[1:]
DECAY_STATES = ("alive", "dim", "soft-forgotten")
ENTITY_TYPES = ("person", "organization", "place", "library", "tool", "project", "concept")
PREDICATES = ("mentions", "works_on", "uses", "prefers", "supersedes", "superseded_by", "conflicts_with", "cites", "runs_on", "belongs_to", "located_at")
GLOBAL_SCOPES = ("global", "_global", "")
SCORE_KEYS = ("D", "U", "R", "A")


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


STRING, LONG, DOUBLE, STAMP = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()
STRINGS = T.ArrayType(STRING)

# The names and types of the tables' columns.
MEMORY = _struct(
    ("slug", STRING), ("type", STRING), ("scope_hash", STRING), ("title", STRING), ("source", STRING), ("created_at", STAMP), ("updated_at", STAMP), ("ttl_days", T.IntegerType()),
    ("decay_state", STRING), ("last_recalled_at", STAMP), ("recall_count", LONG), ("fingerprint", STRING), ("body_path", STRING), ("scope_sensitive", T.BooleanType()), ("body", STRING),
)
CHUNK = _struct(("content", STRING), ("source", STRING), ("heading", STRING), ("heading_level", T.IntegerType()), ("start_line", T.IntegerType()), ("end_line", T.IntegerType()))
RELATION_REF = _struct(("subject_id", STRING), ("predicate", STRING), ("object_id", STRING))
ENTRY = _struct(
    ("id", STRING), ("content", STRING), ("content_hash", STRING), ("memory_type", STRING), ("scope", STRING), ("source", STRING), ("decay_state", STRING), ("sensitive", T.BooleanType()),
    ("created_at", DOUBLE), ("updated_at", DOUBLE), ("tags", STRINGS), ("entities", STRINGS), ("supersedes", STRINGS), ("superseded_by", STRINGS), ("relations", T.ArrayType(RELATION_REF)), ("merge_notes", STRINGS),
)
AUDIT = _struct(("seq", LONG), ("ts", DOUBLE), ("action", STRING), ("target_id", STRING), ("changed_fields", STRINGS), ("after", T.MapType(STRING, STRING)))
BUNDLE = _struct(("version", STRING), ("exported_at", STRING), ("memories", T.ArrayType(ENTRY)), ("audit_chain", T.ArrayType(AUDIT)))
