"""Writers: Markdown texts, partitioned tables, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordered import numbered
from tessera.operators.security import encrypted


def save_memories(memories: DataFrame, path: str, key: str | None = None, mode: str = "append") -> None:
    """Parquet by scope and type; bodies of sensitive scopes are encrypted if there is a key (32 bytes in hexadecimal)."""
    if key:
        hidden = encrypted(memories.where("scope_sensitive"), "body", key)
        memories = memories.where(~F.coalesce("scope_sensitive", F.lit(False))).unionByName(hidden)
    # a rebalance by scope and type splits what a hot scope has into several files
    memories.hint("rebalance", "scope_hash", "type").write.mode(mode).partitionBy("scope_hash", "type").parquet(path)


FIELDS = ("title", "slug", "type", "scope_hash", "source", "created_at", "updated_at", "ttl_days", "decay_state", "last_recalled_at", "recall_count")
DEFAULTS = {"decay_state": "alive", "recall_count": "0"}


def markdown(memories: DataFrame) -> DataFrame:
    """slug, text: each memory as front matter and body; empty fields and defaults are left out."""

    def quoted(value: Column) -> Column:
        """A string as JSON has it."""
        listed = F.to_json(F.array(value))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    lines = []
    for c in FIELDS:
        if c in memories.columns:
            value = F.col(c).cast("string")
            lines.append(F.when((value != "") & (value != DEFAULTS.get(c, "")), F.concat(F.lit(f"{c}: "), quoted(value))))
    if "triggers" in memories.columns:
        items = F.transform("triggers", lambda w: F.concat(F.lit("- "), quoted(w)))
        lines.append(F.when(F.size("triggers") > 0, F.concat_ws("\n", F.lit("triggers:"), items)))
    # concat_ws leaves out nulls
    head = F.concat_ws("\n", F.lit("---"), *lines, F.lit("---\n"))
    return memories.select("slug", F.concat(head, F.lit("\n"), F.coalesce("body", F.lit(""))).alias("text"))


def next_version(versions: DataFrame, content: DataFrame) -> DataFrame:
    """versions with new ones (content_md, written_at, ...) numbered after the last in the order of their times.

    The old rows' largest number is one row; the new ones are numbered in ranges of their times, those of one time by content.
    """
    last = versions.agg(F.coalesce(F.max("version_num"), F.lit(0)).alias("last_"))
    rows = numbered(content.withColumn("all_", F.lit(0)), "all_", "written_at", "content_md").crossJoin(last)
    rows = rows.withColumn("version_num", (F.col("last_") + F.col("pos")).cast(versions.schema["version_num"].dataType))
    return versions.unionByName(rows.drop("all_", "pos", "first_", "last_"), allowMissingColumns=True)


def save_report(reports: DataFrame, new: DataFrame) -> DataFrame:
    """Reports with the new ones; the newest of each period stays."""
    newest = Window.partitionBy("period").orderBy(F.desc("generated_at"))
    return reports.unionByName(new).withColumn("n_", F.row_number().over(newest)).where("n_ = 1").drop("n_")


def write_bundle(lines: DataFrame, path: str) -> None:
    """An export as JSON lines of entries (id, line)."""
    lines.select("line").write.mode("overwrite").text(path)
