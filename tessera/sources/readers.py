"""Readers of Markdown memories, transcripts, rollouts, imports, logs and bundles.

Files are rows: Spark lists them and deals them out, and a parser sees one file (or one line) at a time.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.batches import sliced
from tessera.functions.ids import kebab, scope_hash
from tessera.functions.text import derive_triggers, infer_type, map_type
from tessera.operators.listing import top_of
from tessera.schemas import BUNDLE

SYNC_SUFFIXES = (".md", ".enc")


def scan_text(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """path, modified, text of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def parse_markdown(files: DataFrame, text: str = "text") -> DataFrame:
    """files with meta (a map of the front matter's scalars), lists (of its lists) and body; error where it can't be read.

    The body loses the line ends before it. A file without front matter is all body.
    """
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema]
    schema = ", ".join([*columns, "meta map<string,string>", "lists map<string,array<string>>", "body string", "error string"])

    def told(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [front_matter(t) for t in rows.column(text).to_pylist()]
        meta = pa.array([list(x[0].items()) for x in found], pa.map_(pa.string(), pa.string()))
        lists = pa.array([list(x[1].items()) for x in found], pa.map_(pa.string(), pa.list_(pa.string())))
        rest = [pa.array([x[i] for x in found], pa.string()) for i in (2, 3)]
        return pa.RecordBatch.from_arrays([*rows.columns, meta, lists, *rest], names=[*rows.schema.names, "meta", "lists", "body", "error"])

    return files.mapInArrow(lambda batches: sliced(batches, text, told), schema)


def front_matter(text: str | None) -> tuple[dict, dict, str, str | None]:
    """Scalars, lists, body and error of a text with YAML front matter."""
    found = re.match(r"---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)", text or "", re.DOTALL)
    if not found:
        return {}, {}, (text or "").lstrip("\n"), None
    try:
        import yaml

        data = yaml.safe_load(found[1]) or {}
    except ImportError:
        data = _plain_yaml(found[1])
    except Exception as error:  # a file that can't be read is a row of its own
        return {}, {}, (text or ""), str(error).split("\n")[0]
    if not isinstance(data, dict):
        return {}, {}, (text or ""), "front matter is no mapping"
    scalars = {str(k): _scalar(v) for k, v in data.items() if v is not None and not isinstance(v, (list, dict))}
    lists = {str(k): [_scalar(x) for x in v if x is not None] for k, v in data.items() if isinstance(v, list)}
    return scalars, lists, text[found.end() :].lstrip("\n"), None


def _scalar(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else value.isoformat() if hasattr(value, "isoformat") else str(value)


def _plain_yaml(text: str) -> dict:
    """Keys with scalars, inline lists or lists of dashes."""
    data: dict = {}
    key = None
    for line in text.split("\n"):
        if m := re.match(r"\s+-\s+(.*)$|-\s+(.*)$", line):
            if key is not None:
                data[key] = [*(data[key] if isinstance(data.get(key), list) else []), (m[1] or m[2] or "").strip().strip("'\"")]
        elif m := re.match(r"([A-Za-z_][\w-]*)\s*:\s*(.*)$", line):
            key, value = m[1], m[2].strip()
            data[key] = [x.strip().strip("'\"") for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else value.strip("'\"") or None
    return data


def memories_of(parsed: DataFrame) -> DataFrame:
    """Memory rows of parsed files; old files get defaults, unknown keys are left out. Rows with an error are not among them."""
    meta = lambda k: F.element_at("meta", F.lit(k))
    stamp = lambda k: F.try_to_timestamp(meta(k)).cast("timestamp_ntz")
    return parsed.where("error IS NULL").select(
        F.coalesce(meta("slug"), F.regexp_extract("path", r"([^/]+?)\.md(?:\.enc)?$", 1)).alias("slug"),
        F.coalesce(meta("type"), F.lit("session")).alias("type"),
        F.coalesce(meta("scope_hash"), F.lit("_unscoped")).alias("scope_hash"),
        F.coalesce(meta("title"), F.lit("")).alias("title"),
        F.coalesce(meta("source"), F.lit("manual")).alias("source"),
        stamp("created_at").alias("created_at"),
        stamp("updated_at").alias("updated_at"),
        meta("ttl_days").try_cast("int").alias("ttl_days"),
        F.coalesce(meta("decay_state"), F.lit("alive")).alias("decay_state"),
        stamp("last_recalled_at").alias("last_recalled_at"),
        F.coalesce(meta("recall_count").try_cast("bigint"), F.lit(0)).alias("recall_count"),
        F.sha1(F.substring("body", 1, 500)).alias("fingerprint"),
        F.col("path").alias("body_path"),
        F.coalesce(meta("scope_sensitive") == "true", F.lit(False)).alias("scope_sensitive"),
        "body",
        F.coalesce(F.element_at("lists", F.lit("triggers")), F.array().cast("array<string>")).alias("triggers"),
    )


def index_report(parsed: DataFrame) -> DataFrame:
    """indexed, errors of a rebuild."""
    return parsed.agg(F.count_if(F.col("error").isNull()).alias("indexed"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def layout(files: DataFrame) -> DataFrame:
    """scope_hash, type, slug of files by their folders (scopes/<scope>/<type>/<slug>.md); hidden and _ names are left out."""
    part = lambda i: F.regexp_extract("path", r"/scopes/([^/]+)/([^/]+)/([^/]+?)\.md(?:\.enc)?$", i)
    rows = files.select("path", part(1).alias("scope_hash"), part(2).alias("type"), part(3).alias("slug"))
    return rows.where((F.col("slug") != "") & ~F.col("slug").rlike(r"^[._]"))


def content_text(content: Column) -> Column:
    """The text of a message's content: a string, or the text parts of a list, one to a line."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "\n")
    return F.when(F.ltrim(content).startswith("["), texts).otherwise(content)


def scan_transcript(lines: DataFrame, last: int = 50) -> DataFrame:
    """file, n, text of the last lines of each transcript (file, n, line) that hold a message; bad lines are skipped."""
    newest = Window.partitionBy("file").orderBy(F.desc("n"))
    rows = lines.withColumn("back_", F.row_number().over(newest)).where(F.col("back_") <= last)
    content = F.coalesce(F.get_json_object("line", "$.message.content"), F.get_json_object("line", "$.content"))
    return rows.select("file", "n", content_text(content).alias("text")).where("text IS NOT NULL AND text <> ''")


def scan_session(lines: DataFrame, most: int = 8000) -> DataFrame:
    """file, body: the messages of each session as '**role**: text' joined by blank lines; '(empty session)' without any."""
    role = F.coalesce(F.get_json_object("line", "$.role"), F.get_json_object("line", "$.author"), F.lit("?"))
    text = content_text(F.get_json_object("line", "$.content"))
    rows = lines.select("file", "n", F.when((text != "") & text.isNotNull(), F.concat(F.lit("**"), role, F.lit("**: "), text)).alias("line"))
    # a message has nine characters at least with what parts it from the next; lines without one stand last and tell that the file is there
    near = top_of(rows, ["file"], [F.isnull("line"), F.asc("n")], most // 8 + 1)
    said = F.when(F.col("line").isNotNull(), F.struct("n", "line"))
    joined = F.array_join(F.col("rows.line"), "\n\n")
    return near.groupBy("file").agg(F.array_sort(F.collect_list(said)).alias("rows")).select("file", F.substring(F.when(F.size("rows") > 0, joined).otherwise("(empty session)"), 1, most).alias("body"))


@F.pandas_udf(T.StructType([T.StructField("header", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.StringType())]))
def rollout(text: pd.Series) -> pd.DataFrame:
    """The leading 'key: value' lines of a text up to a blank (or other) line, and what follows."""
    headers, bodies = [], []
    for value in text.fillna(""):
        lines = value.split("\n")
        n, header = 0, {}
        while n < len(lines) and (m := re.match(r"([A-Za-z_][\w-]*):\s*(.*)$", lines[n])):
            header[m[1]] = m[2]
            n += 1
        headers.append(header)
        bodies.append("\n".join(lines[n + (n < len(lines) and not lines[n].strip()) :]))
    return pd.DataFrame({"header": headers, "body": bodies})


def import_sections(files: DataFrame, source: str, date: str) -> DataFrame:
    """slug, type, title, body, triggers of the H2 and H3 sections of each text (file, text) that have a body.

    A slug that comes again in a file has -1, -2 and so on.
    """
    heading = r"(?m)^#{2,3}[ \t]+(.+?)[ \t]*$"
    titles, bodies = F.regexp_extract_all("text", F.lit(heading), F.lit(1)), F.slice(F.split("text", heading, -1), F.lit(2), F.greatest(F.size(F.split("text", heading, -1)) - 1, F.lit(0)))
    rows = files.select("file", F.posexplode(F.arrays_zip(titles.alias("title"), bodies.alias("body"))).alias("pos", "s")).select("file", "pos", "s.title", F.regexp_replace("s.body", r"^\s+|\s+$", "").alias("body")).where("body <> ''")
    base = F.concat(F.lit(f"{date}-"), kebab(F.col("title")))
    again = F.row_number().over(Window.partitionBy("file", "base").orderBy("pos")) - 1
    numbered = rows.withColumn("base", base).withColumn("again", again)
    return numbered.select("file", F.when(F.col("again") > 0, F.concat_ws("-", "base", F.col("again").cast("string"))).otherwise(F.col("base")).alias("slug"), infer_type(F.col("title")).alias("type"), "title", "body", derive_triggers(F.col("title")).alias("triggers"), F.lit(source).alias("source"))


def import_memories_json(rows: DataFrame, most: int = 8000) -> DataFrame:
    """title, type, body, triggers of a JSON document each (raw): a list of memories, or an object with one."""
    item = "array<struct<title:string,name:string,content:string,text:string,body:string,type:string,tags:array<string>,metadata:struct<type:string>>>"
    found = F.coalesce(F.from_json(F.get_json_object("raw", "$.memories"), item), F.from_json("raw", item))
    one = rows.select(F.explode(found).alias("m"))
    body = F.substring(F.coalesce("m.content", "m.text", "m.body"), 1, most)
    title = F.coalesce("m.title", "m.name", F.substring(body, 1, 60))
    own = F.array_distinct(F.coalesce("m.tags", F.array().cast("array<string>")))
    return one.select(title.alias("title"), map_type(F.coalesce("m.metadata.type", "m.type")).alias("type"), body.alias("body"), F.when(F.size(own) >= 2, own).otherwise(derive_triggers(title)).alias("triggers")).where("body IS NOT NULL AND body <> ''")


def import_auto_memory(files: DataFrame) -> DataFrame:
    """slug, title, type, body of small Markdown memories (path, text), in the order of paths; MEMORY.md is the index and left out."""
    parsed = parse_markdown(files.where(~F.col("path").endswith("MEMORY.md")))
    meta = lambda k: F.element_at("meta", F.lit(k))
    return parsed.where("error IS NULL").select(F.concat(F.lit("auto-"), kebab(F.regexp_extract("path", r"([^/]+)\.md$", 1))).alias("slug"), F.coalesce(meta("name"), meta("title"), F.regexp_extract("path", r"([^/]+)\.md$", 1)).alias("title"), map_type(meta("type")).alias("type"), "body").orderBy("slug")


def scan_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The entries of an export bundle; foreign fields are left out."""
    return spark.read.schema(BUNDLE).json(path, multiLine=True).select(F.explode_outer("memories").alias("m")).select("m.*").where("id IS NOT NULL")


def resolve_spilled(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Contents that were written to side files (content_ref -> name, content)."""
    joined = entries.join(chunks.select(F.col("name").alias("content_ref"), F.col("content").alias("side_")), "content_ref", "left")
    return joined.withColumn("content", F.coalesce("content", "side_")).drop("side_", "content_ref")


def audit_lines(spark: SparkSession, path: str) -> DataFrame:
    """log, n, line of log files; n is the line's place in its file (a log is one group: its chain is one sequence)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    return files.where("line <> ''").withColumn("n", F.col("n") + 1)


def sync_files(spark: SparkSession, root: str) -> DataFrame:
    """key, fingerprint of the files of a copy: Markdown and encrypted ones, no hidden or _ folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    key = F.regexp_replace("path", "^.*?/(scopes/)", "scopes/")
    kept = files.where(F.col("path").rlike(r"\.(md|enc)$") & ~F.col("path").rlike(r"/[._][^/]*(/|$)"))
    return kept.select(key.alias("key"), F.substring(F.sha2("content", 256), 1, 16).alias("fingerprint"))


def handoffs(files: DataFrame, limit: int = 10) -> DataFrame:
    """path, date of dated snapshots, the newest first."""
    rows = files.withColumn("date", F.regexp_extract("path", r"(\d{4}-\d\d-\d\d)[^/]*\.md$", 1)).where("date <> ''")
    return rows.orderBy(F.desc("date"), "path").limit(limit)


def scope_of_content(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (id, text) with the deepest known root (root) whose path stands in the text; null if it's ambiguous.

    The paths in a text are cut into their ancestors, so that roots are found by equality. Two roots that don't stand
    above each other are ambiguous.
    """
    paths = F.array_distinct(F.regexp_extract_all("text", F.lit(r"/(?:[\w.-]+/)*[\w.-]+"), F.lit(0)))
    path = rows.select("id", F.explode(paths).alias("path")).select("id", F.split("path", "/").alias("parts"))
    above = path.select("id", F.explode(F.transform(F.sequence(F.lit(2), F.size("parts")), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))).alias("root")).distinct()
    hit = above.join(roots.select("root"), "root").groupBy("id").agg(F.max_by("root", F.struct(F.length("root"), "root")).alias("deepest"), F.collect_set("root").alias("all"))
    clear = F.forall("all", lambda r: (F.col("deepest") == r) | F.startswith(F.col("deepest"), F.concat(r, F.lit("/"))))
    return rows.join(hit.where(clear).select("id", F.col("deepest").alias("root")), "id", "left").withColumn("scope_hash", F.coalesce(scope_hash(F.col("root")), F.lit("_unscoped")))


def files_of_type(files: DataFrame, kind: str) -> DataFrame:
    """scope_hash, slug, path of the files of one type, by their paths."""
    return layout(files).where(F.col("type") == kind).select("scope_hash", "slug", "path").orderBy("path")


def recent_slugs(files: DataFrame, kind: str, limit: int = 50) -> DataFrame:
    """scope_hash, slug, path of the files of a type, the last slugs first."""
    return files_of_type(files, kind).orderBy(F.desc("slug"), "path").limit(limit)


def recent_files(files: DataFrame, limit: int = 5) -> DataFrame:
    """path, slug, modified of the files modified last (path, modified)."""
    placed = layout(files).join(files.select("path", "modified"), "path")
    return placed.select("path", "slug", "modified").orderBy(F.desc("modified"), "path").limit(limit)
