"""The memory tables, derived from the driver's tables by plain arithmetic (the SQL twin of each is in oracles.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.schemas import ENTITY_TYPES

#: The clock of queries over tables derived from documents, events and orders.
NOW, EVENTS_NOW, ORDERS_NOW = "2024-06-01 00:00:00", "2024-01-31 00:00:00", "1998-08-02 00:00:00"

#: Days from the orders' last ones to January 2024.
MOVED = 9300


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(column: str | Column) -> Column:
    """A timestamp without zone as text, for results."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _after(hours: Column) -> Column:
    return (F.timestamp_seconds(F.lit(1704067200) + hours * 3600)).cast("timestamp_ntz")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory for each document."""
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in ("session", "decision", "preference", "fact", "playbook", "warning")])
    body = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), i).alias("slug"),
        F.get(kinds, (i % 6).cast("int")).alias("type"),
        F.substring(F.sha1("source"), 1, 12).alias("scope_hash"),
        F.substring(F.substring_index(body, "\n", 1), 1, 80).alias("title"),
        F.col("source"),
        _after(i).alias("created_at"),
        _after(i + i % 48).alias("updated_at"),
        F.when(i % 3 != 0, (i % 5 + 1) * 7).cast("int").alias("ttl_days"),
        F.when(i % 10 < 7, "alive").when(i % 10 < 9, "dim").otherwise("soft-forgotten").alias("decay_state"),
        F.when(i % 7 > 0, _after(i + i % 20 * 24)).alias("last_recalled_at"),
        (i % 7).alias("recall_count"),
        F.sha1(F.substring(body, 1, 500)).alias("fingerprint"),
        F.concat_ws("/", F.lit("scopes"), "source", F.concat(F.lit("doc-"), i, F.lit(".md"))).alias("body_path"),
        F.col("source").isin("src0", "src1").alias("scope_sensitive"),
        body.alias("body"),
        i.alias("doc_id"),
    )


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug, trigger: the first three distinct words of three letters or more of each title."""
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"\p{L}{3,}"), F.lit(0))), 1, 3)
    return memories(spark, sf_dir).select("slug", F.explode(words).alias("trigger"))


def trigger_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trigger, scope_hash, day, hits: daily counts of the events' keys by a tenth of the users."""
    events = read(spark, sf_dir, "events")
    key = F.get_json_object("props", "$.k")
    return (
        events.select(F.concat(F.col("event_type"), F.lit(":"), key).alias("trigger"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("scope_hash"), F.to_date("ts").alias("day"))
        .groupBy("trigger", "scope_hash", "day")
        .agg(F.count("*").alias("hits"))
    )


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored candidate for each labelled document."""
    i = F.col("doc_id")
    score = F.to_json(F.struct((F.col("quality") * 0.5 + i % 5 / 10).alias("D"), (i % 10 / 10).alias("U"), (i % 7 / 10 + 0.3).alias("R"), (F.lit(1.0) - F.col("toxic") * 0.5).alias("A")))
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select(
        i.alias("id"),
        F.concat(F.lit("doc-"), i).alias("source_session_slug"),
        F.get(F.array(*[F.lit(k) for k in ("decision", "preference", "fact", "playbook", "warning")]), (i % 5).cast("int")).alias("proposed_type"),
        F.concat(F.lit("Candidate "), i).alias("proposed_title"),
        score.alias("dura_score"),
        F.when(i % 3 == 0, F.concat(F.lit('["doc-'), i - 1, F.lit('"]'))).otherwise("[]").alias("proposed_supersedes"),
        F.substring(F.sha1("source"), 1, 12).alias("scope_hash"),
        F.get(F.array(*[F.lit(k) for k in ("pending", "approved", "rejected", "merged")]), (i % 4).cast("int")).alias("status"),
        _after(i).alias("created_at"),
    )


def sensitive_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("src0",), ("src1",)], "scope_root string").select(F.substring(F.sha1("scope_root"), 1, 12).alias("scope_hash"), "scope_root")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders with their orders and parts. A task holds orders and parts, which have a row a key, and lines pass by them: they aren't sorted."""
    orders, lines, parts = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    return lines.join(orders.hint("shuffle_hash"), F.col("o_orderkey") == F.col("l_orderkey")).join(parts.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw mentions of entities: a row for each time that an order names its customer."""
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return orders.join(customers.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.lit("person").alias("type"), F.col("c_name").alias("name"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("scope_hash"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("context")
    )


def recent_entities(spark: SparkSession, sf_dir: str, *, tools: bool = False) -> DataFrame:
    """The entities of the mentions (with the brands of the parts that are ordered), with their times moved by MOVED days to those of the other tables."""
    from tessera.operators.graph import upsert_entities

    rows = mentions(spark, sf_dir)
    if tools:
        # the name as relations have it
        name = F.replace("p_brand", F.lit("#"), F.lit("_"))
        rows = rows.unionByName(order_lines(spark, sf_dir).select(F.lit("tool").alias("type"), name.alias("name"), F.lit("n0").alias("scope_hash"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"), F.lit("").alias("context")))
    return upsert_entities(rows.withColumn("at", F.col("at") + F.expr(f"INTERVAL {MOVED} DAYS")))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges: customers at nations, nations in regions, and customers that use the brands of parts they order."""
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    person = F.concat(F.lit("entity:person:customer_"), F.col("c_custkey"))
    place = F.concat(F.lit("entity:place:"), F.replace(F.lower("n_name"), F.lit(" "), F.lit("_")))
    located = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        person.alias("subject_id"), F.lit("located_at").alias("predicate"), place.alias("object_id"), F.concat(F.lit("memory:c"), F.col("c_custkey") % 50).alias("source_memory_id"), F.lit(0.9).alias("confidence"), (F.col("c_custkey") % 11 != 0).alias("active"), F.col("c_custkey").alias("ord")
    )
    belongs = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        place.alias("subject_id"), F.lit("belongs_to").alias("predicate"), F.concat(F.lit("entity:place:"), F.replace(F.lower("r_name"), F.lit(" "), F.lit("_"))).alias("object_id"), F.lit(None).cast("string").alias("source_memory_id"), F.lit(1.0).alias("confidence"), F.lit(True).alias("active"), F.col("n_nationkey").cast("bigint").alias("ord")
    )
    uses = (
        order_lines(spark, sf_dir)
        .select(
            F.concat(F.lit("entity:person:customer_"), F.col("o_custkey")).alias("subject_id"), F.lit("uses").alias("predicate"), F.concat(F.lit("entity:tool:"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_"))).alias("object_id"), F.concat(F.lit("memory:o"), F.col("o_orderkey")).alias("source_memory_id"), F.lit(0.7).alias("confidence"), (F.col("l_linenumber") != 3).alias("active"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")
        )
    )
    return located.unionByName(belongs).unionByName(uses)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of entities: the first two words of each title are a name, the third is another for it."""
    found = F.regexp_extract_all(F.lower("title"), F.lit(r"\p{L}{3,}"), F.lit(0))
    kinds = F.array(*[F.lit(k) for k in ENTITY_TYPES])
    rows = memories(spark, sf_dir).select(F.get(kinds, (F.col("doc_id") % 7).cast("int")).alias("type"), found.alias("w")).where(F.size("w") >= 2)
    return rows.select("type", F.concat_ws(" ", F.col("w")[0], F.col("w")[1]).alias("name"), F.slice("w", 3, 1).alias("aliases"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and all turns of conversations, as texts with the time that they are taken in."""
    docs = memories(spark, sf_dir).select("slug", "body", "scope_hash", F.col("created_at").alias("at"), F.col("doc_id").alias("seq"))
    turns = read(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv-"), "conv_id", F.lit("-"), "turn").alias("slug"), F.coalesce("text", F.lit("")).alias("body"), F.lit("chat").alias("scope_hash"), _after(F.col("conv_id")).alias("at"), (F.lit(1_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("seq")
    )
    return docs.unionByName(turns)


def supersedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """newer, older, entity_id, decided_at: consecutive orders of each customer."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = read(spark, sf_dir, "orders").withColumn("older", F.lag("o_orderkey").over(by)).where("older IS NOT NULL")
    memory = lambda c: F.concat(F.lit("memory:o"), F.col(c))
    return orders.select(memory("o_orderkey").alias("newer"), memory("older").alias("older"), F.concat(F.lit("entity:person:customer_"), F.col("o_custkey")).alias("entity_id"), F.col("o_orderdate").alias("decided_at"), (F.col("o_orderkey") % 100 / 100).alias("confidence"))


def entries(spark: SparkSession, sf_dir: str, *, remote: bool) -> DataFrame:
    """Bundle entries of the documents: the remote side misses some, edits some, and has newer or older times."""
    i = F.col("doc_id")
    body = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents")
    if remote:
        docs = docs.where(i % 9 != 0)
    content = F.when(i % 4 == 1, F.concat(body, F.lit(" edited"))).otherwise(body) if remote else body
    moved = F.when(i % 4 == 1, F.when(i % 8 == 1, 100).otherwise(-100)).otherwise(0) if remote else F.lit(0)
    docs = docs if remote else docs.where((i % 13 != 0) | (i % 9 == 0))
    side = "r" if remote else "l"
    return docs.select(
        F.concat(F.lit("doc-"), i).alias("id"),
        F.sha2(content, 256).alias("content_hash"),
        F.concat(F.lit("scope-"), F.col("source")).alias("scope"),
        F.when(i % 5 == 0, f"{side}-kind").otherwise("fact").alias("memory_type"),
        (i * 10.0).alias("created_at"),
        (i * 10.0 + 5 + moved).alias("updated_at"),
        F.array(F.lit("all"), F.concat(F.lit("lang-"), F.col("lang")), F.lit(side)).alias("tags"),
        F.array(F.struct(F.lit("s").alias("subject_id"), F.lit("p").alias("predicate"), F.concat(F.lit(side), i % 2).alias("object_id")), F.struct(F.lit("s").alias("subject_id"), F.lit("p").alias("predicate"), F.lit("both").alias("object_id"))).alias("relations"),
    )
