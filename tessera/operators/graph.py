"""The knowledge graph: entities, relations, neighbourhoods, chains and conflicts."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ids import entity_id
from tessera.schemas import ENTITY_TYPES, GLOBAL_SCOPES, PREDICATES
from tessera.shared import written

# Other names of predicates, with those whose ends change places.
ALIASES = {
    "mention": "mentions", "mentioned": "mentions", "mentioned_by": "mentions", "work_on": "works_on", "working_on": "works_on", "owns": "works_on", "use": "uses", "used": "uses", "used_by": "uses",
    "prefer": "prefers", "preferred": "prefers", "supersede": "supersedes", "supersedes_by": "superseded_by", "conflict": "conflicts_with", "conflict_with": "conflicts_with", "conflicts": "conflicts_with",
    "cite": "cites", "cited": "cites", "cited_by": "cites", "runs": "runs_on", "run_on": "runs_on", "deployed_on": "runs_on", "belongs": "belongs_to", "belong_to": "belongs_to", "part_of": "belongs_to",
    "located": "located_at", "at": "located_at",
}
REVERSED = ("mentioned_by", "used_by", "cited_by")
CONFLICTING = ("prefers", "uses", "works_on")

#: A node's edges are dealt into so many groups, so that no task has all of a node that most edges share; results don't depend on it.
GROUPS = 8


def normalised_predicate(raw: Column) -> tuple[Column, Column]:
    """The canonical predicate (unknown ones as they are) and whether the ends change places."""
    plain = F.translate(F.lower(F.trim(F.coalesce(raw, F.lit("")))), " -", "__")
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    known = plain.isin(*PREDICATES)
    return F.when(known, plain).otherwise(F.coalesce(F.element_at(names, plain), plain)), ~known & plain.isin(*REVERSED)


def normalise_relations(relations: DataFrame, least: float = 0.0, *, drop_unknown: bool = True) -> DataFrame:
    """Relations with canonical predicates, their ends changed where need be, confidence in 0 to 1 and at least `least`."""
    name, reverse = normalised_predicate(F.col("predicate"))
    rows = relations.withColumns({"name_": name, "back_": reverse, "confidence": F.least(F.greatest(F.coalesce("confidence", F.lit(1.0)), F.lit(0.0)), F.lit(1.0))})
    rows = rows.withColumns({"predicate": F.col("name_"), "subject_id": F.when(F.col("back_"), F.col("object_id")).otherwise(F.col("subject_id")), "object_id": F.when(F.col("back_"), F.col("subject_id")).otherwise(F.col("object_id"))})
    rows = rows.where(F.col("confidence") >= least)
    return (rows.where(F.col("predicate").isin(*PREDICATES)) if drop_unknown else rows).select(*relations.columns)


def upsert_entities(mentions: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Entities of mentions (type, name, scope_hash, at, seq, context): counts, first and last times, first scope, last context.

    Unknown types are left out. Old entities are added up with the new.
    """
    rows = mentions.where(F.col("type").isin(*ENTITY_TYPES)).withColumn("id", entity_id(F.col("type"), F.col("name")))
    order = F.struct("at", "seq")
    context = F.nullif(F.col("context"), F.lit(""))
    found = rows.groupBy("id", "type").agg(
        F.min_by("name", order).alias("name"), F.count("*").alias("mention_count"), F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"), F.min_by("scope_hash", order).alias("scope_hash"), F.max_by(context, F.when(context.isNotNull(), order)).alias("context")
    )
    if old is None:
        return found
    return (
        found.unionByName(old.select(*found.columns))
        .groupBy("id", "type")
        .agg(F.min_by("name", "first_seen_at").alias("name"), F.sum("mention_count").alias("mention_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.min_by("scope_hash", "first_seen_at").alias("scope_hash"), F.max_by("context", "last_seen_at").alias("context"))
    )


def merge_aliases(mentions: DataFrame) -> DataFrame:
    """id, aliases: the aliases of all mentions (id, seq, aliases), each once, in the order of their first."""
    firsts = mentions.select("id", "seq", F.posexplode("aliases").alias("pos", "alias")).groupBy("id", "alias").agg(F.min(F.struct("seq", "pos")).alias("at"))
    return firsts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "alias"))).alias("rows")).select("id", F.col("rows.alias").alias("aliases"))


def top_entities(entities: DataFrame, since: str | None = None, scope: str | None = None, limit: int = 20) -> DataFrame:
    rows = entities if since is None else entities.where(F.col("last_seen_at") >= F.expr(f"TIMESTAMP_NTZ '{since}'"))
    rows = rows if scope is None else rows.where(F.col("scope_hash") == scope)
    return rows.orderBy(F.desc("mention_count"), F.desc("last_seen_at"), "id").limit(limit)


def top_open_entities(entities: DataFrame, sensitive: DataFrame, since: str | None = None, scope: str | None = None, limit: int = 10) -> DataFrame:
    """The top entities of a window in scopes that aren't sensitive, out of twice as many (so there may be fewer)."""
    return top_entities(top_entities(entities, since, scope, 2 * limit).join(sensitive.select("scope_hash"), "scope_hash", "left_anti"), limit=limit)


def find_entities(entities: DataFrame, name: str, *, fuzzy: bool = True) -> DataFrame:
    """By part of a name or of the aliases' text, or by the whole name; without regard to case."""
    low = F.lower("name")
    wanted = F.lit(name.lower())
    hit = F.contains(low, wanted) if fuzzy else low == wanted
    if fuzzy and "aliases" in entities.columns:
        hit = hit | F.contains(F.lower(F.to_json("aliases")), wanted)
    return entities.where(hit).orderBy(F.desc("mention_count"), F.desc("last_seen_at"), "id")


def distinct_relations(relations: DataFrame) -> DataFrame:
    """The first of equal relations; those without a source memory are never equal."""
    key = Window.partitionBy("subject_id", "predicate", "object_id", "source_memory_id").orderBy("ord")
    keyed = relations.where("source_memory_id IS NOT NULL").withColumn("n_", F.row_number().over(key)).where("n_ = 1").drop("n_")
    return keyed.unionByName(relations.where("source_memory_id IS NULL"))


def list_entities(entities: DataFrame, kind: str | None = None, scope: str | None = None) -> DataFrame:
    """All entities of a type or a scope, the last seen first."""
    for column, value in (("type", kind), ("scope_hash", scope)):
        entities = entities if value is None else entities.where(F.col(column) == value)
    return entities.orderBy(F.desc("last_seen_at"), "id")


def mark_superseded(relations: DataFrame, ids: DataFrame, at: str, key: str = "ord") -> DataFrame:
    """relations with superseded_at set, and not active any more, where their key is among the ids; an earlier time stays."""
    hit = ids.select(key, F.lit(True).alias("hit_")).distinct()
    old = F.col("superseded_at") if "superseded_at" in relations.columns else F.lit(None).cast("timestamp_ntz")
    marked = relations.withColumn("superseded_at", old).join(hit, key, "left")
    now = F.when(F.col("hit_"), F.coalesce("superseded_at", F.expr(f"TIMESTAMP_NTZ '{at}'"))).otherwise(F.col("superseded_at"))
    return marked.withColumns({"superseded_at": now, "active": F.col("active") & F.col("hit_").isNull()}).drop("hit_")


def supersedes_for(supersedes: DataFrame, memory: str) -> DataFrame:
    """What a memory replaces: older, decided_at, the latest first."""
    return supersedes.where(F.col("newer") == memory).select("older", "decided_at").orderBy(F.desc("decided_at"), "older")


def superseded_by(supersedes: DataFrame, memory: str) -> DataFrame:
    """What replaces a memory: newer, decided_at, the latest first."""
    return supersedes.where(F.col("older") == memory).select("newer", "decided_at").orderBy(F.desc("decided_at"), "newer")


def parsed_entities(entities: DataFrame) -> DataFrame:
    """Extracted entities with trimmed names, known types in lower case, and confidence from 0 to 1 (null: 0.5); others are left out."""
    rows = entities.withColumns({"name": F.trim("name"), "type": F.lower(F.trim("type")), "confidence": _sure(), "context": F.substring(F.coalesce("context", F.lit("")), 1, 500)})
    return rows.where((F.col("name") != "") & F.col("type").isin(*ENTITY_TYPES))


def parsed_relations(relations: DataFrame) -> DataFrame:
    """Extracted relations with both names, a predicate and known types; the others are left out."""
    rows = relations.withColumns({c: F.trim(c) for c in ("subject", "object")} | {c: F.lower(F.trim(c)) for c in ("subject_type", "object_type", "predicate")} | {"confidence": _sure()})
    return rows.where("subject <> '' AND object <> '' AND predicate <> ''").where(F.col("subject_type").isin(*ENTITY_TYPES) & F.col("object_type").isin(*ENTITY_TYPES))


def _sure() -> Column:
    return F.least(F.greatest(F.coalesce("confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def ingest(entities: DataFrame, relations: DataFrame, memories: DataFrame, least: float = 0.0, *, drop_unknown: bool = False, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, edges and counts of what was extracted from memories, which are taken in the order of at and seq.

    entities: memory_id, type, name, pos, context, confidence; relations: memory_id, subject_type, subject, predicate, object_type,
    object, confidence, pos; memories: memory_id, scope_hash, at, seq. Each telling of an entity is a mention. The ends of a relation that
    is taken (of confidence `least` or more, of a known predicate if unknown ones are dropped) become entities where none is
    there yet, in this order or in `old`; that is one mention. Edges: subject_id, predicate, object_id, source_memory_id,
    confidence, active, ord; each memory mentions the entities told of it (not the ends), and of equal edges the first stays.
    Counts, in one row: entities_added and entities_updated (of those told), relations_added and relations_skipped.
    """
    when = memories.select("memory_id", "scope_hash", "at", "seq")
    id_ = entity_id(F.col("type"), F.col("name")).alias("id")
    # memories have a row each: a task holds them, and what is told passes by unsorted
    told = parsed_entities(entities).join(when.hint("shuffle_hash"), "memory_id").select("memory_id", id_, "type", "name", "scope_hash", "at", F.struct("seq", F.lit(0).alias("kind"), "pos").alias("seq"), "context", "confidence")
    parsed = parsed_relations(relations).join(when, "memory_id")
    name, reverse = normalised_predicate(F.col("predicate"))
    taken = (F.col("confidence") >= least) & (F.col("name_") != "") & (F.col("name_").isin(*PREDICATES) | F.lit(not drop_unknown))
    parsed = parsed.withColumns({"name_": name, "back_": reverse}).withColumn("taken_", taken)
    side = lambda a, b: F.when(F.col("back_"), F.col(b)).otherwise(F.col(a))
    rows = parsed.where("taken_").select(
        "memory_id", "scope_hash", "at", "seq", "pos", "confidence", F.col("name_").alias("predicate"), *[side(f"{a}{t}", f"{b}{t}").alias(f"{a}{t}") for a, b in (("subject", "object"), ("object", "subject")) for t in ("", "_type")]
    )
    ends = [
        rows.select("memory_id", F.col(f"{e}_type").alias("type"), F.col(e).alias("name"), "scope_hash", "at", F.struct("seq", F.lit(1).alias("kind"), (2 * F.col("pos") + i).alias("pos")).alias("seq"))
        .withColumn("id", id_).withColumns({"context": F.lit(""), "confidence": F.lit(None).cast("double")})
        .select(*told.columns)
        for i, e in enumerate(("subject", "object"))
    ]
    # when an id is named first, in whichever way; contexts of all that is told aren't compared
    ends = ends[0].unionByName(ends[1])
    firsts = told.select("id", "at", "seq").unionByName(ends.select("id", "at", "seq")).groupBy("id").agg(F.min(F.struct("at", "seq")).alias("first")).select("id", "first.*")
    firsts = firsts if old is None else firsts.join(old.select("id"), "id", "left_anti")
    opening = ends.groupBy("id").agg(F.min_by(F.struct(*ends.columns), F.struct("at", "seq")).alias("first")).select("first.*")
    found = upsert_entities(told.unionByName(opening.join(firsts.where("seq.kind = 1").select("id"), "id", "left_semi").select(*told.columns)), old)
    mentions = told.groupBy("memory_id", "id").agg(F.min_by("confidence", "seq").alias("confidence"), F.min("seq.seq").alias("ord"))
    mentions = mentions.select(F.concat(F.lit("memory:"), "memory_id").alias("subject_id"), F.lit("mentions").alias("predicate"), F.col("id").alias("object_id"), F.col("memory_id").cast("string").alias("source_memory_id"), "confidence", F.lit(True).alias("active"), "ord")
    edges = rows.select(
        entity_id(F.col("subject_type"), F.col("subject")).alias("subject_id"), "predicate", entity_id(F.col("object_type"), F.col("object")).alias("object_id"), F.col("memory_id").cast("string").alias("source_memory_id"), "confidence", F.lit(True).alias("active"), F.col("seq").alias("ord"), "pos"
    )
    first = Window.partitionBy("subject_id", "predicate", "object_id", "source_memory_id").orderBy("ord", "pos")
    edges = edges.withColumn("n_", F.row_number().over(first)).where("n_ = 1").drop("n_", "pos")
    added = firsts.agg(F.count_if(F.col("seq.kind") == 0).alias("entities_added"))
    n_told = told.agg(F.count("*").alias("told_"))
    n_related = parsed.agg(F.count_if("taken_").alias("relations_added"), F.count_if(~F.col("taken_")).alias("relations_skipped"))
    counts = added.crossJoin(n_told).crossJoin(n_related)  # one row each
    return found, mentions.unionByName(edges), counts.select("entities_added", (F.col("told_") - F.col("entities_added")).alias("entities_updated"), "relations_added", "relations_skipped")


def ingest_stats(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """added, updated, unchanged of new rows against a table, by the key and a hash of the other columns they share."""
    shared = [c for c in new.columns if c in old.columns and c != key]
    before = old.select(key, F.xxhash64(*shared).alias("was_"))
    rows = new.select(key, F.xxhash64(*shared).alias("is_")).join(before, key, "left")
    return rows.agg(F.count_if(F.col("was_").isNull()).alias("added"), F.count_if(F.col("was_") != F.col("is_")).alias("updated"), F.count_if(F.col("was_") == F.col("is_")).alias("unchanged"))


def get_relations(relations: DataFrame, subject: str | None = None, object_: str | None = None, predicate: str | None = None, *, active: bool = True) -> DataFrame:
    for column, value in (("subject_id", subject), ("object_id", object_), ("predicate", predicate)):
        if value is not None:
            relations = relations.where(F.col(column) == value)
    return (relations.where("active") if active else relations).orderBy(F.desc("ord"))


def neighbourhood(relations: DataFrame, node: str) -> DataFrame:
    """direction, predicate, other, ord of the active relations of a node."""
    active = relations.where("active")
    out = active.where(F.col("subject_id") == node).select(F.lit("out").alias("direction"), "predicate", F.col("object_id").alias("other"), "ord")
    back = active.where((F.col("object_id") == node) & (F.col("subject_id") != node)).select(F.lit("in"), "predicate", "subject_id", "ord")
    return out.union(back)


def memories_about(relations: DataFrame, node: str, memories: DataFrame | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """slug of the distinct memories that actively mention an entity, of some types if given."""
    found = relations.where(F.col("active") & (F.col("object_id") == node) & (F.col("predicate") == "mentions") & F.col("subject_id").startswith("memory:"))
    slugs = found.select(F.regexp_replace("subject_id", "^memory:", "").alias("slug")).distinct()
    return slugs if memories is None or not types else slugs.join(memories.where(F.col("type").isin(*types)), "slug", "left_semi")


def conflicts(relations: DataFrame, predicates: tuple[str, ...] = CONFLICTING) -> DataFrame:
    """Groups of conflicting memories, as members: subject_id, predicate, object_id, memory_id.

    A group is the active relations of a subject and predicate of which there are two objects and two memories or more; two of its members
    with different objects are in conflict. One row for each member: the pairs of a group, which grow with its square, aren't made.
    """
    rows = relations.where(F.col("active") & F.col("source_memory_id").isNotNull() & F.col("predicate").isin(*predicates)).select("subject_id", "predicate", "object_id", F.col("source_memory_id").alias("memory_id")).distinct()
    bounds = [f(c).alias(f"{n}_{c}") for c in ("object_id", "memory_id") for f, n in ((F.min, "low"), (F.max, "high"))]
    groups = rows.groupBy("subject_id", "predicate").agg(*bounds).where("low_object_id <> high_object_id AND low_memory_id <> high_memory_id")
    return rows.join(groups.select("subject_id", "predicate"), ["subject_id", "predicate"], "left_semi").select("subject_id", "predicate", "object_id", "memory_id")


def last_edges(relations: DataFrame, *columns: str, memory_nodes: bool = False) -> DataFrame:
    """subject_id, object_id and columns: the last of parallel edges among the active relations, written once for all hops."""
    edges = relations.where("active")
    if not memory_nodes:
        edges = edges.where(~F.col("subject_id").startswith("memory:") & ~F.col("object_id").startswith("memory:"))
    return written(edges.groupBy("subject_id", "object_id").agg(*[F.max_by(c, "ord").alias(c) for c in columns]), "edges")


def _sides(edges: DataFrame) -> DataFrame:
    """Edges from both of their ends: node, other, and the group that the edge is in among its node's."""
    ends = [F.struct(F.col(a).alias("node"), F.col(b).alias("other")) for a, b in (("subject_id", "object_id"), ("object_id", "subject_id"))]
    return edges.select("*", F.explode(F.array(*ends)).alias("e")).select(*edges.columns, "e.*").withColumn("group_", F.pmod(F.xxhash64("other"), F.lit(GROUPS)).cast("int"))


def _step(sides: DataFrame, frontier: DataFrame) -> DataFrame:
    """The edges at the frontier's nodes. A task holds its part of the frontier, where nodes are distinct, and edges pass by it: they aren't sorted."""
    near = frontier.withColumn("group_", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
    return sides.join(near.hint("shuffle_hash"), ["node", "group_"])


def n_hop(relations: DataFrame, seeds: DataFrame, depth: int, *, memory_nodes: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (seed, node, hops) and edges (seed, subject_id, object_id, predicate) within `depth` hops of each seed (seed).

    One join for each hop: the active relations of the frontier, without nodes seen before. Of parallel edges the last stays.
    """
    live = last_edges(relations, "predicate", memory_nodes=memory_nodes)
    sides = _sides(live)
    nodes = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"))
    frontier, found = nodes, None
    for hop in range(1, depth + 1):
        step = _step(sides, frontier.select("seed", "node"))
        found = step if found is None else found.union(step)
        fresh = step.select("seed", F.col("other").alias("node")).distinct().join(nodes, ["seed", "node"], "left_anti")
        frontier = fresh.withColumn("hops", F.lit(hop))
        nodes = nodes.union(frontier)
    if found is None:
        found = _step(sides, nodes.select("seed", "node")).limit(0)
    return nodes, found.select("seed", *live.columns).distinct()


def global_graph(entities: DataFrame, relations: DataFrame, now: str, days: int = 30, top: int = 15, scope: str | None = None, kind: str | None = None, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, hops, name, type, mention_count) and edges (subject_id, object_id, predicate, confidence, source_memory_id) about the top entities.

    The `top` entities of a window and scope (a global one: of all), then those of a type, are the seeds; their subgraphs of 1 to 3 hops are
    merged. As an edge is in one of them if an end is nearer than `depth` to some seed, one frontier goes out from all seeds
    at once, and no node is reached twice. Nodes that are no entities are named by their id and of type unknown; of parallel edges the last stays.
    """
    recent = entities.where(F.col("last_seen_at") >= F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {int(days)} DAYS"))
    seeds = top_entities(recent, scope=None if scope in GLOBAL_SCOPES else scope, limit=top)
    seeds = seeds if kind is None else seeds.where(F.col("type") == kind)
    live = last_edges(relations, "predicate", "confidence", "source_memory_id")
    sides = _sides(live)
    nodes, edges = seeds.select(F.col("id").alias("node"), F.lit(0).alias("hops")), None
    frontier = nodes
    for hop in range(1, max(1, min(3, depth)) + 1):
        step = _step(sides, frontier.select("node"))
        edges = step if edges is None else edges.unionByName(step)
        frontier = step.select(F.col("other").alias("node")).distinct().join(nodes.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop))
        nodes = nodes.unionByName(frontier)
    told = nodes.join(entities.select(F.col("id").alias("node"), "name", "type", "mention_count"), "node", "left")
    told = told.select("node", "hops", F.coalesce("name", "node").alias("name"), F.coalesce("type", F.lit("unknown")).alias("type"), "mention_count")
    return told, edges.select(*live.columns).distinct()


def _topological(edges: pd.DataFrame) -> list[str]:
    """An entity's memories from older to newer, the smallest id first; with a cycle the older ends by time, and the last newer one."""
    pairs = list(dict.fromkeys(zip(edges["older"], edges["newer"], strict=True)))
    nexts: dict[str, list[str]] = {}
    waits: dict[str, int] = {}
    for a, b in pairs:
        nexts.setdefault(a, []).append(b)
        waits[b] = waits.get(b, 0) + 1
        waits.setdefault(a, 0)
    ready = [m for m, n in waits.items() if not n]
    heapify(ready)
    out = []
    while ready:
        out.append(node := heappop(ready))
        for other in nexts.get(node, ()):
            waits[other] -= 1
            if not waits[other]:
                heappush(ready, other)
    return out if len(out) == len(waits) else [*edges["older"], edges["newer"].iloc[-1]]


def _chains(edges: pd.DataFrame) -> pd.DataFrame:
    """The orders of many entities' edges, which stand by entity and time. Edges that each begin where the one before ends are in order as they are."""
    edges = edges.reset_index(drop=True)
    group = edges.groupby("entity_id", sort=False, dropna=False).ngroup()
    first = group.ne(group.shift())
    nodes = pd.concat([pd.DataFrame({"group": group[first], "node": edges["older"][first]}), pd.DataFrame({"group": group, "node": edges["newer"]})])
    bent = set(group[~first & edges["older"].ne(edges["newer"].shift())]) | set(nodes["group"][nodes.duplicated()])
    straight = ~group.isin(bent)
    parts = [
        pd.DataFrame({"entity_id": edges["entity_id"][first & straight], "pos": 0, "memory_id": edges["older"][first & straight]}),
        pd.DataFrame({"entity_id": edges["entity_id"][straight], "pos": edges.groupby(group).cumcount()[straight] + 1, "memory_id": edges["newer"][straight]}),
    ]
    for _, own in edges[~straight].groupby(group[~straight]):
        found = _topological(own)
        parts.append(pd.DataFrame({"entity_id": own["entity_id"].iloc[0], "pos": range(len(found)), "memory_id": found}))
    return pd.concat(parts)


def evolution_chain(supersedes: DataFrame) -> DataFrame:
    """entity_id, pos, memory_id: the memories of each entity from older to newer, in a topological order with the smallest id first.

    Edges are sorted by entity and time within partitions, and the entities of an Arrow batch are ordered together; one
    that goes on into the next batch waits for its last edge. With a cycle: the older ends by time, and the last newer one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            ids = batch["entity_id"].fillna("")
            ends = ids.eq(ids.iloc[-1])
            if held and ends.all() and held[-1]["entity_id"].fillna("").iloc[-1] == ids.iloc[-1]:
                held.append(batch)
                continue
            done = pd.concat([*held, batch[~ends]]) if not ends.all() else pd.concat(held) if held else batch[:0]
            if held and not ends.all() or len(done):
                yield _chains(done)
            held = [batch[ends]]
        if held:
            yield _chains(pd.concat(held))

    rows = supersedes.select("entity_id", "older", "newer", "decided_at").repartition("entity_id").sortWithinPartitions("entity_id", "decided_at", "newer")
    return rows.mapInPandas(run, "entity_id string, pos int, memory_id string")


def add_supersedes(rows: DataFrame) -> DataFrame:
    """The latest row of each (newer, older); a memory can't replace itself."""
    latest = Window.partitionBy("newer", "older").orderBy(F.desc("decided_at"))
    return rows.where("newer <> older").withColumn("n_", F.row_number().over(latest)).where("n_ = 1").drop("n_")


def supersede_candidates(mentions: DataFrame, fresh: DataFrame, types: tuple[str, ...] = ("decision", "preference", "fact")) -> DataFrame:
    """new, old, entity_id: older memories of some types in the scope of a fresh one that mention one of its entities; the first entity of a pair.

    mentions: memory_id, type, scope_hash, entity_id, created_at, pos, and active, where false ones of older memories don't count.
    """
    live = mentions.where("active") if "active" in mentions.columns else mentions
    old = live.join(fresh, "memory_id", "left_anti").where(F.col("type").isin(*types)).select(F.col("memory_id").alias("old"), "scope_hash", "entity_id")
    new = mentions.join(fresh, "memory_id", "left_semi").select(F.col("memory_id").alias("new"), "scope_hash", "entity_id", "pos")
    return new.join(old, ["scope_hash", "entity_id"]).groupBy("new", "old").agg(F.min_by("entity_id", F.struct("pos", "entity_id")).alias("entity_id"))


def judged(candidates: DataFrame, auto: float = 0.85, review: float = 0.5) -> DataFrame:
    """Judgements (decision, confidence) as apply, pending or ignore; only 'supersedes' counts, and a null confidence is 0."""
    sure = F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    said = F.lower(F.trim(F.coalesce("decision", F.lit("")))) == "supersedes"
    return candidates.withColumn("action", F.when(~said, "ignore").when(sure >= auto, "apply").when(sure >= review, "pending").otherwise("ignore"))


def applied_judgements(memories: DataFrame, supersedes: DataFrame, judgements: DataFrame, at: str, auto: float = 0.85, review: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The memories and the supersedes table after judgements (new, old, entity_id, decision, confidence, reason).

    What is sure enough is written down as decided by auto, and the old memory is dim from then on; what is to be reviewed as decided by
    digest. Of a pair that is judged twice the latest stays, and a memory doesn't replace itself.
    """
    told = judged(judgements, auto, review).where("action <> 'ignore' AND new <> old")
    dim = told.where("action = 'apply'").select(F.col("old").alias("slug"), F.lit(True).alias("dim_")).distinct()
    state = F.when(F.col("dim_"), "dim").otherwise(F.col("decay_state"))
    after = memories.join(dim, "slug", "left").withColumn("decay_state", state).select(*memories.columns)
    sure = F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))
    by = F.when(F.col("action") == "apply", "auto").otherwise("digest")
    rows = told.select(F.col("new").alias("newer"), F.col("old").alias("older"), "entity_id", sure.alias("confidence"), F.substring(F.coalesce("reason", F.lit("")), 1, 500).alias("reason"), by.alias("decided_by"), F.expr(f"TIMESTAMP_NTZ '{at}'").alias("decided_at"))
    return after, add_supersedes(supersedes.unionByName(rows, allowMissingColumns=True))


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Elements of a graph view as JSON, an edge's id being src--predicate->dst."""
    node = nodes.select(F.to_json(F.struct(F.struct(F.col("node").alias("id")).alias("data"))).alias("element"))
    data = F.struct(F.concat("subject_id", F.lit("--"), "predicate", F.lit("->"), "object_id").alias("id"), F.col("subject_id").alias("source"), F.col("object_id").alias("target"), F.col("predicate").alias("label"))
    return node.union(edges.select(F.to_json(F.struct(data.alias("data")))))
