"""Hunks of texts against plain Python."""

from __future__ import annotations

import difflib
import random

from tessera.operators import diffs

SCHEMA = "pair string, before string, after string"


def found(spark, rows):
    pairs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = {k: [] for k, _, _ in rows}
    told = diffs.hunks(pairs)
    for r in told.collect():
        out[r.pair].append((r.before_at, r.before_n, r.after_at, r.after_n))
    lines = {}
    for r in sorted(diffs.patched(pairs, told).collect(), key=lambda r: (r.pair, r.pos, r.nth)):
        lines.setdefault(r.pair, []).append(r.line)
    return {k: sorted(v) for k, v in out.items()}, {k: "\n".join(v) for k, v in lines.items()}


def test_hunks_of_small_texts(spark):
    rows = [
        ("same", "a\nb", "a\nb"),
        ("line", "a\nb\nc", "a\nx\nc"),
        ("added", "a\nc", "a\nb\nb\nc"),
        ("gone", "a\nb\nc\n", "a\n"),
        ("moved", "a\nb\nc\nd", "b\nc\nd\na"),
        ("first", None, "a\nb"),
        ("last", "a", None),
        ("empty", "", "x"),
        ("no text", None, None),
        ("repeats", "x\nx\nx", "x\nx"),
        ("ends", "}\na\n}\n}", "}\nb\n}\n}"),
    ]
    told, texts = found(spark, rows)
    assert told["same"] == told["no text"] == []
    assert told["line"] == [(2, 1, 2, 1)] and told["added"] == [(2, 0, 2, 2)] and told["gone"] == [(2, 2, 2, 0)]
    assert told["moved"] == [(1, 1, 1, 0), (5, 0, 4, 1)] and told["first"] == [(1, 0, 1, 2)] and told["last"] == [(1, 1, 1, 0)] and told["empty"] == [(1, 1, 1, 1)]
    assert told["repeats"] == [(3, 1, 3, 0)] and told["ends"] == [(2, 1, 2, 1)]
    assert texts == {k: b for k, _, b in rows if b is not None}


def test_patched_texts_are_the_new_ones(spark):
    rng = random.Random(7)
    rows, changed = [], 0
    for i in range(60):
        old = [rng.choice(["", "}", *(f"line {k}" for k in range(40))]) for _ in range(rng.randrange(60))]
        new = list(old)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(new) + 1)
            new[at : at + rng.randrange(3)] = [f"new {rng.randrange(9)}" for _ in range(rng.randrange(3))]
        rows.append((f"p{i}", "\n".join(old), "\n".join(new)))
    told, texts = found(spark, rows)
    for key, old, new in rows:
        assert texts[key] == new
        a, b = old.split("\n"), new.split("\n")
        least = sum(x2 - x1 + y2 - y1 for tag, x1, x2, y1, y2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal")
        own = sum(n + m for _, n, _, m in told[key])
        assert (own == 0) == (old == new) and own <= 3 * least + 12
        changed += own > 0
    assert changed > 30


def test_a_long_page(spark):
    old = [f"line {i}" for i in range(60_000)]
    new = [*old[:100], "x", *old[100:30_000], *old[30_010:]]
    told, texts = found(spark, [("p", "\n".join(old), "\n".join(new))])
    assert told["p"] == [(101, 0, 101, 1), (30_001, 10, 30_002, 0)] and texts["p"] == "\n".join(new)


def test_versions_of_pages(spark):
    rows = spark.createDataFrame([("p", 3, "a\nc"), ("p", 1, "a"), ("p", 7, "a\nc"), ("q", 2, "z"), (None, 1, "n"), (None, 4, "n\nm")], "page string, version_num long, content_md string")
    pairs, told = diffs.version_hunks(rows)
    names = {r.pair: (r.page, r.version_num) for r in pairs.collect()}
    assert {(*names[r.pair], r.before_n, r.after_n) for r in told.collect()} == {("p", 1, 0, 1), ("p", 3, 0, 1), ("q", 2, 0, 1), (None, 1, 0, 1), (None, 4, 0, 1)}


def test_many_small_pairs_share_a_function_over_batches(spark, monkeypatch):
    monkeypatch.setattr(diffs, "ROWS", 3)
    rows = [(f"p{i}", "a\nb\nc\nd", "\n".join("abcd"[: i % 5]) + "\nx" * (i % 3)) for i in range(200)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 7)
    try:
        _, texts = found(spark, rows)
        points = spark.createDataFrame([(p, k, k) for p, _, _ in rows for k in (0, 2)], "pair string, a int, b int")
        gaps = diffs._gaps(points, spark.createDataFrame([(p, 4, 4) for p, _, _ in [*rows, ("none", "", "")]], "pair string, n long, m long"))
        assert sorted(tuple(r) for r in gaps.collect()) == sorted([g for p, _, _ in rows for g in ((p, 0, 1, 2, 1, 2), (p, 1, 3, 4, 3, 4))] + [("none", 0, 0, 4, 0, 4)])
    finally:
        spark.conf.set(size, before)
    assert texts == {p: b for p, _, b in rows}
    # a function called for each group costs milliseconds for each small pair
    assert "InPandas" not in gaps._jdf.queryExecution().toString()


def test_versions_are_compared_in_ranges(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    made = {}
    for page in ("p", "q", "r", None):
        text = None
        for number in range(1, 2 if page == "r" else 60):
            text = None if rng.random() < 0.05 else "\n".join(rng.choice(["", "}", *(f"line {k}" for k in range(9))]) if rng.random() < 0.3 else x for x in [*(text or "").split("\n"), "end"][: rng.randrange(1, 30)])
            made[(page, number)] = text
    rows = spark.createDataFrame([(p, n, x) for (p, n), x in made.items()], "page string, version_num long, content_md string").repartition(5)
    kept = []
    monkeypatch.setattr(diffs, "written", lambda df, name, _f=diffs.written: kept.append(df) or _f(df, name))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        columns = {"before": F.col("before"), "hunks": F.col("hunks"), "patched": diffs.patched_text(*[F.col(c) for c in ("before", "after", "hunks")])}
        found = {(r.page, r.version_num): r for r in diffs.version_rows(rows, columns).collect()}
        plain = {r.pair: sorted((h.before_at, h.before_n, h.after_at, h.after_n) for h in found[(r.page, r.version_num)].hunks) for r in diffs.version_hunks(rows)[0].collect()}
    finally:
        spark.conf.unset(key)
    assert found.keys() == made.keys()
    for (page, number), r in found.items():
        assert r.before == made.get((page, number - 1)) and r.patched == made[(page, number)]
    # the same hunks as those of lines as rows
    pairs = spark.createDataFrame([(k, made.get((p, n - 1)), made[(p, n)]) for (p, n), k in zip(made, map(str, range(len(made))), strict=True)], SCHEMA)
    slow = {}
    for r in diffs.hunks(pairs).collect():
        slow.setdefault(r.pair, []).append((r.before_at, r.before_n, r.after_at, r.after_n))
    assert {str(i): sorted(tuple(h) for h in found[k].hunks) for i, k in enumerate(made) if found[k].hunks} == {k: sorted(v) for k, v in slow.items()}
    assert len(plain) == len(made)
    # one table is written, of a version its columns and not its text, and texts are shuffled once
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan
