"""Differences of large texts as rows of line ranges.

Lines that both texts have once are their common points; the longest sequence of them that ascends on both sides is kept (a
pair's points are two integers each, and no text is part of it). Between two kept points a gap is made smaller from either end
as far as its lines are equal, by comparing lines at equal distances from its ends. What is left are the hunks.

`hunks` has lines as rows. Versions of pages are sorted in ranges, where each passes by the one before it, and a pair's lines
are compared as numbers there; texts are shuffled once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.batches import sliced
from tessera.shared import written

HUNK = ["before_at", "before_n", "after_at", "after_n"]
HUNKS = f"array<struct<{', '.join(f'{c}: bigint' for c in HUNK)}>>"
#: Versions of a range: those after another of it; its first one, whose version before is in another range; its last one, once more.
INNER, FIRST, LAST = range(3)

#: Rows of gaps that a task gives on at a time.
ROWS = 10_000


def _lines(pairs: DataFrame, column: str) -> DataFrame:
    """pair, pos, line of a text's lines (null: none; an empty text has one empty line)."""
    return pairs.where(F.col(column).isNotNull()).select("pair", F.posexplode(F.split(column, "\n", -1)).alias("pos", "line"))


def _ascending(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest sequence of points, given by their first number, whose second numbers ascend."""
    ends: list[int] = []  # the least second number that ends a sequence of each length
    last: list[int] = []  # and its point
    back = [-1] * len(points)
    for i, (_, b) in enumerate(points):
        n = bisect_left(ends, b)
        if n == len(ends):
            ends.append(b)
            last.append(i)
        else:
            ends[n], last[n] = b, i
        back[i] = last[n - 1] if n else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(points[i])
        i = back[i]
    return out[::-1]


def _gaps(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """pair, gap, a0, a1, b0, b1: the line ranges (ends exclusive) between kept points."""

    kept = points.select("pair", "a", "b").join(sizes, "pair", "right").sortWithinPartitions("pair", "a")

    def own(pair: str, n: int, m: int, there: list[tuple[int, int]]) -> Iterator[tuple]:
        at_a, at_b, gap = 0, 0, 0
        for a, b in [*_ascending(there), (n, m)]:
            if a > at_a or b > at_b:
                yield pair, gap, at_a, a, at_b, b
                gap += 1
            at_a, at_b = a + 1, b + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs one after the other, which may go over several batches; as functions of groups, small pairs would cost milliseconds each."""
        current, there, found = None, [], []
        for batch in batches:
            for pair, a, b, n, m in zip(*(batch.column(c).to_pylist() for c in ("pair", "a", "b", "n", "m")), strict=True):
                if current is None or pair != current[0]:
                    if current is not None:
                        found.extend(own(*current, there))
                    current, there = (pair, n, m), []
                if a is not None:
                    there.append((a, b))
                if len(found) >= ROWS:
                    yield told(found)
                    found = []
        if current is not None:
            found.extend(own(*current, there))
            yield told(found)

    def told(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(columns)], names=["pair", "gap", "a0", "a1", "b0", "b1"])

    return kept.mapInArrow(run, "pair string, gap long, a0 long, a1 long, b0 long, b1 long")


def hunks(pairs: DataFrame, old: str = "before", new: str = "after") -> DataFrame:
    """pair, before_at, before_n, after_at, after_n: the ranges of lines (from 1) that differ, of pairs (pair: a string, and both texts).

    A null text has no lines, an empty one an empty line. Equal texts have no hunk. Pairs are distinct, and their number of lines has no
    bound: lines are compared by hashes of 64 bits and their lengths.
    """
    told = lambda c: _lines(pairs, c).select("pair", "pos", F.struct(F.xxhash64("line").alias("h"), F.char_length("line").alias("n")).alias("line"))
    a, b = written(told(old), "before-lines"), written(told(new), "after-lines")
    once = lambda rows, name: rows.groupBy("pair", "line").agg(F.count("*").alias("n"), F.min("pos").alias(name)).where("n = 1").drop("n")
    points = once(a, "a").join(once(b, "b"), ["pair", "line"])
    n = [rows.groupBy("pair").agg(F.count("*").alias(x)) for rows, x in ((a, "n"), (b, "m"))]
    sizes = n[0].join(n[1], "pair", "full_outer").fillna(0, ["n", "m"])
    gaps = written(_gaps(points, sizes), "gaps")
    both = gaps.withColumn("k", F.least(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0"))).where("k > 0")

    def equal_ends(rows: DataFrame, a_at: Column, b_at: Column, name: str) -> DataFrame:
        """pair, gap and how many lines from an end are equal; steps are 0 to k - 1."""
        steps = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("i")).select("pair", "gap", "k", "i", a_at.alias("at"), b_at.alias("of"))
        met = steps.join(a.select("pair", F.col("pos").alias("at"), F.col("line").alias("x")), ["pair", "at"]).join(b.select("pair", F.col("pos").alias("of"), F.col("line").alias("y")), ["pair", "of"])
        return met.groupBy("pair", "gap").agg(F.coalesce(F.min(F.when(F.col("x") != F.col("y"), F.col("i"))), F.max("k")).alias(name))

    i = F.col("i")
    front = equal_ends(both, F.col("a0") + i, F.col("b0") + i, "front")
    rest = both.join(front, ["pair", "gap"]).withColumn("k", F.col("k") - F.col("front")).where("k > 0")
    back = equal_ends(rest, F.col("a1") - 1 - i, F.col("b1") - 1 - i, "back")
    cut = gaps.join(front, ["pair", "gap"], "left").join(back, ["pair", "gap"], "left").fillna(0, ["front", "back"])
    at = {"before": ("a0", "a1"), "after": ("b0", "b1")}
    out = [c for side, (x, y) in at.items() for c in ((F.col(x) + F.col("front") + 1).alias(f"{side}_at"), (F.col(y) - F.col("back") - F.col(x) - F.col("front")).alias(f"{side}_n"))]
    return cut.select("pair", *out).where("before_n > 0 OR after_n > 0")


def patched(pairs: DataFrame, found: DataFrame, old: str = "before", new: str = "after") -> DataFrame:
    """pair, pos, nth, line: the lines of the old text with each hunk's in place of its own, to be read in the order of pos and nth."""
    a, b = _lines(pairs, old), _lines(pairs, new)
    gone = found.where("before_n > 0").select("pair", F.explode(F.sequence(F.col("before_at"), F.col("before_at") + F.col("before_n") - 1)).alias("at"))
    stays = a.withColumn("at", (F.col("pos") + 1).cast("bigint")).join(gone, ["pair", "at"], "left_anti").select("pair", F.col("at").alias("pos"), F.lit(0).cast("bigint").alias("nth"), "line")
    fresh = found.where("after_n > 0").select("pair", "before_at", F.explode(F.sequence(F.col("after_at"), F.col("after_at") + F.col("after_n") - 1)).alias("of"))
    added = fresh.join(b.select("pair", (F.col("pos") + 1).cast("bigint").alias("of"), "line"), ["pair", "of"])
    # what is added stands before the old line of that place
    return stays.unionByName(added.select("pair", F.col("before_at").alias("pos"), (F.col("of") - (1 << 40)).alias("nth"), "line"))


def _compared(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """The hunks of two texts whose lines are numbers."""
    sides = [np.unique(side, return_index=True, return_counts=True) for side in (x, y)]
    once = [(line[n == 1], at[n == 1]) for line, at, n in sides]
    _, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    points = np.stack([once[0][1][i], once[1][1][j]], 1)
    a0, b0 = 0, 0
    for a1, b1 in [*_ascending(points[np.argsort(points[:, 0])].tolist()), (len(x), len(y))]:
        if a1 > a0 or b1 > b0:
            k = min(a1 - a0, b1 - b0)
            front = int(np.argmax(np.append(x[a0 : a0 + k] != y[b0 : b0 + k], True)))
            k -= front
            back = int(np.argmax(np.append((x[a1 - k : a1] != y[b1 - k : b1])[::-1], True)))
            n, m = a1 - back - a0 - front, b1 - back - b0 - front
            if n or m:
                yield a0 + front + 1, n, b0 + front + 1, m
        a0, b0 = a1 + 1, b1 + 1


def _hunk_lists(before: pa.Array, after: pa.Array) -> pa.Array:
    """The hunks of each pair, in their order."""
    sides = [pc.split_pattern(side, "\n") for side in (before, after)]
    ends = [np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False), dtype=np.int64)) for side in sides]
    lines = pa.concat_arrays([side.flatten() for side in sides]).dictionary_encode().indices.to_numpy()
    x, y = lines[: ends[0][-1]], lines[ends[0][-1] :]
    found, until = [], [0]
    for i in range(len(before)):
        found.extend(_compared(x[ends[0][i] : ends[0][i + 1]], y[ends[1][i] : ends[1][i + 1]]))
        until.append(len(found))
    numbers = np.array(found, np.int64).reshape(-1, len(HUNK))
    return pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.StructArray.from_arrays([pa.array(numbers[:, i]) for i in range(len(HUNK))], HUNK))


def _with_hunks(pairs: DataFrame) -> DataFrame:
    """pairs (before, after) with their hunks."""
    names = [*pairs.columns, "hunks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sliced(batches, "after", lambda rows: pa.RecordBatch.from_arrays([*rows.columns, _hunk_lists(rows.column("before"), rows.column("after"))], names=names))

    return pairs.mapInArrow(run, ", ".join([*(f"{c} {kind}" for c, kind in pairs.dtypes), f"hunks {HUNKS}"]))


def patched_text(old: Column, new: Column, hunks: Column) -> Column:
    """The old text with each hunk's lines of the new one in place of its own; null where no line is left."""
    lines = lambda text: F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))
    whole = F.struct(lines(old).alias("a"), lines(new).alias("b"), hunks.alias("hunks"))

    def joined(t: Column) -> Column:
        past = lambda h: F.coalesce(h["before_at"] + h["before_n"], F.lit(1)).cast("int")
        piece = lambda h, i: F.concat(F.slice(t["a"], past(F.get(t["hunks"], i - 1)), h["before_at"].cast("int") - past(F.get(t["hunks"], i - 1))), F.slice(t["b"], h["after_at"].cast("int"), h["after_n"].cast("int")))
        rest = F.slice(t["a"], past(F.get(t["hunks"], F.size(t["hunks"]) - 1)), F.size(t["a"]))
        every = F.concat(F.flatten(F.transform(t["hunks"], piece)), rest)
        return F.when(F.size(every) > 0, F.array_join(every, "\n"))

    # bound by a function, so that texts are cut once and not for each hunk
    return F.transform(F.array(whole), joined)[0]


def version_rows(versions: DataFrame, columns: dict[str, Column], page: str = "page", content: str = "content_md") -> DataFrame:
    """page, version_num and columns, made of before, after and hunks, of each version and the one before it on its page.

    A page's first version has null before. Versions are sorted in ranges of about as many each, whatever a page has of them, and are written as
    the columns only, but for the first and the last of each range, whose texts meet those of the ranges beside.
    """
    rows = versions.select(F.col(page).alias("page"), "version_num", F.col(content).alias("after"))
    kinds = dict(rows.dtypes)
    whole = rows.repartitionByRange("page", "version_num").sortWithinPartitions("page", "version_num").withColumn("part", F.spark_partition_id())
    names = [*whole.columns, "place", "before", "hunks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None

        def told(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal last
            n, first, after = len(rows), last is None, rows.column("after")
            ahead = pa.concat_arrays([pa.nulls(1, after.type) if first else last.column("after"), after.slice(0, n - 1)])
            pages = [None if first else last.column("page")[0].as_py(), *rows.column("page").to_pylist()]
            before = pc.if_else(pa.array([a == b for a, b in zip(pages, pages[1:], strict=False)]), ahead, pa.scalar(None, after.type))
            last = rows.slice(n - 1, 1)
            place = np.full(n, INNER, np.int32)
            place[: int(first)] = FIRST
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(place), before, _hunk_lists(before, after)], names=names)

        yield from sliced(batches, "after", told)
        if last is not None:
            yield pa.RecordBatch.from_arrays([*last.columns, pa.array([LAST], pa.int32()), pa.nulls(1, pa.string()), _hunk_lists(*[pa.nulls(1, pa.string())] * 2)], names=names)

    told = whole.mapInArrow(run, f"page {kinds['page']}, version_num {kinds['version_num']}, after string, part int, place int, before string, hunks {HUNKS}")
    inner = F.col("place") == INNER
    table = written(told.select("page", "version_num", "part", "place", *[F.when(inner, c).alias(name) for name, c in columns.items()], F.when(~inner, F.col("after")).alias("text_")), "versions")
    lasts = table.where(F.col("place") == LAST)
    # numbers of ranges
    order = lasts.select("part").withColumn("ahead", F.lag("part").over(Window.orderBy("part")))
    met = table.where(F.col("place") == FIRST).select("page", "version_num", "part", F.col("text_").alias("after")).join(order, "part").join(lasts.select(F.col("part").alias("ahead"), F.col("page").alias("page_"), "text_"), "ahead", "left")
    edges = _with_hunks(met.select("page", "version_num", F.when(F.col("page_").eqNullSafe(F.col("page")), F.col("text_")).alias("before"), "after"))
    return table.where(inner).select("page", "version_num", *columns).unionByName(edges.select("page", "version_num", *[c.alias(name) for name, c in columns.items()]))


def version_hunks(versions: DataFrame, page: str = "page", content: str = "content_md") -> tuple[DataFrame, DataFrame]:
    """Pairs (pair, page, version_num, before, after) of each version and the one before it on its page, and their hunks.

    A page's first version has null before. A page may have any number of versions, and a version any number of lines.
    """
    rows = version_rows(versions, {c: F.col(c) for c in ("before", "after", "hunks")}, page, content)
    pair = F.to_json(F.struct("page", "version_num")).alias("pair")
    return rows.select(pair, "page", "version_num", "before", "after"), rows.select(pair, F.inline("hunks"))
