"""Secret scan: named patterns, and strings that a battery of randomness tests can't tell from random keys.

A candidate is a run of 20 or more characters of one alphabet (both base64 ones, and letters and digits alone) whose
characters point to an encoding, so that a key in a path or after a name is tested by itself too. Three tests hold it
against a uniform random string of that encoding: chi-squared of the alphabet's counts, runs about the middle of the
alphabet, and serial correlation at lag one. Their p values are combined (Sidak), so that those of true keys are spread
evenly from 0 to 1 and those of other strings gather at 0.

What is reported is set for each encoding and band of lengths, by two rates of false discoveries:

* among the strings reported, at most a set share are not keys: the keys are counted by the upper half of the p values,
  where few others are, and strings are reported from that p value on at which the excess over them is small enough;
* among the strings dismissed as not random by a Benjamini-Hochberg step at most a set share are keys, and what that
  step dismisses is never reported.

Walks over the matches of a text take time in proportion to their number. DataFrame expressions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_or_empty

# Patterns of the named kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: A run of key characters, the runs of one alphabet that are looked for in it, and the encodings in the order in which they are tried: name, pattern, alphabet.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
PARTS = (r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9]{20,}")
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef"),
    ("upper_hex", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^(?=(?:.*[0-9]){3})(?=.*[A-Z])[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower36", r"^(?=(?:.*[0-9]){3})(?=.*[a-z])[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Bands of lengths, by their least length, and the share of false ones allowed in each, of the keys among the strings
#: dismissed and of the others among those reported: the tests see less in a short string.
BANDS = ((20, 0.10), (32, 0.05), (64, 0.01))
KINDS = ("assign", "access", "hex", "random")
#: p values are counted in bins of this part of a factor of ten.
BINS_PER_TEN, LAST_BIN = 20, 400
#: p values in bins under this (over one half) count the keys.
HALF_BIN = 6
#: Standard errors by which the keys may be more than their count tells (the upper limit of a 95 % range).
CHANCE = 1.64
#: Items of a walk that are handled together.
CHUNK = 256


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def walked(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], none: Column) -> Column:
    """What a walk over items gives out: step(state, item) is the next state and an array of what the item gives (of none's type).

    Chunks are walked by themselves and joined at the end, so that no array grows item by item with all that came before.
    """

    def chunk_of(own: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / CHUNK).cast("int")), lambda c: F.slice(own, c * CHUNK + 1, F.lit(CHUNK)))

        def one(acc: Column, item: Column) -> Column:
            state_, out = step(acc["state"], item)
            return F.struct(state_.alias("state"), F.concat(acc["out"], out).alias("out"))

        def some(acc: Column, chunk: Column) -> Column:
            inner = F.aggregate(chunk, F.struct(acc["state"].alias("state"), none.alias("out")), one)
            return _once(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        start = F.struct(state.alias("state"), F.slice(F.array(none), 1, 0).alias("out"))
        return F.when(F.size(own) > 0, F.flatten(F.aggregate(cut, start, some, lambda acc: acc["out"]))).otherwise(none)

    return _once(items, chunk_of)


def matches(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches: an array of struct(start, end, match), in code points, end exclusive."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def told(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        both = F.zip_with(gaps, found, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            start = at + x["gap"]
            end = start + F.length(x["match"])
            return end, F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))

        return F.when(F.size(found) > 0, walked(both, F.lit(0), step, none)).otherwise(none)

    return _once(F.regexp_extract_all(text, pattern, F.lit(0)), told)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal (the rational approximation of erfc with an error under 1.5e-7 of its value at 0)."""

    def tail(own: Column) -> Column:
        x = F.abs(own) / math.sqrt(2)
        half = _once(
            F.lit(1.0) / (F.lit(1.0) + x * 0.3275911),
            lambda t: t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * 1.061405429)))) * F.exp(-x * x) / 2,
        )
        return _once(half, lambda h: F.when(own >= 0, h).otherwise(F.lit(1.0) - h))

    return _once(z, tail)


def chi_squared_p(codes: Column, size: Column) -> Column:
    """p of the counts of a uniform alphabet: the statistic with its exact variance, and a cube-root normal tail."""
    n, df = F.size(codes).cast("double"), (size - 1).cast("double")
    squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(codes, lambda d: d == c)).cast("double"), F.lit(2.0)))
    statistic, spread = squares * size / n - n, F.lit(2.0) / (df * 9)
    z = (F.pow(F.greatest(statistic, F.lit(0.0)) / df, F.lit(1 / 3)) - (F.lit(1.0) - spread)) / F.sqrt(spread * (n - 1) / n)
    return _upper_tail(z)


def runs_p(codes: Column, size: Column) -> Column:
    """Two-sided p of the number of runs below and above the middle of the alphabet."""
    n = F.size(codes).cast("double")

    def of(high: Column) -> Column:
        ones = F.aggregate(high, F.lit(0), lambda a, x: a + x).cast("double")
        changes = F.aggregate(F.zip_with(F.slice(high, 1, F.size(codes) - 1), F.slice(high, 2, F.size(codes) - 1), lambda x, y: (x != y).cast("int")), F.lit(1), lambda a, x: a + x)

        def z(mean: Column) -> Column:
            variance = (mean - 1) * (mean - 2) / (n - 1)
            return F.abs(changes - mean) / F.sqrt(F.when(variance > 0, variance))

        return F.coalesce(_upper_tail(_once(_once(ones, lambda k: k * 2 * (n - k) / n + 1), z)) * 2, F.lit(0.0))

    return _once(F.transform(codes, lambda c: (c * 2 >= size).cast("int")), of)


def serial_p(codes: Column) -> Column:
    """Two-sided p of the correlation of neighbours."""
    n = F.size(codes).cast("double")

    def of(centred: Column) -> Column:
        variance = F.aggregate(centred, F.lit(0.0), lambda a, c: a + c * c)
        product = F.aggregate(F.zip_with(F.slice(centred, 1, F.size(codes) - 1), F.slice(centred, 2, F.size(codes) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c)
        r = product / _once(variance, lambda v: F.when(v > 0, v))
        return F.coalesce(_upper_tail(F.abs(r + F.lit(1.0) / n) * F.sqrt(n)) * 2, F.lit(0.0))

    return _once(F.aggregate(codes, F.lit(0.0), lambda a, c: a + c) / n, lambda mean: _once(F.transform(codes, lambda c: c - mean), of))


def candidates(text: Column) -> Column:
    """The strings that have an encoding: array of struct(start, end, encoding, band, bin); bin is that of -log10 p."""
    alphabets = F.array(*[F.lit(a) for _, _, a in ENCODINGS])

    def parts(m: Column) -> Column:
        found = F.flatten(F.transform(F.array(*[F.lit(p) for p in PARTS]), lambda p: matches(m["match"], p)))
        moved = F.transform(found, lambda x: F.struct((m["start"] + x["start"]).alias("start"), (m["start"] + x["end"]).alias("end"), x["match"].alias("match")))
        def step(last: Column, x: Column) -> tuple[Column, Column]:  # equal ones are neighbours
            return x, F.when(last.eqNullSafe(x), F.slice(F.array(x), 1, 0)).otherwise(F.array(x))

        none = F.array().cast("array<struct<start:int,end:int,match:string>>")
        distinct = walked(F.array_sort(moved), F.lit(None).cast("struct<start:int,end:int,match:string>"), step, none)
        return F.when(m["match"].rlike("[+/_-]"), distinct).otherwise(F.array(m))

    def told(m: Column) -> Column:
        encoding = F.coalesce(*[F.when(m["match"].rlike(pattern), F.lit(i)) for i, (_, pattern, _) in enumerate(ENCODINGS)], F.lit(-1))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), encoding.alias("encoding"))

    def tested(c: Column) -> Column:
        codes = _once(F.get(alphabets, c["encoding"]), lambda alphabet: F.struct(F.transform(F.split(c["match"], ""), lambda ch: F.instr(alphabet, ch) - 1).alias("codes"), F.length(alphabet).alias("size")))
        n = c["end"] - c["start"]
        least = _once(codes, lambda x: F.least(chi_squared_p(x["codes"], x["size"]), runs_p(x["codes"], x["size"]), serial_p(x["codes"]), F.lit(1.0)))
        p = _once(least, lambda m: m * (F.lit(3.0) - m * (F.lit(3.0) - m)))  # 1 - (1 - m)**3
        p_bin = F.least(F.floor(F.log10(F.greatest(p, F.lit(1e-30))) * -BINS_PER_TEN), F.lit(LAST_BIN)).cast("int")
        band = sum([(n >= least).cast("int") for least, _ in BANDS[1:]], F.lit(0))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["encoding"].alias("encoding"), band.alias("band"), p_bin.alias("bin"))

    return F.transform(F.filter(F.transform(F.flatten(F.transform(matches(text, CANDIDATE), parts)), told), lambda c: c["encoding"] >= 0), tested)


def first_not_reported(bins: DataFrame) -> dict[tuple[int, int], int]:
    """For each encoding and band, the bin from which on strings (of smaller p values) are not reported.

    bins: encoding, band, bin, n over all candidates; it has a bounded number of rows (encodings, bands and bins are
    fixed). The number of keys is the upper limit that chance allows for what the upper half tells and one more, so that few keys are
    not lost for want of numbers; over many rows the limit meets the number.
    """
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for r in bins.collect():
        counts.setdefault((r.encoding, r.band), {})[r.bin] = r.n
    value = lambda b: 10.0 ** (-b / BINS_PER_TEN)
    first = {}
    for (encoding, band), by_bin in counts.items():
        share = BANDS[band][1]
        total, seen, dismissed = sum(by_bin.values()), 0, LAST_BIN + 1
        for b in sorted(by_bin, reverse=True):  # from the smallest p on
            seen += by_bin[b]
            if value(b) * total <= share * seen:
                dismissed = b
        upper = 1 + sum(n for b, n in by_bin.items() if b < HALF_BIN)
        keys = (upper + CHANCE * math.sqrt(upper)) / (1 - value(HALF_BIN))
        reported, last = 0, 0
        for b in sorted(by_bin):  # from the largest p on
            reported += by_bin[b]
            if reported - keys * (1 - value(b + 1)) <= share * reported:
                last = b + 1
        first[encoding, band] = min(dismissed, last)
    return first


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `secrets`: array of struct(start, kind, end), by start, then kind (0 assign, 1 access, 2 hex, 3 random).

    Positions are code points, ends exclusive. Random strings that overlap a named kind, or lie within a longer random string, are left out. A null text counts
    as empty and has an empty array; an empty table gives no rows; columns of docs are kept (one named `secrets` is
    replaced). The counts of p values that set the dismissals are those of all rows.
    """
    source = text_or_empty(text)
    bins = docs.select(F.explode(candidates(source)).alias("c")).groupBy("c.encoding", "c.band", "c.bin").agg(F.count("*").alias("n"))
    least = first_not_reported(bins)

    def spans(found: Column, kind: int) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    # the assignment pattern is the dearest, and every match has one of these words
    lowered = F.lower(source)
    hinted = F.lit(False)
    for word in ("passw", "secret", "token", "key"):
        hinted = hinted | F.contains(lowered, F.lit(word))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    assigned = F.when(hinted, F.filter(matches(source, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 8)).otherwise(none)
    access = F.when(F.contains(source, F.lit("AKIA")), matches(source, ACCESS)).otherwise(none)
    named = F.concat(spans(assigned, 0), spans(access, 1), spans(matches(source, HEX), 2))
    with_named = docs.withColumn("secrets", named)

    def reported(c: Column) -> Column:
        first = F.lit(0)
        for (encoding, band), b in least.items():
            first = F.when((c["encoding"] == encoding) & (c["band"] == band), F.lit(b)).otherwise(first)
        return c["bin"] < first

    # candidates that no named span overlaps, by a walk forth (spans that begin before) and one back (those that begin after)
    kind = "array<struct<start:int,kind:int,end:int>>"
    empty = F.array().cast(kind)
    found = F.transform(F.filter(candidates(source), reported), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    named_one = lambda x: x["kind"] < 3

    def forth(end: Column, x: Column) -> tuple[Column, Column]:
        return F.when(named_one(x), F.greatest(end, x["end"])).otherwise(end), F.when(named_one(x) | (end <= x["start"]), F.array(x)).otherwise(empty)

    def back(start: Column, x: Column) -> tuple[Column, Column]:
        return F.when(named_one(x), F.least(start, x["start"])).otherwise(start), F.when(~named_one(x) & (start >= x["end"]), F.array(x)).otherwise(empty)

    def outermost(end: Column, x: Column) -> tuple[Column, Column]:
        return F.greatest(end, -x["before"]), F.when(-x["before"] > end, F.array(F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), (-x["before"]).alias("end")))).otherwise(empty)

    def kept(own: Column) -> Column:
        alone = walked(F.reverse(walked(F.array_sort(F.concat(F.col("secrets"), own)), F.lit(0), forth, empty)), F.lit(2**31 - 1), back, empty)
        by_start = F.array_sort(F.transform(alone, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("before"))))
        return F.when(F.size(own) > 0, walked(by_start, F.lit(0), outermost, empty)).otherwise(empty)

    return with_named.withColumn("secrets", F.array_sort(F.concat(F.col("secrets"), _once(found, kept))))


def span_string(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span masked; overlapping spans are masked as one. Spans are by start, as scan gives them.

    A chunk's spans are cut from the chunk's part of the text, as finding a place in a text takes time in proportion to it.
    """
    none = F.array().cast("array<string>")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int")), lambda c: F.slice(spans, c * CHUNK + 1, F.lit(CHUNK)))

    def some(acc: Column, chunk: Column) -> Column:
        def cut(region: Column) -> Column:
            def one(a: Column, s: Column) -> Column:
                gap = F.substring(region, a["at"] - acc["at"] + 1, s["start"] - a["at"])
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.when(s["start"] >= a["at"], F.array(gap, F.lit(mask))).otherwise(none)).alias("out"))

            inner = F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), one)
            return _once(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(r["out"], ""))).alias("out")))

        end = F.array_max(F.transform(chunk, lambda s: s["end"]))
        return _once(F.substring(text, acc["at"] + 1, F.greatest(end - acc["at"], F.lit(0))), cut)

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    masked = F.aggregate(chunks, start, some, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, masked).otherwise(text)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_string(base), 256).alias("base_sha256"), span_string(spans).alias("spans"), count(3).alias("n_random")
    )
