"""Fill-in-the-middle examples by relational units.

A text's units (by default its lines) are exploded with their ordinals, a window sums up their lengths, each document asks for
its two cuts by ordinal, and a join answers with the offsets. They are aggregated to one row of a document, and substrings
give prefix, middle and suffix. The cuts and the form of a document follow from its key and a seed alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import numbered_columns, table, text_or_empty, written

#: The units that texts are cut into.
LINES = r"[^\n]*\n|[^\n]+"
#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """The sentinels, if an output of them can be taken apart in one way only."""
    borders = any(a[-n:] == b[:n] for a in sentinels for b in sentinels for n in range(1, len(a)) if n < len(b))
    inside = any(a in b for i, a in enumerate(sentinels) for j, b in enumerate(sentinels) if i != j)
    if len(sentinels) != 3 or not all(sentinels) or borders or inside:
        raise ValueError("sentinels must not be empty, stand within one another, or end as one of them begins")
    return sentinels


def drawn(key: str, seed: int = SEED) -> Column:
    """Four integers below 2**32: the first groups of eight digits of the SHA-256 of seed:key (a null key counts as empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)])


def cut_texts(docs: DataFrame, unit: str = LINES, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, str, str] = SENTINELS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, spm or psm), prefix, middle and suffix (null where plain), and output of every whole text.

    `unit` is a pattern whose matches cover the text. `rate` of 100 texts are cut, `spm_rate` of 100 of those suffix first; empty
    texts and those with a sentinel in them stay plain. A null text counts as empty; very long texts are rows of units like
    others; repeated rows have rows of their own (equal ones), also where only ids repeat; null keys are kept; an empty table
    gives no rows; other columns are ignored.
    """
    p, s, m = (F.lit(x) for x in _checked(sentinels))
    source = numbered_columns(docs.select(F.col(key), text_or_empty(text)))
    # of rows with one handle key and text are the same, and so are their cuts
    named = F.sha2(F.concat(F.coalesce(F.col("c0").cast("string"), F.lit("")), F.lit("\n"), "c1"), 256)
    source = source.withColumn("handle", F.coalesce(named, F.lit("")))  # never null, so that the join infers no filter that hashes again
    plain = F.col("c1") == ""
    for sentinel in sentinels:
        plain |= F.contains("c1", F.lit(sentinel))
    h, lengths = F.col("h"), F.transform(F.regexp_extract_all("c1", F.lit(unit), F.lit(0)), F.char_length)
    facts = source.select("handle", lengths.alias("lengths"), plain.alias("plain"), drawn("c0", seed).alias("h"))
    form = F.when(F.col("plain") | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    facts = facts.groupBy("handle").agg(*[F.first(c).alias(c) for c in ("lengths", "plain", "h")]).withColumn("form", form)
    # a few numbers of each document, so that the pattern runs once; dealt out by handle before the units are exploded
    facts = written(facts, "units").repartition("handle")
    n = F.size("lengths")
    requests = facts.select("handle", "form", n.alias("n"), F.posexplode(F.array_sort(F.array(h[0] % (n + 1), h[1] % (n + 1)))).alias("cut", "ordinal"))
    units = facts.select("handle", F.posexplode("lengths").alias("pos", "length"))
    running = F.sum("length").over(Window.partitionBy("handle").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    ends = units.select(F.col("handle").alias("of"), (F.col("pos") + 1).alias("nth"), running.alias("end"))
    # the difference keeps the ordinal out of the join's keys, which would deal all units out anew
    met = requests.join(ends, (F.col("handle") == F.col("of")) & (F.col("nth") - F.col("ordinal") == 0), "left")
    at = [F.coalesce(F.max(F.when(F.col("cut") == i, F.col("end"))), F.lit(0)).cast("int") for i in (0, 1)]
    offsets = met.groupBy("handle").agg(F.max("n").cast("bigint").alias("n"), F.max("form").alias("form"), at[0].alias("first"), at[1].alias("second"))
    # hashing the offsets spares a sort of the texts
    cut, whole = source.join(offsets.hint("shuffle_hash"), "handle"), F.col("c1")
    some = F.col("form") != "plain"
    pieces = {
        "prefix": F.when(some, F.substring(whole, F.lit(1), F.col("first"))),
        "middle": F.when(some, F.substring(whole, F.col("first") + 1, F.col("second") - F.col("first"))),
        "suffix": F.when(some, F.substring(whole, F.col("second") + 1, F.char_length(whole))),
    }
    output = F.when(~some, whole).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    return cut.withColumns(pieces).select(F.col("c0").alias(key), "n", "form", *pieces, output.alias("output"))


def restored(form: str = "form", output: str = "output", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of, by its form and the sentinels in it alone."""
    p, s, m = (re.escape(x) for x in _checked(sentinels))
    back = {"psm": (f"(?s)^{p}(.*?){s}(.*?){m}(.*)$", "$1$3$2"), "spm": (f"(?s)^{s}(.*?){p}(.*?){m}(.*)$", "$2$3$1")}
    out = F.col(output)
    for name, (pattern, order) in back.items():
        out = F.when(F.col(form) == name, F.regexp_replace(output, pattern, order)).otherwise(out)
    return out


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fill-in-the-middle examples: sizes and digests."""
    cut = cut_texts(table(spark, sf_dir, "documents"))
    sizes = [F.char_length(c).cast("bigint").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return cut.select("doc_id", "n", "form", *sizes, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
