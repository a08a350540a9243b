"""Text expressions and the chunker."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.batches import sliced

# Patterns of comments, ends of lines and headings.
COMMENT = r"(?s)<!--.*?-->"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
# Ordered hints of a heading's type, and substrings of an imported type.
TYPE_HINTS = (
    (r"(?i)warning|踩坑|不要|避免|caution", "warning"),
    (r"(?i)playbook|流程|操作|how[- ]?to|steps?\b", "playbook"),
    (r"(?i)decision|决策|选[择型方]?|chose|chosen", "decision"),
    (r"(?i)preference|偏好|习惯|prefer|like to", "preference"),
)
TYPE_MAP = (("decision", "decision"), ("pref", "preference"), ("warn", "warning"), ("playbook", "playbook"), ("process", "playbook"))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def clean_for_embedding(text: Column) -> Column:
    """Without HTML comments, runs of blank lines collapsed, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, COMMENT, ""), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def meaningful(text: Column) -> Column:
    """Two characters or more besides comments and lines that are headings."""
    lines = F.split(F.regexp_replace(text, COMMENT, ""), LINE_END)
    body = F.array_join(F.filter(lines, lambda x: ~x.rlike(r"(?sU)^#{1,6}\s+.+$")), "\n")
    return F.length(F.regexp_replace(body, r"(?U)^\s+|\s+$", "")) >= 2


def count_words(text: Column) -> Column:
    """Tokens that have an ASCII character, and CJK characters."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t.rlike(r"[\x00-\x7F]"))
    return F.coalesce(F.size(tokens) + F.length(text) - F.length(F.regexp_replace(text, r"[一-鿿]", "")), F.lit(0))


def first_line(text: Column, most: int = 80) -> Column:
    return F.substring(F.substring_index(text, "\n", 1), 1, most)


def infer_type(heading: Column) -> Column:
    """The type that a heading hints at, else fact."""
    return F.coalesce(*[F.when(heading.rlike(p), F.lit(k)) for p, k in TYPE_HINTS], F.lit("fact"))


def map_type(kind: Column) -> Column:
    """The memory type of an imported type's name."""
    return F.coalesce(*[F.when(F.contains(F.lower(kind), F.lit(part)), F.lit(k)) for part, k in TYPE_MAP], F.lit("fact"))


def derive_triggers(heading: Column) -> Column:
    """At most five words of three characters or more; two stand-ins go first if there are fewer than two."""
    from tessera.functions.ids import kebab

    words = F.slice(F.filter(F.regexp_extract_all(heading, F.lit(r"[A-Za-z一-鿿][A-Za-z0-9一-鿿_-]+"), F.lit(0)), lambda w: F.length(w) >= 3), 1, 5)
    return F.slice(F.when(F.size(words) < 2, F.concat(F.array(F.lit("imported"), kebab(heading)), words)).otherwise(words), 1, 5)


def topic_key(text: Column) -> Column:
    """The first three alphanumeric words in snake case, 32 characters at most; else memory."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(F.size(words) > 0, F.substring(F.array_join(F.slice(words, 1, 3), "_"), 1, 32)).otherwise("memory")


def summarise(text: Column, most: int = 2000) -> Column:
    """The first characters, with a mark where the rest was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n\n…(truncated)"))).otherwise(text)


def quote_block(text: Column) -> Column:
    """Each line after '> ' ('>' alone for blank ones)."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.when(F.trim(line) == "", F.lit(">")).otherwise(F.concat(F.lit("> "), line))), "\n")


def format_date(value: Column) -> Column:
    """An ISO time as its date; else the first ten characters."""
    return F.coalesce(F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd"), F.substring(value, 1, 10))


def change_summary(text: Column) -> Column:
    """What follows a change summary mark on its line, or null."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?im)^\W*change[ _]summary\W*:\s*(.+)$", 1)), F.lit(""))


def truncate_by_paragraph(text: Column, most: int) -> Column:
    """Cut at the last blank line beyond the middle, else at the last line end, else at `most` characters."""
    part = F.substring(text, 1, most)
    blank = most - F.locate("\n\n", F.reverse(part)) - 1
    line = most - F.locate("\n", F.reverse(part))
    cut = lambda at: F.concat(F.rtrim(F.regexp_replace(F.substring(part, F.lit(1), at), r"\s+$", "")), F.lit("\n"))
    has = lambda mark: F.locate(mark, part) > 0
    return F.when(F.length(text) <= most, text).when(has("\n\n") & (blank > most // 2), cut(blank)).when(has("\n") & (line > 0), cut(line)).otherwise(part)


def truncate_by_words(text: Column, most: int) -> Column:
    """Whole paragraphs until the word budget is met; the first always stays."""
    paragraphs = F.split(text, "\n\n")

    def take(acc: Column, p: Column) -> Column:
        n = count_words(p)
        stop = acc["done"] | ((acc["used"] + n > most) & (F.size(acc["out"]) > 0))
        return F.when(stop, F.struct(acc["out"].alias("out"), acc["used"].alias("used"), F.lit(True).alias("done"))).otherwise(
            F.struct(F.concat(acc["out"], F.array(p)).alias("out"), (acc["used"] + n).alias("used"), (acc["used"] + n >= most).alias("done"))
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("done"))
    kept = F.aggregate(paragraphs, start, take, lambda acc: acc["out"])
    return F.concat(F.regexp_replace(F.array_join(kept, "\n\n"), r"\s+$", ""), F.lit("\n"))


# The ends of sentences; ASCII marks count before white space, CJK or the end.
SENTENCE_END = re.compile(r"(?:……|…|[。！？；]\s*|[.!?;](?=\s|$|[一-鿿぀-ヿ가-힯])\s*)")


def split_long(text: str, most: int) -> list[str]:
    """Pieces of at most `most` characters, each to the last sentence end within reach."""
    out, at = [], 0
    while len(text) - at > most:
        ends = [m.end() for m in SENTENCE_END.finditer(text, at, at + most)]
        to = ends[-1] if ends else at + most
        out.append(text[at:to])
        at = to
    return out + ([text[at:]] if at < len(text) else [])


def _sections(lines: list[str]) -> Iterator[tuple[int, int, str, int]]:
    """begin, end, heading and level of each section; what stands before the first heading has level 0."""
    marks = [(i, m) for i, line in enumerate(lines) if (m := HEADING.match(line))]
    starts = [(i, m[2].strip(), len(m[1])) for i, m in marks]
    if not starts or starts[0][0]:
        starts.insert(0, (0, "", 0))
    for (begin, heading, level), (end, *_) in zip(starts, [*starts[1:], (len(lines),)], strict=True):
        yield begin, end, heading, level


def _windows(lines: list[str], most: int, overlap: int) -> Iterator[tuple[str, int, int]]:
    """content, first and last line (from 0, inclusive) of the parts of a section longer than `most`.

    A part is closed when its text reaches `most`: with a blank line at once, else before the line that made it too long; its
    last `overlap` lines open the next. A single line that is too long is cut alone.
    """
    first = 0  # of the open part, which is lines[first : i + 1]
    i = 0
    while i < len(lines):
        text = "\n".join(lines[first : i + 1])
        if len(text) < most:
            i += 1
            continue
        if not lines[i].strip() and i + 1 < len(lines):
            yield text, first, i
            first = max(first, i + 1 - overlap)
            i += 1
        elif i > first:
            yield "\n".join(lines[first:i]).strip(), first, i - 1
            first = max(first, i - overlap)
            i += 1
        else:
            yield text, first, i
            first = i = i + 1
    if first < len(lines):
        yield "\n".join(lines[first:]), first, len(lines) - 1


def chunks_of(text: str, most: int = 1500, overlap: int = 2) -> Iterator[tuple[str, str, int, int, int]]:
    """content, heading, level, first and last line (from 1) of the chunks of a Markdown text."""
    lines = text.split("\n")
    for begin, end, heading, level in _sections(lines):
        section = "\n".join(lines[begin:end]).strip()
        plain = re.sub(COMMENT, "", section)
        if len("\n".join(x for x in plain.splitlines() if not HEADING.match(x)).strip()) < 2:
            continue
        if len(section) <= most:
            yield section, heading, level, begin + 1, end
            continue
        for content, first, last in _windows(lines[begin:end], most, overlap):
            content = content.strip()
            for part in split_long(content, most) if len(content) > most else [content]:
                if part.strip():
                    yield part.strip() if len(content) > most else part, heading, level, begin + first + 1, begin + last + 1


def chunk_markdown(docs: DataFrame, key: str = "slug", text: str = "body", most: int = 1500, overlap: int = 2) -> DataFrame:
    """source, content, heading, heading_level, start_line, end_line, n of every document's chunks, by tasks over batches of rows."""

    fields = {"source": pa.string(), "content": pa.string(), "heading": pa.string(), "heading_level": pa.int32(), "start_line": pa.int32(), "end_line": pa.int32(), "n": pa.int32()}

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, *c, n) for k, t in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for n, c in enumerate(chunks_of(t, most, overlap))]
        columns = list(zip(*rows, strict=True)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, fields.values(), strict=True)], names=[*fields])

    rows = docs.select(F.col(key).cast("string").alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda batches: sliced(batches, "text", told), "source string, content string, heading string, heading_level int, start_line int, end_line int, n int")


@F.pandas_udf(T.ArrayType(T.StringType()))
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """The first 200 lines of a unified diff with two lines of context."""
    pairs = zip(before.fillna(""), after.fillna(""), strict=True)
    return pd.Series([list(difflib.unified_diff(a.splitlines(), b.splitlines(), "prev", "new", n=2, lineterm=""))[:200] for a, b in pairs])
