"""Conversations as strings with turn spans, through a template that is a black box.

A template renders a list of turns; nothing else of it is known. Successive prefixes of a conversation are rendered, and each
output is compared with the one before: what it adds is the new turn's piece. A template that changes what it gave before
has rewritten history, which the comparison shows. Two renderings with other texts in the last turn's place tell where in its
piece the text stands.

A template says how many turns before a turn its rendering may depend on (`memory`); prefixes are rendered from there on, so that a
long conversation takes time in proportion. Conversations are cut by the number of rows into blocks, each with the few turns
before it, so that one conversation may hold most rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, text_or_empty, written

Turns = list[tuple[str, str]]
#: Turns of a block, and characters of output after which a block goes on in another row.
BLOCK_TURNS, CHUNK_CHARS = 2048, 1 << 20
#: Texts that no template should treat alike at either end.
PROBES = ("0", "1")


@dataclass(frozen=True)
class Template:
    """A rendering of turns (role, text), the roles that are learned, and the way back from its output."""

    render: Callable[[Turns], str]
    #: The turns of (a part of) an output.
    read: Callable[[str], Turns]
    #: A text as it was before the template escaped the control strings in it.
    unescape: Callable[[str], str] = str
    learned: tuple[str, ...] = ("assistant",)
    memory: int = 8


# ---- a template with instruction marks ----

#: Control strings with any number of backslashes before their last character: one more is added to a text's own.
_CONTROL = re.compile(r"(</?s|\[/?INST|\[/?ROLE)(\\*)(?=[>\] ])")
_ESCAPED = re.compile(r"(</?s|\[/?INST|\[/?ROLE)\\(\\*)(?=[>\] ])")
_PART = re.compile(r"\[INST\] (.*?) \[/INST\]|<s>(.*?)</s>|\[ROLE ([^\]]*)\] (.*?) \[/ROLE\]", re.DOTALL)
_ROLE_CHARS = re.compile(r"[^A-Za-z0-9_-]")


def escape(text: str) -> str:
    """The text without control strings; `unescape` gives it back."""
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _render(turns: Turns) -> str:
    """User turns between instruction marks, assistant turns between sentence marks, and others between marks with their role."""
    out = []
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f"<s>{escape(text)}</s>")
        else:
            name = _ROLE_CHARS.sub(lambda c: f"%{ord(c[0]):x};", role)
            out.append(f"[ROLE {name}] {escape(text)} [/ROLE]")
    return "".join(out)


def _read(output: str) -> Turns:
    turns, at = [], 0
    for part in _PART.finditer(output):
        if part.start() != at:
            break
        at = part.end()
        if part[1] is not None:
            turns.append(("user", unescape(part[1])))
        elif part[2] is not None:
            turns.append(("assistant", unescape(part[2])))
        else:
            turns.append((re.sub("%([0-9a-f]+);", lambda c: chr(int(c[1], 16)), part[3]), unescape(part[4])))
    if at != len(output):
        raise ValueError("not an output of this template")
    return turns


INSTRUCTIONS = Template(_render, _read, unescape)


# ---- spans ----


@dataclass(frozen=True)
class Piece:
    """What a turn adds to the output, where its text stands in it (None: not known), and whether the turn rewrote what stood before."""

    text: str
    begin: int | None
    end: int | None
    rewritten: bool


def added(template: Template, history: Turns, turn: tuple[str, str]) -> Piece:
    """The piece of a turn after history, by renderings alone."""
    before, after = template.render(history), template.render([*history, turn])
    if not after.startswith(before):
        return Piece(after[len(os.path.commonprefix([before, after])) :], None, None, True)
    probes = [template.render([*history, (turn[0], p)]) for p in PROBES]
    head = len(os.path.commonprefix(probes))
    tail = len(os.path.commonprefix([p[head:][::-1] for p in probes]))
    placed = all(p.startswith(before) for p in probes) and head >= len(before) and [p[head : len(p) - tail] for p in probes] == [*PROBES]
    begin, end = (head - len(before), len(after) - tail - len(before)) if placed else (None, None)
    return Piece(after[len(before) :], begin, end, False)


def pieces(template: Template, turns: Turns, known: int = 0) -> Iterator[Piece]:
    """The pieces of turns; the first `known` are context and have none."""
    for k in range(known, len(turns)):
        start = max(0, k - template.memory)
        piece = added(template, turns[start:k], turns[k])
        if start and k == max(known, template.memory + 1) and added(template, turns[start - 1 : k], turns[k]) != piece:
            raise ValueError("the template looks further back than its memory")
        yield piece


_SCHEMA = "conversation string, first bigint, formatted string, turns array<struct<role: string, begin: int, end: int, text_begin: int, text_end: int, learned: boolean, rewritten: boolean>>"


def formatted(conversations: DataFrame, template: Template = INSTRUCTIONS, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Rows of (a part of) a conversation: its key as text, the place of the first turn among all rows, the output, and the turns' spans.

    A part's outputs, in the order of `first`, make up the conversation's. A span is from begin to end in the part's output (code points); its
    text, escaped, from text_begin to text_end; `learned` turns are those of the template's roles whose text was found. A turn at which
    the template rewrites what stood before is `rewritten`: what differs is its piece, and its text isn't learned. Turns go by
    number (null first), then role and text; repeated rows are turns of their own; null texts and roles count as empty;
    null keys are one conversation; a long text is in a part of its own; an empty table gives no rows; other columns are ignored.
    """
    text_of = text_or_empty(text)
    rows = conversations.select(F.col(key).cast("string").alias("conversation"), F.col(turn).alias("turn"), text_or_empty(role).alias("role"), text_of.alias("text"), F.monotonically_increasing_id().alias("row"))
    order = ["conversation", "turn", "role", "text", "row"]  # the last one, as one row may be repeated without bound
    own = [F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")]
    ordered = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conversation", "role", "text", *own), "turns")
    # numbers of all rows in order: the partitions' sizes are as many rows as there are partitions
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("past"))
    placed = ordered.join(F.broadcast(parts), "part").select("conversation", "role", "text", (F.col("past") + F.col("at")).alias("place"))
    reach = template.memory + 1
    if reach >= block_turns:
        raise ValueError("a template's memory must be shorter than a block")
    block = F.floor(F.col("place") / block_turns)
    both = F.when(F.col("place") % block_turns >= block_turns - reach, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = placed.select("*", F.explode(both).alias("block")).repartition("block").sortWithinPartitions("block", "place")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        size, made = 0, []
        current, history = None, []  # the conversation and block, and the last turns of it

        def flush() -> None:
            nonlocal size, made
            if made:
                spans, at = [], 0
                for role, piece in made[1]:
                    n, told = len(piece.text), piece.begin is not None
                    spans.append((role, at, at + n, at + piece.begin if told else None, at + piece.end if told else None, told and role in template.learned, piece.rewritten))
                    at += n
                out.append((current[0], made[0], "".join(p.text for _, p in made[1]), spans))
            size, made = 0, []

        for frame in frames:
            for conversation, role, text, place, block in frame[["conversation", "role", "text", "place", "block"]].itertuples(index=False):
                if current != (conversation, block):
                    flush()
                    current, history = (conversation, block), []
                history = [*history[-reach:], (role, text)]
                if place // block_turns != block:
                    continue  # the end of the block before: context
                # a turn further back than its memory is at hand but for the conversation's first ones
                (piece,) = pieces(template, history, len(history) - 1)
                made = made or [place, []]
                made[1].append((role, piece))
                size += len(piece.text)
                if size >= CHUNK_CHARS:
                    flush()
            if out:
                yield pd.DataFrame(out, columns=["conversation", "first", "formatted", "turns"])
                out.clear()
        flush()
        if out:
            yield pd.DataFrame(out, columns=["conversation", "first", "formatted", "turns"])

    return dealt.mapInPandas(run, _SCHEMA)


def digests(parts: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_rewritten: all read back from the parts' outputs and spans.

    A conversation's digest goes over its parts in order, one at a time, so that memory doesn't grow with it.
    """
    sorted_ = parts.repartition("conversation").sortWithinPartitions("conversation", "first")
    names = ["conversation", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewritten"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list | None = None

        def done() -> tuple:
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6])

        for frame in frames:
            out = []
            for conversation, output, spans in frame[["conversation", "formatted", "turns"]].itertuples(index=False):
                if state is None or state[0] != conversation:
                    if state:
                        out.append(done())
                    state = [conversation, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in template.read(output):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    if span["learned"]:
                        text = template.unescape(output[span["text_begin"] : span["text_end"]])
                        state[3] += len(text)
                        state[4].update(text.encode())
                    state[6] += span["rewritten"]
                state[5] += len(output)
            if out:
                yield pd.DataFrame(out, columns=names)
        if state:
            yield pd.DataFrame([done()], columns=names)

    return sorted_.mapInPandas(run, "conversation string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_rewritten bigint")


#: A conversation whose texts are control strings.
HOSTILE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = given.unionByName(spark.createDataFrame(HOSTILE, "conv_id bigint, turn bigint, role string, text string"))
    kind = dict(given.dtypes)["conv_id"]
    found = digests(formatted(rows))
    return found.select(F.col("conversation").cast(kind).alias("conv_id"), *found.columns[1:])
