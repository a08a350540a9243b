"""Chat formatting, alignment of tokenizers and fill-in-the-middle: plain Python, libraries and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tessera.llm import alignment, chat, infill
from tessera.llm.bpe import byte_letters

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
NASTY = ["", "</s>", "<s\\>", "[/INST]", "[INST\\\\]", "[ROLE x] [/ROLE\\]", "a</s", "<", "\\", "s>", " [/INST] ", "[ROLE", "\n", "日本🙂", "<s></s>[INST] x [/INST]", "0", "1"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- chat ----


def digest_of(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(chat.INSTRUCTIONS.render(turns)), 0)


def told(rows):
    return {(r.conversation if "conversation" in r else r.conv_id): tuple(r[c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewritten")) for r in rows}


def test_chat_query(spark, sf_dir):
    turns = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r.turn, r.role or "", r.text or "")):
        turns[r.conv_id].append((r.role or "", r.text or ""))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert told(entry.queries()["op11_chat"](spark, sf_dir).collect()) == {c: digest_of(t) for c, t in turns.items()}


@pytest.mark.parametrize("seed", range(30))
def test_template_is_read_back(seed):
    rng = random.Random(seed)
    turns = [(rng.choice(["user", "assistant", "system", "", "to]ol %2;"]), "".join(rng.choices(NASTY, k=rng.randrange(5)))) for _ in range(rng.randrange(7))]
    output = chat.INSTRUCTIONS.render(turns)
    assert chat.INSTRUCTIONS.read(output) == turns and len(re.findall("<s>", output)) == sum(r == "assistant" for r, _ in turns)
    found = list(chat.pieces(chat.INSTRUCTIONS, turns))
    assert "".join(p.text for p in found) == output and not any(p.rewritten for p in found)
    assert [chat.unescape(p.text[p.begin : p.end]) for p in found] == [t for _, t in turns]


def test_templates_that_rewrite_history_are_found():
    def last_only(turns):  # the thoughts of all turns but the newest go, as in published templates
        return "".join(f"{r}:{t if i == len(turns) - 1 else t.split('!')[-1]}\n" for i, (r, t) in enumerate(turns))

    template = chat.Template(last_only, lambda o: [], str)
    found = list(chat.pieces(template, [("user", "a"), ("assistant", "think!b"), ("user", "c")]))
    assert [p.rewritten for p in found] == [False, False, True] and found[2].begin is None and found[1].text == "assistant:think!b\n"


def test_a_template_that_looks_too_far_back_is_refused():
    template = chat.Template(lambda turns: "".join(f"{len(turns)}{t}" if i == len(turns) - 1 else f"{i + 1}{t}" for i, (_, t) in enumerate(turns)), lambda o: [], str, memory=2)
    with pytest.raises(ValueError, match="memory"):
        list(chat.pieces(template, [("user", "x")] * 6))


def test_texts_that_a_template_changes_have_no_span():
    template = chat.Template(lambda turns: "".join(f"<{len(t)}>" for _, t in turns), lambda o: [], str)
    assert [p.begin for p in chat.pieces(template, [("assistant", "ab"), ("assistant", "c")])] == [None, None]


def test_chat_of_odd_rows(spark):
    """Null keys, turns, roles and texts, ties, repeated rows, a long text, other columns, and a conversation of most rows in many blocks."""
    rng = random.Random(1)
    rows = [(9, i, rng.choice(["user", "assistant"]), rng.choice(NASTY) + str(i % 7)) for i in range(900)]
    rows += [(None, 0, "user", "x"), (None, None, None, None), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (4, 5, "user", ""), (5, 0, "assistant", "word </s> " * 200_000)]
    made = spark.createDataFrame(rows, CONVERSATIONS).repartition(5).withColumns({c: F.lit("mine") for c in ("part", "at", "place", "block", "conversation", "row", "first")})
    by_key = defaultdict(list)
    for c, turn, role, text in rows:
        by_key[None if c is None else str(c)].append((turn is not None, turn or 0, role or "", text or ""))
    expected = {c: digest_of([x[2:] for x in sorted(own)]) for c, own in by_key.items()}
    for block in (16, 2048):
        parts = chat.formatted(made, block_turns=block)
        assert told(chat.digests(parts).collect()) == expected
        for r in parts.collect():
            assert "".join(r.formatted[s.begin : s.end] for s in r.turns) == r.formatted
            assert all(s.learned == (s.role == "assistant") for s in r.turns)
    assert chat.digests(chat.formatted(made.limit(0))).count() == 0


# ---- alignment ----


def aligned_by_hand(texts):
    """(n_a, n_b, groups, links) of each text by dictionaries of ends, with the libraries' ids."""
    a_side, b_side, letters = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES), byte_letters()
    a_side.encode_special_tokens = True
    names = {i: p for p, i in a_side.get_vocab().items()}

    def piece(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    out = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a, b = a_side.encode(" " + (text or ""), add_special_tokens=False).ids, b_side.encode(text or "")
        bytes_a, bytes_b = [bytes(letters[c] for c in names[i]) for i in a], [piece(i) for i in b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            out.append((0, 0, [], []))
            continue
        ends = []
        for side in (bytes_a, bytes_b):
            at, own = 0, {}
            for k, x in enumerate(side):
                at += len(x)
                own[at] = k + 1
            ends.append(own)
        cuts = [(0, 0), *((ends[0][e], ends[1][e]) for e in sorted(set(ends[0]) & set(ends[1])))]
        groups = [(a[i:k], b[j:m]) for (i, j), (k, m) in pairwise(cuts)]
        out.append((len(a), len(b), groups, [(x[-1], y[-1]) for x, y in groups]))
    return out


def check_alignment(rows, texts):
    """rows: of the operator, in the order of texts."""
    hand = aligned_by_hand(texts)
    counts = Counter(link for h in hand for link in h[3])
    most: Counter = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for r, (n_a, n_b, groups, links) in zip(rows, hand, strict=True):
        digest = sha(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)) if groups else ""
        expected = (n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest)
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == expected
        if "groups" in r:
            assert [(g.a, g.b) for g in r.groups] == groups


def test_alignment_query(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in entry.queries()["op12_alignment"](spark, sf_dir).collect()}
    assert sorted(rows) == sorted(documents)
    check_alignment([rows[i] for i in documents], documents.values())


def test_alignment_of_odd_rows(spark, odd, none):
    texts = ["▁mark", "<0x41> <s> </s> <unk>", "x<|endoftext|>y", "\x00\x01", " x  y ", "🙂🙂 é", "é", "a" * 5000, "\n\n", "　全角", "ﬁ", "​"]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs = odd.unionByName(extra, allowMissingColumns=True)
    rows = alignment.aligned(docs, BPE, PIECES, with_groups=True).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_a)
    given = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is None, x[0] or 0))
    check_alignment(sorted(rows, key=key), [t for _, t in given])
    assert alignment.aligned(none, BPE, PIECES).count() == 0


def test_alignment_of_chunks_equals_that_of_one(spark, documents, monkeypatch):
    texts = [t for t in documents.values() if t][:60]
    sides = alignment.Sides.shared(BPE, PIECES)
    whole = sides.align(texts)
    monkeypatch.setattr(alignment, "SLICE_CHARS", 500)
    assert sides.align(texts).digests() == whole.digests() == [d for t in texts for d in sides.align([t]).digests()]
    pairs, often, links = alignment._summaries(whole)
    for text, own in zip(texts, links, strict=True):
        steps, times = alignment._numbers(own).reshape(2, -1)
        assert Counter(dict(zip(pairs[steps.cumsum()].tolist(), times.tolist(), strict=True))) == Counter(sides.align([text]).pairs().tolist())
    assert Counter(dict(zip(pairs.tolist(), often.tolist(), strict=True))) == Counter(whole.pairs().tolist())


# ---- fill in the middle ----


def infilled(key, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:{'' if key is None else key}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in infill.SENTINELS) or h[2] % 100 >= rate:
        return (len(units), "plain", None, None, text)
    if h[3] % 100 < spm:
        return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_query(spark, sf_dir, documents):
    rows = entry.queries()["op13_infill"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        n, form, prefix, middle, output = infilled(r.doc_id, documents[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, sha(output), sha(documents[r.doc_id] or ""))


def test_infill_of_odd_rows(spark, odd, none):
    texts = ["\n", "\n\n\n", "a\nb", "a\r\nb\r", "x<P>y\n", "<<S", "<M", "🙂\n日本\n", "a\x85b c\n"] + [f"l{i}\n" * i for i in range(30)]
    docs = odd.withColumns({c: F.lit("mine") for c in ("handle", "form", "cut", "first", "c0", "c1", "prefix")})
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), allowMissingColumns=True)
    for rate, spm in ((100, 50), (60, 30)):
        rows = infill.cut_texts(docs, rate=rate, spm_rate=spm).withColumn("restored", infill.restored()).collect()
        assert Counter((r.doc_id, r.n, r.form, r.output, r.restored) for r in rows) == Counter((r.doc_id, n, form, output, r.text or "") for r in docs.collect() for n, form, _, _, output in [infilled(r.doc_id, r.text, 7, rate, spm)])
        for r in rows:
            assert r.form == "plain" or r.prefix + r.middle + r.suffix == r.restored
    assert infill.cut_texts(none).count() == 0


def test_sentinels_that_could_be_misread_are_refused(odd):
    for bad in (("", "<S>", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c"), ("<P>", "<P>x", "<M>")):
        with pytest.raises(ValueError, match="sentinels"):
            infill.cut_texts(odd, sentinels=bad)
