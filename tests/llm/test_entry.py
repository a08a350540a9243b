"""The corpus queries are registered, and equal their SQL twins where they have one."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from tessera.llm import registry

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ASSIGN = re.compile(r"""(?:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)} and "pipeline" in names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sf_dir, same, name):
    same(entry.queries()[name](spark, sf_dir), entry.oracle_sql()[name])


@pytest.fixture(scope="module")
def rows_of_queries(spark, sf_dir):
    return lambda name: entry.queries()[name](spark, sf_dir).collect()


def test_toxicity_query(rows_of_queries, documents):
    rows = rows_of_queries("op1_toxicity")
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_secrets_query(rows_of_queries, documents):
    rows = rows_of_queries("op3_secrets")
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    kinds = ("assign", "access", "hex")
    for r in rows:
        own = base(documents[r.doc_id] or "")
        told = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in own)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in own) for i in range(3)] and r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("random")) == told


def test_lm_query(rows_of_queries, documents):
    rows = {r.doc_id: r for r in rows_of_queries("op9_lm")}
    assert sorted(rows) == sorted(documents)
    held = {i for i in documents if zlib.crc32(str(i).encode()) % 7 == 2}
    own = {i: [*words(t), "\0"] for i, t in documents.items()}
    counts = Counter(w for i, ws in own.items() if i not in held for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in own.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) and r.score < 0


def test_packing_query(rows_of_queries, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows_of_queries("op10_packing"):
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(documents)
    total = 0
    for i, text in documents.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        pieces, at = sorted(by_doc[i], key=lambda r: r.piece), 0
        for k, r in enumerate(pieces):
            own = ids[at : at + r.length]
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(struct.pack(f"<{len(own)}I", *own))) and (k == 0 or r.length == 2048)
            at += r.length
        assert at == len(ids)
        total += at
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= 1.02 * -(-total // 2048) + 1


def test_pieces_query(rows_of_queries, documents):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows_of_queries("op5_pieces"):
        text = documents[r.doc_id] or ""
        assert r.ids == library.encode(text) and r.n_ids == len(r.ids) and r.decoded_crc32 == zlib.crc32(text.replace("▁", " ").encode())
