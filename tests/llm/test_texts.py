"""Pieces, packing, media and licences: libraries, exact round trips and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import licences, media, packing
from tessera.llm.bpe import Encoder
from tessera.llm.pieces import MARK, Pieces, decoded, encoded

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", "\n", "a\n\nb", " x", "x ", "don't it's.", "日本。 語, ok.", "x<|endoftext|>y", "a\r\nb", "A.B, c.d  e", "\x00\x01", "🙂" * 50, "a" * 3000, "  two  spaces\t\ttabs", "▁mark"]


def test_bpe_ids_are_the_library_s(documents):
    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    texts = [*documents.values(), *HARD]
    for text, ids in zip(texts, Encoder.shared(BPE).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_piece_ids_are_the_library_s(documents):
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), Pieces(PIECES)
    texts = [*documents.values(), *HARD]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        found = np.frombuffer(ids, "<u4").tolist()
        assert found == library.encode(text)
        assert own.decode(found) == text.replace("▁", " ")


def test_unigram_pieces_are_the_library_s(tmp_path, documents):
    """A unigram model made by hand: random scores for short strings, no byte fallback."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng, proto = random.Random(3), pb.ModelProto()
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        proto.pieces.add(piece=piece, score=0, type=kind)
    text = " ".join(documents.values())[:5000]
    found = {"▁" + w[:n] for w in text.split() for n in (1, 2, 4)} | {w[i : i + n] for w in text.split() for i in range(len(w)) for n in (1, 2, 3)}
    for piece in sorted(found - {"▁"}):
        proto.pieces.add(piece=piece, score=-rng.uniform(1, 12), type=1)
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), Pieces(str(path))
    words = sorted(set(text.split()))[:300]
    for word, ids in zip(words, own.encode(words), strict=True):
        mine, theirs = np.frombuffer(ids, "<u4").tolist(), library.encode(word)
        total = lambda x: sum(library.get_score(i) for i in x)
        assert mine == theirs or math.isclose(total(mine), total(theirs), rel_tol=1e-5)


def test_best_scores_are_those_of_all_segmentations():
    """Forward scores that prefixes share against a search of every segmentation, and against the library with the same scores in a unigram model."""
    own, rng = Pieces(PIECES), random.Random(11)
    words = sorted({MARK * rng.randrange(2) + "".join(rng.choices("aeinrst☃", k=rng.randrange(1, 9))) for _ in range(150)} | {"▁the", "the", "▁▁", "ation", "▁nation", "▁nations"})

    def best(word):
        if not word:
            return 0.0
        return max(best(word[:-n]) + (own.scores.get(word[-n:], own.least if n == 1 else -math.inf)) for n in range(1, len(word) + 1))

    for word, (_, n, score) in zip(words, own._walk(words), strict=True):
        assert score == pytest.approx(best(word)) and 1 <= n <= len(word)


def test_best_scores_are_the_library_s(tmp_path, documents):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(PIECES, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), Pieces(PIECES)
    words = sorted({w for t in documents.values() for w in (t or "").split()})[:1500]
    checked = 0
    for word, n, score in zip(words, *own.segmented(words)[2:], strict=True):
        first = library.nbest_encode_as_ids(word, 2)[0]  # the lattice's best
        if not any(library.is_byte(i) or library.is_unknown(i) for i in first):
            checked += 1
            assert score == pytest.approx(sum(library.get_score(i) for i in first)) and n > 0
    assert checked > 1000


def test_pieces_of_odd_rows(odd, none):
    rows = decoded(encoded(odd, PIECES), PIECES).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.decoded) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in odd.collect())
    assert decoded(encoded(none, PIECES), PIECES).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    histogram = np.bincount(np.clip(rng.lognormal(5.5, 1, 20_000 * (seed > 0)).astype(int), 1, 2048), minlength=2049)
    planned, used = packing.plan(histogram), np.zeros(2049, int)
    for lengths, often in planned:
        assert often > 0 and sum(lengths) <= 2048
        for n in lengths:
            used[n] += often
    assert (used == histogram).all()
    sequences, least = sum(n for _, n in planned), math.ceil((histogram * np.arange(2049)).sum() / 2048)
    assert sequences <= least * 1.01 + 1


def test_packing_of_odd_rows(odd, none):
    library = Tokenizer.from_file(BPE)
    rows = packing.pack(odd, BPE, with_ids=True).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) and r.length == len(r.ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    for doc in {r.doc_id: r for r in odd.collect() if r.doc_id != 7}.values():
        found = [i for r in sorted(by_doc[doc.doc_id], key=lambda r: r.piece) for i in r.ids]
        assert found == [*library.encode(doc.text or "", add_special_tokens=False).ids, 0]
    long = sorted((r.piece, r.start, r.length) for r in by_doc[7])
    assert len(long) % 2 == 0 and all(n == 2048 for p, _, n in long if p) and long[0][1] == 0
    assert packing.pack(none, BPE).count() == 0


def test_media_round_trip(odd, none):
    rows = media.described(media.stored(odd)).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes == 44 + len(payload) and len(r.times) == len(r.codes)
    one = {r.doc_id: (r.payload_sha256, r.media_sha256, r.times, r.codes) for r in media.fingerprinted(odd).collect()}
    assert one[1] == one[2] and one == {r.doc_id: (r.payload_sha256, r.media_sha256, r.times, r.codes) for r in rows}
    assert media.fingerprinted(none).count() == 0


def test_peaks_find_a_tone():
    n = np.arange(576 * 20)
    tone = (128 + 60 * np.sin(2 * np.pi * 30 * n / 192) + 30 * np.sin(2 * np.pi * 60 * n / 192)).astype(np.uint8)
    found = media.peaks(tone.tobytes())
    assert (found[1:-1, 2] == 30).all() and (found[1:-1, 3] == 60).all() and len(media.fingerprint(b"\xff" * 576)[1]) == 0


@pytest.mark.parametrize("text", ["one short text", "x", "", "The quick brown fox jumps over the lazy dog. " * 30, "日本語 🙂 " * 90])
def test_fingerprints_by_a_plain_transform(text):
    """Every frame by a sum over all samples for each frequency; no peak near a tie."""
    raw = text.encode()
    payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
    times, codes = media.fingerprint(payload)
    size, hop, frames = media.FRAME, media.HOP, []
    levels = [(b - 128) / 128 for b in payload]
    levels = [b - media.EMPHASIS * a for a, b in zip([levels[0], *levels], levels, strict=False)]
    levels = [0.0] * hop + levels + [0.0] * hop
    for start in range(0, len(levels) - size + 1, hop):
        x = levels[start : start + size]
        middle = sum(x) / size
        x = np.array([(v - middle) * (0.5 - 0.5 * math.cos(2 * math.pi * i / size)) for i, v in enumerate(x)])
        strength = [abs(sum(x * np.exp(-2j * np.pi * k * np.arange(size) / size))) for k in range(size // 2 + 1)]
        floor, own = media.FLOOR * sum(strength) / len(strength) + 1e-4, []
        for first, end in zip(media.BANDS, media.BANDS[1:], strict=False):
            there = [k for k in range(first, end) if strength[k] > strength[k - 1] and strength[k] >= strength[k + 1] and strength[k] > floor]
            own.append(max(there, key=lambda k: strength[k], default=0))
        frames.append(own)
    wanted = []
    for t, own in enumerate(frames):
        wanted += [(t, 0, b, x, next(y for y in own[b + 1 :] if y)) for b, x in enumerate(own) if x and any(own[b + 1 :])]
        for step in media.STEPS:
            if t + step < len(frames):
                wanted += [(t, step, b, x, y) for b, (x, y) in enumerate(zip(own, frames[t + step], strict=True)) if x and y]
    assert [(int(t), int(c & 3), int(c >> 16), int(c >> 9 & 127), int(c >> 2 & 127)) for t, c in zip(times, codes, strict=True)] == wanted
    assert len(wanted) > 0 or len(raw) < 2


def test_media_query_has_the_contract_s_columns(spark, sf_dir, documents):
    rows = media.op7_media(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    features = {}
    for r in rows:
        raw = (documents[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        file = media.wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest()) and r.feature.startswith(f"{len(r.codes)}:")
        assert features.setdefault(raw, r.feature) == r.feature and (len(r.codes) > 0 or len(raw) < 2)


def test_licences_and_inheritance(spark, odd, none):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.py", "code"), ("a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"), ("a/b/z.py", ""),
        ("a/b/LICENSE.txt", "intro\nThis work is licensed under the GNU General Public License, version 3."), ("a/b/c/d.py", None), ("top.py", "x"), ("e/f.py", "a licence to print money for all of them"), (None, "Released under the MIT License."),
    ]
    found = licences.inherited(licences.scored(spark.createDataFrame(files, "path string, text string"))).collect()
    assert {r.path: (r.licence, r.licence_from) for r in found} == {
        "a/LICENSE": ("MIT", "own"), "a/x.py": ("MIT", "a"), "a/b/y.py": ("Apache-2.0", "own"), "a/b/z.py": ("GPL-3.0", "a/b"), "a/b/LICENSE.txt": ("GPL-3.0", "own"),
        "a/b/c/d.py": ("GPL-3.0", "a/b"), "top.py": (None, None), "e/f.py": (None, None), None: ("MIT", "own"),
    }
    clash = spark.createDataFrame([("a/x", "MIT", 0.9, "mine")] * 2, "path string, own_licence string, own_score double, near string").withColumns({c: F.lit("mine") for c in ("depth", "above", "given", "dir", "c0")})
    assert [r.asDict() for r in licences.inherited(clash).collect()] == [{**r.asDict(), "licence": "MIT", "licence_from": "own"} for r in clash.collect()]
    assert licences.inherited(licences.scored(none).withColumn("path", F.lit("a"))).count() == 0


def plain_licences(texts):
    """The best template of every window of lines and of the whole, by plain vectors."""
    terms = [licences._terms(t or "") for t in texts]
    frequency = Counter(t for x in terms for t in set(x))
    weight = lambda t: math.log((1 + len(texts)) / (1 + frequency[t])) + 1
    vector = lambda x: {t: n * weight(t) for t, n in Counter(x).items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    templates = [(i, name, set(names), vector(licences._terms(t))) for i, (name, t, names) in enumerate(licences.TEMPLATES)]
    out = []
    for text in texts:
        lines, units = [licences._terms(line) for line in re.split(licences.CUT, text or "", flags=re.ASCII)], []
        for width in licences.WIDTHS:
            step = max(1, width // 4)
            units += [sum(lines[s : s + width], []) for s in range(0, len(lines) - width // 2, step)]
        best = (0.0, 0.0, 0, None)
        for unit in [*units, sum(lines, [])]:
            own = vector(unit)
            for i, name, names, other in templates:
                if own and names <= set(own):
                    score = round(sum(w * other.get(t, 0) for t, w in own.items()) / (norm(own) * norm(other)), 6)
                    if score >= licences.LEAST:
                        best = max(best, (round(score * norm(other), 6), score, -i, name), key=lambda x: x[:3])
        out.append((best[3], best[1]) if best[3] else (None, None))
    return out


def wrapped(text, prefix, width=70):
    import textwrap

    return "\n".join(prefix + line for line in textwrap.wrap(text, width))


def test_headers_texts_and_tags(spark):
    """Planted headers (wrapped, as comments), full texts, titles and tags: all found, by plain vectors too, and nothing else."""
    of = {}
    for name, text, names in licences.TEMPLATES:
        if len(text) > 200 and name not in of:
            of[name] = text
    gnu = {n: next(t for i, t, _ in licences.TEMPLATES if i == n and len(t) > 200) for n in ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0")}
    prose = "The river runs past the stone bridge and on to the sea.\nNobody knows its name."
    planted = [(name, f"#!/bin/sh\n{wrapped(text, '# ')}\n\nimport this\n{prose}") for name, text in {**of, **gnu}.items()]
    planted += [(name, f"{prose}\n{wrapped(text, ' * ', 50)}\n{prose}") for name, text in gnu.items()]
    planted += [("BSD-2-Clause", of["BSD-2-Clause"]), ("MIT", "Copyright (c) 2021 Jane Roe. Released under the MIT License."), ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\nint main();"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"), ("ISC", "ISC License"), ("EPL-2.0", "Eclipse Public License 2.0"), ("CC0-1.0", "CC0 1.0 Universal"), ("Unlicense", "Unlicense")]
    clean = ["License", "a licence to print money", "Version 2.0 of the plan", "SPDX-License-Identifier: Nobody-1.0", "All rights reserved. Copyright by nobody.", "the public and the general", prose, "", None, "mit"]
    texts = [t for _, t in planted] + clean + [f"{prose} {i} and more of it, word by word" for i in range(60)]
    rows = {r.i: (r.own_licence, r.own_score) for r in licences.scored(spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)).collect()}
    plain = plain_licences(texts)
    for i, wanted in enumerate(plain):
        assert rows[i][0] == wanted[0] and rows[i][1] == pytest.approx(wanted[1], abs=2e-6), texts[i]
    found = [rows[i][0] for i in range(len(planted))]
    assert all(f in (None, name) for f, (name, _) in zip(found, planted, strict=True)), [x for x in zip(found, planted, strict=True) if x[0] != x[1][0]]
    assert sum(f is not None for f in found) >= 0.9 * len(planted), [x for x in zip(found, planted, strict=True) if x[0] is None]
    assert all(rows[len(planted) + i][0] is None for i in range(len(clean)))


def test_licence_query_by_plain_paths(spark, sf_dir):
    """The query's paths and what is inherited along them, in plain Python."""
    rows = licences.op4_licences(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs) and any(r.own_licence for r in rows)
    for r in rows:
        digit = f"{zlib.crc32(str(r.doc_id).encode()):08x}"[0]
        assert r.path == f"{docs[r.doc_id].source or '-'}/{docs[r.doc_id].lang or '-'}/{digit}/{r.doc_id}.txt"
    firsts = {}
    for r in sorted((r for r in rows if r.own_licence), key=lambda r: r.doc_id):
        firsts.setdefault(r.path.rsplit("/", 1)[0], r.own_licence)
    for r in rows:
        above = r.path.rsplit("/", 1)[0]
        while above and above not in firsts:
            above = above.rsplit("/", 1)[0] if "/" in above else ""
        assert (r.licence, r.licence_from) == ((r.own_licence, "own") if r.own_licence else (firsts.get(above), above or None))
    texts = [docs[r.doc_id].text for r in rows]
    named = [r.own_licence for r in rows]
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    for text, own in zip(texts, named, strict=True):
        there = {v for k, v in lines.items() if k in (text or "").split("\n")}
        assert (own in there) if there else own is None


def test_licences_do_not_vanish_as_tables_grow(spark):
    """Every term is counted: scores are those of plain vectors, and the same however many rows there are."""
    kinds = ["Released under the MIT License.", *["This project is released under the MIT License."] * 5]
    for often in (10, 500):
        texts = kinds * often + ["Copyright by nobody", "", None, "Copyright"]
        rows = licences.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), least=0.5).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(texts))) and "text" not in rows[0].asDict()
        terms = [set(licences._terms(t or "")) for t in texts]
        weight = lambda t: math.log((1 + len(texts)) / (1 + sum(t in x for x in terms))) + 1  # noqa: B023, E731
        norm = lambda text: math.sqrt(sum(weight(t) ** 2 for t in licences._terms(text)))  # noqa: B023, E731
        for row in rows:
            if texts[row.doc_id] in kinds:
                assert row.own_licence == "MIT" and row.own_score == pytest.approx(norm(kinds[0]) / norm(texts[row.doc_id]), abs=2e-6) and row.own_score > 0.7
            else:
                assert row.own_licence is None and row.own_score is None


def test_scores_of_odd_rows(odd, none):
    assert licences.scored(odd).count() == odd.count() and licences.scored(none).count() == 0


def test_ids_with_added_tokens_are_the_library_s(spark, documents):
    """The library in its default settings: special tokens have their own ids."""
    library, own = Tokenizer.from_file(BPE), Encoder.shared(BPE, added=True)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    rng = random.Random(11)
    parts = [*added, "one document ", " another", " ", "\n\n", "a", "<|", "|>", "end"]
    texts = [*list(documents.values())[:50], *HARD, *added, "one document <|endoftext|> another", *("".join(rng.choices(parts, k=9)) for _ in range(300))]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    text = "one document <|endoftext|> another"
    row = packing.pack(spark.createDataFrame([(1, text)], "doc_id int, text string"), BPE, with_ids=True).first()
    assert row.ids == [*library.encode(text, add_special_tokens=False).ids, 0] and 50256 in row.ids


@pytest.mark.parametrize("run", [" " * 12_000, "\n" * 12_000, "\t " * 6_000, " \u3000\x85\xa0" * 3_000, " " * 9_999 + "\x1c" * 5, "\x1c" * 12_000, "\u2028" * 11_000])
def test_long_runs_have_the_library_s_ids(run):
    library, own = Tokenizer.from_file(BPE), Encoder.shared(BPE, added=True)
    texts = [a + run + b for a in ("", "x", "x!", "1 ") for b in ("", "y", "'s", "!", "7", "\x1c", "<|endoftext|>")]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_very_long_run_of_spaces_has_ids():
    ids = Encoder.shared(BPE, added=True).encode(["a" + " " * 1_000_000 + "b"])[0]
    assert Encoder.shared(BPE).encode(["a" + " " * 1_000_000 + "b"])[0] == ids and len(ids) > 0
