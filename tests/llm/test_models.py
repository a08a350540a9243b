"""Toxicity on held-out rows, the language model and the Jaccard classes by brute force, and the pipeline."""

from __future__ import annotations

import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import jaccard_join, lm, secrets, toxicity

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_folding():
    assert toxicity.fold("Ѕtup1d 5CUM ＴＲＡＳＨ mo​ron") == "stupid scum trash moron"


def test_lexicon_matches_words_stems_and_exceptions():
    lexicon = toxicity.Lexicon({"trash": 5.0}, {"idio": 4.0}, ("trash can",))
    hits = lambda t: [(s, w) for s, _, w in lexicon.hits(toxicity.fold(t))]
    assert hits("such tr4sh!") == [(5, 5.0)] and hits("trashy") == [] and hits("the trash can is full") == [] and hits("idiotic") == [(0, 4.0)] and hits("xidiot") == []
    assert lexicon.evidence("") == 0.0 and lexicon.score("") < 0.1
    assert lexicon.score("trash") > lexicon.score("trash " + "fine words here " * 400)


def test_hits_are_those_of_a_plain_scan():
    """Every word and every phrase is looked for by itself, on random texts of few letters."""
    rng = random.Random(9)
    terms = ["".join(rng.choices("abc", k=rng.randrange(2, 5))) for _ in range(12)]
    lexicon = toxicity.Lexicon({t: 1.0 + i for i, t in enumerate(terms[:6])}, {t: 1.5 + i for i, t in enumerate(terms[6:])}, tuple(f"{a} {b}" for a, b in zip(terms, terms[1:], strict=False)))
    for _ in range(400):
        text = toxicity.fold("".join(rng.choices("abc  1", k=rng.randrange(60))))
        spots = [m.span() for m in re.finditer(r"[^\W\d_]+", text)]
        phrases = [(s, s + len(p)) for p in lexicon.exceptions for s in range(len(text)) if text.startswith(p, s) and not text[s - 1 : s].isalpha() * bool(s) and not text[s + len(p) : s + len(p) + 1].isalpha()]
        wanted = []
        for s, e in spots:
            word = text[s:e]
            fits = [(w, s + len(t)) for t, w in lexicon.words.items() if t == word] + [(w, s + len(t)) for t, w in lexicon.stems.items() if word.startswith(t)]
            if fits and not any(a <= s and max(fits)[1] <= b for a, b in phrases):
                wanted.append((s, max(fits)[1], max(fits)[0]))
        assert lexicon.hits(text) == wanted


def test_hits_are_linear_in_the_phrases():
    import time

    lexicon = toxicity.Lexicon({"trash": 5.0}, {}, ("trash can",))
    began = time.perf_counter()
    assert len(lexicon.hits("trash can and trash " * 32_000)) == 32_000 and time.perf_counter() - began < 5


def test_toxicity_is_learned_and_held_out(spark, odd, none):
    rng = random.Random(1)
    plain = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    rows = []
    for i in range(600):
        text = rng.choices(plain, k=30)
        if i % 6 == 0:
            text[rng.randrange(30)] = rng.choice(("blorgly", "zaxwort", "quimmo"))
        elif i % 24 == 1:
            text[3:5] = ["blorgly", "bridge"]
        rows.append((i, " ".join(text), int(i % 6 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = toxicity.learn(df.where("doc_id < 450").select("doc_id", "text"), df.select("doc_id", "toxic").where("doc_id < 450"))
    found = toxicity.scored(df, lexicon).where("doc_id >= 450").collect()
    right = sum((r.toxicity >= 0.3) == bool(r.toxic) for r in found)
    assert right >= 0.95 * len(found), lexicon
    assert any("bridge" in e for e in lexicon.exceptions)
    assert toxicity.scored(odd, lexicon).count() == odd.count() and toxicity.scored(none, lexicon).count() == 0
    empty = toxicity.learn(none.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert toxicity.scored(odd, empty).agg(F.max("toxicity")).first()[0] < 0.1


def test_lm_base_scores_and_odd_rows(odd, none):
    train = F.col("doc_id").isNotNull() & (F.col("doc_id") != 8)
    rows = lm.scored(odd, train).collect()
    docs = [(r.doc_id, [*words(r.text), "\0"]) for r in odd.collect()]
    counts = Counter(w for i, ws in docs if i is not None and i != 8 for w in ws)
    n, v = sum(counts.values()), len(counts)
    wanted = sorted((i is None, i or 0, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in docs)
    assert wanted == sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows)
    assert all(r.score < 0 for r in rows) and lm.scored(none, train).count() == 0


def test_lm_helps_on_held_out_rows(spark, documents):
    df = spark.createDataFrame(list(documents.items()), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in lm.scored(df, F.col("doc_id") % 5 != 0).collect()}
    held = [r for i, r in rows.items() if i % 5 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_are_those_of_plain_expectation_maximisation():
    bins, b = [(3, 0.0, 0.5, 0.1, 10.0), (3, 0.0, 0.0, 0.2, 5.0), (1, 0.0, 0.0, 0.01, 3.0), (27, 0.5, 0.25, 0.1, 4.0), (27, 0.0, 0.1, 0.3, 2.0)], lm.FREQUENCIES
    weights = lm.weights_of(bins, 0.001)
    assert np.allclose(weights.sum(1), 1) and (weights[:b, 0] == 0).all() and weights[0, 1] == 0
    mixed = [0.3, 0.3, 0.3, 0.1]
    for _ in range(lm.ROUNDS):
        got = [0.0] * 4
        for _, *p, n in (r for r in bins if r[0] == 27):
            parts = [m * x for m, x in zip(mixed, [*p, 0.001], strict=True)]
            got = [g + n * x / sum(parts) for g, x in zip(got, parts, strict=True)]
        got = [max(g / 6, 1e-6) for g in got]
        mixed = [g / sum(got) for g in got]
    assert np.allclose(weights[27], mixed)


@pytest.mark.parametrize("chunk_bytes", [2_000, 6 << 20])
def test_lm_scores_by_brute_force(spark, documents, monkeypatch, chunk_bytes):
    """Counts, estimates, buckets and mixture in plain Python; and a context's words have probabilities that sum to 1."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 50_000)
    docs = dict(list(documents.items())[:60])
    docs[10**6] = docs[min(docs)]
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3)
    rows = {r.doc_id: r for r in lm.scored(df, F.col("doc_id") % 5 != 0).collect()}
    held = {r.doc_id for r in df.where((F.pmod(F.xxhash64("doc_id", "text"), F.lit(lm.HELD)) == 0) & (F.col("doc_id") % 5 != 0)).collect()}
    own = {i: [*words(t), "\0"] for i, t in docs.items()}

    def grams(ws):
        return [(u, v, w) for u, v, w in zip(["^", "\0", *ws], ["\0", *ws], ws, strict=False)]

    def model(ids):
        word, pair, triple = Counter(), Counter(), Counter()
        for i in ids:
            for u, v, w in grams(own[i]):
                word[w] += 1
                pair[v, w] += 1
                triple[u, v, w] += 1
        return word, pair, triple, sum(word.values())

    def estimates(m, u, v, w):
        word, pair, triple, total = m
        context = word[v]
        history = word["\0"] if u == "^" else pair[u, v]
        level = lambda n: min(1 + int(math.log2(n)), lm.FREQUENCIES - 1)
        bucket = lm.FREQUENCIES + level(history) if history else level(context) if context else 0
        return bucket, (triple[u, v, w] / max(history, 1), pair[v, w] / max(context, 1), word[w] / total)

    trained = [i for i in docs if i % 5]
    fit, full = model([i for i in trained if i not in held]), model(trained)
    bins = defaultdict(lambda: [0, 0.0, 0.0, 0.0])
    for i in held:
        for gram in grams(own[i]):
            bucket, p = estimates(fit, *gram)
            into = bins[(bucket, *(1 + min(lm.LOW_BINS, max(0, int(np.rint(-np.log2(x))))) if x else 0 for x in p))]
            into[0] += 1
            for k, x in enumerate(p):
                into[k + 1] += x
    assert held and bins
    weights = lm.weights_of([(k[0], v[1] / v[0], v[2] / v[0], v[3] / v[0], v[0]) for k, v in sorted(bins.items())], 1 / (len(fit[0]) + 1))
    probability = lambda *gram: (lambda b, p: sum(x * y for x, y in zip(weights[b], (*p, 1 / (len(full[0]) + 1)), strict=True)))(*estimates(full, *gram))
    for i, ws in own.items():
        assert rows[i].score == pytest.approx(sum(math.log10(probability(*g)) for g in grams(ws)), rel=1e-6, abs=1e-6)
    for u, v in [("^", "\0"), *list(full[1])[:20], ("never", "seen"), ("never", own[min(own)][0])]:
        if v != "\0" or u == "^":
            assert sum(probability(u, v, w) for w in [*full[0], "never seen"]) == pytest.approx(1)


def classes(docs):
    sets = {}
    for i, t in docs.items():
        w = words(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    shared = Counter((a, b) for own in having.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in docs}


def test_classes_by_brute_force(spark):
    """Families of edited texts of many sizes, so that pairs stand on both sides of the threshold."""
    rng, docs = random.Random(2), {}
    for size in (3, 5, 6, 8, 9, 12, 15, 20, 26, 40, 70, 120, 300, 700):
        for _ in range(4):
            seed = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for _ in range(5):
                own = list(seed)
                for _ in range(rng.randrange(0, 2 + size // 40)):
                    own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
                docs[len(docs) * 3 + 1] = " ".join(own[: len(own) - rng.randrange(0, 1 + size // 9)])
    wanted = classes(docs)
    rows = jaccard_join.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == wanted
    assert len({c for _, c in wanted.values()}) < len(docs)


def test_no_similar_pair_is_without_a_signature():
    """Sets at the bound of the difference share a signature, for sizes of all kinds of bands."""
    rng, bands = np.random.default_rng(4), jaccard_join.Bands()
    for size in (4, 5, 9, 14, 20, 33, 64, 100, 333, 1000):
        for _ in range(15):
            a = rng.integers(1, 2**63, size).astype(np.uint64)
            keep = max(1, math.ceil(0.8 * size))
            b = np.unique(a[:keep])
            while len(np.union1d(a, c := np.append(b, rng.integers(1, 2**63, 1).astype(np.uint64)))) * 80 <= 100 * len(np.intersect1d(a, c)):
                b = c
            if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)) or len(np.union1d(a, b)) == len(b) == len(a):
                continue
            mine, theirs = ({(band, g, s): x for band, m in jaccard_join.signatures(np.unique(x_), bands) for (g, s), x in np.ndenumerate(m) if x} for x_ in (a, b))
            assert any(theirs.get(k) == v for k, v in mine.items()), size


def test_classes_of_odd_rows(odd, none):
    rows = jaccard_join.near_duplicates(odd).collect()
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == odd.count()
    assert {(1, 6, 1), (2, 6, 1), (3, 6, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (8, 1, 8), (9, 1, 8)} <= found
    assert jaccard_join.near_duplicates(none).count() == 0


def rows_that_stay(rows):
    """Indices of one row of each class of texts with words (the smallest id, null ids last), and of all without words."""
    linked = classes({i: t for i, (_, t) in enumerate(rows)})
    by = defaultdict(list)
    for i, (n, c) in linked.items():
        by[c if n else ("none", i)].append(i)
    return list(by.values())


def test_one_row_of_each_class_stays(spark):
    """Ids that repeat with other texts, rows that repeat, null ids and texts, and columns with the operator's own names."""
    words_ = [f"w{i}" for i in range(40)]
    near = [*words_[:39], "other"]
    rows = [
        (1, " ".join(words_)), (7, " ".join(near)), (7, "a text of its own with quite other words"), (7, "a text of its own with quite other words"),
        (3, "b text of its own with few words"), (3, "B text of its own\twith few words"), (None, " ".join(words_)), (None, "null id with words of its own here"), (None, None), (8, ""), (8, ""), (9, "one"),
    ]
    df = spark.createDataFrame([(i, t, "mine", "mine") for i, t in rows], "doc_id bigint, text string, class_id string, copy string").repartition(3)
    left = jaccard_join.representatives(df)
    assert left.columns == df.columns
    found = Counter((r.doc_id, r.text) for r in left.collect())
    groups = rows_that_stay(rows)
    assert sum(found.values()) == len(groups)
    for own in groups:
        least = min((rows[i][0] is None, rows[i][0] or 0) for i in own)
        texts = {rows[i] for i in own if (rows[i][0] is None, rows[i][0] or 0) == least}
        assert sum(found[x] for x in texts) == (1 if words(rows[own[0]][1]) else found[rows[own[0]]])
    assert found[(7, "a text of its own with quite other words")] == 1 and found[(8, "")] == 2 and found[(1, " ".join(words_))] == 1


def test_classes_in_split_buckets_and_blocks(spark, monkeypatch):
    """Buckets cut by values and sets cut into blocks give the same classes."""
    monkeypatch.setattr(jaccard_join, "BUCKET_SETS", 40)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    test_classes_by_brute_force(spark)


def test_different_sets_of_one_handle(spark, monkeypatch):
    """Sets that share the first hash are kept apart by the second."""
    plain = jaccard_join._featured
    monkeypatch.setattr(jaccard_join, "_featured", lambda *a: plain(*a).withColumn("handle", F.when(F.col("n") == 3, F.lit(77)).otherwise(F.col("handle"))))
    texts = {1: "a b c d e f g", 2: "h i j k l m n", 5: "a b c d e f g"}
    rows = jaccard_join.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(1, 1), (2, 2), (5, 1)}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, sf_dir, odd, none, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.char_length("text").cast("bigint")})
    out = stage(spark, docs, sf_dir)
    assert out.count() > 0 and stage(spark, docs.limit(0), sf_dir).count() == 0
    if name != "packing":
        assert out.columns == docs.columns and set(out.collect()) <= set(docs.collect())


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["start"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def base_spans(text):
    """Spans that any secrets scan has: long hexadecimal strings and access keys."""
    return [m.span() for p in (r"[0-9a-f]{32,}", r"AKIA[A-Z0-9]{12,}") for m in re.finditer(p, text or "")]


def masked_by_hand(text, spans):
    out, at = [], 0
    for s, e in spans:
        out += [text[at:s], "[SECRET]"] if s >= at else []
        at = max(at, e)
    return "".join([*out, text[at:]])


def test_secrets_are_masked_as_by_hand(spark, sf_dir):
    rng = random.Random(3)
    secret = lambda: rng.choice(["AKIA" + "".join(rng.choices("ABCDEF0123456789", k=16)), "".join(rng.choices("0123456789abcdef", k=rng.randrange(32, 70))), "password: " + "".join(rng.choices("abcXYZ0189+/", k=20)), "日本 token=" + "f" * 40])
    rows = [(i, " ".join(rng.choice(["plain", "words", "ünd", secret()]) for _ in range(rng.randrange(40))), "en", "s", 0) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spans = {r.doc_id: sorted((s.start, s.end) for s in r.secrets) for r in secrets.scan(docs, "text").collect()}
    found = {r.doc_id: r for r in corpus_pipeline.mask_secrets(spark, docs, sf_dir).collect()}
    for i, text, *_ in rows:
        assert set(base_spans(text)) <= set(spans[i])
        assert found[i].text == masked_by_hand(text, spans[i]) and not base_spans(found[i].text)
        assert found[i].n_chars == (len(found[i].text) if spans[i] else 0)


def test_pipeline_stages(spark, sf_dir, stages):
    start = {r.doc_id: r for r in stages["start"]}
    kept = {r.doc_id: r for r in stages["toxicity"]}
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    marked = {r.doc_id: int(r.toxic > 0) for r in marks.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in start}
    words_, stems, exceptions = learned_by_hand([(start[i].text or "", y) for i, y in marked.items()])
    curve = toxicity.learn(spark.createDataFrame(stages["start"]), marks.where("crc32(cast(doc_id as string)) % 4 != 2")).curve
    lexicon = toxicity.Lexicon(words_, stems, tuple(exceptions), curve)
    assert kept == {i: r for i, r in start.items() if lexicon.score(r.text or "") < 0.3}
    norm = lambda t: "".join((t or "").split())
    distinct = {r.doc_id: r for r in stages["exact_dedup"]}
    assert len(distinct) == len({norm(r.text) for r in kept.values()}) == len({norm(r.text) for r in distinct.values()})
    near = {r.doc_id for r in stages["near_dups"]}
    assert near == {c for i, (n, c) in classes({i: r.text for i, r in distinct.items()}).items()}
    masked = {r.doc_id: r for r in stages["secrets"]}
    assert set(masked) == near and all(set(r.asDict()) == set(start[i].asDict()) for i, r in masked.items())
    spans = {r.doc_id: sorted((s.start, s.end) for s in r.secrets) for r in secrets.scan(spark.createDataFrame(stages["near_dups"], "doc_id bigint, text string, lang string, source string, n_chars bigint"), "text").collect()}
    for i, r in masked.items():
        assert r == start[i] if not spans[i] else (r.text == masked_by_hand(start[i].text, spans[i]) and r.n_chars == len(r.text))
        assert set(base_spans(start[i].text)) <= set(spans[i])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in stages["packing"]:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == near
    for i, own in pieces.items():
        ids, at = [*library.encode(masked[i].text or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(own, key=lambda r: r.piece):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length])))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        assert [o for o, _ in sorted(own)] == [0, *itertools.accumulate(n for _, n in sorted(own))][:-1] and sum(n for _, n in own) <= 2048


def test_run_is_the_stages(spark, sf_dir, stages):
    key = lambda rows: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(corpus_pipeline.run(spark, sf_dir).collect()) == key(stages["packing"])
    assert zlib.crc32(b"") == 0


def learned_by_hand(rows):
    """Words, stems and exceptions of (text, label) rows, by counting every word, beginning and neighbour."""

    def tests(side, other, n_side, n_other, least_z):
        if side < 4 or side * n_other <= other * n_side * 3:
            return None
        odds = lambda x, n: (x + 0.5) / (n - x + 0.5)
        weight = math.log(odds(side, n_side) / odds(other, n_other))
        z = weight / math.sqrt(sum(1 / (y + 0.5) for y in (side, other, n_side - side, n_other - other)))
        return weight if weight >= 1.5 and z >= least_z else None

    n = Counter(label for _, label in rows)
    in_rows = {}
    for text, label in rows:
        spoken = set(re.findall(r"[^\W\d_]+", toxicity.fold(text)))
        for term in {("word", w) for w in spoken if len(w) >= 3} | {("stem", w[:k]) for w in spoken for k in (4, 5, 6) if len(w) >= k}:
            in_rows.setdefault(term, Counter())[label] += 1
    weights = {t: w for t, c in in_rows.items() if (w := tests(c[1], c[0], n[1], n[0], 3.0))}
    words_, stems = ({t: w for (kind, t), w in weights.items() if kind == k} for k in ("word", "stem"))
    phrases = {}
    for text, label in rows:
        folded = toxicity.fold(text)
        spots = [m.span() for m in re.finditer(r"[^\W\d_]+", folded)]
        own = set()
        for k, (s, e) in enumerate(spots):
            if folded[s:e] in words_ or any(folded[s:e].startswith(t) for t in stems):
                if k + 1 < len(spots) and spots[k + 1][0] == e + 1 and folded[e].isspace():
                    own.add(folded[s : spots[k + 1][1]])
                if k and spots[k - 1][1] == s - 1 and folded[s - 1].isspace():
                    own.add(folded[spots[k - 1][0] : e])
        for phrase in own:
            phrases.setdefault(phrase, Counter())[label] += 1
    return words_, stems, {p for p, c in phrases.items() if tests(c[0], c[1], n[0], n[1], 1.0)}


def test_lexicon_and_curve_are_those_of_plain_counts(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 8))) for _ in range(150)]
    rows = []
    for i in range(500):
        text, label = rng.choices(plain, k=rng.randrange(5, 40)), int(i % 5 == 0)
        if label or i % 25 == 1:
            text[rng.randrange(len(text))] = rng.choice(("gr0mble", "grombles", "zaxwort", "QUIMMO", "zaxwort's"))
        if i % 6 == 1 and not label:
            text[1:3] = ["zaxwort", "bridge"] if i % 12 == 1 else ["old", "quimmo"]
        rows.append((i, " ".join(text), label))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    words_, stems, exceptions = learned_by_hand([(t, y) for _, t, y in rows])
    assert lexicon.words == pytest.approx(words_) and lexicon.stems == pytest.approx(stems) and set(lexicon.exceptions) == exceptions
    assert len(words_) >= 3 and stems and exceptions
    # the curve is where the penalised likelihood of all rows is flat
    x = np.array([math.log1p(round(lexicon.evidence(t), 2)) for _, t, _ in rows])
    y = np.array([label for *_, label in rows], float)
    design, beta = np.stack([np.ones(len(x)), x], 1), np.array(lexicon.curve)
    p = 1 / (1 + np.exp(-design @ beta))
    slope = design.T @ (y - p) - np.array([1e-3, 1e-2]) * len(rows) / 100 * beta
    assert np.abs(slope).max() < 1e-3


def test_all_terms_are_kept_however_many(spark):
    """6,000 marking words: none is left out by number."""
    toxic = [(i, " ".join(f"t{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}x" for k in range(6000)), 1) for i in range(6)]
    df = spark.createDataFrame(toxic + [(100 + i, "calm plain text", 0) for i in range(200)], "doc_id bigint, text string, toxic int")
    lexicon = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert len(lexicon.words) == 6000


def test_signatures_of_other_columns_and_buckets_have_other_ids(spark):
    """Two signatures of a bucket whose column and value add up alike, and two of neighbouring buckets, keep their members apart."""

    def blob(handles, matrix):
        return np.array(handles, np.uint64).tobytes() + np.array(matrix, np.uint32).tobytes()

    quiet = [[100 * i + c for c in range(5)] for i in range(1, 5)]
    for i, (c, v) in enumerate([(3, 1000), (3, 1000), (4, 999), (4, 999)]):
        quiet[i][c] = v
    rows = [(7, 5, blob([1, 2, 3, 4], quiet)), (8, 1, blob([5, 6], [[65_000 + 537], [65_000 + 537]])), (9, 1, blob([7, 8], [[0 + 1], [0 + 1]])), (8 + 65_537, 1, blob([5, 6, 9], [[1], [1], [1]]))]
    met = jaccard_join._met(spark.createDataFrame(rows, "bucket bigint, width int, blob binary")).collect()
    by = defaultdict(set)
    for r in met:
        by[r.signature].add(r.handle)
    assert sorted(map(sorted, by.values())) == [[1, 2], [3, 4], [5, 6], [5, 6, 9], [7, 8]]
    ids = [jaccard_join._named(b, c, v) for b in (0, 1, 65_537, -3) for c in range(40) for v in (*range(60), 65_537, 2**32 - 1)]
    assert len(set(ids)) == len(ids)


def test_pairs_across_classes_lose_no_link(spark):
    """Sets of one signature, each a class of its own: every similar pair is told, few others."""
    rng = np.random.default_rng(6)
    base = rng.integers(1, 2**63, 150).astype(np.uint64)
    sets = [np.unique(np.append(base[rng.permutation(150)[: rng.integers(115, 150)]], rng.integers(1, 2**63, rng.integers(0, 30)).astype(np.uint64))) for _ in range(60)]
    rows = [(1, 1 + i % 2, i, i, len(s), jaccard_join.sketch(s).tolist()) for i, s in enumerate(sets)]
    rows += [(1, 3, i, i, len(s), jaccard_join.sketch(s).tolist()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "bucket bigint, signature bigint, handle bigint, label bigint, n bigint, parity array<bigint>")
    told = {(r.u, r.v) for r in jaccard_join._across(df, 80).collect()}
    similar = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert similar and similar <= told and len(told) < 60 * 59 / 2
