"""N-gram Jaccard self-join by PartEnum signatures, and the classes of linked documents.

A set's features are hashes of its word shingles. Bands of set sizes overlap so that two sets of similar size share one
band; a band bounds the symmetric difference k of similar sets. Its feature domain is cut into groups of partitions,
and in each group every subset of partitions that leaves out as many as may differ is a signature. By the pigeonhole
two similar sets agree on a whole subset in at least `SPARE` groups:

* small bands have one group of k + 5 partitions, and all subsets that leave out k of them;
* larger ones have k // 2 + spare groups of three partitions, and subsets that leave out one. At most k // 2 groups can
  differ in two partitions, so `spare` groups agree. A set with fewer than `spare` groups in which a subset is empty
  has no signature for its empty subsets: two similar sets agree on a subset that isn't empty unless both have `spare`
  such groups, and then both have all signatures. So no pair is lost, and nothing piles up on the empty subset.

Sets that share a signature are candidates. Parity sketches (two bits or more a feature), whose Hamming distance is never
more than the symmetric difference, reject nearly all that aren't similar; the rest are compared in full.
Candidates are first only pairs of a signature's smallest member with the others; classes are formed; what shares a signature
but no class yet is tried with other leaders, and at last all pairs of different classes. Pairs within a class are never made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import numbered_columns, released, slices, table, text_or_empty, written
from tessera.llm.words import SLICE_BYTES, U64, hashed, mix

#: Words of a shingle, and the least similarity in percent.
WORDS, PERCENT = 5, 80
#: Bands whose difference bound is at most this have one group.
SMALL = 3
#: Groups of a block of columns that is compared together.
BLOCK_GROUPS = 16
#: Sets of a signature that are compared with as many others at a time, and sets of a bucket of which all pairs are one task's.
PAIR_BLOCK, BLOCK_SETS = 512, 2048
#: Sets up to which a bucket has a block of groups; beyond, each column of signatures is cut by their values into buckets of as many.
BUCKET_SETS = 4_000_000
#: Rows whose sets a task makes at a time, and bytes of signatures that it pools before they leave it.
BATCH_ROWS, POOL_BYTES = 1024, 8 << 20
#: Rounds with other leaders before all pairs of different classes.
LEADERS = 2


def shingles(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """The set of hashed shingles of each text, sorted: of `words` words, or all of a shorter text's words as one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    for part in slices(sizes, SLICE_BYTES):
        all_words, counts = hashed(texts[part])
        factors = mix(np.arange(1, words + 1, dtype=U64)) | U64(1)
        n = max(0, len(all_words) - words + 1)
        rolled = np.zeros(n, U64)
        for i in range(words):
            rolled += all_words[i : i + n] * factors[i]
        rolled = mix(rolled)
        at = 0
        for count in counts:
            if count >= words:
                yield np.unique(rolled[at : at + count - words + 1])
            elif count:
                yield mix(np.array([(all_words[at : at + count] * factors[:count]).sum() + U64(count)], U64))
            else:
                yield np.empty(0, U64)
            at += count


class Bands:
    """The bands of set sizes for a similarity, and how the features of each are cut."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.percent = percent
        self.first: list[int] = [1]
        self.last: list[int] = []

    def _grow(self, size: int) -> None:
        while not self.last or self.first[-1] <= size:
            low = self.first[-1]
            following = max(low + 1, -(-low * 100 // self.percent))
            self.last.append(following - 1)
            self.first.append(following)

    def of(self, size: int) -> list[int]:
        """The bands in which a set of this size can meet similar ones."""
        self._grow(size)
        own = next(i for i in range(len(self.last) - 1, -1, -1) if self.first[i] <= size)
        out = []
        while own >= 0 and size * self.percent <= self.last[own] * 100:
            out.append(own)
            own -= 1
        return out

    def difference(self, band: int) -> int:
        """The largest symmetric difference of similar sets of which the smaller is in this band."""
        small = self.last[band]
        large = small * 100 // self.percent
        return (small + large) * (100 - self.percent) // (100 + self.percent)

    def groups(self, band: int) -> tuple[int, int, int, int]:
        """Groups, partitions of each, partitions left out, and groups that agree at least (spare)."""
        k = self.difference(band)
        if k <= SMALL:
            return 1, k + 5, k, 1
        half = k // 2
        spare = 2 + half // 7
        return half + spare, 3, 1, spare


_SUBSETS = {}


def _subsets(partitions: int, left_out: int) -> np.ndarray:
    """0/1 rows: the partitions of each subset."""
    key = (partitions, left_out)
    if key not in _SUBSETS:
        rows = list(combinations(range(partitions), partitions - left_out))
        made = np.zeros((len(rows), partitions), U64)
        for i, row in enumerate(rows):
            made[i, list(row)] = 1
        _SUBSETS[key] = made
    return _SUBSETS[key]


def signatures(features: np.ndarray, bands: Bands) -> Iterator[tuple[int, np.ndarray]]:
    """For each band of a set: the 32-bit signatures by group (row) and subset (column); 0 where there is none."""
    for band in bands.of(len(features)):
        if not bands.difference(band):
            continue  # similar sets are equal
        groups, partitions, left_out, spare = bands.groups(band)
        mixed = mix(features + U64((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        part = (mixed % U64(groups * partitions)).astype(np.int64)
        sums = np.zeros(groups * partitions, U64)
        np.add.at(sums, part, mix(mixed))
        subsets = _subsets(partitions, left_out)
        sums = sums.reshape(groups, partitions) @ subsets.T
        counts = np.bincount(part, minlength=groups * partitions).reshape(groups, partitions) @ subsets.T.astype(np.int64)
        out = (mix(sums + U64(band)) >> U64(32)).astype(np.uint32)
        out[out == 0] = 1
        empty = counts == 0
        if groups > 1 and empty.any(1).sum() < spare:
            out[empty] = 0
        yield band, out


def sketch(features: np.ndarray) -> np.ndarray:
    """Parities of the numbers of features in 2**i bins, at least 128 and twice as many as features, as 64-bit integers."""
    bits = max(128, 2 << int(len(features) - 1).bit_length()) if len(features) else 128
    odd = np.bincount((features >> U64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _featured(docs: DataFrame, bands: Bands, splits: int) -> DataFrame:
    """One row for each document (bucket null), and rows of signatures for each block of a band (doc_id null).

    A document: doc_id, copy (a hash of the text), n, handle and check (two hashes of the set; null for the empty one),
    parity. A row of signatures: bucket, blob (handles, then their signatures), width. With splits, a bucket has one
    column's signatures of one remainder.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, copy bigint, n bigint, handle bigint, check bigint, parity array<bigint>, bucket bigint, width int, blob binary"
    names = ["doc_id", "copy", "n", "handle", "check", "parity", "bucket", "width", "blob"]

    def emit(pool: dict, of: pa.DataType) -> pa.RecordBatch:
        buckets, widths, blobs = [], [], []
        for (band, block), (handles, rows) in pool.items():
            owner, matrix = np.array(handles, U64), np.stack(rows)
            if splits == 1:
                parts = [(band << 40 | block << 20, owner, matrix)]
            else:
                columns = np.argsort(matrix % np.uint32(splits), axis=0, kind="stable")
                parts = []
                for c in range(matrix.shape[1]):
                    values = matrix[columns[:, c], c]
                    edges = np.flatnonzero(np.diff(values % np.uint32(splits), prepend=np.uint32(splits)))
                    for start, end in zip(edges, [*edges[1:], len(values)], strict=True):
                        own = columns[start:end, c]
                        number = (((band << 14 | block) << 7 | c) * splits) + int(values[start] % splits)
                        parts.append((number, owner[own], matrix[own, c : c + 1]))
            for number, own, signatures_ in parts:
                there = signatures_.any(1)
                if there.any():
                    buckets.append(number)
                    widths.append(signatures_.shape[1])
                    blobs.append(own[there].tobytes() + signatures_[there].tobytes())
        n = len(buckets)
        none = [pa.nulls(n, t) for t in (of, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*none, pa.array(buckets, pa.int64()), pa.array(widths, pa.int32()), pa.array(blobs, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: dict = {}
        held, of = 0, pa.null()
        for batch in (whole.slice(at, BATCH_ROWS) for whole in batches for at in range(0, len(whole), BATCH_ROWS)):
            of = batch.schema.field(0).type
            texts = [x.as_buffer().to_pybytes() for x in batch.column(2)]
            n, handles, checks, parities = [], [], [], []
            seen = set()
            for features in shingles(texts):
                n.append(len(features))
                if not len(features):
                    handles.append(None)
                    checks.append(None)
                    parities.append(None)
                    continue
                handle = int((mix(features).sum() + U64(len(features))).view(np.int64))
                handles.append(handle)
                checks.append(int(mix(features ^ U64(0x5851F42D4C957F2D)).sum().view(np.int64)))
                parities.append(sketch(features))
                if handle in seen:
                    continue  # an equal set of this batch has the signatures
                seen.add(handle)
                for band, out in signatures(features, bands):
                    for block in range(0, len(out), BLOCK_GROUPS):
                        own, rows = pool.setdefault((band, block // BLOCK_GROUPS), ([], []))
                        own.append(np.int64(handle).view(U64))
                        rows.append(out[block : block + BLOCK_GROUPS].ravel())
                    held += out.nbytes
            ends = np.cumsum([0, *(0 if p is None else len(p) for p in parities)], dtype=np.int32)
            flat = [p for p in parities if p is not None]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)))
            rows_ = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(handles, pa.int64()), pa.array(checks, pa.int64()), lists, pa.nulls(rows_, pa.int64()), pa.nulls(rows_, pa.int32()), pa.nulls(rows_, pa.binary())],
                names=names,
            )
            if held > POOL_BYTES:
                yield emit(pool, of)
                pool, held = {}, 0
        if pool:
            yield emit(pool, of)
        pool = {}
        released()

    return docs.select("doc_id", F.xxhash64("text").alias("copy"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _named(bucket: int, column: int, value: int) -> int:
    """A signature's 64-bit id: bucket, column and value mixed one after the other, as sums of them would meet."""
    out = np.array([bucket], np.int64).view(U64)
    for part in (column, value):
        out = mix(out) + U64(part + 1)
    return int(mix(out)[0].view(np.int64))


def _met(featured: DataFrame) -> DataFrame:
    """Members of the signatures that two sets or more have: bucket, signature, handle, leader (the smallest handle).

    A group is the blobs of one block of a band (or of a part of its signatures): a bounded number of columns, and as
    many parts as keep a group small. Signatures of a group that have the same members are told once.
    """

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        width = int(group["width"].iloc[0])
        handles, matrices = [], []
        for blob in group["blob"]:
            n = len(blob) // (8 + 4 * width)
            handles.append(np.frombuffer(blob, U64, n))
            matrices.append(np.frombuffer(blob, np.uint32, n * width, 8 * n).reshape(n, width))
        owner, first = np.unique(np.concatenate(handles), return_index=True)
        matrix = np.concatenate(matrices)[first]
        told: dict[bytes, tuple[int, np.ndarray]] = {}
        for column in range(width):
            values = matrix[:, column]
            order = np.argsort(values, kind="stable")
            ordered = values[order]
            starts = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] ^ np.uint32(1)))
            sizes = np.diff(starts, append=len(ordered))
            for s, n in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
                if ordered[s]:
                    own = owner[order[s : s + n]]
                    told.setdefault(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), (_named(int(group["bucket"].iloc[0]), column, int(ordered[s])), own))
        if not told:
            return pd.DataFrame({"bucket": [], "signature": [], "handle": [], "leader": []}, dtype=np.int64)
        del matrix, matrices, handles
        kept = list(told.values())
        sizes = [len(own) for _, own in kept]
        members = np.concatenate([own for _, own in kept]).view(np.int64)
        leaders = [own.view(np.int64).min() for _, own in kept]
        return pd.DataFrame({"bucket": group["bucket"].iloc[0], "signature": np.repeat([s for s, _ in kept], sizes), "handle": members, "leader": np.repeat(leaders, sizes)})

    blobs = featured.where(F.col("bucket").isNotNull()).select("bucket", "width", "blob")
    return blobs.groupBy("bucket").applyInPandas(meet, "bucket long, signature long, handle long, leader long")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """u, v: pairs of sets that share a signature but no class, and whose sizes and sketches allow the similarity.

    members: bucket, signature, handle, label, n, parity. The sets of a bucket of signatures (as in _met) are cut into blocks
    of BLOCK_SETS, and a group is two of its blocks, so that a pair that shares many signatures of the bucket is told once
    and no bucket, however many sets it has, is one task's.
    """

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        handles, labels, sizes, block = (group[c].to_numpy() for c in ("handle", "label", "n", "block"))
        alone = group["i"].iloc[0] == group["j"].iloc[0]
        sketches = [np.asarray(x) for x in group["parity"]]
        length = min(map(len, sketches))
        folded = np.stack([np.bitwise_xor.reduce(x.reshape(-1, length), axis=0) for x in sketches]).view(U64)
        flat = np.concatenate([np.asarray(x) for x in group["signatures"]])
        own = np.repeat(np.arange(len(handles)), group["signatures"].map(len))
        order = np.argsort(flat, kind="stable")
        edges = [*np.flatnonzero(np.diff(flat[order], prepend=flat[order][0] - 1)), len(flat)]
        found = []
        for begin, end in zip(edges, edges[1:], strict=False):
            mine = np.unique(own[order[begin:end]])
            left, right = (mine, mine) if alone else (mine[block[mine] == group["i"].iloc[0]], mine[block[mine] == group["j"].iloc[0]])
            for x in range(0, len(left), PAIR_BLOCK):
                for y in range(x if alone else 0, len(right), PAIR_BLOCK):
                    a, b = left[x : x + PAIR_BLOCK, None], right[None, y : y + PAIR_BLOCK]
                    n, m = sizes[a], sizes[b]
                    p, q = np.nonzero((labels[a] != labels[b]) & ((a < b) | (not alone)) & (n * percent <= m * 100) & (m * percent <= n * 100))
                    a, b = a[p, 0], b[0, q]
                    distance = np.concatenate([np.bitwise_count(folded[a[k : k + 4096]] ^ folded[b[k : k + 4096]]).sum(1, dtype=np.int64) for k in range(0, len(a), 4096)] or [np.empty(0, np.int64)])
                    near = distance * (100 + percent) <= (sizes[a] + sizes[b]) * (100 - percent)
                    found.append(a[near].astype(np.int64) << 32 | b[near])
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        u, v = handles[pairs >> 32], handles[pairs & 0xFFFFFFFF]
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    sets = members.groupBy("bucket", "handle").agg(F.collect_list("signature").alias("signatures"), *[F.first(c).alias(c) for c in ("label", "n", "parity")])
    blocks = members.groupBy("bucket", "handle").count().groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"))
    cut = sets.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("handle"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return dealt.drop("other", "blocks").groupBy("bucket", "i", "j").applyInPandas(compare, "u long, v long")


def _distance(a: Column, b: Column) -> Column:
    """The Hamming distance of two sketches; the longer is folded to the other's size (sizes of similar sets are within a factor of two)."""

    def folded(x: Column, size: Column) -> Column:
        half = F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > size, half).otherwise(x)

    size = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(folded(a, size), folded(b, size), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, x: total + x)


def _may_link(percent: int) -> Column:
    """Of sets a and b: sizes and sketches allow the similarity."""
    n, m = F.col("a.n"), F.col("b.n")
    sizes = (n * percent <= m * 100) & (m * percent <= n * 100)
    return sizes & (_distance(F.col("a.parity"), F.col("b.parity")) * (100 + percent) <= (n + m) * (100 - percent))


def _linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v: handles of sets) whose sets, made again from the texts, are similar."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            sizes = batch["u_text"].map(len).to_numpy() + batch["v_text"].map(len).to_numpy()
            for part in slices(sizes, 4 * SLICE_BYTES):
                own = batch.iloc[part]
                both = [*own["u_text"], *own["v_text"]]
                distinct = {t: i for i, t in enumerate(dict.fromkeys(both))}
                sets = list(shingles(list(distinct)))
                for u, v, a, b in zip(own["u"], own["v"], own["u_text"], own["v_text"], strict=True):
                    x, y = sets[distinct[a]], sets[distinct[b]]
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * same >= percent * (len(x) + len(y) - same):
                        kept.append((u, v))
            yield pd.DataFrame(kept, columns=["u", "v"])
        released()

    of = lambda side: texts.select(F.col("handle").alias(side), F.col("text").alias(f"{side}_text"))
    return pairs.join(of("u"), "u").join(of("v"), "v").mapInPandas(compare, "u long, v long")


def components(links: DataFrame, name: str = "classes") -> DataFrame:
    """node, label (the smallest node of its class) of every node of the links (u, v), by label exchange and pointer jumps.

    Each round is a bounded number of joins on written tables, until nothing changes.
    """
    both = written(links.select("u", "v").union(links.select("v", "u")).distinct(), f"{name}-links")
    labels = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("other")), "v").groupBy(F.col("u").alias("node")).agg(F.min("other").alias("other"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "other").alias("fresh"))
        jump = hooked.select(F.col("node").alias("fresh"), F.col("fresh").alias("next"))
        jumped = hooked.join(jump, "fresh", "left").select("node", F.col("label").alias("old"), F.least("fresh", F.coalesce("next", "fresh")).alias("label"))
        labels = written(jumped, name)
        if labels.where(F.col("old") != F.col("label")).isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The class of linked documents of every row: doc_id, n_shingles, component_id, class_id, copy.

    Documents link when their sets of 5-word shingles (A-Z lowered; all words as one if there are fewer) have a Jaccard
    similarity of percent / 100 or more. component_id is the smallest key reachable by links; class_id (null for empty sets)
    tells classes apart even where keys repeat, and copy is a hash of the text. Sets are compared as 64-bit hashes of
    shingles, and equal sets known by two 64-bit hashes of theirs; one text stands for those of one set. A null or empty
    text has no shingle and links with nothing, so that it has its own key; null keys are never the smallest unless all
    of a class are null; repeated rows are all returned; an empty table gives no rows; other columns are ignored.
    """
    bands = Bands(percent)
    source = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    splits = -(-max(1, source.count()) // BUCKET_SETS)
    featured = written(_featured(source, bands, splits), "features")
    rows = featured.where(F.col("bucket").isNull()).select("doc_id", "copy", "n", "handle", "check", "parity")
    # one row for each distinct set: its smallest key, and the text that stands for it
    sets = (
        rows.where("handle IS NOT NULL")
        .groupBy("handle", "check", "n")
        .agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "copy")).alias("first"), F.first("parity").alias("parity"))
        .select("handle", "check", "n", "parity", F.col("first.doc_id").alias("least"), F.col("first.copy").alias("of"))
    )
    sets = written(sets, "sets")
    # different sets of one handle: all but one of them get another, and what their handle shares with others goes for each
    twins = sets.groupBy("handle").agg(F.min("check").alias("kept"), F.max("check").alias("other")).where("kept <> other").select("handle", "kept")
    if not twins.isEmpty():
        renamed = sets.join(twins, "handle").select("handle", "check", F.when(F.col("check") == F.col("kept"), F.col("handle")).otherwise(F.xxhash64("handle", "check")).alias("own"))
        renamed = written(renamed, "twins")
        met = _met(featured).join(renamed.select("handle", "own"), "handle", "left")
        met = written(met.select("bucket", "signature", F.coalesce("own", "handle").alias("handle"), "leader"), "met")
        named = lambda df: df.join(renamed, ["handle", "check"], "left").withColumn("handle", F.coalesce("own", "handle")).drop("own")
        rows, sets = named(rows), written(named(sets), "sets")
    else:
        met = written(_met(featured), "met")
    wanted = sets.join(met.select("handle").distinct(), "handle").select("handle", "least", "of")
    texts = source.withColumn("copy", F.xxhash64("text")).join(wanted, (F.col("copy") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least")))
    texts = written(texts.groupBy("handle").agg(F.first("text").alias("text")).select("handle", F.col("text").cast("binary").alias("text")), "texts")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    one, other = sets.select("handle", "n", "parity").alias("a"), sets.select("handle", "n", "parity").alias("b")

    def checked(pairs: DataFrame) -> DataFrame:
        fit = pairs.join(one, F.col("u") == F.col("a.handle")).join(other, (F.col("v") == F.col("b.handle")) & _may_link(percent)).select("u", "v")
        return _linked(fit, texts, percent)

    tried = written(ordered(met.select(F.col("handle").alias("u"), F.col("leader").alias("v"))), "tried")
    links = written(checked(tried), "links")
    for i in range(LEADERS + 1):
        classes = components(links)
        classed = met.select("bucket", "signature", "handle").join(classes.withColumnRenamed("node", "handle"), "handle", "left").withColumn("label", F.coalesce("label", "handle"))
        open_ = classed.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") != F.col("high")).select("signature")
        # signatures with the same members (by 128 bits and their number) are one
        sums = [F.sum(F.xxhash64(F.lit(x), "handle").cast("decimal(20,0)")).alias(x) for x in ("one", "two")]
        members = classed.join(open_, "signature").groupBy("signature").agg(F.count("*").alias("n"), *sums)
        once = members.groupBy("n", "one", "two").agg(F.min("signature").alias("signature")).select("signature")
        left = written(classed.join(once, "signature").select("bucket", "signature", "handle", "label"), "open")
        if i < LEADERS:
            lead = left.groupBy("signature").agg(F.min_by(F.struct("handle", "label"), F.xxhash64("handle", F.lit(i))).alias("lead"))
            fresh = left.join(lead, "signature").where(F.col("label") != F.col("lead.label")).select(F.col("handle").alias("u"), F.col("lead.handle").alias("v"))
            fresh = written(ordered(fresh).join(tried, ["u", "v"], "left_anti"), "fresh")
            tried = tried.unionByName(fresh)
            links = written(links.unionByName(checked(fresh)), "links")
        else:
            fresh = _across(left.join(sets.select("handle", "n", "parity"), "handle"), percent)
            fresh = ordered(fresh).join(tried, ["u", "v"], "left_anti")
            links = written(links.unionByName(_linked(fresh, texts, percent)), "links")
    classes = components(links)
    classed = sets.select("handle", "least").join(classes.withColumnRenamed("node", "handle"), "handle", "left").withColumn("label", F.coalesce("label", "handle"))
    least = classed.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = classed.join(least, "label").select("handle", "component_id", F.col("label").alias("class_id"))
    found = rows.where("handle IS NOT NULL").join(ids, "handle").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id", "copy")
    empty = rows.where("handle IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("class_id"), "copy")
    return found.unionByName(empty)


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs of which one stands for each class of near_duplicates, with the columns of docs.

    Of a class, the row with the smallest key stays (null keys last), of different texts with that key the one with the
    smallest hash, and of rows that repeat both, one. Rows without words are in no class and all stay, repeated ones too; whatever the
    names of the columns are, none is changed; an empty table gives no rows.
    """
    own = numbered_columns(docs)
    of = dict(zip(docs.columns, own.columns, strict=True))
    classes = written(near_duplicates(own, of[key], of[text], percent).where("class_id IS NOT NULL").select("doc_id", "class_id", "copy"), "classed")
    row = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "copy")
    best = classes.groupBy("class_id").agg(F.min(row).alias("best"))
    counted = classes.groupBy("class_id", "doc_id", "copy").agg(F.count("*").alias("n")).join(best, "class_id").withColumn("stays", row == F.col("best"))
    counted = written(counted.where("NOT stays OR n > 1").select(F.col("doc_id").alias("key"), F.col("copy").alias("of_copy"), "stays"), "decided")
    hashed_ = own.withColumn("copy", F.xxhash64(text_or_empty(of[text])))
    same = F.col(of[key]).eqNullSafe(F.col("key")) & (F.col("copy") == F.col("of_copy"))
    left = hashed_.join(counted.where("NOT stays"), same, "left_anti")
    again = counted.where("stays")
    if not again.isEmpty():
        once = left.join(again, same, "left_semi").dropDuplicates([of[key], "copy"])
        left = left.join(again, same, "left_anti").unionByName(once)
    return left.select(*own.columns).toDF(*docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of near-duplicates of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
