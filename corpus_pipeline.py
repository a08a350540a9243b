"""A corpus pipeline of five stages, each of which takes the documents that the one before it kept.

toxicity drops documents that the lexicon rejects; exact_dedup keeps one of each group of equal texts; near_dups keeps one of
each class of linked documents; secrets masks the secrets found; packing puts what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import numbered_columns, table, text_or_empty, written
from tessera.llm.exact_dedup import deduplicated
from tessera.llm.jaccard_join import representatives
from tessera.llm.packing import pack
from tessera.llm.secrets import redacted, scan
from tessera.llm.toxicity import learn, scored

#: A document with this toxicity is rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the threshold, by a lexicon learned from labels of three quarters of the ids.

    Null and empty texts have no term and stay, as do null ids and repeated rows; whole texts are read; without labelled
    rows of both kinds nothing is toxic and all stay; an empty table stays empty.
    """
    own = numbered_columns(docs)
    key, text = (own.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    quarter = F.crc32(F.col("doc_id").cast("string")) % 4
    labels = table(spark, sf_dir, "labels").where(quarter != 2).select(F.col("doc_id").alias(key), "toxic")
    lexicon = learn(own, labels, key, text)
    return scored(own, lexicon, text).where(F.col("toxicity") < TOXIC).select(*own.columns).toDF(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest id (null ids last).

    Null, empty and blank texts are equal; of repeated rows one stays; an empty table stays empty.
    """
    return deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents: the smallest id (null ids last), then the smallest hash of the text.

    Only that row of an id goes or stays whose text is in the class: other texts with the same id are in classes of
    their own. Null and empty texts are in no class and stay; of repeated rows with words one stays; an empty table stays empty.
    """
    return representatives(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked and n_chars set to the new length.

    Null, empty and clean texts stay as they are; ids, repeated rows and other columns are kept; an empty table stays empty.
    """
    own = numbered_columns(docs)
    text = own.columns[docs.columns.index("text")]
    found, some = scan(own, text), F.size("secrets") > 0
    clean = {text: F.when(some, redacted(text_or_empty(text), F.col("secrets"))).otherwise(F.col(text))}
    out = found.withColumns(clean)
    if "n_chars" in docs.columns:
        size = own.columns[docs.columns.index("n_chars")]
        out = out.withColumn(size, F.when(some, F.char_length(text).cast(own.schema[size].dataType)).otherwise(F.col(size)))
    return out.select(*own.columns).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens.

    Null and empty texts have one token; longer ones than a sequence are cut whole; null ids and repeated rows have pieces like
    others; an empty table gives none.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dups", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: The lexicon, the randomness tests and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
