"""A corpus pipeline of five stages over ``documents``: toxicity, exact dedup, near-duplicates, personal data, packing.

Each stage is written as Parquet in the shared folder and read again; all but the last give the columns of documents. The last gives the pieces with
their token ids, sequence and offset.

Defined cases: a null or empty text is never toxic by its words (it gets the base rate), equals all other empty texts in exact dedup, is linked with
nothing as a near copy, has no personal data and is one piece of the end token. Rows without doc_id lose ties in exact dedup, take no part in
near-duplicates and stay there; rows that share an id but not their text are documents of their own in every stage, and of fully repeated rows one
stays. An empty table gives an empty result. Extra columns of any name are carried through all stages but the last. ``labels`` of unknown documents
are not used; without labels nothing is called toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geodelta.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from geodelta.llm.common import bound_batches, cut, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    bound_batches(spark)
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the least doc_id stays."""
    bound_batches(spark)
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a Jaccard similarity of 0.8 or more over five-word shingles the one with the least doc_id stays."""
    bound_batches(spark)
    return jaccard_join.keep_one(docs, shingle=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked in the texts; n_chars follows."""
    bound_batches(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts packed into sequences of at most 1024 tokens, with the ids of each piece (binary, unsigned little-endian 32-bit)."""
    import public_tokenizers

    bound_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, added=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near-duplicates", drop_near_copies),
    ("personal data", mask_personal_data),
    ("packing", pack),
]

#: The first stage trains a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
