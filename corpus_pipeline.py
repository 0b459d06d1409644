"""The corpus pipeline: stages that each write Parquet and read it back as the next one's documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of documents; the last returns packed pieces. No stage has SQL (trained models, exact sketch links, parsers
and tokenizers), so their tests compare them with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.llm import common, minhash, packing, pii, quality, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: drops documents whose score of good quality is under the cut.

    Null, empty and blank texts score 0 and go. Repeated rows and null ids are judged by their text like others; extra
    columns of any name stay as they are."""
    model = quality.learn(docs, common.table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where("predicted = 1").select(common.columns(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: drops documents graded as toxic.

    Null, empty and blank texts hold no toxic word and stay. Repeated rows and null ids are judged by their text like
    others; extra columns of any name stay as they are."""
    model = toxicity.learn(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.grade(docs, model).where("NOT toxic").select(common.columns(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one row of each near-duplicate group (five words, 0.8) stays, that of the least doc_id.

    Rows are told apart by doc_id and text: a doc_id on several rows loses no other text and keeps no second copy. Rows
    with a null doc_id and rows of null, empty or wordless texts stay."""
    return minhash.distinct_documents(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal data gives way to its kind in angle brackets; n_chars follows the text (null for null).

    Every row stays, repeated ones and those with null ids too."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(common.columns(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token sequences of at most 2048 ids, one row a piece with its ids.

    Null and empty texts give the end id alone; repeated rows and null ids are packed like others. The result has the
    columns of packing.SCHEMA, whatever docs holds beside doc_id and text."""
    import public_tokenizers as P

    return packing.pack(docs, P.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
