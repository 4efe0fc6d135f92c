"""The corpus pipeline: quality, language, near-duplicates, benchmark items, packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return the
columns of documents, whatever these are called. No stage is expressible in SQL as a whole, so ORACLE_SQL is None and
tests/llm/test_pipeline.py holds each stage against a brute-force version.

In every stage an empty table gives no rows, ties go to the smaller id, and texts count whole, however long. What
becomes of null and empty texts and of repeated rows each stage says itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import common, decontam, langid, neardup, packing, quality

#: A document stays if the classifier gives label 1 at least this probability.
QUALITY = 0.3
#: Languages that stay; a text without a letter has none of them.
LANGUAGES = ("de", "en", "es", "fr")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels outside the held-out fifth. Null and empty texts
    are scored from zero statistics, repeated rows alike; without labels every score is one half, so all stay."""
    model = quality.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model, threshold=QUALITY).where("predicted = 1").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of LANGUAGES go, null texts and texts without a letter among them. The prototypes are learned
    from what has come this far; repeated rows are judged alike."""
    profiles = langid.fit(docs, common.crc_mod(F.col("doc_id"), 3) != 1)
    return langid.predict(docs, profiles).where(F.col("lang_pred").isin(*LANGUAGES)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at a similarity of 0.8 or more the smallest id stays, and a repeated row once. Null and empty texts are
    near nothing; different texts of an id count as documents of their own; rows without an id stay."""
    return neardup.keep_one(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's shingles go. Null and empty texts hold nothing; rows of an id go
    together; without benchmark items all stay."""
    return decontam.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as packed sequences of 2048 tokens. A null or empty text is its end token alone; repeated rows are packed
    each."""
    return packing.pack_texts(docs, with_ids=False)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
