"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept. Stages but the last return
the columns of ``documents``; the last returns a row per piece of a sequence. A document's id stands for it: what a
stage decides about an id holds for all rows with it, and rows without an id can only be left out by their text's language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.llm import language_id, ngram_join, packing, quality
from lakemill.llm.queries import tokenizer_file
from lakemill.llm.scratch import Scratch, matching
from lakemill.session import ship, table

#: Below this probability of its language a document is rejected.
LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, and those of no clear language, go."""
    ship(spark)
    language, score = language_id.identify(docs, language_id.fit(docs, id_col="doc_id"))
    return docs.where((language != language_id.UNDETERMINED) & (score >= LANGUAGE_SCORE))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good more likely than not, by their text and their site."""
    ship(spark)
    judged = Scratch(spark, "quality-stage").table(quality.judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "keep"), "judged")
    return matching(docs, "doc_id", judged.where(~F.col("keep")).select("doc_id").distinct(), "left_anti")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id; rows of one id with the same text count once, those with other texts stay."""
    ship(spark)
    classes = Scratch(spark, "near-duplicate-stage").table(ngram_join.near_duplicates(docs), "classes")
    copies = classes.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = matching(docs, "doc_id", copies, "left_anti")
    repeated = classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.head(1):
        return kept
    rows = F.struct(*(c for c in docs.columns))  # the least of equal texts' rows, the same at each try
    once = matching(kept, "doc_id", repeated).groupBy("doc_id", F.xxhash64("text").alias("_name"), F.xxhash64(F.lit(7), "text").alias("_other")).agg(F.min(rows).alias("row")).select("row.*")
    return matching(kept, "doc_id", repeated, "left_anti").union(once)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence of at most 2048 ids."""
    ship(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: SQL has no tokenizer and no fitted classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written as Parquet and read again by the next."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
