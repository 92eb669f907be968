"""Corpus pipeline: each stage's result is written as Parquet and read again as the next one's documents.

In every stage null text counts as empty, an empty table gives an empty result, texts are read whole, and columns besides those of documents
are left behind. Rows are told apart by id and text, so null and repeated ids are fine; rows that agree in
both share their fate, but among near duplicates one of them stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm import decontam, language, neardup, packing, substrings
from gapline.llm.shared import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no language (no text, or no letter in it) go; the others stay, whatever their language."""
    docs = docs.select(*COLUMNS)
    model = language.fit(docs, language.not_held_out())
    if not model.labels:  # nothing is labelled, so no language is told from none
        return language.with_letter(docs)
    return language.tag(docs, model).where(F.col("lang_pred") != language.UND).select(*COLUMNS)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays: the one with the smallest id, and of rows that share an id, or
    have none, the one whose text has the smallest hash. Of rows with one id and one text, one stays."""
    docs = docs.select(*COLUMNS)
    first = neardup.groups(docs, size=5, percent=80).where("first").select(F.col("doc_id").alias("k"), "th").distinct()
    own = F.col("doc_id").eqNullSafe(F.col("k")) & (F.xxhash64("text") == F.col("th"))
    return docs.join(first, own, "left_semi").dropDuplicates(["doc_id", "text"])


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur elsewhere too are cut out of the texts: of repeated rows all of such a text goes. Null text stays null; what is cut away
    whole becomes empty, and its row stays."""
    out = substrings.remove_repeats(docs.select(*COLUMNS), as_text=True).withColumn("text", F.coalesce("kept", "text"))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go, with all rows of the same id and text; without benchmark items all stay. Null text has no words and stays."""
    docs = docs.select(*COLUMNS)
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("k"), "row").distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("k")) & (F.xxhash64("text") == F.col("row")), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, each of one document; null or empty text is one sequence, the end id. Repeated rows give repeated pieces."""
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("neardup", neardup_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: the stages' tokenizer, hashes and kernel are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
