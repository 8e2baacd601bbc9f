"""A training corpus from raw documents: each stage calls one corpus operator and works on what its predecessor kept.

All stages but the last return exactly the columns they were given, extra ones included, whatever their names. Null texts are
rejected by the first stage; later stages, given one, keep it. Repeated rows are judged alike and kept alike, but for the
near-duplicate stage, which keeps one row of each group. Each stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from freshet.llm.common import Scratch, aliased, others, pick


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go: of them no language can be told. The model is learned from this stage's own documents."""
    model = language_id.fit(docs.where(~language_id.held_out(pick(docs, "doc_id"))))
    renamed, back = aliased(docs, "text")
    return language_id.identify(renamed, model).where(F.col("lang_pred") != "und").select(*back.values())


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more have go; n_chars is counted anew where lines went. All documents stay, emptied ones too: the mix takes 0 words of them."""
    renamed, back = aliased(docs, "text")
    found = line_dedup.dedup_lines(renamed.withColumn("__null", F.col("text").isNull()) if "text" in docs.columns else renamed)
    for c in {"text", "n_chars"} & set(docs.columns):
        new = F.when(~(F.col("__null") & (F.col("n_dropped") == 0)), F.col("text")) if c == "text" else F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(back[c])
        back[c] = new.cast(docs.schema[c].dataType).alias(c)
    return found.select(*back.values())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document that the mix takes, with its size, how many copies of it and how many words in all; columns called like these are replaced."""
    mixed = mixing.mix_sources(docs).where(F.col("taken") > 0)
    return mixed.select(*others(docs, *mixing.MADE), "size", "copies", "taken")


STAGES = [("language ID", identify_language), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks), ("mixing sources to target weights", mix)]

#: Language ID and the near-duplicate groups have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
