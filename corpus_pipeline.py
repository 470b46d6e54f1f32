"""Documents to training sequences, stage by stage.

Each stage takes all that the one before kept and returns the columns of
``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfade.llm import decontaminate, langid, packing, quality, resemblance
from crossfade.sources.staging import stage, stage_path


def _boxed(docs: DataFrame, *names: str) -> DataFrame:
    """The columns ``names``, and all others in ``row``, where they can't clash."""
    others = [c for c in docs.columns if c not in names]
    return docs.select(*names, F.struct(*others).alias("row") if others else F.lit(None).cast("string").alias("row"))


def _unboxed(boxed: DataFrame, docs: DataFrame, *names: str) -> DataFrame:
    return boxed.select(*(F.col(c) if c in names else F.col("row").getField(c).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter and those between two languages go."""
    model = langid.fit(docs)
    found = langid.identify(_boxed(docs, "text"), model)
    kept = found.filter((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous"))
    return _unboxed(kept, docs, "text")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rather good than bad, given their text and their site."""
    model, _ = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = ("text", "source", "lang")
    scored = quality.score(quality.measure(_boxed(docs, *names)), model, host_col="source", path_col="lang")
    return _unboxed(scored.filter("keep"), docs, *names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked at 0.8 or more of its five-word shingles, that with the smallest id if any has one."""
    return resemblance.representatives(docs, words=5, least=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; a text is known by its hash, so nothing is copied."""
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    found = decontaminate.contaminated(marked.select("__mark", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__mark")
    hit = stage(found.select(F.col("doc_id").alias("__mark")).distinct(), "contaminated")
    return marked.join(decontaminate.bounded(hit, decontaminate.MOST_HITS), "__mark", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids, in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Classifiers, components and packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        path = stage_path(spark, name)
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
