"""From raw documents to packed training sequences: toxicity, quality, near-duplicates, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stridelake.llm import mixing, packing, quality, simhash, toxicity
from stridelake.llm.common import importable, materialize
from stridelake.llm.queries import tokenizer_files


NEEDED = ("doc_id", "text", "lang", "source")


def _shielded(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with names that no operator makes for all columns that none needs, and what gives the names back."""
    names = docs.columns
    inner = docs.toDF(*(c if c in NEEDED else f"column_{k}" for k, c in enumerate(names)))
    return inner, lambda out: out.select(*inner.columns).toDF(*names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression distance says they are not toxic."""
    model = toxicity.train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    inner, named = _shielded(docs)
    return named(toxicity.score_toxicity(inner, model).filter("predicted = 0"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    bands = quality.fit_bands(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    inner, named = _shielded(docs)
    return named(quality.score_quality(inner, bands).filter("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    inner, named = _shielded(docs)
    return named(simhash.keep_one(inner))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    inner, named = _shielded(docs)
    return named(mixing.mix_documents(inner))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: the sequence it is in and where."""
    return packing.pack_documents(docs, **tokenizer_files())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express the compression stages; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage is written as Parquet and read again."""
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
