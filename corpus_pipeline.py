"""A training-corpus pipeline of five stages. Each stage reads what its predecessor kept; ``run`` chains them on ``documents``.

Stages: quality classifier (rejected documents go), line dedup (boilerplate lines go), n-gram Jaccard join (one document of each class
stays), mixing sources to target weights (a row per document and epoch), SentencePiece encoding (ids and digests).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumring.llm import jaccard_join, line_dedup, mixing, piece_fst, quality
from sumring.llm.common import materialize
from sumring.session import ship_package

#: A line goes if more than this share of its source's pages holds it: in the middle of the measured gap. The one line that is on all sources
#: alike has 8.7 to 13.2 % of each on sf0.1 (11.3 to 12.6 % on check_l), any other at most 4.6 % (3.9 %).
LINE_RATIO = 0.065
#: Near duplicates share at least so much (numerator, denominator) of the union of their shingles of so many words.
NEAR = (5, 80, 100)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    out = line_dedup.drop_boilerplate(docs, ratio=LINE_RATIO)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return jaccard_join.keep_one(docs, *NEAR).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mix(docs).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return piece_fst.encode_decode(docs, piece_fst.model_path(), [c for c in docs.columns if c != "text"])


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: SQL cannot express the classifier, the join at this scale, or the tokenizer; tests compare with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written to the shared folder and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
