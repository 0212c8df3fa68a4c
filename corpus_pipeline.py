"""The training-data pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes what its predecessor kept, as Parquet. All but the last return the columns of documents. A stage
removes the intermediate tables of those before it, but for what its own input still reads.

Edge cases, of each stage as of its operator: a null or empty text fails the quality rules; a null id is kept like
any other; of rows equal in id and text one is left by the Jaccard join; ties go to the least id; a table
without rows gives one without rows, with the same columns; labels of no row, or of one class, keep all that the base rules
keep; further columns are carried through to the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, jaccard, lines, packing, quality
from tallyframe.llm.scratch import release, scope, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release("pipeline", keep=docs)
        # what the last stage returns reads its tables until the process ends
        with scope("result" if f.__name__ == "packing_stage" else "pipeline"):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or that the model finds poor, go."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go, but for the first of each group; n_chars follows."""
    out = lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (shingles of five words, Jaccard 0.8)."""
    return jaccard.keep_one(docs, k=5, percent=80)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows over a twentieth of their words go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: The fitted model and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, f) in enumerate(STAGES):
        if i:
            with scope("pipeline"):
                docs = staged(docs)
        docs = f(spark, docs, sf_dir)
    return docs
