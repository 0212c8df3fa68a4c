"""Queries of the training-data operators over the synthetic tables, each over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, language, lines, lm, packing, quality, substrings, tokencount
from .hashing import remainder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.assess(docs, model).drop("p_good")


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.occurrences(docs, table(spark, sf_dir, "benchmark")))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.fit(docs.where(~rest))
    return language.predict(docs, model).withColumn("held_out", rest).select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.segments(turns.unionByName(own)))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), k=4, percent=85)


@query
def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def sample_edits() -> Column:
    """Four edits of every kept document, at places that follow from its id: a replacement, an insertion, a deletion, and a tenth of the text made new."""

    def at(key: str) -> Column:
        return F.coalesce(F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(key)).cast("binary")), F.lit(0)) % (F.col("n_chars") + 1)

    def one(start: Column, length: Column | int, text: Column | str) -> Column:
        length, text = (x if isinstance(x, Column) else F.lit(x) for x in (length, text))
        return F.struct(start.cast("bigint").alias("start"), length.cast("bigint").alias("length"), text.alias("text"))

    tenth = F.floor(F.col("n_chars") / 10)
    return F.array(one(at("a"), 7, " revised 2024 "), one(at("b"), 0, "'s \n"), one(at("c"), 3, ""), one(at("d"), tenth, F.expr("repeat(' a new line,\n', cast(n_chars div 130 as int))")))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return tokencount.recount(docs, sample_edits(), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short_lines=True)
