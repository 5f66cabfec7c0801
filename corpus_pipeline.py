"""From raw documents to training tokens: quality rules, line and document duplicates, mixing, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, lines, mix, neardup, quality
from tidewright.llm.store import WORD, table, words, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, as they are; null and empty texts go."""
    return quality.keep_good(docs, "text", "lang", "source").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines. One of which no word is left was told by others in full and goes: such are
    copies, near copies too, as this stage comes before the comparison of whole documents. Null and empty texts stay."""
    left = lines.drop_repeated(docs.select(COLUMNS), "doc_id", "text")
    left = left.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates (five words, similarity 0.8), and all others. Null
    and empty texts are like nothing and stay."""
    return neardup.keep_one(docs, "doc_id", "text").select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their weights: a document as often as the mix takes it whole, and once more with its first words where
    the mix ends within it (joined by spaces). Documents it doesn't take, and those without words, go."""
    sized = docs.select(*COLUMNS, F.size(words(F.col("text"))).cast("long").alias("size"))
    m = mix.mix(sized, "doc_id", "source", "size").where("taken > 0")
    m = m.withColumn("rest", F.col("taken") % F.col("size")).withColumn("copies", F.floor(F.col("taken") / F.col("size")).cast("int"))
    whole = F.array_repeat(F.col("text"), F.col("copies"))
    part = F.when(F.col("rest") > 0, F.array(F.array_join(F.slice(words(F.col("text")), 1, F.col("rest").cast("int")), " "))).otherwise(F.array().cast("array<string>"))
    out = m.select("doc_id", F.explode(F.concat(whole, part)).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (packed 32-bit integers), their number, and the text read back from them."""
    how = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = docs.select("doc_id", "lang", "source", bpe.encode(F.col("text"), *how).alias("ids")).withColumn("raw", bpe.decode(F.col("ids"), *how))
    return coded.select("doc_id", "lang", "source", bpe.token_count(F.col("ids")).alias("n_tokens"), "ids", F.decode("raw", "UTF-8").alias("text"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mixed), ("encoding", encoded)]

#: No SQL: near-duplicate lines and byte-pair merges aren't expressible; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
