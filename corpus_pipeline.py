"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as
the next one's docs. All but the last return the columns of documents; n_chars, where docs has it, follows the text.

Null and empty texts stay and become a document of the end id alone; rows without a doc_id stay, but for near copies;
of rows that repeat a doc_id and text one stays; an empty table gives no pieces; other columns are kept up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkledger.llm.common import new_path, table
from linkledger.llm.line_dedup import drop_lines
from linkledger.llm.near_dedup import keep_one
from linkledger.llm.packing import pack
from linkledger.llm.queries import tokenizer_file
from linkledger.llm.repeats import drop_repeats
from linkledger.llm.toxicity import drop_toxic


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    n = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    return (docs.withColumn("n_chars", n) if "n_chars" in columns else docs).select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(drop_lines(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(drop_repeats(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]
#: The toxicity model, shingle links and token packing are not expressible in SQL. tests/llm/test_brute_force.py has plain versions of all five.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
