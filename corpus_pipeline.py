"""From raw documents to token ids: quality rules, two kinds of deduplication, mixing, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.bpe import with_ids
from lorespark.llm.common import dropped, written
from lorespark.llm.exact_dedup import without_exact_duplicates
from lorespark.llm.mixing import mixed_documents
from lorespark.llm.ngram_join import one_of_each_group
from lorespark.llm.quality import of_good_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the cascade keeps. Null and empty texts have no words and go; repeated rows share one verdict."""
    return of_good_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with texts that are equal but for the kind of white space: the smallest doc_id, null last;
    of rows that repeat that too, one."""
    return without_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links connect, the smallest doc_id, null last, by row: an unlinked
    text stays even if a linked one shares its id. Texts without words link with nothing and stay."""
    return one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix of sources takes them: repeated for each epoch, left out, or cut at the budget. A null
    source is a source and the last; texts without words are never taken; ties of the random key go by doc_id and size."""
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the hash of the text that they decode to; rows are independent of each other."""
    coded = with_ids(docs.select("doc_id", "text", "lang", "source"), decoded=True)
    return coded.select("doc_id", "lang", "source", F.expr("octet_length(token_ids) div 4").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("tokens", tokens)]

#: SQL expresses neither the links of stage 3 nor the ids of stage 5; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's table goes as soon as the
    next one is written. An empty table gives no rows; columns beyond those of documents stay up to the last stage."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
