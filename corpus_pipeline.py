"""A corpus pipeline of five of the llm operators; each stage works on all its predecessor kept.

Every stage takes documents (doc_id, text, lang, source, n_chars; more columns may follow) and, but for the last, returns
rows with the same columns. Nulls may stand in any of them: null or letterless texts go in the first stage; null ids,
languages and sources are values like others. Rows that repeat each other are told apart by nothing and count one by
one until near copies go. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm.common import discard, documents, written
from sievemark.llm.decontaminate import without_contaminated
from sievemark.llm.jaccard_join import keep_one_of_each
from sievemark.llm.language_id import keep_identified
from sievemark.llm.mixture import mixed_documents
from sievemark.llm.token_file import encode_and_read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of at least 0.5; the others go.

    Null and letterless texts have no language. Without a labelled row that may train none has, and nothing is kept."""
    return keep_identified(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, Jaccard 0.8 or more): the smallest doc_id, null ids last.

    Rows are told apart by id and text, so rows that repeat an id with another text lose nothing by each other."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, told by their text; an empty benchmark leaves all."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often, and as much of them, as their source's target takes; n_chars follows the text. A null
    source is a source of its own, the last."""
    return mixed_documents(docs)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Simple-8b shards, read back: doc_id, start, n_tokens, ids_crc32; null ids come first, repeats as they stand."""
    return encode_and_read(docs)


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("decontaminate", decontaminate), ("mixture", mixture), ("token_file", token_file)]
#: Naive Bayes and the mix's permutations have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
            discard(before)  # nothing reads it any more
    return docs
