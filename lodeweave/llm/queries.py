"""Queries of the ten problems on the tables of TESTDATA.md, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import abuse, bpe, credentials, groups, leaks, near_duplicates, neighbours, provenance, splitting, syntax
from lodeweave.session import ship, table

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    _all[f.__name__] = run
    return run


def _groups(spark: SparkSession, d: str, with_vectors: bool = False) -> DataFrame:
    return groups.similarity_groups(table(spark, d, "code_chunks"), "chunk_id", "embedding", ["repo_id", "language"], with_vectors=with_vectors)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.group_pairs(_groups(spark, d))


@query
def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.describe(_groups(spark, d, True), ["repo_id", "language"])


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, d, "code_chunks").filter(F.col("chunk_type").isin("function", "method"))
    return near_duplicates.near_duplicates(chunks, "chunk_id", "raw_code")


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.record_pairs(*_near(spark, d))


@query
def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    members, links = _near(spark, d)
    return near_duplicates.record_classes(members, links.persist())


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Code and files of pull requests as one table."""
    a = table(spark, d, "code_chunks").select(F.lit("code_chunks").alias("table_name"), F.col("chunk_id").alias("record_id"), F.col("file_path").alias("path"), F.col("raw_code").alias("text"))
    b = table(spark, d, "pr_files").select(F.lit("pr_files").alias("table_name"), F.col("pr_file_id").alias("record_id"), F.col("filename").alias("path"), F.col("content").alias("text"))
    return a.unionByName(b)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find(_texts(spark, d), ["table_name", "record_id"], "text", "path").select("table_name", "record_id", "line_number").distinct()


@query
def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    keys = ["table_name", "record_id"]
    return credentials.redact(_texts(spark, d), credentials.find(_texts(spark, d), keys, "text", "path"), keys, "text")


def _syntax(spark: SparkSession, d: str) -> DataFrame:
    """Whole files of ``code_chunks`` with the sha of their commit; a commit delivered again counts once."""
    files = table(spark, d, "code_chunks").filter((F.col("chunk_type") == "module") & F.col("raw_code").isNotNull()).select("repo_id", "commit_id", "file_path", "language", "raw_code")
    judged = syntax.unparsable(files, ("repo_id", "commit_id", "file_path"))
    return judged.join(table(spark, d, "commits").select("commit_id", "sha").distinct(), "commit_id")


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _syntax(spark, d).filter("cost > 0").select("sha", "file_path").distinct()


@query
def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("cost") > 0
    counts = [F.count_if(bad & (F.col("error_kind") == k)).alias(k) for k in ("truncation", "conflict", "mismatch", "edit")]
    return _syntax(spark, d).groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if(bad).alias("unparsable"), F.avg(bad.cast("double")).alias("rate"), *counts)


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.classify(table(spark, d, "code_chunks")).select("repo_id", "file_path")


@query
def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return provenance.classify(table(spark, d, "code_chunks")).groupBy("repo_id", "reason").agg(F.count(F.lit(1)).alias("files"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "code_chunks"))


@query
def p6_balanced(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "code_chunks"), method="balanced")


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(neighbours.collection(table(spark, d, "code_chunks"), table(spark, d, "semantic_clusters")), "id", "v")


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(_nearest(spark, d))


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(table(spark, d, "documents"))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id")


@query
def p9_items(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaked(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("shared_passages").alias("shared_passages"))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score(table(spark, d, "documents")).filter("score >= 0.5").select("doc_id").distinct()


@query
def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    scored = abuse.score(docs).join(docs.select("doc_id", "source"), "doc_id")
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") >= 0.5).alias("flagged"), F.avg((F.col("score") >= 0.5).cast("double")).alias("rate"))


def queries() -> dict[str, Query]:
    return dict(_all)
