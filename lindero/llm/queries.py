"""The queries of the llm problems. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lindero.llm import leakage, lookalike, packing, pii, splitting, truncation
from lindero.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *more)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text is cut."""
    return truncation.cut_texts(_documents(spark, sf_dir, "lang")).filter("is_cut").select("doc_id")


def p1_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts, and how many of the cuts finish_reason tells."""
    return truncation.cut_share(_documents(spark, sf_dir, "lang", "source", "finish_reason"))


def _strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parses = table(spark, sf_dir, "docling_parses").select(F.lit("docling_parses").alias("tbl"), F.col("parse_id").alias("row_id"), F.col("text").alias("string"))
    values = table(spark, sf_dir, "field_results").select(F.lit("field_results").alias("tbl"), F.col("result_id").alias("row_id"), F.col("value").alias("string"))
    return parses.unionByName(values)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose string isn't in the consistent form."""
    return lookalike.changed_form(_strings(spark, sf_dir), "string", "form").filter("form != string").select("tbl", "row_id").distinct()


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each string in its consistent form."""
    return lookalike.consistent_form(_strings(spark, sf_dir), "string", "form").select("tbl", "row_id", "form")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized sections with the coarsest boundary that cuts them small enough."""
    return splitting.weakest_boundaries(table(spark, sf_dir, "document_sections"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections in pieces within the limit."""
    return splitting.split_sections(table(spark, sf_dir, "document_sections"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or piece of a larger one, in its container."""
    return packing.pack(packing.token_counts(_documents(spark, sf_dir)))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p7_containers(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and an evaluation item that leaked into it."""
    return leakage.leaked(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked items, with the number of documents they leaked into."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "split", "lang")
    return leakage.leaked(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items")).groupBy("item_id").agg(F.count("*").alias("documents")).join(items, "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention of personal information."""
    return pii.find_mentions(_documents(spark, sf_dir)).drop("end_pos")


def p9_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with its mentions replaced by placeholders."""
    return pii.replace_mentions(_documents(spark, sf_dir)).select("doc_id", "clean_text")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
