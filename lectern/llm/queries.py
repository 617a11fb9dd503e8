"""Queries of the training-text operators and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.plans.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from lectern.llm.sentences import sentences

    return sentences(table(spark, d, "scidoc").where("fmt <> 'paperxml' or fmt is null"), "scidoc_id")


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "scidoc")
    english = rows.where("fmt = 'paperxml' or lower(trim(lang)) = 'en'")
    return rows.where("fmt = 'paperxml'"), english


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from lectern.llm.pages import page_noise

    rows, english = _pages(spark, d)
    return page_noise(rows, "scidoc_id", words_from=english)


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    from lectern.llm.pages import paragraphs

    rows, english = _pages(spark, d)
    return paragraphs(rows, "scidoc_id", words_from=english)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from lectern.llm.people import same_pairs

    return same_pairs(p4_entities(spark, d))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every author record with the entity it stands for."""
    from lectern.llm.people import resolve

    return resolve(table(spark, d, "authors"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_matches(spark, d).select("rec_id", "guid")


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every record of the other collection that has a paper, with its confidence."""
    from lectern.llm.matching import match_records

    return match_records(table(spark, d, "aan_records"), table(spark, d, "papers"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    from lectern.llm.tokens import encode_corpus

    return encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from lectern.llm.leaks import leaks

    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """As p8_found, with one word in the twelve put in, left out or changed."""
    from lectern.llm.leaks import leaks

    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), edits=1).distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the number of documents that give it away."""
    from pyspark.sql import functions as F

    items = table(spark, d, "benchmark").select("item_id").distinct()
    n = p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return items.join(n, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from lectern.llm.residue import residue

    return residue(table(spark, d, "documents")).select("doc_id")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_paragraphs": p3_paragraphs, "p4_found": p4_found, "p4_entities": p4_entities, "p5_found": p5_found, "p5_matches": p5_matches, "p7_ids": p7_ids, "p8_found": p8_found, "p8_items": p8_items, "p8_near": p8_near, "p9_found": p9_found}
SQL: dict[str, str] = {}
