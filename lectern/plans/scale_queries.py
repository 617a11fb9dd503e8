"""Queries of the general large-scale operators, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.operators import orphans, skew
from lectern.plans.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """GUIDs whose stored inlink count differs from the number of distinct citing papers."""
    n = skew.citing_counts(table(spark, d, "links"), table(spark, d, "papers"))
    return n.where("least_stored <> n_citing or most_stored <> n_citing").select("guid")


def p1_citing(spark: SparkSession, d: str) -> DataFrame:
    """Distinct citing papers of every paper beside the stored counts."""
    return skew.citing_counts(table(spark, d, "links"), table(spark, d, "papers"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.corpus_orphans(*(table(spark, d, t) for t in ("links", "missing_papers", "papers")))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p6_found(spark, d))


QUERIES = {"p1_found": p1_found, "p1_citing": p1_citing, "p6_found": p6_found, "p6_report": p6_report}

_KEY = "lower(trim({}))"
_CITING = f"""
  SELECT min(p."GUID") AS guid, coalesce(max(l.n), 0) AS n_citing, min(p.num_inlinks) AS least_stored, max(p.num_inlinks) AS most_stored
  FROM papers p LEFT JOIN (
    SELECT {_KEY.format('"GUID_to"')} AS k, count(DISTINCT {_KEY.format('"GUID_from"')}) AS n FROM links GROUP BY 1
  ) l ON {_KEY.format('p."GUID"')} = l.k
  WHERE p."GUID" IS NOT NULL GROUP BY {_KEY.format('p."GUID"')}"""
_ORPHANS = f"""
  WITH c AS (
    SELECT 'links' AS ref_table, link_id AS row_id, {_KEY.format('"GUID_to"')} AS k, time_created AS t FROM links
    UNION ALL SELECT 'missing_papers', missing_id, norm_title, time_created FROM missing_papers),
  p AS (
    SELECT 'links' AS ref_table, {_KEY.format('"GUID"')} AS k, time_created AS a, time_deleted AS z FROM papers
    UNION ALL SELECT 'missing_papers', norm_title, time_created, time_deleted FROM papers),
  j AS (
    SELECT c.ref_table, c.row_id, c.t, count(p.k) AS n, bool_or(p.a <= c.t AND (p.z IS NULL OR p.z > c.t)) AS there, bool_or(p.z <= c.t) AS gone
    FROM c LEFT JOIN p ON c.ref_table = p.ref_table AND c.k = p.k WHERE trim(c.k) <> '' GROUP BY 1, 2, 3)
  SELECT ref_table, row_id, strftime(t, '%Y-%m') AS period, CASE WHEN n = 0 THEN 'missing' WHEN gone THEN 'deleted' ELSE 'late' END AS reason
  FROM j WHERE there IS NOT TRUE"""
SQL = {
    "p1_found": f"SELECT guid FROM ({_CITING}) WHERE least_stored <> n_citing OR most_stored <> n_citing",
    "p1_citing": _CITING,
    "p6_found": _ORPHANS,
    "p6_report": f"SELECT ref_table, period, reason, count(*) AS n_rows FROM ({_ORPHANS}) GROUP BY 1, 2, 3",
}
