"""Queries of the citation-analytics operators over whole tables, each beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.keys import guid_key
from lectern.operators import documents as D
from lectern.operators import keywords as K
from lectern.operators import learning as L
from lectern.operators import metrics as M
from lectern.operators import references as J
from lectern.operators import reports as A
from lectern.operators import retrieval as I  # noqa: E741
from lectern.operators import sequence as W
from lectern.operators import similarity as G
from lectern.plans.session import kept, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


_T = r"[\p{L}\p{N}_]+"
_STOP = "(" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + ")"
_SYM = X.SYMBOLS.replace("'", "''")
_KEY = "lower(trim({}))"


# ---- text ----
@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(lower(text), '-  ', ''), '- ', ''), '{_SYM}', ' ', 'g'), '\\s+', ' ', 'g'))[1:200] AS title FROM documents")
def t_normalize_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.normalize_title("text").alias("title"))


@query(f"SELECT doc_id, length(regexp_replace(text, '{_SYM}', ' ', 'g')) AS n, md5(regexp_replace(text, '{_SYM}', ' ', 'g')) AS digest FROM documents")
def t_remove_symbols(spark: SparkSession, d: str) -> DataFrame:
    t = X.remove_symbols("text")
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("bigint").alias("n"), F.md5(t.cast("binary")).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '</?[^<>]+>', ' ', 'g')) AS digest FROM documents")
def t_clean_xml(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean_xml("text").cast("binary")).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)<cit[^<>]*/>', '', 'g'), '(?i)</?footnote[^<>]*>', ' ', 'g')) AS digest FROM documents")
def t_remove_citations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.remove_citations("text").cast("binary")).alias("digest"))


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\([^()]*(?:1[89]|20)\d\d[a-z]?[^()]*\)', '', 'g'), '{X.NUMBERED}', '', 'g')) AS digest FROM documents")
def t_remove_bracketed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.remove_bracketed_citations("text").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '{X.URL}', '', 'g')) AS digest FROM documents")
def t_remove_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.remove_urls("text").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), '{_T}')) AS n_tokens, len(list_filter(regexp_extract_all(lower(text), '{_T}'), lambda x: x NOT IN {_STOP})) AS n_content, len(regexp_extract_all(text, '\\w+')) // 2 AS n_words FROM documents WHERE text IS NOT NULL")
def t_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = X.tokens("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(w).cast("bigint").alias("n_tokens"), F.size(X.without_stopwords(w)).cast("bigint").alias("n_content"), X.word_count("text").cast("bigint").alias("n_words"))


_AY, _NU = X.ANY_AUTHOR_YEAR.replace("'", "''"), X.NUMBERED


@query(f"SELECT scidoc_id, CASE WHEN n > a THEN 'AFI' WHEN a > 0 THEN 'APA' END AS style FROM (SELECT scidoc_id, len(regexp_extract_all(text, '{_NU}')) AS n, len(regexp_extract_all(text, '{_AY}')) AS a FROM scidoc)")
def t_citation_style(spark: SparkSession, d: str) -> DataFrame:
    """Of every text, null for null."""
    return table(spark, d, "scidoc").select("scidoc_id", X.citation_style("text").alias("style"))


@query(f"SELECT scidoc_id, c.k AS k, c.x AS mark FROM (SELECT scidoc_id, unnest(list_transform(regexp_extract_all(text, '{_NU}'), lambda x, i: {{'k': i, 'x': x}})) AS c FROM scidoc)")
def t_numbered_citations(spark: SparkSession, d: str) -> DataFrame:
    marks = F.posexplode(F.regexp_extract_all("text", F.lit(X.NUMBERED), 0)).alias("p", "mark")
    return table(spark, d, "scidoc").select("scidoc_id", marks).select("scidoc_id", (F.col("p") + 1).cast("bigint").alias("k"), "mark")


@query("""SELECT "GUID" AS guid, count(*) AS n_rows, min(family) AS family, min(given) AS given FROM (
  SELECT "GUID", CASE WHEN contains(t, ',') THEN trim(split_part(t, ',', 1)) WHEN len(w) > 1 AND regexp_full_match(w[len(w)], '(?:[A-Z]\\.?)+') THEN w[1] ELSE w[len(w)] END AS family,
    CASE WHEN contains(t, ',') THEN trim(split_part(t, ',', 2)) WHEN len(w) > 1 AND regexp_full_match(w[len(w)], '(?:[A-Z]\\.?)+') THEN array_to_string(w[2:], ' ') ELSE array_to_string(w[1:len(w) - 1], ' ') END AS given
  FROM (SELECT "GUID", t, string_split(t, ' ') AS w FROM (SELECT "GUID", trim(regexp_replace(full_name, '\\s+', ' ', 'g')) AS t FROM authors) WHERE t <> '')) GROUP BY 1""")
def t_author_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "authors").select(F.col("GUID").alias("guid"), X.author_parts("full_name").alias("p")).where("p is not null")
    return p.groupBy("guid").agg(F.count("*").alias("n_rows"), F.min("p.family").alias("family"), F.min("p.given").alias("given"))


_SN = "list_filter(list_transform(regexp_split_to_array(lower(coalesce({0}, '')), '\\s*[;,]\\s*'), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""SELECT "GUID" AS guid, count(*) AS n_rows, min(CASE len(s) WHEN 0 THEN NULL WHEN 1 THEN '(' || s[1] || ', ' || coalesce(year, 'n.d.') || ')' WHEN 2 THEN '(' || s[1] || ' and ' || s[2] || ', ' || coalesce(year, 'n.d.') || ')' ELSE '(' || s[1] || ' et al., ' || coalesce(year, 'n.d.') || ')' END) AS cited
  FROM (SELECT "GUID", year, {_SN.format('surnames')} AS s FROM papers) GROUP BY 1""")
def t_in_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").select(F.col("GUID").alias("guid"), X.in_text(J.names("surnames"), F.col("year")).alias("c"))
    return p.groupBy("guid").agg(F.count("*").alias("n_rows"), F.min("c").alias("cited"))


@query(
    "WITH h AS (SELECT DISTINCT header, list_filter(regexp_split_to_array(lower(header), '[\\s\\d,./:;-]+'), lambda x: x <> '') AS w FROM scidoc WHERE header IS NOT NULL), s(k, name, words) AS (VALUES "
    + ", ".join(f"({i}, '{n}', string_split('{ws}', ' '))" for i, (n, ws) in enumerate(X.SECTIONS.items()))
    + "), c AS (SELECT header, k, name, list_sum(list_transform(w, lambda x: len(list_filter(words, lambda y: y = x)))) AS n, list_position(list_transform(w, lambda x: list_contains(words, x)), true) AS pos FROM h CROSS JOIN s) SELECT header, CASE WHEN max(n) > 0 THEN arg_min(name, (-n, pos, k)) FILTER (n > 0) ELSE '' END AS section FROM c GROUP BY 1"
)
def t_section_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scidoc").where("header is not null").select("header").distinct().select("header", X.generic_section("header").alias("section"))


@query("SELECT vec_id, round(1 / (1 + exp(-label)), 6) AS s, CASE WHEN label > 0 THEN round(list_sum(list_transform(range(1, label + 1), lambda i: 1.0 / i)) / label, 6) END AS chance FROM embeddings")
def t_curves(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(X.sigmoid("label"), 6).alias("s"), F.round(X.chance_mrr("label"), 6).alias("chance"))


# ---- store ----
@query(f"""SELECT collection_id, coalesce(import_id, '?') AS import_id, count(*) AS n_rows, count(DISTINCT {_KEY.format('"GUID"')}) AS n_guids FROM papers WHERE time_deleted IS NULL GROUP BY 1, 2""")
def s_collection(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").where("time_deleted is null")
    return p.groupBy("collection_id", F.coalesce("import_id", F.lit("?")).alias("import_id")).agg(F.count("*").alias("n_rows"), F.countDistinct(guid_key("GUID")).alias("n_guids"))


_CURRENT = f"""(SELECT * EXCLUDE (rk), {_KEY.format('"GUID"')} AS g FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY.format('"GUID"')} ORDER BY time_created DESC NULLS LAST, norm_title DESC NULLS LAST, corpus_id DESC NULLS LAST) AS rk FROM papers WHERE "GUID" IS NOT NULL AND time_deleted IS NULL) WHERE rk = 1)"""


@query(f"SELECT g AS guid, norm_title, year FROM {_CURRENT}")
def s_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A second import put over the first: of a GUID's rows the last holds."""
    from lectern.sources.records import upsert

    p = table(spark, d, "papers")
    old, new = (J.current(p.where(w)).select(F.col("GUID").alias("guid"), "norm_title", "year", "time_created", "corpus_id") for w in ("time_created < timestamp_ntz'2015-01-01'", "time_created >= timestamp_ntz'2015-01-01' or time_created is null"))
    late = new.join(old.select("guid", F.col("time_created").alias("t")), "guid", "left").where("time_created is not null or t is null").drop("t")
    return upsert(old, late, "guid").select("guid", "norm_title", "year")


@query(f"""SELECT d.doc_id, EXISTS (SELECT 1 FROM papers p WHERE {_KEY.format('p."GUID"')} = {_KEY.format('d.guid')}) AS there FROM documents d""")
def s_exists(spark: SparkSession, d: str) -> DataFrame:
    from lectern.sources.store import exists

    return exists(table(spark, d, "documents"), table(spark, d, "papers"), "guid", "GUID").select("doc_id", "there")


@query("SELECT norm_title, count(*) - 1 AS n_again, max(reference_counts) AS most FROM missing_papers WHERE norm_title IS NOT NULL GROUP BY 1")
def s_missing_counter(spark: SparkSession, d: str) -> DataFrame:
    from lectern.sources.store import missing_counts

    return missing_counts(table(spark, d, "missing_papers"))


@query("""WITH p AS (SELECT "GUID" AS guid, string_agg(DISTINCT p, '|' ORDER BY p) AS papers FROM (SELECT "GUID", unnest(from_json(json_extract(metadata, '$.papers'), '["VARCHAR"]')) AS p FROM authors) GROUP BY 1), f AS (SELECT "GUID" AS guid, string_agg(DISTINCT a.name, '|' ORDER BY a.name) AS affiliations FROM (SELECT "GUID", unnest(from_json(json_extract(metadata, '$.affiliation'), '[{"name": "VARCHAR"}]')) AS a FROM authors) GROUP BY 1),
n AS (SELECT "GUID" AS guid, string_agg(DISTINCT full_name, '|' ORDER BY full_name) AS names FROM authors GROUP BY 1) SELECT guid, coalesce(names, '') AS names, coalesce(papers, '') AS papers, coalesce(affiliations, '') AS affiliations FROM n LEFT JOIN p USING (guid) LEFT JOIN f USING (guid) WHERE guid IS NOT NULL""")
def s_author_merge(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one GUID as one author: names, papers and affiliations without repeats."""
    from lectern.sources.store import merged_authors

    m = merged_authors(table(spark, d, "authors").where("GUID is not null"))
    return m.select("guid", *[F.array_join(c, "|").alias(c) for c in ("names", "papers", "affiliations")])


_PAIRS = f"""(SELECT DISTINCT {_KEY.format('"GUID_from"')} AS a, {_KEY.format('"GUID_to"')} AS b FROM links WHERE trim("GUID_from") <> '' AND trim("GUID_to") <> '')"""


@query(f"SELECT guid, sum(o) AS n_out, sum(i) AS n_in FROM (SELECT a AS guid, 1 AS o, 0 AS i FROM {_PAIRS} UNION ALL SELECT b, 0, 1 FROM {_PAIRS}) GROUP BY 1")
def s_link_lists(spark: SparkSession, d: str) -> DataFrame:
    return J.link_lists(table(spark, d, "links"))


# ---- predicates and joins ----
_LINKJ = f"""(SELECT l.link_id, {_SN.format('l.authors_from')} AS fa, {_SN.format('l.authors_to')} AS ta, try_cast(nullif(regexp_extract(l.year_from, '(1[89]\\d\\d|20\\d\\d)', 1), '') AS INTEGER) AS y FROM links l)"""


@query(f"SELECT link_id, coalesce(y > 2010, false) OR len(list_intersect(fa, ta)) > 1 OR coalesce(fa[1] = ta[1], false) AS ignored, len(list_intersect(fa, ta)) AS n_shared FROM {_LINKJ}")
def f_should_ignore(spark: SparkSession, d: str) -> DataFrame:
    a, b = J.names("authors_from"), J.names("authors_to")
    return table(spark, d, "links").select("link_id", J.should_ignore(a, b, J.year_number("year_from"), max_year=2010, max_overlap=1, no_first_author=True).alias("ignored"), J.overlapping_authors(a, b).cast("bigint").alias("n_shared"))


@query("SELECT guid, n, md5(txt) AS digest FROM (SELECT guid, count(*) AS n, string_agg(text, ' ' ORDER BY ord, text) AS txt FROM scidoc WHERE text IS NOT NULL GROUP BY 1)")
def f_full_text(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scidoc").where("text is not null")
    return D.ordered_text(s, ["guid"]).join(s.groupBy("guid").agg(F.count("*").alias("n")), "guid").select("guid", "n", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""WITH f AS (SELECT *, first_value(parent) OVER (PARTITION BY guid ORDER BY ord, parent) AS fp FROM scidoc WHERE parent IS NOT NULL)
SELECT guid, md5(string_agg(text, ' ' ORDER BY ord, text) FILTER (parent = fp)) AS abstract, md5(coalesce(string_agg(text, ' ' ORDER BY ord, text) FILTER (parent <> fp), '')) AS body FROM f GROUP BY 1""")
def f_abstract(spark: SparkSession, d: str) -> DataFrame:
    s = D.sections(table(spark, d, "scidoc").where("parent is not null"))
    had = F.when(F.col("abstract").isNotNull(), F.col("abstract"))
    return s.select("guid", F.md5(F.nullif(had, F.lit("\0")).cast("binary")).alias("abstract"), F.md5(F.col("body").cast("binary")).alias("body"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS k FROM documents) WHERE k <= 25")
def f_class_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most 25 documents a class, the longest first: a top-k report."""
    return D.cap_by_class(table(spark, d, "documents"), "source", [F.desc_nulls_last("n_chars"), F.col("doc_id")], 25).select("doc_id", "source")


@query(f"""WITH p AS {_CURRENT}, r AS (SELECT missing_id, norm_title, from_json(json_extract(metadata, '$.surnames'), '["VARCHAR"]') AS s FROM missing_papers)
SELECT missing_id AS ref_id, min(p.g) AS guid, 'title' AS matched_by FROM r JOIN p ON r.norm_title = p.norm_title AND len(list_intersect(list_transform(r.s, lambda x: lower(x)), {_SN.format('p.surnames')})) > 0
WHERE r.norm_title <> '' AND NOT regexp_matches(r.norm_title, '["\\\\]') GROUP BY 1""")
def j_reference_match(spark: SparkSession, d: str) -> DataFrame:
    """Works recorded as missing against the collection, by title and a shared surname."""
    meta = F.from_json("metadata", "surnames array<string>")["surnames"]
    refs = table(spark, d, "missing_papers").select(F.col("missing_id").alias("ref_id"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("corpus_id"), F.lit(None).cast("string").alias("guid"), "norm_title", F.transform(meta, lambda x: F.lower(x)).alias("surnames"))
    papers = J.current(table(spark, d, "papers")).select(F.col("GUID").alias("guid"), F.col("DOI").alias("doi"), "corpus_id", "norm_title", J.names("surnames").alias("surnames"))
    return J.match_references(refs, papers)


@query(f"""WITH p AS {_CURRENT}, h AS (SELECT rec_id, p.g, 0 AS k FROM aan_records a JOIN p ON a.doi = p."DOI" WHERE a.doi <> '' UNION ALL
  SELECT rec_id, p.g, 3 FROM (SELECT *, trim(regexp_replace(regexp_replace(replace(replace(lower(title), '-  ', ''), '- ', ''), '{_SYM}', ' ', 'g'), '\\s+', ' ', 'g'))[1:200] AS nt, {_SN.format('author')} AS s FROM aan_records) a
  JOIN p ON nt = p.norm_title AND len(list_intersect(s, {_SN.format('p.surnames')})) > 0 WHERE nt <> '')
SELECT rec_id AS ref_id, arg_min(g, (k, g)) AS guid, CASE min(k) WHEN 0 THEN 'doi' ELSE 'title' END AS matched_by FROM h GROUP BY 1""")
def j_priority_match(spark: SparkSession, d: str) -> DataFrame:
    """Records by DOI first, then by title and surname."""
    null = F.lit(None).cast("string")
    refs = table(spark, d, "aan_records").select(F.col("rec_id").alias("ref_id"), "doi", null.alias("corpus_id"), null.alias("guid"), X.normalize_title("title").alias("norm_title"), J.names("author").alias("surnames"))
    papers = J.current(table(spark, d, "papers")).select(F.col("GUID").alias("guid"), F.col("DOI").alias("doi"), "corpus_id", "norm_title", J.names("surnames").alias("surnames"))
    return J.match_references(refs, papers)


@query(f"""SELECT guid, count(*) AS n_links, sum((n > 0)::INT) AS n_self FROM (SELECT {_KEY.format('"GUID_from"')} AS guid, {_KEY.format('"GUID_to"')} AS t, max(len(list_intersect({_SN.format('authors_from')}, {_SN.format('authors_to')}))) AS n FROM links WHERE "GUID_from" IS NOT NULL AND "GUID_to" IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def j_self_citations(spark: SparkSession, d: str) -> DataFrame:
    return J.self_citations(table(spark, d, "links"))


@query(f"""WITH a AS (SELECT a, b FROM {_PAIRS}), o AS (SELECT DISTINCT {_KEY.format('"GUID_from"')} AS a, {_KEY.format('"GUID_to"')} AS b FROM links WHERE time_created < TIMESTAMP '2018-01-01' AND trim("GUID_from") <> '' AND trim("GUID_to") <> '')
SELECT a, b, 'ADD' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM o) UNION ALL SELECT a, b, 'REMOVE' FROM (SELECT * FROM o EXCEPT SELECT * FROM a)""")
def j_link_changes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "links").select(guid_key("GUID_from").alias("a"), guid_key("GUID_to").alias("b"), "time_created").where("a <> '' and b <> ''")
    return J.link_changes(p.where("time_created < timestamp_ntz'2018-01-01'"), p, ["a", "b"])


@query(f"""WITH e AS {_PAIRS}, r AS (SELECT g FROM {_CURRENT}), l1 AS (SELECT DISTINCT g AS root, b AS guid FROM r JOIN e ON e.a = g), l2 AS (SELECT DISTINCT root, e.b AS guid FROM l1 JOIN e ON e.a = l1.guid)
SELECT root, guid, min(level) AS level FROM (SELECT g AS root, g AS guid, 0 AS level FROM r UNION ALL SELECT root, guid, 1 FROM l1 UNION ALL SELECT root, guid, 2 FROM l2) GROUP BY 1, 2""")
def j_reference_tree(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "links").where("trim(GUID_from) <> '' and trim(GUID_to) <> ''")
    roots = J.current(table(spark, d, "papers")).select(F.col("GUID").alias("guid"))
    return J.reference_tree(links, roots, 2)



@query(r"""WITH RECURSIVE m(doc, text, pos, s, e) AS (
  SELECT scidoc_id, text, 0, 0, 0 FROM scidoc WHERE regexp_matches(text, '\([A-Z]') UNION ALL
  SELECT doc, text, s2, s2, s2 + 2 FROM (SELECT doc, text, pos + strpos(substr(text, pos + 1), '(') AS s2, strpos(substr(text, pos + 1), '(') AS f FROM m) WHERE f > 0)
, c AS (SELECT doc, s, e, CASE WHEN s - lag(e) OVER (PARTITION BY doc ORDER BY s) <= 7 THEN 0 ELSE 1 END AS new FROM m WHERE s > 0),
k AS (SELECT doc, s, sum(new) OVER (PARTITION BY doc ORDER BY s) AS cluster FROM c)
SELECT doc, s AS start, cluster, count(*) OVER (PARTITION BY doc, cluster) AS multi FROM k""")
def j_citation_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Opening brackets as marks: those at most seven characters apart form a cluster."""
    t = table(spark, d, "scidoc").where(F.col("text").rlike(r"\([A-Z]"))
    at = F.filter(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.when(F.substring(F.col("text"), i, F.lit(1)) == "(", i)), lambda x: x.isNotNull())
    marks = t.select(F.col("scidoc_id").alias("doc"), F.lit(0).alias("sentence"), F.explode(at).alias("start")).withColumn("end", F.col("start") + 2)
    return J.clusters(marks).select("doc", F.col("start").cast("bigint").alias("start"), "cluster", "multi")


#: Edits between two lists of code points, row by row; DuckDB's own function counts bytes.
_EDITS = """list_reduce(list_concat([range(0, len(q.c) + 1)], list_transform(b.c, lambda x: [x])), lambda row, x: list_transform(range(0, len(q.c) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k:
  CASE WHEN k = 0 THEN row[1] + 1 ELSE least(row[k + 1] + 1, row[k] + (q.c[k] <> x[1])::BIGINT) - k END))))"""
_CODES = "list_transform(string_split(t, ''), lambda x: unicode(x)::BIGINT)"


@query(f"""WITH r AS (SELECT rec_id, trim(regexp_replace(regexp_replace(lower(title), '{_SYM}', ' ', 'g'), '\\s+', ' ', 'g')) AS t, nullif(regexp_extract(year, '(1[89]\\d\\d|20\\d\\d)', 1), '') AS y FROM aan_records), p AS (SELECT g, norm_title AS t, nullif(regexp_extract(year, '(1[89]\\d\\d|20\\d\\d)', 1), '') AS y FROM {_CURRENT}),
b AS (SELECT *, {_CODES} AS c, regexp_full_match(t, '[ -~]*') AS plain FROM r WHERE t <> ''), q AS (SELECT *, {_CODES} AS c, regexp_full_match(t, '[ -~]*') AS plain FROM p WHERE t <> ''),
s AS (SELECT rec_id, g, 1 - CASE WHEN b.plain AND q.plain THEN levenshtein(b.t, q.t) ELSE {_EDITS}[len(q.c) + 1] END / greatest(len(b.c), len(q.c)) AS s FROM b JOIN q ON b.y = q.y AND len(b.c) >= 0.9 * len(q.c) AND len(q.c) >= 0.9 * len(b.c))
SELECT DISTINCT rec_id AS ref_id, g AS guid, round(s, 6) AS similarity FROM s WHERE s > 0.9""")
def j_similar_titles(spark: SparkSession, d: str) -> DataFrame:
    """Of all titles; the SQL compares all pairs of a year."""
    title = F.trim(F.regexp_replace(X.remove_symbols(F.lower("title")), r"\s+", " "))
    refs = table(spark, d, "aan_records").select(F.col("rec_id").alias("ref_id"), title.alias("norm_title"), J.year_number("year").alias("year"))
    papers = J.current(table(spark, d, "papers")).select(F.col("GUID").alias("guid"), "norm_title", J.year_number("year").alias("year"))
    return J.similar_titles(refs, papers).withColumn("similarity", F.round("similarity", 6))


@query("""SELECT doc, item, ord FROM (SELECT s.guid AS doc, s.ord * 2 - 1 AS item, max(t.ord) AS ord FROM scidoc s LEFT JOIN (SELECT guid, ord FROM scidoc WHERE elem_type = 'p') t ON s.guid = t.guid AND t.ord <= s.ord WHERE s.elem_type <> 'p' GROUP BY 1, 2)""")
def j_nearest_lower(spark: SparkSession, d: str) -> DataFrame:
    """Each element that is no paragraph goes to the paragraph before it."""
    s = table(spark, d, "scidoc")
    stranded = s.where("elem_type <> 'p'").select(F.col("guid").alias("doc"), (F.col("ord") * 2 - 1).alias("item"), F.col("ord").alias("at")).distinct()
    return D.nearest_lower(stranded, s.where("elem_type = 'p'").select(F.col("guid").alias("doc"), "ord").distinct())


# ---- index and retrieval ----
_FIELDS = {"head": 2.0, "text": 1.0}
_DOCS = "(SELECT doc_id AS guid, 'text' AS field, text AS t FROM documents UNION ALL SELECT doc_id, 'head', regexp_extract(text, '^[^.!?]*') FROM documents)"
_POST = f"(SELECT guid, field, term, count(*) AS tf FROM (SELECT guid, field, unnest(regexp_extract_all(lower(t), '{_T}')) AS term FROM {_DOCS}) WHERE term NOT IN {_STOP} GROUP BY 1, 2, 3)"
_QT = f"(SELECT query_id, term, count(*) AS c FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{_T}')) AS term FROM benchmark) WHERE term NOT IN {_STOP} AND NOT regexp_matches(term, '^\\d') GROUP BY 1, 2)"
_HITS = f"""post AS MATERIALIZED {_POST}, len AS (SELECT guid, field, sum(tf) AS l FROM post GROUP BY 1, 2), tm AS (SELECT field, term, count(*) AS df FROM post GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
hits AS (SELECT query_id, guid, field, term, c * (1 + ln(n / (df + 1))) AS qw, sqrt(tf) * (1 + ln(n / (df + 1))) / sqrt(l) AS fw FROM {_QT} JOIN tm USING (term) JOIN post USING (field, term) JOIN len USING (guid, field), n)"""
_W = "CASE field WHEN 'head' THEN 2.0 ELSE 1.0 END"
_SCORES = f"scores AS (SELECT query_id, guid, sum(qw * fw * {_W}) AS score FROM hits GROUP BY 1, 2)"
_TOP = "ranked AS (SELECT query_id, guid, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, guid) AS rank FROM scores QUALIFY rank <= 200)"


def _shingle_sql(key: str, name: str) -> str:
    return f"(SELECT DISTINCT {key} AS id, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '{_T}') AS w FROM {name}) WHERE len(w) >= 8))"


_MATCH = f"match AS (SELECT DISTINCT b.id AS query_id, d.id AS guid FROM {_shingle_sql('item_id', 'benchmark')} b JOIN {_shingle_sql('doc_id', 'documents')} d USING (s))"


def _index(spark: SparkSession, d: str) -> I.Index:
    """The index of the documents, written once in an application: whole texts, and what stands before their first stop."""

    def make() -> tuple:
        docs = table(spark, d, "documents").select("doc_id", "text", F.regexp_extract("text", "^[^.!?]*", 0).alias("head"))
        index = I.build(docs, "doc_id", ["head", "text"])
        return index.stored.postings, index.stored.terms, index

    return kept(spark, ("index", d), make)[-1]


def _query_terms(spark: SparkSession, d: str) -> DataFrame:
    return I.structured_query(table(spark, d, "benchmark"), "item_id", "text")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return I.formula_hits(_index(spark, d), _query_terms(spark, d))


def _shingles(df: DataFrame, key: str, name: str) -> DataFrame:
    w = X.tokens("text")
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, 8), " "))
    return df.select(F.col(key).alias(name), w.alias("w")).where("size(w) >= 8").select(name, F.explode(F.array_distinct(runs)).alias("s"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share eight words in a row with a query count as its matches. The queries' runs of words are sent to the documents if they are few, counted first."""
    b, x = written(_shingles(table(spark, d, "benchmark"), "item_id", "query_id"), "runs"), _shingles(table(spark, d, "documents"), "doc_id", "guid")
    return x.join(F.broadcast(b) if b.count() <= I.BLOCK_TERMS else b, "s").select("query_id", "guid").distinct()


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.round("score", 9))


def _product_rounded(name: str, n: int) -> Column:
    """To n decimals as the SQL has it: the product with 10^n is rounded. ``F.round`` goes by the decimal digits of the value itself, and differs where these end in a half."""
    return (F.round(F.col(name) * 10.0**n, 0) / 10.0**n).alias(name)


@query(f"WITH post AS {_POST} SELECT field, term, count(*) AS df, sum(tf) AS ttf FROM post GROUP BY 1, 2")
def i_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).stored.terms


@query(f"SELECT query_id, term, c AS count FROM {_QT}")
def i_structured_query(spark: SparkSession, d: str) -> DataFrame:
    return _query_terms(spark, d).select("query_id", "term", "count")


@query(f"WITH {_HITS}, {_SCORES}, {_TOP} SELECT query_id, guid, round(score, 4) AS score FROM ranked WHERE rank <= 10")
def i_top_ten(spark: SparkSession, d: str) -> DataFrame:
    return I.top(_rounded(I.score(_hits(spark, d), _FIELDS)), 10).select("query_id", "guid", F.round("score", 4).alias("score"))


@query(f"WITH {_HITS}, f AS (SELECT query_id, guid, field, sum(qw * fw * {_W}) AS s FROM hits GROUP BY 1, 2, 3), scores AS (SELECT query_id, guid, max(s) + 0.3 * (sum(s) - max(s)) AS score FROM f GROUP BY 1, 2) SELECT query_id, count(*) AS n, round(sum(score), 3) AS total, round(max(score), 4) AS best FROM scores GROUP BY 1")
def i_best_field(spark: SparkSession, d: str) -> DataFrame:
    s = I.score_best_field(_hits(spark, d), _FIELDS, 0.3)
    return s.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("total"), F.round(F.max("score"), 4).alias("best"))


@query(f"WITH {_HITS}, p AS (SELECT query_id, guid, coalesce(sum(qw * fw * 2) FILTER (field = 'head'), 0) AS a, coalesce(sum(qw * fw) FILTER (field = 'text'), 0) AS b, coalesce(sum(qw * fw * 25) FILTER (field = 'text'), 0) AS c FROM hits GROUP BY 1, 2) SELECT query_id, count(*) AS n, round(sum(greatest(a, b) + c), 2) AS total FROM p GROUP BY 1")
def i_clauses(spark: SparkSession, d: str) -> DataFrame:
    s = I.score_clauses(_hits(spark, d), [_FIELDS, {"text": 25.0}])
    return s.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"))


_M_SQL = """b AS (SELECT m.query_id, m.guid, r.rank AS r, count(*) OVER (PARTITION BY m.query_id) AS m, n.n AS n FROM match m JOIN (SELECT query_id, max(rank) AS n FROM ranked GROUP BY 1) n USING (query_id) LEFT JOIN ranked r ON m.query_id = r.query_id AND m.guid = r.guid),
s AS (SELECT *, CASE WHEN count(r) OVER (PARTITION BY query_id) = m THEN max(r) OVER (PARTITION BY query_id) ELSE n END AS stop FROM b),
measured AS (SELECT query_id, avg(CASE WHEN r IS NULL THEN 0.0 WHEN m > 1 AND r <= m THEN 1.0 ELSE 1.0 / r END) AS mrr, avg(CASE WHEN r IS NULL THEN 0.0 WHEN m > 1 AND r <= m OR m = 1 AND r = 1 THEN 1.0 ELSE 0.0 END) AS precision,
 avg(CASE WHEN r IS NULL THEN 0.0 WHEN m > 1 AND r <= m THEN 1.0 ELSE ln(2) / ln(1 + r) END) AS ndcg, floor(sum(CASE WHEN r IS NULL THEN 200 WHEN m > 1 AND r <= m THEN 1 ELSE r END) / first(m))::BIGINT AS rank,
 sum(CASE WHEN r IS NULL THEN 0.0 ELSE list_sum(list_transform(range(r, stop + 1), lambda i: 1.0 / i)) END) / first(m) AS map FROM s GROUP BY 1)"""


@query(f"WITH {_HITS}, {_SCORES}, {_TOP}, {_MATCH}, {_M_SQL} SELECT query_id, round(mrr, 6) AS mrr, round(precision, 6) AS precision, round(ndcg, 6) AS ndcg, rank, round(map, 6) AS map FROM measured")
def i_retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: retrieve for every query, rank, and measure against the matching documents."""
    m = M.measure(I.top(_rounded(I.score(_hits(spark, d), _FIELDS))), _matches(spark, d))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("mrr", "precision", "ndcg")], "rank", F.round("map", 6).alias("map"))


@query(f"""WITH {_HITS}, {_MATCH}, cand AS (SELECT query_id, guid FROM match UNION SELECT query_id, guid + 1 FROM match WHERE guid + 1 IN (SELECT doc_id FROM documents)), nn AS (SELECT query_id, count(DISTINCT guid) AS n FROM cand GROUP BY 1),
own AS (SELECT q.query_id, p.guid, p.field, p.term, p.tf, q.c FROM post p JOIN cand USING (guid) JOIN {_QT} q ON q.query_id = cand.query_id AND q.term = p.term), dfs AS (SELECT query_id, field, term, count(*) AS df FROM own GROUP BY 1, 2, 3)
SELECT query_id, guid, round(sum(c * (1 + ln(n / (df + 1))) * sqrt(tf) * (1 + ln(n / (df + 1))) / sqrt(l) * {_W}), 4) AS score FROM own JOIN dfs USING (query_id, field, term) JOIN nn USING (query_id) JOIN len USING (guid, field) GROUP BY 1, 2 HAVING sum(c * (1 + ln(n / (df + 1))) * sqrt(tf) * (1 + ln(n / (df + 1))) / sqrt(l) * {_W}) > 0""")
def i_within_candidates(spark: SparkSession, d: str) -> DataFrame:
    m = _matches(spark, d)
    there = table(spark, d, "documents").select(F.col("doc_id").alias("guid"))
    cand = m.union(m.select("query_id", F.col("guid") + 1).toDF("query_id", "guid").join(there, "guid", "left_semi").select("query_id", "guid")).distinct()
    return I.score(I.within_candidates(_index(spark, d).stored, _query_terms(spark, d), cand), _FIELDS).withColumn("score", F.round("score", 4))


# ---- metrics ----
@query(f"WITH {_HITS}, {_SCORES}, {_TOP} SELECT query_id, count(*) AS n, round(list_sum(list_transform(range(1, count(*) + 1), lambda i: 1.0 / i)) / count(*), 6) AS mrr, round(1.0 / count(*), 6) AS precision FROM ranked GROUP BY 1")
def m_random_control(spark: SparkSession, d: str) -> DataFrame:
    c = M.random_control(I.top(_rounded(I.score(_hits(spark, d), _FIELDS))))
    return c.select("query_id", "n", F.round("mrr", 6).alias("mrr"), F.round("precision", 6).alias("precision"))




@query(f"""WITH {_HITS}, {_MATCH}, sa AS (SELECT query_id, guid, round(sum(qw * fw * {_W}), 9) AS s FROM hits GROUP BY 1, 2), sb AS (SELECT query_id, guid, round(sum(qw * fw), 9) AS s FROM hits WHERE field = 'text' GROUP BY 1, 2),
r AS (SELECT 'both' AS method, query_id, guid, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, guid) AS r FROM sa UNION ALL SELECT 'text', query_id, guid, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, guid) FROM sb),
h AS (SELECT method, query_id, coalesce(min(r.r), 200) AS best FROM match m JOIN (SELECT * FROM r WHERE r <= 200) r USING (query_id, guid) GROUP BY 1, 2), o AS (SELECT query_id, (count(DISTINCT best) <= 1)::INT AS same FROM h GROUP BY 1) SELECT round(avg(same), 6) AS overlap, count(*) AS n_queries FROM o""")
def m_method_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Two methods agree on a query if their best match has the same rank."""
    hits, matches = _hits(spark, d), _matches(spark, d)
    out = None
    for name, w in (("both", _FIELDS), ("text", {"text": 1.0})):
        t = I.top(_rounded(I.score(hits, w))).join(matches, ["query_id", "guid"]).groupBy("query_id").agg(F.min("rank").alias("rank")).withColumn("method", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return M.method_overlap(out, "method").withColumn("overlap", F.round("overlap", 6))


@query(f"""WITH p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(regexp_extract(text, '^[^.!?]*')), '{_T}')) AS w FROM documents), g AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(regexp_replace(text, '^[^.!?]*', '')), '{_T}')) AS w FROM documents),
n AS (SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, count(*) FILTER (p.w IS NOT NULL AND g.w IS NOT NULL) AS tp, count(p.w) AS np, count(g.w) AS ng FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.w = g.w GROUP BY 1)
SELECT doc_id, round(CASE WHEN np > 0 THEN tp / np ELSE 0 END, 6) AS precision, round(CASE WHEN ng > 0 THEN tp / ng ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (np + ng) ELSE 0 END, 6) AS f1 FROM n""")
def m_set_scores(spark: SparkSession, d: str) -> DataFrame:
    """Words of a document up to its first stop as predictions of the words of its rest."""
    docs = table(spark, d, "documents")
    p = docs.select("doc_id", F.explode(X.tokens(F.regexp_extract("text", "^[^.!?]*", 0))).alias("w"))
    g = docs.select("doc_id", F.explode(X.tokens(F.regexp_replace("text", "^[^.!?]*", ""))).alias("w"))
    return M.set_scores(p, g, "doc_id", "w").select("doc_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


# ---- representations and contexts ----
@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{_T}') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, o AS offset, array_to_string(w[o + 1:o + 50], ' ') AS passage FROM (SELECT doc_id, w, unnest(list_distinct(list_concat(range(0, len(w), 50), range(25, len(w), 50)))) AS o FROM t)""")
def b_passages(spark: SparkSession, d: str) -> DataFrame:
    return D.passages(table(spark, d, "documents"), "doc_id", "text", 50).withColumn("offset", F.col("offset").cast("bigint"))


@query("SELECT guid, coalesce(fmt, 'none') AS zone, md5(string_agg(text, ' ' ORDER BY ord, text)) AS digest FROM scidoc WHERE text IS NOT NULL GROUP BY 1, 2")
def b_zoned(spark: SparkSession, d: str) -> DataFrame:
    return D.zoned(table(spark, d, "scidoc").where("text is not null"), "guid", F.col("fmt")).select("guid", "zone", F.md5(F.col("text").cast("binary")).alias("digest"))


_CTX = f"""c AS (SELECT {_KEY.format('guid')} AS g, doc_id, text FROM documents WHERE source = 'citing_context' AND text IS NOT NULL), e AS {_PAIRS}, ilc AS (SELECT e.b AS guid, string_agg(text, ' ' ORDER BY doc_id, text) AS t, count(*) AS n FROM e JOIN c ON c.g = e.a GROUP BY 1)"""


@query(f"WITH {_CTX} SELECT guid, md5(t) AS digest, n AS n_contexts FROM ilc")
def b_inlink_context(spark: SparkSession, d: str) -> DataFrame:
    """Citing contexts of each cited paper, read block by block."""
    return D.digests(_inlink(spark, d)).select("guid", "digest", "n_contexts")


def _inlink(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source = 'citing_context'").select(guid_key("guid").alias("guid"), F.col("doc_id").alias("ctx_id"), "text")
    links = table(spark, d, "links").select(guid_key("GUID_from").alias("guid"), guid_key("GUID_to").alias("to")).where("guid <> '' and `to` <> ''").distinct()
    return D.inlink_blocks(docs, links)


@query(f"""WITH {_CTX}, own AS (SELECT {_KEY.format('guid')} AS guid, string_agg(text, ' ' ORDER BY doc_id, text) AS t FROM documents WHERE source = 'abstract' AND text IS NOT NULL GROUP BY 1)
SELECT guid, md5(trim(concat_ws(' ', own.t, ilc.t))) AS digest FROM own FULL JOIN ilc USING (guid)""")
def b_mashup(spark: SparkSession, d: str) -> DataFrame:
    own = D.ordered_text(table(spark, d, "documents").where("source = 'abstract' and text is not null").withColumn("guid", guid_key("guid")), ["guid"], order="doc_id")
    blocks = own.select("guid", F.lit(-1).cast("bigint").alias("block"), "text", F.lit(0).cast("bigint").alias("n_contexts")).unionByName(_inlink(spark, d))
    return D.digests(blocks, trim=True).select("guid", "digest")


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{_T}') AS w FROM documents), p AS (SELECT doc_id, w, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'al')) AS p FROM t)
SELECT doc_id, p, m AS method, array_to_string(list_concat(w[greatest(p - l, 1):p - 1], w[p + 1:p + r]), ' ') AS words FROM p CROSS JOIN (VALUES ('window5_5', 5, 5), ('window20_20', 20, 20)) v(m, l, r)""")
def q_word_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of two sizes around every ``al`` (of et al.) of each document."""
    t = table(spark, d, "documents").select("doc_id", X.tokens("text").alias("w"))
    t = t.select("doc_id", "w", F.explode(F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: F.get("w", i - 1) == "al")).alias("p"))
    return t.select("doc_id", F.col("p").cast("bigint").alias("p"), F.explode(D.word_windows(F.col("w"), F.col("p"), [(5, 5), (20, 20)])).alias("x")).select("doc_id", "p", "x.method", F.array_join("x.words", " ").alias("words"))


_SENT = "(SELECT guid AS doc, min(parent) AS para, ord, min(text) AS text FROM scidoc WHERE parent IS NOT NULL GROUP BY guid, ord)"


@query(f"""SELECT c.doc, c.ord AS cit_ord, s.ord, md5(s.text) AS digest FROM {_SENT} c JOIN {_SENT} s ON c.doc = s.doc AND s.ord BETWEEN c.ord - 2 AND c.ord + 1 AND c.para = s.para WHERE contains(c.text, '(')""")
def q_sentence_window(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scidoc").where("parent is not null").groupBy(F.col("guid").alias("doc"), "ord").agg(F.min("parent").alias("para"), F.min("text").alias("text"))
    c = s.where(F.contains("text", F.lit("("))).select("doc", F.col("ord").alias("cit_ord"), F.col("text").alias("ct"))
    w = D.sentence_window(s, c, "2up_1down_withinpara")
    return w.select("doc", "cit_ord", "ord", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("WITH t AS (SELECT doc_id, length(text) AS n, string_split(text, 'et al') AS parts FROM documents WHERE contains(text, 'et al')), k AS (SELECT doc_id, n, parts, unnest(range(1, len(parts))) AS k FROM t) SELECT doc_id, k, CAST(floor((list_sum(list_transform(parts[1:k], lambda x: length(x))) + 5 * (k - 1)) / n * 10) + 1 AS INTEGER) AS chunk FROM k")
def q_position(spark: SparkSession, d: str) -> DataFrame:
    """The tenth of its document that each ``et al`` stands in."""
    t = table(spark, d, "documents").where(F.contains("text", F.lit("et al"))).select("doc_id", F.length("text").alias("n"), F.split("text", "et al", -1).alias("parts"))
    t = t.select("doc_id", "n", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    at = F.aggregate(F.slice("parts", F.lit(1), F.col("k")), F.lit(0), lambda s, x: s + F.length(x)) + 5 * (F.col("k") - 1)
    return t.select("doc_id", F.col("k").cast("bigint").alias("k"), D.position_chunk(at, F.col("n"), 10).alias("chunk"))


# ---- keywords ----
@query(f"WITH {_HITS} SELECT query_id, count(*) AS n, round(sum(s), 3) AS total FROM (SELECT query_id, guid, term, max(qw * fw) AS s FROM hits GROUP BY 1, 2, 3) GROUP BY 1")
def k_term_scores(spark: SparkSession, d: str) -> DataFrame:
    return K.term_scores(_hits(spark, d)).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("total"))


_NORM = f"""ts AS (SELECT query_id, guid, term, max(qw * fw) AS s FROM hits SEMI JOIN (SELECT query_id, guid FROM ranked UNION SELECT query_id, guid FROM match) USING (query_id, guid) GROUP BY 1, 2, 3), sums AS (SELECT query_id, term, sum(s) AS raw FROM ts SEMI JOIN ranked USING (query_id, guid) GROUP BY 1, 2),
own AS (SELECT ts.*, coalesce(raw, 0) AS raw FROM ts SEMI JOIN match USING (query_id, guid) LEFT JOIN sums USING (query_id, term)),
a AS (SELECT *, s / sum(s) OVER (PARTITION BY query_id, guid) / power(1 + raw, 2) AS x FROM own), nrm AS (SELECT query_id, guid, term, x / sum(x) OVER (PARTITION BY query_id, guid) AS s FROM a), comb AS (SELECT query_id, term, sum(s) AS score FROM nrm GROUP BY 1, 2)"""
_KW = f"{_HITS}, {_SCORES}, {_TOP}, {_MATCH}, {_NORM}"


def _explained(spark: SparkSession, d: str) -> tuple[I.Index, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The index, the query terms, the 200 retrieved of each query, its matches, and the leaves of both."""
    index = _index(spark, d)

    def make() -> tuple:
        q = written(_query_terms(spark, d), "terms")
        return q, written(_matches(spark, d), "matches"), written(I.retrieved(index, q, _FIELDS).select("query_id", "guid", "rank"), "top")

    q, m, top = kept(spark, ("retrieved", d), make)
    return index, q, top, m, I.formula_hits(index, q, pairs=top.select("query_id", "guid").union(m))


def _combined(spark: SparkSession, d: str) -> tuple[DataFrame, I.Index, DataFrame, DataFrame]:
    index, q, top, m, hits = _explained(spark, d)
    return written(K.combine(K.normalised(K.term_scores(hits), m, top)), "combined"), index, q, m


@query(f"WITH {_KW} SELECT query_id, term, round(score, 6) AS score FROM comb")
def k_normalised(spark: SparkSession, d: str) -> DataFrame:
    return _combined(spark, d)[0].withColumn("score", F.round("score", 6))


@query(f"WITH {_KW} SELECT query_id, term, rank FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, term) AS rank FROM comb) WHERE rank <= 8")
def k_best_terms(spark: SparkSession, d: str) -> DataFrame:
    return K.best(_rounded(_combined(spark, d)[0]), 8).select("query_id", "term", "rank")


@query(f"""WITH {_KW}, rt AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, term) AS n FROM comb), part AS (SELECT query_id, guid, n, sum(qw * fw * {_W}) AS s FROM hits JOIN rt USING (query_id, term) GROUP BY 1, 2, 3),
grid AS (SELECT query_id, guid, unnest(range(1, last + 1)) AS n FROM (SELECT DISTINCT query_id, guid FROM part) JOIN (SELECT query_id, max(n) AS last FROM rt GROUP BY 1) USING (query_id)),
run AS (SELECT query_id, guid, n, round(sum(coalesce(s, 0)) OVER (PARTITION BY query_id, guid ORDER BY n), 7) AS r FROM grid LEFT JOIN part USING (query_id, guid, n)),
rk AS (SELECT query_id, guid, n, row_number() OVER (PARTITION BY query_id, n ORDER BY r DESC, guid) AS rank FROM run WHERE r > 0), av AS (SELECT query_id, n, avg(rank) AS rank FROM rk SEMI JOIN match USING (query_id, guid) GROUP BY 1, 2)
SELECT query_id, arg_min(n, (round(rank, 9), n))::INT AS n_terms, round(min(rank), 6) AS rank FROM av GROUP BY 1""")
def k_minimal_set(spark: SparkSession, d: str) -> DataFrame:
    """The shortest list of a query's best terms, of all their number, that ranks its matches best among all documents."""
    s, index, q, m = _combined(spark, d)
    return K.minimal_set_of(index, q, _rounded(s), m, _FIELDS).withColumn("rank", F.round("rank", 6))


_Q = "OVER (PARTITION BY query_id)"
_UP, _DOWN = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term)", "row_number() OVER (PARTITION BY query_id ORDER BY score, term DESC)"
_SIG = "1 / (1 + exp(-({})))"
_RAW_TRANSFORMS = {
    "multiply": "score * 2", "add": "score + 1", "constant": "1.0::DOUBLE", "top": f"CASE WHEN {_UP} <= 3 THEN score * 1.1 ELSE score END", "bottom": f"CASE WHEN {_DOWN} <= 3 THEN score * 10 ELSE score END",
    "extremes": f"CASE WHEN {_UP} <= 3 THEN score * 2 WHEN {_DOWN} <= 3 THEN score * 0.5 ELSE score END", "invert": "CASE WHEN score = 0 THEN NULL ELSE 1 / score END", "raise_low": f"CASE WHEN score < mx / count(*) {_Q} THEN score * 10 ELSE score END",
    "by_max": "score / mx", "sigmoid": _SIG.format("score / mx"), "power": "score * score", "over_sigmoid": f"score / ({_SIG.format('score')})", "quadratic": "score * (1 + power(score / mx - mx / 2, 2))", "tanh": "score * tanh(score)",
}


_WEIGHTS = "c AS (SELECT query_id, term, round(score, 9) AS score, max(round(score, 9)) OVER (PARTITION BY query_id) AS mx FROM comb), tw AS (SELECT query_id, term, " + ", ".join(f'{x} AS "{n}"' for n, x in _RAW_TRANSFORMS.items()) + " FROM c)"


@query(f"""WITH {_KW}, {_WEIGHTS}, few AS MATERIALIZED (SELECT query_id, guid, term, sum(qw * fw * {_W}) AS s FROM hits SEMI JOIN match USING (query_id) GROUP BY 1, 2, 3), lw AS (UNPIVOT tw ON {", ".join(f'"{n}"' for n in _RAW_TRANSFORMS)} INTO NAME transform VALUE weight),
sc AS (SELECT transform, query_id, guid, sum(s * weight) AS s FROM few JOIN lw USING (query_id, term) GROUP BY 1, 2, 3 HAVING sum(s * weight) > 0), rk AS (SELECT transform, query_id, guid, row_number() OVER (PARTITION BY transform, query_id ORDER BY round(ln(s), 9) DESC, guid) AS r FROM sc QUALIFY r <= 200),
there AS (SELECT DISTINCT transform, query_id FROM rk), b AS (SELECT transform, query_id, guid, r, count(*) OVER (PARTITION BY transform, query_id) AS m FROM there JOIN match USING (query_id) LEFT JOIN rk USING (transform, query_id, guid)),
q AS (SELECT transform, query_id, avg(CASE WHEN r IS NULL THEN 0.0 WHEN m > 1 AND r <= m THEN 1.0 ELSE ln(2) / ln(1 + r) END) AS ndcg FROM b GROUP BY 1, 2) SELECT transform, count(*) AS n_queries, round(avg(ndcg), 6) AS ndcg FROM q GROUP BY 1""")
def k_compare_transforms(spark: SparkSession, d: str) -> DataFrame:
    """Every transform but the two random ones."""
    s, index, q, m = _combined(spark, d)
    near = _explained(spark, d)[2].select("query_id", "guid")
    return K.compare_transforms(index, q, _rounded(s).withColumnRenamed("score", "weight"), m, near, _FIELDS, list(_RAW_TRANSFORMS)).withColumn("ndcg", F.round("ndcg", 6))


@query(f"WITH {_KW}, c AS (SELECT query_id, term, round(score, 9) AS score, max(round(score, 9)) {_Q} AS mx FROM comb), t AS (SELECT query_id, term, " + ", ".join(f'{x} AS "{n}"' for n, x in _RAW_TRANSFORMS.items()) + " FROM c) SELECT query_id, term, "
       + ", ".join(f'round("{n}"{f" / max({chr(34)}{n}{chr(34)}) {_Q}" if n in K.SCALED else ""}, {3 if n == "invert" else 6}) AS "{n}"' for n in _RAW_TRANSFORMS) + " FROM t")
def k_transforms(spark: SparkSession, d: str) -> DataFrame:
    """Every transform but the two random ones, side by side."""
    w = _rounded(_combined(spark, d)[0]).withColumnRenamed("score", "weight")
    return K.transform_all(w, list(_RAW_TRANSFORMS)).select("query_id", "term", *[_product_rounded(n, 3 if n == "invert" else 6) for n in _RAW_TRANSFORMS])


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{_T}') AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t WHERE len(w) >= 2))
SELECT doc_id, a || ' ' || b AS ngram, count(*) AS n FROM g WHERE a NOT IN {_STOP} AND b NOT IN {_STOP} GROUP BY 1, 2 HAVING count(*) >= 2""")
def k_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return K.ngrams(table(spark, d, "documents"), "doc_id", X.tokens("text"), 2, 2, X.STOPWORDS)


@query(f"WITH post AS {_POST}, t AS (SELECT field, term, count(*) AS df FROM post GROUP BY 1, 2) SELECT field, term, df FROM t WHERE df >= 0.4 * (SELECT max(df) FROM t) AND length(term) BETWEEN 2 AND 6")
def k_corpus_stopwords(spark: SparkSession, d: str) -> DataFrame:
    return K.corpus_stopwords(_index(spark, d).stored.terms)


# ---- reports ----
_PIV = "SELECT CASE WHEN lang IS NULL THEN 'none' ELSE lower(lang) END AS lang, source, n_chars FROM documents WHERE source IN ('abstract', 'review', 'introduction')"


@query(f"""WITH p AS (SELECT lang, avg(n_chars) FILTER (source = 'abstract') AS abstract, avg(n_chars) FILTER (source = 'review') AS review, avg(n_chars) FILTER (source = 'introduction') AS introduction FROM ({_PIV}) GROUP BY 1),
m AS (SELECT *, (coalesce(abstract, 0) + coalesce(review, 0) + coalesce(introduction, 0)) / nullif((abstract IS NOT NULL)::INT + (review IS NOT NULL)::INT + (introduction IS NOT NULL)::INT, 0) AS "Mean" FROM p),
a AS (SELECT * FROM m UNION ALL SELECT 'Mean', avg(abstract), avg(review), avg(introduction), avg("Mean") FROM m), x AS (SELECT *, greatest(abstract, review, introduction, "Mean") AS "Max" FROM a), y AS (SELECT * FROM x UNION ALL SELECT 'Max', max(abstract), max(review), max(introduction), max("Mean"), max("Max") FROM x)
SELECT lang, round(abstract, 5) AS abstract, round(review, 5) AS review, round(introduction, 5) AS introduction, round("Mean", 5) AS "Mean", round("Max", 5) AS "Max" FROM y""")
def a_pivot_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("source in ('abstract', 'review', 'introduction')").select(F.coalesce(F.lower("lang"), F.lit("none")).alias("lang"), "source", "n_chars")
    return A.pivot_means(rows, "lang", "source", "n_chars", ["abstract", "review", "introduction"])


@query("SELECT source, lang, mean FROM (SELECT source, lang, round(avg(n_chars), 6) AS mean, row_number() OVER (PARTITION BY source ORDER BY avg(n_chars) DESC NULLS LAST, lang) AS k FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) WHERE k = 1")
def a_best_method(spark: SparkSession, d: str) -> DataFrame:
    b = A.best_method(table(spark, d, "documents").where("lang is not null"), "source", "lang", "n_chars")
    return b.select("source", "lang", F.round("mean", 6).alias("mean"))


@query("WITH z AS (SELECT coalesce(fmt, 'none') AS zone, count(*) AS n FROM scidoc GROUP BY 1), r AS (SELECT zone, n, n / sum(n) OVER () AS ratio FROM z) SELECT zone, n, round(ratio, 6) AS ratio FROM r UNION ALL SELECT 'total', sum(n), round(sum(ratio), 6) FROM r")
def a_zone_totals(spark: SparkSession, d: str) -> DataFrame:
    return A.zone_totals(table(spark, d, "scidoc"), F.col("fmt")).withColumn("ratio", F.round("ratio", 6))


@query(f"SELECT nullif(regexp_extract(year, '(1[89]\\d\\d|20\\d\\d)', 1), '')::INT AS year, count(*) AS n FROM {_CURRENT} GROUP BY 1")
def a_years(spark: SparkSession, d: str) -> DataFrame:
    return A.per_year(J.current(table(spark, d, "papers")), J.year_number("year"))


@query(f"WITH post AS {_POST}, t AS (SELECT term, sum(tf) AS c FROM post WHERE field = 'text' GROUP BY 1), s AS (SELECT v.size, right(term, v.size) AS suffix, sum(c) AS n FROM t, (VALUES (2), (3), (4)) v(size) WHERE length(term) > v.size GROUP BY 1, 2) SELECT size, suffix, n FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY n DESC, suffix) AS k FROM s) WHERE k <= 50")
def a_suffixes(spark: SparkSession, d: str) -> DataFrame:
    return A.suffixes(_index(spark, d).stored.terms.where("field = 'text'"), "term", F.col("ttf"))


@query("SELECT bucket, count(*) AS n, round(avg(n_chars), 6) AS mean FROM (SELECT n_chars, ntile(50) OVER (ORDER BY doc_id) AS bucket FROM documents) GROUP BY 1")
def a_smoothed(spark: SparkSession, d: str) -> DataFrame:
    return A.smoothed(table(spark, d, "documents").select("doc_id", "n_chars"), ["doc_id"], "n_chars", 50).withColumn("mean", F.round("mean", 6))


@query('SELECT lang, CAST((k + 1) / 2 AS INTEGER) AS pair, n_chars AS "first", second FROM (SELECT lang, n_chars, row_number() OVER w AS k, lead(n_chars) OVER w AS second FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id)) WHERE k % 2 = 1 AND second IS NOT NULL')
def a_pairs(spark: SparkSession, d: str) -> DataFrame:
    return A.consecutive_pairs(table(spark, d, "documents"), "lang", ["doc_id"], "n_chars")


@query("SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS n_both, count(*) FILTER (a.k IS NULL OR b.k IS NULL) AS n_one, round(count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) / count(*), 6) AS share FROM (SELECT DISTINCT guid AS k FROM documents WHERE guid IS NOT NULL) a FULL JOIN (SELECT DISTINCT guid AS k FROM scidoc WHERE guid IS NOT NULL) b ON a.k = b.k")
def o_overlap(spark: SparkSession, d: str) -> DataFrame:
    return A.overlap(table(spark, d, "documents"), table(spark, d, "scidoc"), "guid").withColumn("share", F.round("share", 6))


@query("SELECT guid FROM documents WHERE guid IS NOT NULL UNION SELECT guid FROM scidoc WHERE guid IS NOT NULL")
def o_union(spark: SparkSession, d: str) -> DataFrame:
    return A.union_keys([table(spark, d, "documents"), table(spark, d, "scidoc")], "guid")


# ---- similarity: items bought together stand for papers cited together ----
_CC = "c AS (SELECT DISTINCT l_orderkey AS place, l_partkey AS item FROM lineitem), n AS (SELECT item, count(*) AS n FROM c GROUP BY 1), t AS (SELECT x.item AS a, y.item AS b, count(*) AS together FROM c x JOIN c y ON x.place = y.place AND x.item < y.item GROUP BY 1, 2), s AS (SELECT a, b, together, together / (na.n + nb.n) AS dice FROM t JOIN n na ON na.item = a JOIN n nb ON nb.item = b)"


def _similar(spark: SparkSession, d: str) -> DataFrame:
    return G.dice(*G.cocitation(table(spark, d, "lineitem"), "l_orderkey", "l_partkey"))


@query(f"WITH {_CC} SELECT a, b, together, round(dice, 6) AS dice FROM s")
def g_dice(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d).withColumn("dice", F.round("dice", 6))


@query(f"""WITH {_CC}, d AS (SELECT a, b, dice FROM s UNION ALL SELECT b, a, dice FROM s), seeds AS (SELECT DISTINCT l_suppkey AS set_id, l_partkey AS item FROM lineitem), sc AS (SELECT set_id, b AS item, sum(dice) AS score FROM seeds JOIN d ON d.a = seeds.item GROUP BY 1, 2)
SELECT set_id, item, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY round(score, 9) DESC, item) AS k FROM sc ANTI JOIN seeds USING (set_id, item)) WHERE k <= 5""")
def g_expand(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    seeds = items.select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("item")).distinct()
    return G.expand(G.stored_dice(items, "l_orderkey", "l_partkey"), seeds, 5, stored=True).select("set_id", "item", _product_rounded("score", 6))


# ---- sequences and features ----
@query("""WITH t AS (SELECT *, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events), r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM t)
SELECT event_id, pos - min(pos) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS dist, lag(event_type, 1) OVER w AS prev_1, lag(event_type, 2) OVER w AS prev_2 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY pos)""")
def w_distance(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    t = W.distance_to(e, "user_id", "pos", F.col("event_type") == "purchase")
    return W.previous(t, "user_id", "pos", "event_type", 2).select("event_id", "dist", "prev_1", "prev_2")


_SS = "(SELECT DISTINCT guid AS doc, parent AS para, ord FROM scidoc WHERE parent IS NOT NULL)"


@query(f"""WITH h AS (SELECT doc, para, ord, (ord % 4 = 1) AS hd FROM {_SS}), s AS (SELECT *, sum(hd::INT) OVER (PARTITION BY doc ORDER BY ord) AS section_no FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY doc, section_no ORDER BY ord) AS i, count(*) OVER (PARTITION BY doc, section_no) AS n, row_number() OVER (PARTITION BY doc, para ORDER BY ord) AS j, count(*) OVER (PARTITION BY doc, para) AS m FROM s)
SELECT doc, ord, section_no, least(i - 1, 10) AS since_header, least(j, 10) AS in_paragraph, CAST(floor((i - 1) * 5 / n) AS INT) + 1 AS section_slice, CAST(floor((j - 1) * 3 / m) AS INT) + 1 AS paragraph_slice FROM r""")
def w_positional(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scidoc").where("parent is not null").select(F.col("guid").alias("doc"), F.col("parent").alias("para"), "ord").distinct().withColumn("is_header", F.col("ord") % 4 == 1)
    return W.positional(s).select("doc", "ord", "section_no", "since_header", "in_paragraph", "section_slice", "paragraph_slice")


@query("SELECT guid AS doc, ord, max(coalesce(contains(text, '('), false)::INT) OVER (PARTITION BY guid ORDER BY ord ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS near FROM (SELECT guid, ord, min(text) AS text FROM scidoc GROUP BY 1, 2)")
def w_near(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scidoc").groupBy(F.col("guid").alias("doc"), "ord").agg(F.min("text").alias("text"))
    return W.near(s, F.contains("text", F.lit("("))).select("doc", "ord", "near")


@query(f"""WITH t AS (SELECT doc_id AS ctx, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_T}') AS w FROM documents)), p AS (SELECT ctx, w[i] AS a, w[i + 1] AS b FROM t WHERE i < len(w)), n AS (SELECT ctx, a, b, count(*) AS n FROM p GROUP BY 1, 2, 3),
s AS (SELECT *, sum(n) OVER (PARTITION BY ctx, a) AS na, sum(n) OVER (PARTITION BY ctx, b) AS nb, sum(n) OVER (PARTITION BY ctx) AS al FROM n), c AS (SELECT ctx, a, b, n, CASE WHEN (na::DOUBLE * (al - na) * nb * (al - nb)) > 0 THEN al * power(n::DOUBLE * (al - na - nb + n) - (na - n)::DOUBLE * (nb - n), 2) / (na::DOUBLE * (al - na) * nb * (al - nb)) ELSE 0 END AS chi2 FROM s)
SELECT ctx, a, b, n, round(chi2, 6) AS chi2 FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY round(chi2, 9) DESC, a, b) AS k FROM c) WHERE k <= 20""")
def w_bigrams(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("doc_id").alias("ctx"), F.posexplode(X.tokens("text")).alias("pos", "word"))
    return W.best_bigrams(t, "ctx", "pos", "word").withColumn("chi2", F.round("chi2", 6))


@query(f"WITH post AS {_POST}, t AS (SELECT term, count(*) AS df FROM post WHERE field = 'text' GROUP BY 1), n AS (SELECT count(*) AS n FROM documents) SELECT guid, round(sum(sqrt(tf) * (1 + ln(n / (df + 1)))), 4) AS weight, count(*) AS n_terms FROM post JOIN t USING (term), n WHERE field = 'text' GROUP BY 1")
def x_tf_idf(spark: SparkSession, d: str) -> DataFrame:
    i = _index(spark, d).stored
    t = i.postings.where("field = 'text'").join(i.terms.where("field = 'text'").select("term", "df"), "term").withColumn("n_docs", i.n_docs.scalar())
    return t.groupBy("guid").agg(F.round(F.sum(L.tf_idf(F.col("tf"), F.col("df"), F.col("n_docs"))), 4).alias("weight"), F.count("*").alias("n_terms"))


@query("SELECT full_name, regexp_matches(full_name, '[0-9]') AS has_num, len(regexp_extract_all(full_name, '[A-Z]')) AS caps_num, round(CASE WHEN length(full_name) > 0 THEN len(regexp_extract_all(full_name, '[A-Z]')) / length(full_name) ELSE 0 END, 6) AS caps_ratio FROM (SELECT DISTINCT full_name FROM authors WHERE full_name IS NOT NULL)")
def x_surface(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = L.surface(F.col("full_name"))
    return table(spark, d, "authors").where("full_name is not null").select("full_name").distinct().select("full_name", a.alias("has_num"), b.cast("bigint").alias("caps_num"), F.round(c, 6).alias("caps_ratio"))


@query("SELECT doc_id, round(coalesce(n_chars::DOUBLE / nullif(max(n_chars) OVER (PARTITION BY source), 0), 0), 6) AS by_max, round(coalesce((n_chars - min(n_chars) OVER (PARTITION BY source))::DOUBLE / nullif(max(n_chars) OVER (PARTITION BY source) - min(n_chars) OVER (PARTITION BY source), 0), 0), 6) AS min_max, ntile(4) OVER (ORDER BY doc_id) - 1 AS fold FROM documents")
def x_normalise(spark: SparkSession, d: str) -> DataFrame:
    t = L.scaled(L.folds(table(spark, d, "documents").select("doc_id", "n_chars", "source"), ["doc_id"], 4), "n_chars", "source")
    return t.select("doc_id", F.round("by_max", 6).alias("by_max"), F.round("min_max", 6).alias("min_max"), "fold")


@query(None)
def x_greedy_weights(spark: SparkSession, d: str) -> DataFrame:
    """Trained field weights with the mean NDCG they reach."""
    w, v = L.greedy_weights(_hits(spark, d), _matches(spark, d), ["head", "text"])
    return spark.createDataFrame([(f, x, v) for f, x in w.items()], "field string, weight double, ndcg double")


# ---- experiments and streams ----
@query(None)
def e_experiment(spark: SparkSession, d: str) -> DataFrame:
    """Two representations by two query windows, measured."""
    from lectern.plans.experiment import run

    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("guid"), "text")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    m = _matches(spark, d).select("query_id", F.col("guid").cast("string").alias("guid"))
    out = run({"doc_methods": {"full_text": {}, "passage": {"parameters": [100]}}, "query_methods": {"whole": {}, "window": {"parameters": [20]}}}, docs, q, m)
    return out.select("doc_method", "query_method", "n_queries", *[F.round(f"avg_{c}", 6).alias(f"avg_{c}") for c in ("mrr", "ndcg")])


@query("SELECT collection_id, count(*) AS n FROM papers WHERE year IS NOT NULL AND (lower(collection_id) = 'aac' OR lower(norm_title) LIKE 'does %') AND year <> '2005' AND num_inlinks >= 1 GROUP BY 1")
def e_conditions(spark: SparkSession, d: str) -> DataFrame:
    """A condition string over the store."""
    from lectern.plans.conditions import parse

    p = table(spark, d, "papers").where(F.col("year").isNotNull() & parse('(collection_id:AAC OR norm_title:"does *") AND NOT year:2005 AND num_inlinks:>=1'))
    return p.groupBy("collection_id").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windowed aggregation of the stream, over the table."""
    from lectern.streaming.ingest import windowed

    return windowed(table(spark, d, "events"), "ts", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    from lectern.streaming.ingest import sessions

    return sessions(table(spark, d, "events"), "ts", "user_id")


# ---- further operators ----
@query(f"WITH {_HITS}, dl AS (SELECT guid, sum(l) AS l FROM len GROUP BY 1), h AS (SELECT query_id, guid, sum(c * power(1 + ln(n / (df + 1)), 2) * sqrt(tf) / sqrt(dl.l) * {_W}) AS s FROM {_QT} JOIN tm USING (term) JOIN post USING (field, term) JOIN dl USING (guid), n GROUP BY 1, 2) SELECT query_id, count(*) AS n, round(sum(s), 3) AS total FROM h WHERE s > 0 GROUP BY 1")
def i_document_norm(spark: SparkSession, d: str) -> DataFrame:
    s = I.score(I.formula_hits(_index(spark, d), _query_terms(spark, d), "document"), _FIELDS)
    return s.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("total"))


@query(f"WITH post AS {_POST}, t AS (SELECT field, term, count(*) AS df, sum(tf) AS ttf FROM post GROUP BY 1, 2) SELECT field, term, df FROM t WHERE df BETWEEN 3 AND 200 AND length(term) >= 4 AND regexp_full_match(term, '[a-z]+')")
def f_term_filter(spark: SparkSession, d: str) -> DataFrame:
    from lectern.operators.terms import filter_terms

    return filter_terms(_index(spark, d).stored.terms, 3, 200, 4).where(F.col("term").rlike("^[a-z]+$")).select("field", "term", "df")


@query(f"""WITH w AS (SELECT DISTINCT g AS guid, unnest(regexp_extract_all(lower(norm_title), '{_T}')) AS term FROM {_CURRENT}), e AS {_PAIRS} SELECT e.a AS guid, e.b AS "to", count(*) AS n_shared FROM e JOIN w x ON x.guid = e.a JOIN w y ON y.guid = e.b AND y.term = x.term GROUP BY 1, 2""")
def j_shared_terms(spark: SparkSession, d: str) -> DataFrame:
    """Words of a citing paper's title that the cited one's has too."""
    from lectern.operators.terms import shared_terms

    p = J.current(table(spark, d, "papers")).select(F.col("GUID").alias("guid"), F.explode(X.tokens("norm_title")).alias("term"))
    links = table(spark, d, "links").select(guid_key("GUID_from").alias("guid"), guid_key("GUID_to").alias("to")).where("guid <> '' and `to` <> ''")
    return shared_terms(p, links)


@query(f"""WITH a AS (SELECT rec_id, nullif(regexp_extract(year, '(1[89]\\d\\d|20\\d\\d)', 1), '') AS y, {_SN.format('author')} AS s FROM aan_records), p AS (SELECT g, nullif(regexp_extract(year, '(1[89]\\d\\d|20\\d\\d)', 1), '') AS y, {_SN.format('surnames')} AS s FROM {_CURRENT})
SELECT DISTINCT rec_id AS ref_id, g AS guid FROM a JOIN p ON a.y = p.y AND len(p.s) > 0 AND len(list_intersect(a.s, p.s)) > 0 WHERE len(list_filter(p.s, lambda x: len(list_filter(a.s, lambda z: contains(z, x))) > 0)) / len(p.s) >= 0.95""")
def j_author_overlap(spark: SparkSession, d: str) -> DataFrame:
    from lectern.operators.terms import author_overlap_matches

    refs = table(spark, d, "aan_records").select(F.col("rec_id").alias("ref_id"), J.year_number("year").alias("year"), J.names("author").alias("names"))
    papers = J.current(table(spark, d, "papers")).select(F.col("GUID").alias("guid"), J.year_number("year").alias("year"), J.names("surnames").alias("surnames"))
    return author_overlap_matches(refs, papers)


@query(r"""WITH s AS (SELECT guid AS doc, ord, min(text) AS text FROM scidoc WHERE text IS NOT NULL GROUP BY 1, 2), f AS (SELECT *, CASE WHEN coalesce(regexp_matches(lag(text) OVER (PARTITION BY doc ORDER BY ord), 'et al\.\s*$'), false) THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY ord) AS k FROM f)
SELECT doc, min(ord) AS ord, md5(string_agg(text, ' ' ORDER BY ord)) AS digest FROM g GROUP BY doc, k""")
def t_merge_et_al(spark: SparkSession, d: str) -> DataFrame:
    from lectern.operators.terms import merge_after_et_al

    s = table(spark, d, "scidoc").where("text is not null").groupBy(F.col("guid").alias("doc"), "ord").agg(F.min("text").alias("text"))
    return merge_after_et_al(s).select("doc", "ord", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(r"SELECT scidoc_id, coalesce(regexp_matches(text, '(?i)\bwe\s+(?:compare|estimate|measure)\b|\bfollowing\s+\w+'), false) AS F_own FROM scidoc")
def t_formulaic(spark: SparkSession, d: str) -> DataFrame:
    from lectern.functions.annotate import formulaic

    f = formulaic("text", {"own": ["we @ACT", "following NN"]}, {"ACT": ["compare", "estimate", "measure"]})
    return table(spark, d, "scidoc").select("scidoc_id", f["F_own"].alias("F_own"))


@query(f"""WITH k AS (SELECT scidoc_id, elem_type, lower(coalesce(lang, 'none')) AS zone, text FROM scidoc WHERE text IS NOT NULL) SELECT zone, elem_type, count(*) AS n, sum(len(regexp_extract_all(lower(text), '{_T}'))) AS n_tokens FROM k GROUP BY ROLLUP (zone, elem_type)""")
def a_zone_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Corpus statistics by zone and element type with all subtotals."""
    s = table(spark, d, "scidoc").where("text is not null").select(F.coalesce(F.lower("lang"), F.lit("none")).alias("zone"), "elem_type", F.size(X.tokens("text")).alias("k"))
    return s.rollup("zone", "elem_type").agg(F.count("*").alias("n"), F.sum("k").alias("n_tokens"))


_RANK = ", ".join(f"""g{i} AS (SELECT k.doc_id, k.b AS term, 0.15 + 0.85 * sum(g.s / o.n) AS s FROM e k JOIN o ON o.doc_id = k.doc_id AND o.a = k.a JOIN g{i - 1} g ON g.doc_id = k.doc_id AND g.term = k.a GROUP BY 1, 2)""" for i in range(1, 6))


@query(f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{_T}'), lambda x: x NOT IN {_STOP}) AS w FROM documents), p AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t)), e AS (SELECT DISTINCT doc_id, a, b FROM (SELECT * FROM p UNION ALL SELECT doc_id, b, a FROM p) WHERE a <> b),
o AS (SELECT doc_id, a, count(*) AS n FROM e GROUP BY 1, 2), g0 AS (SELECT doc_id, a AS term, 1.0 AS s FROM o), {_RANK}, all_words AS (SELECT doc_id, regexp_extract_all(lower(text), '{_T}') AS w FROM documents), f AS (SELECT DISTINCT doc_id, unnest([w[i], w[i + 1]]) AS term FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM all_words) WHERE w[i] NOT IN {_STOP} AND w[i + 1] NOT IN {_STOP})
SELECT doc_id, term, round(s, 6) AS score FROM g5 SEMI JOIN f USING (doc_id, term)""")
def k_keyphrases(spark: SparkSession, d: str) -> DataFrame:
    """Words that rank high in a document's graph and stand in its phrases."""
    from lectern.operators.terms import text_rank

    docs = table(spark, d, "documents")
    r = text_rank(docs, "doc_id", "text", 5).select("doc_id", F.col("term"), F.round("score", 6).alias("score"))
    phrase = K.ngrams(docs, "doc_id", X.tokens("text"), 2, 1, X.STOPWORDS).select("doc_id", F.explode(F.split("ngram", " ")).alias("term")).distinct()
    return r.join(phrase, ["doc_id", "term"], "left_semi")
