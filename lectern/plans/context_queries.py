"""Queries of citing contexts, stored leaves, phrases and reports over whole tables, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.keys import guid_key
from lectern.operators import contexts as C
from lectern.operators import documents as D
from lectern.operators import formulas as E
from lectern.operators import keywords as K
from lectern.operators import metrics as M
from lectern.operators import references as J
from lectern.operators import reports as A
from lectern.operators import retrieval as I  # noqa: E741
from lectern.operators import sequence as W
from lectern.operators import similarity as G
from lectern.plans import reference_queries as R
from lectern.plans.reference_queries import _CC, _CURRENT, _FIELDS, _HITS, _KEY, _KW, _M_SQL, _MATCH, _PAIRS, _POST, _QT, _SCORES, _STOP, _T, _TOP, _W
from lectern.plans.session import table, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- citing contexts ----
_NU = X.NUMBERED
_MARKS = rf"""mk AS (SELECT scidoc_id, guid, parent, ord, header, text, k, m[k] AS mark, (list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::BIGINT AS spot
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT *, regexp_split_to_array(text, '{_NU}') AS b, regexp_extract_all(text, '{_NU}') AS m FROM scidoc WHERE text IS NOT NULL)))"""
_NUMBERS = r"""nb AS (SELECT mk.* EXCLUDE (guid), lower(trim(guid)) AS g, unnest(list_distinct(flatten(list_transform(string_split(regexp_replace(mark, '[\[\]\s]', '', 'g'), ','), lambda p: CASE WHEN len(regexp_extract_all(p, '\d+')) = 2 AND regexp_extract_all(p, '\d+')[2]::INT >= regexp_extract_all(p, '\d+')[1]::INT AND regexp_extract_all(p, '\d+')[2]::INT <= 9999
  THEN range(regexp_extract_all(p, '\d+')[1]::INT, regexp_extract_all(p, '\d+')[2]::INT + 1) ELSE list_transform(regexp_extract_all(p, '\d+'), lambda x: x::BIGINT) END)))) AS number FROM mk)"""
_REFS = f"""rf AS (SELECT a AS g, b AS "to", row_number() OVER (PARTITION BY a ORDER BY b) AS number FROM {_PAIRS})"""
_CITED = f'{_MARKS}, {_NUMBERS}, {_REFS}, rs AS (SELECT nb.*, rf."to" FROM nb JOIN rf USING (g, number))'


def _words_sql(text: str, punctuation: bool = False) -> str:
    return f"list_filter(regexp_extract_all(lower(regexp_replace({text}, '{_NU}', '', 'g')), '{_T}'), lambda x: x NOT IN {_STOP})"


def _window_sql(n: int) -> str:
    size = (n + C.MARGIN) * C.PER_WORD
    before, after = f"substr(text, greatest(spot - {size}, 0) + 1, spot - greatest(spot - {size}, 0))", f"substr(text, spot + length(mark) + 1, {size})"
    b = _words_sql(before)
    return f"array_to_string({b}[greatest(len({b}) - {n - 1}, 1):], ' ') AS before, array_to_string({_words_sql(after)}[1:{n}], ' ') AS after"


def _marked(spark: SparkSession, d: str) -> DataFrame:
    return C.marks(table(spark, d, "scidoc").where("text is not null").select("scidoc_id", "guid", "parent", "ord", "header", "text"))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    return C.resolved(_marked(spark, d), C.numbered_references(table(spark, d, "links")))


@query(f'WITH {_MARKS} SELECT scidoc_id, k, mark, spot::INT AS "at" FROM mk')
def q_marks(spark: SparkSession, d: str) -> DataFrame:
    """Every numbered citation mark with its place."""
    return _marked(spark, d).select("scidoc_id", "k", "mark", "at")


@query(f"WITH {_MARKS} SELECT scidoc_id, k, {_window_sql(20)} FROM mk")
def q_mark_windows(spark: SparkSession, d: str) -> DataFrame:
    """The twenty words on either side of every mark."""
    w = C.word_windows(_marked(spark, d), 20, 20)
    return w.select("scidoc_id", "k", F.array_join("before", " ").alias("before"), F.array_join("after", " ").alias("after"))


@query(f'WITH {_CITED}, late AS (SELECT g FROM {_CURRENT} WHERE nullif(regexp_extract(year, \'(1[89]\\d\\d|20\\d\\d)\', 1), \'\')::INT > 2018) SELECT "to", scidoc_id, k, number, {_window_sql(10)} FROM rs ANTI JOIN late USING (g) WHERE "to" <> g')
def b_inlink_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of ten words around the marks that cite a paper, by the paper; citing papers after 2018 are left out."""
    late = J.current(table(spark, d, "papers")).where(J.year_number("year") > 2018).select(F.col("GUID").alias("guid"))
    w = C.word_windows(C.inlink_rows(_cited(spark, d), late), 10, 10)
    return w.select("to", "scidoc_id", "k", F.col("number").cast("bigint").alias("number"), F.array_join("before", " ").alias("before"), F.array_join("after", " ").alias("after"))


@query(f"""WITH {_CITED}, s AS (SELECT guid, ord, min(parent) AS parent, min(text) AS text FROM scidoc WHERE parent IS NOT NULL GROUP BY 1, 2), ci AS (SELECT DISTINCT "to", lower(trim(scidoc.guid)) AS g, scidoc.guid, rs.ord FROM rs JOIN scidoc USING (scidoc_id) WHERE scidoc.parent IS NOT NULL)
SELECT "to", ci.guid, ci.ord AS cit_ord, s.ord, md5(s.text) AS digest FROM ci JOIN s ON s.guid = ci.guid AND s.ord BETWEEN ci.ord - 1 AND ci.ord + 1""")
def b_inlink_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The elements beside those that cite a paper, by the paper."""
    cited = _cited(spark, d).where("parent is not null").select("to", "guid", F.col("ord").alias("cit_ord")).distinct()
    s = table(spark, d, "scidoc").where("parent is not null").groupBy(F.col("guid").alias("doc"), "ord").agg(F.min("parent").alias("para"), F.min("text").alias("text"))
    w = D.sentence_window(s, cited.select(F.col("guid").alias("doc"), "cit_ord").distinct(), "1up_1down")
    return cited.join(w.withColumnRenamed("doc", "guid"), ["guid", "cit_ord"]).select("to", "guid", "cit_ord", "ord", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""WITH {_CITED} SELECT "to", coalesce(lower(nullif(trim(header), '')), 'Bac') AS zone, count(*) AS n, sum(len(regexp_extract_all(lower(text), '{_T}'))) AS n_words FROM rs WHERE "to" <> g GROUP BY 1, 2""")
def b_inlink_zones(spark: SparkSession, d: str) -> DataFrame:
    """Citing contexts of each paper by the zone of the citing element, its header."""
    return C.by_zone(C.inlink_rows(_cited(spark, d)), F.lower(F.nullif(F.trim("header"), F.lit(""))))


@query(f"WITH {_MARKS}, {_NUMBERS}, {_REFS} SELECT scidoc_id, k, number FROM nb ANTI JOIN rf USING (g, number)")
def j_lost_citations(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of marks that name no reference of their paper."""
    return C.unresolved(_marked(spark, d), C.numbered_references(table(spark, d, "links"))).select("scidoc_id", "k", F.col("number").cast("bigint").alias("number"))


_LINES = "(SELECT guid AS doc, ord, min(text) AS text, string_agg(DISTINCT lower(substr(elem_type, 1, 1)), '' ORDER BY lower(substr(elem_type, 1, 1))) AS label FROM scidoc GROUP BY 1, 2)"


@query(f"""WITH l AS {_LINES}, c AS (SELECT doc, ord AS spot FROM l WHERE contains(text, '(')) SELECT l.doc, spot AS "at", l.ord FROM c JOIN l ON l.doc = c.doc AND l.ord BETWEEN spot - 4 AND spot + 4 WHERE contains(label, 'p') AND NOT contains(label, 'x')""")
def q_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs at most four lines from one with a bracket; the labels are the first letters of the elements' types."""
    lines = table(spark, d, "scidoc").groupBy(F.col("guid").alias("doc"), "ord").agg(F.min("text").alias("text"), F.collect_set(F.lower(F.substring("elem_type", 1, 1))).alias("labels"))
    return C.by_label(lines, F.coalesce(F.contains("text", F.lit("(")), F.lit(False)), F.col("labels"), ["p"])


@query(f"""WITH f AS (SELECT *, first_value(parent) OVER (PARTITION BY guid ORDER BY ord, parent) AS fp FROM scidoc WHERE parent IS NOT NULL), s AS (SELECT {_KEY.format('guid')} AS g, string_agg(text, ' ' ORDER BY ord, text) FILTER (parent = fp) AS abstract FROM f GROUP BY guid)
SELECT coalesce(p.g, s.g) AS guid, md5(trim(concat_ws(' ', norm_title, abstract))) AS digest FROM {_CURRENT} p FULL JOIN s ON p.g = s.g""")
def b_title_abstract(spark: SparkSession, d: str) -> DataFrame:
    sections = D.sections(table(spark, d, "scidoc").where("parent is not null")).select(guid_key("guid").alias("guid"), "abstract")
    titles = J.current(table(spark, d, "papers")).select(F.col("GUID").alias("guid"), F.col("norm_title").alias("title"))
    return C.title_abstract(sections, titles).select("guid", F.md5(F.col("text").cast("binary")).alias("digest"))


_INDEXED = rf"array_to_string(list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)<cit[^<>]*/>', '', 'g'), '(?i)</?footnote[^<>]*>', ' ', 'g'), '\([^()]*(?:1[89]|20)\d\d[a-z]?[^()]*\)', '', 'g'), '{_NU}', '', 'g'), '</?[^<>]+>', ' ', 'g')), '{_T}'), lambda x: x NOT IN {_STOP}), ' ')"


@query(f"SELECT scidoc_id, md5({_INDEXED}) AS digest FROM scidoc")
def q_for_indexing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scidoc").select("scidoc_id", F.md5(C.for_indexing("text").cast("binary")).alias("digest"))


@query("SELECT doc_id AS query_id, 'lang' AS kind, lang AS value FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 'source', source FROM documents WHERE source IS NOT NULL")
def q_by_class(spark: SparkSession, d: str) -> DataFrame:
    return C.by_class(table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "lang", "source"), ["lang", "source"])


@query(f"SELECT doc_id AS query_id, w AS term, count(*) AS count FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_T}')) AS w FROM documents) WHERE length(w) > 1 AND w NOT IN {_STOP} GROUP BY 1, 2")
def q_baseline_terms(spark: SparkSession, d: str) -> DataFrame:
    return C.baseline_terms(table(spark, d, "documents"), "doc_id", "text", X.STOPWORDS)


@query(f"SELECT item_id AS query_id, w AS term, count(*) AS count, min(i) - 1 AS pos FROM (SELECT item_id, w[i] AS w, i FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, list_filter(regexp_extract_all(lower(regexp_replace(text, '__(?:cit|author|ref)\\w*', ' ', 'g')), '{_T}'), lambda x: NOT regexp_matches(x, '^\\d') AND x NOT IN {_STOP}) AS w FROM benchmark))) GROUP BY 1, 2")
def q_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    return C.rebuilt(table(spark, d, "benchmark"), "item_id", "text").select("query_id", "term", "count", F.col("pos").cast("bigint").alias("pos"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT guid AS doc, elem_id, parent FROM scidoc WHERE elem_id IS NOT NULL), u AS (SELECT doc, elem_id, parent AS section, 1 AS level FROM e WHERE parent <> '' UNION SELECT u.doc, u.elem_id, e.parent, level + 1 FROM u JOIN e ON e.doc = u.doc AND e.elem_id = u.section WHERE e.parent <> '' AND level <= 8)
SELECT doc, section, count(DISTINCT elem_id) AS n FROM u GROUP BY 1, 2""")
def f_section_elements(spark: SparkSession, d: str) -> DataFrame:
    """How many elements lie in each section, at any depth."""
    e = table(spark, d, "scidoc").where("elem_id is not null").select(F.col("guid").alias("doc"), "elem_id", "parent", "elem_type").distinct()
    return C.section_ancestors(e).groupBy("doc", "section").agg(F.countDistinct("elem_id").alias("n"))


# ---- references ----
@query(f"""SELECT e.a AS guid, e.b AS "to" FROM {_PAIRS} e SEMI JOIN (SELECT {_KEY.format('"GUID"')} AS b FROM papers) p ON e.b = p.b""")
def j_in_collection(spark: SparkSession, d: str) -> DataFrame:
    return J.in_collection(table(spark, d, "links"), table(spark, d, "papers"))


@query(f"""SELECT link_id, {_KEY.format('"GUID_to"')} IN (SELECT {_KEY.format('"GUID"')} FROM papers WHERE "GUID" IS NOT NULL) AND "GUID_to" IS NOT NULL AS in_collection FROM links""")
def j_tag_in_collection(spark: SparkSession, d: str) -> DataFrame:
    return J.tag_in_collection(table(spark, d, "links"), table(spark, d, "papers"), "GUID_to").select("link_id", "in_collection")


@query(f"""WITH p AS {_CURRENT}, r AS (SELECT DISTINCT coalesce(corpus_id, '') || '|' || {_KEY.format('"GUID"')} AS ref_id, corpus_id, {_KEY.format('"GUID"')} AS k FROM papers WHERE "GUID" IS NOT NULL), h AS (SELECT ref_id, p.g, 1 AS k FROM r JOIN p ON r.corpus_id = p.corpus_id WHERE r.corpus_id <> '' AND NOT regexp_matches(r.corpus_id, '["\\\\]') UNION ALL SELECT ref_id, p.g, 2 FROM r JOIN p ON r.k = p.g WHERE r.k <> '')
SELECT ref_id, arg_min(g, (k, g)) AS guid, CASE min(k) WHEN 1 THEN 'corpus_id' ELSE 'guid' END AS matched_by FROM h GROUP BY 1""")
def j_match_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the papers, deleted ones included, against those in the collection: by corpus id first, then by GUID."""
    p, null = table(spark, d, "papers").where("GUID is not null"), F.lit(None).cast("string")
    refs = p.select("corpus_id", guid_key("GUID").alias("guid")).distinct().select(F.concat_ws("|", F.coalesce("corpus_id", F.lit("")), "guid").alias("ref_id"), null.alias("doi"), "corpus_id", "guid", null.alias("norm_title"), F.array().cast("array<string>").alias("surnames"))
    papers = J.current(p).select(F.col("GUID").alias("guid"), F.col("DOI").alias("doi"), "corpus_id", "norm_title", J.names("surnames").alias("surnames"))
    return J.match_references(refs, papers)


# ---- stored leaves ----
_EXPLAINED = f"{_HITS}, {_SCORES}, {_TOP}, {_MATCH}, ex AS (SELECT hits.* FROM hits SEMI JOIN (SELECT query_id, guid FROM ranked UNION SELECT query_id, guid FROM match) USING (query_id, guid))"


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    _, _, _, m, hits = R._explained(spark, d)
    return hits, m


@query(f"WITH {_EXPLAINED} SELECT query_id, guid, count(*) AS n_leaves, round(sum(qw * fw), 4) AS total FROM ex GROUP BY 1, 2")
def i_stored(spark: SparkSession, d: str) -> DataFrame:
    """The stored leaves of the retrieved and the matching documents, in sum."""
    return _stored(spark, d)[0].groupBy("query_id", "guid").agg(F.count("*").alias("n_leaves"), F.round(F.sum(F.col("qw") * F.col("fw")), 4).alias("total"))


@query(f"WITH {_EXPLAINED} SELECT query_id, term, count(*) AS n_docs, round(min(s), 5) AS least, round(avg(s), 5) AS mean, round(max(s), 5) AS most FROM (SELECT query_id, guid, term, max(qw * fw) AS s FROM ex GROUP BY 1, 2, 3) GROUP BY 1, 2")
def k_term_values(spark: SparkSession, d: str) -> DataFrame:
    v = E.values_by_term(_stored(spark, d)[0])
    return v.select("query_id", "term", "n_docs", *[F.round(c, 5).alias(c) for c in ("least", "mean", "most")])


_RERANK = "rr AS (SELECT query_id, guid, round(sum(qw * fw * CASE field WHEN 'head' THEN 5.0 ELSE 1.0 END), 9) AS score FROM ex GROUP BY 1, 2), ranked2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, guid) AS rank FROM rr QUALIFY rank <= 200)"


@query(f"WITH {_EXPLAINED}, {_RERANK}, {_M_SQL.replace('ranked', 'ranked2')} SELECT count(*) AS n_queries, round(avg(mrr), 6) AS mrr, round(avg(precision), 6) AS precision, round(avg(ndcg), 6) AS ndcg, round(avg(map), 6) AS map FROM measured")
def x_weights_value(spark: SparkSession, d: str) -> DataFrame:
    """What other field weights would score on the stored leaves."""
    hits, m = _stored(spark, d)
    return E.weights_value(hits, m, {"head": 5.0, "text": 1.0}).select("n_queries", *[F.round(c, 6).alias(c) for c in ("mrr", "precision", "ndcg", "map")])


@query(f"""WITH {_EXPLAINED}, cls AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'OWN' WHEN item_id % 3 = 1 THEN 'Met' END AS c FROM benchmark)
SELECT query_id, guid, round(sum(qw * fw * CASE WHEN c = 'OWN' THEN CASE field WHEN 'head' THEN 2.0 ELSE 0.5 END WHEN field = 'text' THEN 3.0 END), 4) AS score FROM ex JOIN cls USING (query_id) WHERE c IS NOT NULL GROUP BY 1, 2 HAVING sum(qw * fw * CASE WHEN c = 'OWN' THEN CASE field WHEN 'head' THEN 2.0 ELSE 0.5 END WHEN field = 'text' THEN 3.0 END) > 0""")
def i_preset_weights(spark: SparkSession, d: str) -> DataFrame:
    """Field weights by the class of the query; a query's second class counts where the first has no weights."""
    hits, _ = _stored(spark, d)
    i = F.col("item_id") % 3
    cls = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(i == 0, "OWN").otherwise("none").alias("az"), F.when(i == 1, "Met").otherwise("none").alias("csc_type"))
    presets = spark.createDataFrame([("OWN", "head", 2.0), ("OWN", "text", 0.5), ("Met", "text", 3.0)], "query_class string, field string, weight double")
    return E.preset_scores(hits, cls, presets).withColumn("score", F.round("score", 4))


@query(f"""WITH {_KW}, sel AS (SELECT query_id, term, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) AS k FROM (SELECT query_id, term, round(score, 9) AS score FROM comb)), ch AS (SELECT 'all' AS selector, * FROM sel UNION ALL SELECT 'five', * FROM sel WHERE k <= 5),
wt AS (SELECT selector, false AS weighted, query_id, term, 1.0 AS weight FROM ch UNION ALL SELECT selector, true, query_id, term, score FROM ch), ex AS (SELECT hits.* FROM hits SEMI JOIN (SELECT query_id, guid FROM ranked UNION SELECT query_id, guid FROM match) USING (query_id, guid)),
sc AS (SELECT selector, weighted, query_id, guid, sum(qw * fw * {_W} * weight) AS s FROM ex JOIN wt USING (query_id, term) GROUP BY 1, 2, 3, 4 HAVING sum(qw * fw * {_W} * weight) > 0), rk AS (SELECT *, row_number() OVER (PARTITION BY selector, weighted, query_id ORDER BY round(ln(s), 9) DESC, guid) AS r FROM sc QUALIFY r <= 200),
there AS (SELECT DISTINCT selector, weighted, query_id FROM rk), b AS (SELECT selector, weighted, query_id, guid, r, count(*) OVER (PARTITION BY selector, weighted, query_id) AS m FROM there JOIN match USING (query_id) LEFT JOIN rk USING (selector, weighted, query_id, guid)),
q AS (SELECT selector, weighted, query_id, avg(CASE WHEN r IS NULL THEN 0.0 WHEN m > 1 AND r <= m THEN 1.0 ELSE 1.0 / r END) AS mrr, avg(CASE WHEN r IS NULL THEN 0.0 WHEN m > 1 AND r <= m THEN 1.0 ELSE ln(2) / ln(1 + r) END) AS ndcg FROM b GROUP BY 1, 2, 3)
SELECT selector, weighted, count(*) AS n_queries, (SELECT count(*) FROM ch WHERE ch.selector = q.selector) AS n_terms, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM q GROUP BY 1, 2""")
def k_compare_selectors(spark: SparkSession, d: str) -> DataFrame:
    """All terms and the five best, plain and weighted, on the stored leaves."""
    _, _, top, m, hits = R._explained(spark, d)
    s = written(R._rounded(K.combine(K.normalised(K.term_scores(hits), m, top))), "combined")
    out = E.compare_selectors(s, hits, m, _FIELDS, {"all": {}, "five": {"selector": "n_best", "n": 5}})
    return out.select("selector", "weighted", "n_queries", "n_terms", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


@query(f"""WITH d AS (SELECT * FROM documents SEMI JOIN (SELECT g FROM {_CURRENT} WHERE nullif(regexp_extract(year, '(1[89]\\d\\d|20\\d\\d)', 1), '')::INT <= 2010) p ON {_KEY.format('documents.guid')} = p.g), post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_T}')) AS term FROM d) WHERE term NOT IN {_STOP} GROUP BY 1, 2) SELECT term, count(*) AS df, sum(tf) AS ttf FROM post GROUP BY 1""")
def i_index_of_year(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies of an index that holds papers up to 2010 only."""
    docs = table(spark, d, "documents").withColumn("guid", guid_key("guid"))
    papers = J.current(table(spark, d, "papers")).select(F.col("GUID").alias("guid"), J.year_number("year").alias("year"))
    return I.build(E.of_year(docs, papers, 2010), "doc_id", ["text"]).terms.select("term", "df", "ttf")


@query(f"""WITH w AS (SELECT doc_id AS guid, regexp_extract_all(lower(text), '{_T}') AS w FROM documents), p AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '{_T}') AS w FROM benchmark), ph AS (SELECT DISTINCT query_id, w[1] || ' ' || w[2] || ' ' || w[3] AS phrase FROM p WHERE len(w) >= 3),
r AS (SELECT guid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS phrase FROM (SELECT guid, w, unnest(range(1, len(w) - 1)) AS i FROM w)) SELECT query_id, guid, phrase, count(*) AS tf FROM r JOIN ph USING (phrase) GROUP BY 1, 2, 3""")
def i_phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    """Where the first three words of an item stand in a row."""
    w = X.tokens("text")
    phrases = table(spark, d, "benchmark").where(F.size(w) >= 3).select(F.col("item_id").alias("query_id"), F.array_join(F.slice(w, 1, 3), " ").alias("phrase")).distinct()
    return E.phrase_hits(table(spark, d, "documents"), "doc_id", "text", phrases)


# ---- keywords ----
_PHRASES = f"(SELECT DISTINCT item_id AS query_id, w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '{_T}') AS w FROM benchmark)) WHERE w[i] NOT IN {_STOP} AND w[i + 1] NOT IN {_STOP})"
_TERM_N = f"(SELECT query_id, term, c::DOUBLE AS score FROM {_QT})"


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    """The items' pairs of words without stopwords."""
    return K.ngrams(table(spark, d, "benchmark"), "item_id", X.tokens("text"), 2, 1, X.STOPWORDS).select(F.col("item_id").alias("query_id"), F.col("ngram").alias("phrase"))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return R._query_terms(spark, d).select("query_id", "term", F.col("count").cast("double").alias("score"))


@query(f"SELECT query_id, phrase, len(regexp_extract_all(t, string_split(phrase, ' ')[1] || '[^\\p{{L}}\\p{{N}}_]+' || string_split(phrase, ' ')[2])) AS count FROM {_PHRASES} JOIN (SELECT item_id AS query_id, lower(text) AS t FROM benchmark) USING (query_id)")
def k_phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("t"))
    return E.phrase_counts(texts, "t", _phrases(spark, d))


@query(f"WITH p AS {_PHRASES}, t AS {_TERM_N} SELECT query_id, phrase, round((a.score + b.score) / 2 * 1.5, 6) AS score FROM p JOIN t a USING (query_id) JOIN t b USING (query_id) WHERE a.term = string_split(phrase, ' ')[1] AND b.term = string_split(phrase, ' ')[2]")
def k_phrase_scores(spark: SparkSession, d: str) -> DataFrame:
    """One and a half times the mean number of the words of each phrase."""
    return E.phrase_scores(_counted(spark, d), _phrases(spark, d), "avg", 1.5).withColumn("score", F.round("score", 6))


@query(f"WITH p AS {_PHRASES}, t AS {_TERM_N}, s AS (SELECT query_id, phrase, a.score + b.score AS score FROM p JOIN t a USING (query_id) JOIN t b USING (query_id) WHERE a.term = string_split(phrase, ' ')[1] AND b.term = string_split(phrase, ' ')[2]) SELECT query_id, term, score FROM t ANTI JOIN (SELECT DISTINCT query_id, unnest(string_split(phrase, ' ')) AS term FROM s) USING (query_id, term) UNION ALL SELECT query_id, phrase, score FROM s")
def k_with_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases in the place of their words."""
    t, p = _counted(spark, d), _phrases(spark, d)
    return E.with_phrases(t, E.phrase_scores(t, p), "sub")


@query(f"WITH p AS (SELECT DISTINCT phrase FROM {_PHRASES}), w AS (SELECT doc_id, regexp_extract_all(lower(text), '{_T}') AS w FROM documents) SELECT DISTINCT doc_id, phrase FROM (SELECT doc_id, w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)) SEMI JOIN p USING (phrase)")
def k_present_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The items' phrases in each document."""
    return E.present_phrases(table(spark, d, "documents"), "doc_id", X.tokens("text"), _phrases(spark, d), (2,))


_TOK = f"(SELECT item_id AS query_id, i - 1 AS pos, w[i] AS token FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '{_T}') AS w FROM benchmark)))"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(X.tokens("text")).alias("pos", "token"))


@query(f"SELECT t.query_id, pos, token, score IS NOT NULL AS extract, coalesce(score, 0) AS weight FROM {_TOK} t LEFT JOIN (SELECT * FROM {_TERM_N} WHERE score > 1) k ON k.query_id = t.query_id AND k.term = t.token")
def k_annotated_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with the mark and weight of the words that an item has more than once."""
    a = E.annotate_tokens(_tokens(spark, d), _counted(spark, d).where("score > 1"))
    return a.select("query_id", F.col("pos").cast("bigint").alias("pos"), "token", "extract", "weight")


@query(f"WITH t AS (SELECT DISTINCT query_id, token AS term FROM {_TOK}) SELECT query_id, term, coalesce(score, 0) AS weight FROM t LEFT JOIN (SELECT * FROM {_TERM_N} WHERE score > 1) USING (query_id, term) WHERE term NOT IN {_STOP}")
def k_gold_weights(spark: SparkSession, d: str) -> DataFrame:
    return E.gold_weights(_tokens(spark, d), _counted(spark, d).where("score > 1").withColumnRenamed("score", "weight"), X.STOPWORDS)


@query(f"WITH w AS {_TOK}, t AS (SELECT DISTINCT query_id, lower(term) AS term FROM {_TERM_N} WHERE score > 1 AND length(term) > 1 AND term NOT IN {_STOP}) SELECT (SELECT count(*) FROM t) AS n_unique, count(*) FILTER (t.term IS NOT NULL) AS n_extracted, count(*) AS n_words, round(count(*) FILTER (t.term IS NOT NULL) / count(*), 6) AS ratio FROM w LEFT JOIN t ON t.query_id = w.query_id AND t.term = w.token")
def m_prediction_stats(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return E.prediction_stats(texts, _counted(spark, d).where("score > 1"), "text", X.STOPWORDS).withColumn("ratio", F.round("ratio", 6))


# ---- metrics and reports ----
@query(f"WITH {_HITS}, {_SCORES}, {_TOP}, {_MATCH}, {_M_SQL}, all_q AS (SELECT DISTINCT item_id AS query_id FROM benchmark) SELECT query_id, mrr IS NOT NULL AS retrieved_any, round(coalesce(mrr, 0), 6) AS mrr, round(coalesce(ndcg, 0), 6) AS ndcg, coalesce(rank, 0) AS rank FROM all_q LEFT JOIN measured USING (query_id)")
def m_with_empty(spark: SparkSession, d: str) -> DataFrame:
    """Every item, those without a measured result at zero."""
    m = M.measure(I.top(R._rounded(I.score(R._hits(spark, d), _FIELDS))), R._matches(spark, d))
    w = M.with_empty(m, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")))
    return w.select("query_id", "retrieved_any", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"), "rank")


_RUNS = f"WITH {_HITS}, {_SCORES}, {_TOP}, {_MATCH}, {_M_SQL}, g AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS qm, CASE WHEN query_id % 3 = 0 THEN 'a' ELSE 'b' END AS dm FROM measured)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Measured queries under two made-up methods each."""
    m = M.measure(I.top(R._rounded(I.score(R._hits(spark, d), _FIELDS))), R._matches(spark, d))
    return m.withColumn("qm", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd")).withColumn("dm", F.when(F.col("query_id") % 3 == 0, "a").otherwise("b"))


@query(f"{_RUNS} SELECT qm, dm, count(*) AS n_queries, round(avg(mrr), 6) AS avg_mrr, round(avg(precision), 6) AS avg_precision, round(avg(ndcg), 6) AS avg_ndcg, round(avg(rank), 6) AS avg_rank, round(avg(map), 6) AS avg_map FROM g GROUP BY 1, 2")
def m_averages(spark: SparkSession, d: str) -> DataFrame:
    a = M.averages(_runs(spark, d), ["qm", "dm"])
    return a.select("qm", "dm", "n_queries", *[F.round(c, 6).alias(c) for c in ("avg_mrr", "avg_precision", "avg_ndcg", "avg_rank", "avg_map")])


@query(f"{_RUNS} SELECT dm, round(avg(a), 6) AS mean_mrr, count(*) AS n_query_methods FROM (SELECT dm, qm, avg(mrr) AS a FROM g GROUP BY 1, 2) GROUP BY 1")
def m_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.summary(_runs(spark, d), "qm", "dm").select("dm", F.round("mean_mrr", 6).alias("mean_mrr"), "n_query_methods")


@query(f"{_RUNS} SELECT qm, round(max(mrr), 6) AS best, count(*) AS n_tied FROM (SELECT *, rank() OVER (PARTITION BY qm ORDER BY mrr DESC) AS k FROM g) WHERE k = 1 GROUP BY 1")
def m_tied_best(spark: SparkSession, d: str) -> DataFrame:
    return M.tied_best(_runs(spark, d), "qm", "mrr").select("qm", F.round("best", 6).alias("best"), "n_tied")


_ZONES = ["jats", "scixml", "sapienta", "paperxml"]
_META = f"(SELECT guid, count(*) AS n_elements, coalesce(sum(len(regexp_extract_all(lower(text), '{_T}'))), 0) AS n_words, " + ", ".join(f"count(*) FILTER (fmt = '{z}') AS {z}" for z in _ZONES) + " FROM scidoc GROUP BY 1)"


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "scidoc").select("guid", "fmt", F.when(F.col("text").isNotNull(), F.size(X.tokens("text"))).cast("bigint").alias("n_words"))
    return A.corpus_metadata(e, _ZONES, zone="fmt")


@query(f"SELECT * FROM {_META}")
def a_corpus_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _metadata(spark, d)


@query(f"SELECT count(*) AS n_papers, round(avg(n_elements), 6) AS mean_elements, round(avg(n_words), 6) AS mean_words, {', '.join(f'sum({z}) AS {z}' for z in _ZONES)} FROM {_META}")
def a_collection_totals(spark: SparkSession, d: str) -> DataFrame:
    t = A.collection_totals(_metadata(spark, d), _ZONES)
    return t.withColumn("mean_elements", F.round("mean_elements", 6)).withColumn("mean_words", F.round("mean_words", 6))


_PC = ", ".join(f"round({z} * 100.0 / nullif({' + '.join(_ZONES)}, 0), 6) AS pc_{z}" for z in _ZONES)


@query(f"SELECT guid, {_PC} FROM {_META}")
def a_percent_columns(spark: SparkSession, d: str) -> DataFrame:
    return A.percent_columns(_metadata(spark, d), _ZONES).select("guid", *[F.round(f"pc_{z}", 6).alias(f"pc_{z}") for z in _ZONES])


@query(f"SELECT source, weight, zone FROM (SELECT guid || '-' AS source, unnest([{', '.join(_ZONES)}]) * 50.0::DOUBLE AS weight, unnest([{', '.join(repr(z) for z in _ZONES)}]) AS zone FROM {_META}) WHERE weight > 0")
def a_sankey(spark: SparkSession, d: str) -> DataFrame:
    return A.sankey(_metadata(spark, d), "guid", _ZONES)


@query("WITH r AS (SELECT lang AS l, source AS t FROM documents WHERE lang IS NOT NULL), u AS (SELECT 'label' AS kind, l AS label, t FROM r UNION ALL SELECT 'letter', unnest(list_distinct(string_split(l, ''))), t FROM r) SELECT kind, label, count(*) AS n, count(DISTINCT t) AS n_unique FROM u WHERE kind = 'label' OR label <> '' GROUP BY 1, 2")
def a_label_statistics(spark: SparkSession, d: str) -> DataFrame:
    return A.label_statistics(table(spark, d, "documents").where("lang is not null"), "lang", "source")


@query("SELECT guid, abstract, citing_context FROM (SELECT guid, min(n_chars) FILTER (source = 'abstract') AS abstract, min(n_chars) FILTER (source = 'citing_context') AS citing_context FROM documents GROUP BY 1) WHERE abstract IS NOT NULL AND citing_context IS NOT NULL")
def a_wide_rows(spark: SparkSession, d: str) -> DataFrame:
    """Papers that have both, as repeated measures."""
    return A.wide_rows(table(spark, d, "documents"), "guid", "source", "n_chars", ["abstract", "citing_context"])


@query("SELECT value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(metadata, '\"venue\": ?\"([^\"]*)\"', 1)) AS value FROM papers) GROUP BY 1")
def a_unique_values(spark: SparkSession, d: str) -> DataFrame:
    """Venues as the metadata writes them."""
    return A.unique_values(table(spark, d, "papers"), "metadata", '"venue": ?"([^"]*)"')


@query(f"WITH {_CC}, p AS (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey + 1 = b.l_orderkey), d AS (SELECT a, b, dice FROM s UNION ALL SELECT b, a, dice FROM s) SELECT p.a, p.b, round(coalesce(dice, 0), 6) AS dice FROM p LEFT JOIN d ON d.a = p.a AND d.b = p.b")
def g_distance(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    pairs = li.select((F.col("l_orderkey") + 1).alias("o"), F.col("l_partkey").alias("a")).join(li.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("b")), "o").select("a", "b").distinct()
    return G.distance(R._similar(spark, d), pairs).withColumn("dice", F.round("dice", 6))


@query(f"SELECT g AS guid, row_number() OVER (ORDER BY g) AS number FROM {_CURRENT}")
def g_numbered(spark: SparkSession, d: str) -> DataFrame:
    return G.numbered_items(J.current(table(spark, d, "papers")).select(F.col("GUID").alias("guid")), "guid")


# ---- sequences ----
@query(f"SELECT scidoc_id, array_to_string(regexp_extract_all(lower(text), '{_T}')[1:4], ' ') AS first_words FROM scidoc")
def w_first_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scidoc").select("scidoc_id", W.first_words(X.tokens("text")).alias("first_words"))


@query(f"WITH s AS (SELECT guid AS ctx, ord, min(text) AS text, min(fmt) AS fmt FROM scidoc WHERE text IS NOT NULL GROUP BY 1, 2), w AS (SELECT ctx, ord, fmt, list_append(regexp_extract_all(lower(text), '{_T}'), '#stop#') AS w FROM s) SELECT ctx, ord, i AS pos, w[i] AS token, fmt FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)")
def w_with_ends(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scidoc").where("text is not null").groupBy(F.col("guid").alias("ctx"), "ord").agg(F.min("text").alias("text"), F.min("fmt").alias("fmt"))
    return W.with_ends(s, X.tokens("text"), ["fmt"]).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"WITH post AS {_POST}, t AS (SELECT field, term, count(*) AS df FROM post GROUP BY 1, 2), m AS (SELECT max(df) AS m FROM t) SELECT field, term, round(power(1 + ln(m / df), 2), 6) AS weight, CASE WHEN df / m > 0.4 THEN 8 WHEN df / m > 0.3 THEN 7 WHEN df / m > 0.2 THEN 6 WHEN df / m > 0.1 THEN 5 WHEN df / m > 0.08 THEN 4 WHEN df / m > 0.06 THEN 3 WHEN df / m > 0.04 THEN 2 WHEN df / m > 0.02 THEN 1 ELSE 0 END AS bin FROM t, m")
def k_baseline_weights(spark: SparkSession, d: str) -> DataFrame:
    """The weight that a term's rarity alone gives it, and the bin of its frequency."""
    t = R._index(spark, d).stored.terms
    m = t.agg(F.max("df")).scalar()
    return t.select("field", "term", F.round(K.baseline_weight(F.col("df"), m), 6).alias("weight"), K.bins(F.col("df") / m).alias("bin"))



# ---- sources and scalars, by a round trip through their formats ----
def _field(c: str) -> str:
    return f"nullif(replace(replace({c}, '{{', '('), '}}', ')'), '')"


@query(f"SELECT rec_id::VARCHAR AS id, {_field('author')} AS author, {_field('title')} AS title, {_field('year')} AS year FROM aan_records")
def s_bibliography(spark: SparkSession, d: str) -> DataFrame:
    """Records written as bibliography text, one text of many, and read again."""
    from lectern.sources.records import bibliography

    plain = lambda c: F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "{}", "()")
    one = F.concat(*[x for c in ("rec_id", "author", "title", "venue", "year") for x in (F.lit(f"{'id' if c == 'rec_id' else c} = {{"), plain(c), F.lit("}\n"))])
    files = table(spark, d, "aan_records").groupBy(F.pmod(F.xxhash64("rec_id"), F.lit(64))).agg(F.array_join(F.collect_list(one), "\n").alias("value"))
    return bibliography(files).select("id", "author", "title", "year")


@query(f"""SELECT DISTINCT {_KEY.format('"GUID_from"')} AS "from", {_KEY.format('"GUID_to"')} AS "to" FROM links WHERE trim("GUID_from") <> '' AND trim("GUID_to") <> ''""")
def s_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links written as ``from ==> to`` lines and read again."""
    from lectern.sources.records import edges

    t = table(spark, d, "links").where("trim(GUID_from) <> '' and trim(GUID_to) <> ''")
    return edges(t.select(F.concat_ws(" ==> ", F.trim("GUID_from"), F.trim("GUID_to")).alias("value")))


@query("SELECT missing_id, norm_title FROM missing_papers m WHERE norm_title IS NULL OR NOT EXISTS (SELECT 1 FROM papers p WHERE p.norm_title = m.norm_title)")
def s_delete(spark: SparkSession, d: str) -> DataFrame:
    """Works recorded as missing without those that have come in since."""
    from lectern.sources.records import delete

    return delete(table(spark, d, "missing_papers"), table(spark, d, "papers").where("norm_title is not null"), "norm_title").select("missing_id", "norm_title")


@query(f"WITH {_MARKS}, {_NUMBERS} SELECT scidoc_id, k AS id, mark AS text, string_agg(DISTINCT number::VARCHAR, ',' ORDER BY number::VARCHAR) AS nums FROM nb GROUP BY 1, 2, 3")
def t_annotated_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbered citations taken apart, ranges spelled out."""
    from lectern.functions.annotate import annotate_citations

    c = table(spark, d, "scidoc").select("scidoc_id", annotate_citations(F.col("text"), F.lit("AFI")).alias("a")).select("scidoc_id", F.inline("a.citations"))
    return c.select("scidoc_id", F.col("id").cast("bigint").alias("id"), "text", F.array_join(F.array_sort(F.array_distinct(F.transform("nums", lambda x: x.cast("string")))), ",").alias("nums"))


@query(f"WITH post AS {_POST}, t AS (SELECT term, count(*) AS df FROM post WHERE field = 'text' GROUP BY 1), m AS (SELECT max(df) AS m FROM t), g AS (SELECT DISTINCT term FROM {_QT}), d AS (SELECT unnest([2.0, 1.7, 1.3, 1.0, 0.7]::DOUBLE[]) AS divisor), x AS (SELECT divisor, df <= m / divisor AS pred, g.term IS NOT NULL AS gold FROM t LEFT JOIN g USING (term) CROSS JOIN m CROSS JOIN d) SELECT divisor, round(2 * count(*) FILTER (pred AND gold) / (count(*) FILTER (pred) + count(*) FILTER (gold)), 6) AS f1 FROM x GROUP BY 1")
def k_divisor_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How well rare terms agree with those of the items, by the divisor of the greatest frequency."""
    t = R._index(spark, d).stored.terms.where("field = 'text'")
    return K.divisor_sweep(t, R._query_terms(spark, d), [2.0, 1.7, 1.3, 1.0, 0.7]).withColumn("f1", F.round("f1", 6))


@query("SELECT guid, source, n_chars FROM documents WHERE source IN (SELECT source FROM (SELECT source, row_number() OVER (ORDER BY avg(n_chars) DESC NULLS LAST, source) AS k FROM documents WHERE source IS NOT NULL GROUP BY 1) WHERE k <= 2)")
def a_long_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the two longest kinds of documents, as independent measures."""
    docs = table(spark, d, "documents")
    best = docs.where("source is not null").groupBy("source").agg(F.avg("n_chars").alias("m")).orderBy(F.desc_nulls_last("m"), "source").limit(2)
    return A.long_rows(docs, "guid", "source", "n_chars", best)



# ---- further scalars and features ----
@query(r"SELECT doc_id, md5(regexp_replace(text, '(?i)<cit id=(\w+)\s*/>', ' __\1 ', 'g')) AS digest, try_cast(nullif(regexp_extract(text, '[0-9]+', 0), '') AS BIGINT) AS first_number, md5(translate(text, chr(9) || chr(10) || chr(13), '   ')) AS cleared FROM documents")
def t_citation_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Citation tags as words, the first number, tabs and line ends as blanks."""
    return table(spark, d, "documents").select("doc_id", F.md5(X.citation_tokens("text").cast("binary")).alias("digest"), X.first_number("text").alias("first_number"), F.md5(X.clear_tabs("text").cast("binary")).alias("cleared"))


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '(?i)<cit id=(\w+)\s*/>', ' __\1 ', 'g')), '{_T}') AS w FROM documents WHERE regexp_matches(text, '(?i)<cit id='))
SELECT doc_id, array_to_string(list_filter(list_transform(w, lambda t: CASE WHEN t = '__cit1' THEN '__cit' ELSE t END), lambda t: NOT (starts_with(t, '__cit') AND t <> '__cit')), ' ') AS words FROM w""")
def t_leave_one_citation(spark: SparkSession, d: str) -> DataFrame:
    """Words in which the first citation is left and the others are gone."""
    t = table(spark, d, "documents").where(F.col("text").rlike("(?i)<cit id="))
    return t.select("doc_id", F.array_join(X.leave_one_citation(X.tokens(X.citation_tokens("text")), "__cit1"), " ").alias("words"))


@query(r"SELECT scidoc_id, array_to_string(list_distinct_in_order, ' ') AS keywords FROM (SELECT scidoc_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_in_order FROM (SELECT scidoc_id, list_filter(regexp_split_to_array(lower(header), '[^a-z0-9_]+'), lambda t: length(t) > 2 AND t <> 'the' AND t <> 'and') AS w FROM scidoc WHERE header IS NOT NULL))")
def x_manual_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Headers read as typed lists of keywords."""
    from lectern.operators.learning import manual_keywords

    return table(spark, d, "scidoc").where("header is not null").select("scidoc_id", F.array_join(manual_keywords("header", ["the", "and"]), " ").alias("keywords"))


@query(f"SELECT scidoc_id, least(floor((n - 1) * 2 / n)::INT + 1, 2) AS slice, (floor(n / 3) * 3)::INT AS bucket, array_to_string(list_concat(w, list_transform(range(0, 12), lambda i: '#'))[1:12], ' ') AS padded FROM (SELECT scidoc_id, w, len(w) AS n FROM (SELECT scidoc_id, regexp_extract_all(lower(text), '{_T}') AS w FROM scidoc WHERE text IS NOT NULL)) WHERE n > 0")
def w_slices(spark: SparkSession, d: str) -> DataFrame:
    """The half in which a text's last word stands, its length in steps of three, and its first twelve words filled up."""
    t = table(spark, d, "scidoc").where("text is not null").select("scidoc_id", X.tokens("text").alias("w")).withColumn("n", F.size("w")).where("n > 0")
    return t.select("scidoc_id", W.slice_of(F.col("n") - 1, F.col("n")).alias("slice"), W.length_bucket(F.col("n")).alias("bucket"), F.array_join(W.pad(F.col("w"), 12, "#"), " ").alias("padded"))


@query(f"WITH {_CC} SELECT a, b, round(dice, 6) AS dice FROM (SELECT a, b, dice FROM s UNION ALL SELECT b, a, dice FROM s) WHERE round(dice, 6) >= 0.02")
def g_related(spark: SparkSession, d: str) -> DataFrame:
    return G.related(R._similar(spark, d).withColumn("dice", F.round("dice", 6)), 0.02)


@query("SELECT doc_id, md5(concat_ws(' ', text, lang, source)) AS text, md5(concat_ws(' ', collection_id, lang, source)) AS collection FROM documents")
def i_append_fields(spark: SparkSession, d: str) -> DataFrame:
    """Two fields appended to two others."""
    t = D.append_fields(table(spark, d, "documents"), ["lang", "source"], ["text", "collection_id"])
    return t.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), F.md5(F.col("collection_id").cast("binary")).alias("collection"))


@query(f"WITH {_MARKS} SELECT scidoc_id FROM scidoc SEMI JOIN (SELECT guid, parent FROM mk) USING (guid, parent)")
def f_trim_to_citing(spark: SparkSession, d: str) -> DataFrame:
    """Elements of the paragraphs that hold a citation mark."""
    return D.trim_to_citing(table(spark, d, "scidoc"), _marked(spark, d), ["guid", "parent"]).select("scidoc_id")


_PERSON = "(SELECT \"GUID\" AS guid, coalesce(json_extract_string(metadata, '$.given'), '') AS given, coalesce(json_extract_string(metadata, '$.middle'), '') AS middle, coalesce(json_extract_string(metadata, '$.family'), '') AS family FROM authors WHERE metadata IS NOT NULL AND \"GUID\" IS NOT NULL)"


@query(f"WITH p AS (SELECT DISTINCT * FROM {_PERSON}) SELECT p.guid AS rec_id, min(q.guid) AS author_id FROM p JOIN p q USING (given, middle, family) GROUP BY 1")
def j_author_match(spark: SparkSession, d: str) -> DataFrame:
    """Author records by equal given, middle and family names: the least id that bears one of a record's names."""
    m = F.from_json("metadata", "given string, middle string, family string")
    p = table(spark, d, "authors").where("metadata is not null and GUID is not null").select(F.col("GUID").alias("author_id"), *[F.coalesce(m[c], F.lit("")).alias(c) for c in ("given", "middle", "family")]).distinct()
    recs = p.select(F.col("author_id").alias("rec_id"), F.lit(None).cast("string").alias("author_id"), "given", "middle", "family")
    return J.match_by_author(recs, p)


@query(f"""WITH q AS {_QT}, o AS (SELECT query_id, min(pos) AS pos, term FROM (SELECT item_id AS query_id, w[i] AS term, i - 1 AS pos FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '{_T}'), lambda x: NOT regexp_matches(x, '^\\d') AND x NOT IN {_STOP}) AS w FROM benchmark))) GROUP BY 1, 3)
SELECT query_id, md5(string_agg(f || ':"' || term || '"^' || (b * c)::DOUBLE::VARCHAR, ' OR ' ORDER BY pos, f)) AS digest FROM q JOIN o USING (query_id, term), (VALUES ('head', 2.0), ('text', 1.0)) v(f, b) GROUP BY 1""")
def i_query_string(spark: SparkSession, d: str) -> DataFrame:
    q = I.query_string(R._query_terms(spark, d), _FIELDS)
    return q.select("query_id", F.md5(F.col("query").cast("binary")).alias("digest"))


@query(f"WITH {_HITS}, ts AS (SELECT query_id, guid, term, max(qw * fw) AS s FROM hits GROUP BY 1, 2, 3) SELECT query_id, round(sum(s) FILTER (term IN ('is', 'are', 'we', 'this', 'that')) / sum(s), 6) AS share FROM ts GROUP BY 1")
def k_stopword_share(spark: SparkSession, d: str) -> DataFrame:
    """What part of each query's score common words make."""
    s = K.shares(K.term_scores(R._hits(spark, d)), ["is", "are", "we", "this", "that"])
    return s.select("query_id", F.round(F.nullif("share", F.lit(0.0)), 6).alias("share"))


@query(f"""WITH w AS (SELECT DISTINCT g, unnest(regexp_extract_all(lower(norm_title), '{_T}')) AS term FROM {_CURRENT}), i AS (SELECT term, count(*) AS df FROM w GROUP BY 1), n AS (SELECT count(*) AS n FROM {_CURRENT}), e AS {_PAIRS}
SELECT e.a AS doc, e.b AS other, count(*) AS n_shared, round(sum(ln(n / df)), 5) AS weight FROM e JOIN w x ON x.g = e.a JOIN w y ON y.g = e.b AND y.term = x.term JOIN i ON i.term = x.term, n GROUP BY 1, 2""")
def j_overlap_by_index(spark: SparkSession, d: str) -> DataFrame:
    """Words that the titles of a citing and a cited paper share, with what their rarity weighs."""
    p = J.current(table(spark, d, "papers"))
    words = p.select(F.col("GUID").alias("doc"), F.explode(X.tokens("norm_title")).alias("term")).distinct()
    index = words.groupBy("term").agg(F.count("*").alias("df")).withColumn("n", p.agg(F.count("*")).scalar())
    links = table(spark, d, "links").select(guid_key("GUID_from").alias("doc"), guid_key("GUID_to").alias("other")).where("doc <> '' and other <> ''").distinct()
    others = links.join(words.select(F.col("doc").alias("other"), "term"), "other")
    return J.overlap_by_index(words, others, index).withColumn("weight", F.round("weight", 5))


@query("SELECT vec_id, CASE WHEN label > 0 THEN (1.0 / (1.0 / label))::INT ELSE -1 END AS rank, (label * label)::DOUBLE AS square FROM embeddings")
def t_ranks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", X.rank_of_mrr(F.when(F.col("label") > 0, F.lit(1.0) / F.col("label")).otherwise(F.lit(0.0))).alias("rank"), X.quadratic(F.col("label").cast("double")).alias("square"))
