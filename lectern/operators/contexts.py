"""Citing contexts: where a text cites, windows and sentences around the place, the cited paper they speak of, and queries made from them.

A context is a row, and no key's contexts are collected; ``documents.inlink_blocks`` joins them where a text a paper is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.keys import guid_key

#: Characters a word of a window is taken to need, and words by which the characters read exceed the window.
PER_WORD, MARGIN = 10, 15


def marks(texts: DataFrame, text: str = "text", pattern: str = X.NUMBERED) -> DataFrame:
    """Adds k (from 1), mark and at (characters before it) for every place where the pattern is met; texts without one, and null texts, have no rows."""
    between, met = F.split(F.col(text), pattern, -1), F.regexp_extract_all(F.col(text), F.lit(pattern), 0)
    t = texts.withColumn("__b", between).withColumn("__m", met).where("size(__m) > 0").select(*texts.columns, "__b", F.posexplode("__m").alias("__k", "mark"), "__m")
    chars = lambda parts, n: F.aggregate(F.transform(F.slice(parts, F.lit(1), n), F.length), F.lit(0), lambda s, x: s + x)
    at = chars("__b", F.col("__k") + 1) + chars("__m", F.col("__k"))
    return t.withColumn("at", at).withColumn("k", (F.col("__k") + 1).cast("bigint")).drop("__b", "__m", "__k")


def word_windows(marked: DataFrame, left: int, right: int, text: str = "text", pattern: str = X.NUMBERED, punctuation: bool = False) -> DataFrame:
    """Adds before and after: the last ``left`` and first ``right`` words beside a mark, read from (words + 15) * 10 characters, without other marks and stopwords.

    With ``punctuation`` the words are what blanks separate, rid of all but letters, digits and blanks, and stopwords stay.
    """
    size = lambda n: (n + MARGIN) * PER_WORD
    start = F.greatest(F.col("at") - size(left), F.lit(0))
    clean = lambda c: F.regexp_replace(c, pattern, "")
    before = clean(F.substring(F.col(text), start + 1, F.col("at") - start))
    after = clean(F.substring(F.col(text), F.col("at") + F.length("mark") + 1, F.lit(size(right))))
    if punctuation:
        words = lambda c: F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}\s]+", ""), r"\s+"), lambda w: w != "")
    else:
        words = lambda c: X.without_stopwords(X.tokens(c))
    last = F.slice(words(before), F.greatest(F.size(words(before)) - left + 1, F.lit(1)), left)
    return marked.withColumn("before", last).withColumn("after", F.slice(words(after), 1, right))


def numbered_references(links: DataFrame) -> DataFrame:
    """(guid, number, to): a paper's references numbered from 1 by the cited GUID; repeated links once."""
    pairs = links.select(guid_key("GUID_from").alias("guid"), guid_key("GUID_to").alias("to")).where("guid <> '' and `to` <> ''").distinct()
    return pairs.withColumn("number", F.row_number().over(Window.partitionBy("guid").orderBy("to")))


def resolved(marked: DataFrame, references: DataFrame, guid: str = "guid") -> DataFrame:
    """Adds number and to, a row for each number of a mark such as [1,3-5] that names a reference of the paper. Numbers without one are left out."""
    cited = marked.withColumn("number", F.explode(F.array_distinct(X.numbered_list("mark")))).withColumn("__g", guid_key(guid))
    return cited.join(references.withColumnRenamed("guid", "__g"), ["__g", "number"]).drop("__g")


def unresolved(marked: DataFrame, references: DataFrame, guid: str = "guid") -> DataFrame:
    """The numbers of marks that name no reference of the paper: citations that a pass over the references has lost."""
    cited = marked.withColumn("number", F.explode(F.array_distinct(X.numbered_list("mark")))).withColumn("__g", guid_key(guid))
    return cited.join(references.select(F.col("guid").alias("__g"), "number"), ["__g", "number"], "left_anti").drop("__g")


def inlink_rows(contexts: DataFrame, exclude: DataFrame | None = None, column: str = "guid") -> DataFrame:
    """Contexts (to, guid, ...) but for those of citing papers to leave out, and of a paper by itself."""
    out = contexts.where(guid_key(column) != F.col("to"))
    return out if exclude is None else out.withColumn("__g", guid_key(column)).join(exclude.select(guid_key("guid").alias("__g")).distinct(), "__g", "left_anti").drop("__g")


def by_zone(contexts: DataFrame, zone: Column, missing: str = "Bac") -> DataFrame:
    """(to, zone, n, n_words): the contexts of each cited paper by the zone of the citing sentence; sentences without a zone count as ``missing``."""
    rows = contexts.withColumn("zone", F.coalesce(zone, F.lit(missing)))
    return rows.groupBy("to", "zone").agg(F.count("*").alias("n"), F.sum(F.size(X.tokens("text")).cast("bigint")).alias("n_words"))


def by_label(lines: DataFrame, citing: Column, labels: Column, include: list[str], up: int = 4, down: int = 4) -> DataFrame:
    """(doc, at, ord): lines around each citing line whose labels meet ``include`` and hold no x. Needs doc, ord; labels is an array of letters."""
    rows = lines.withColumn("__l", labels).withColumn("__c", citing)
    at = rows.where("__c").select("doc", F.explode(F.sequence(F.col("ord") - up, F.col("ord") + down)).alias("ord"), F.col("ord").alias("at"))
    keep = F.arrays_overlap("__l", F.array(*map(F.lit, include))) & ~F.array_contains("__l", "x")
    return at.join(rows.select("doc", "ord", "__l"), ["doc", "ord"]).where(keep).select("doc", "at", "ord")


def title_abstract(sections: DataFrame, titles: DataFrame) -> DataFrame:
    """(guid, text): title and first section; either alone where the other is missing."""
    return titles.select("guid", "title").join(sections.select("guid", "abstract"), "guid", "full").select("guid", F.trim(F.concat_ws(" ", "title", "abstract")).alias("text"))


def section_ancestors(elements: DataFrame, depth: int = 8) -> DataFrame:
    """(doc, elem_id, section): every element with each section it lies in, at any level up to ``depth``; one join a level. Needs doc, elem_id, parent, elem_type."""
    up = elements.select("doc", F.col("elem_id").alias("section"), F.col("parent").alias("above"))
    at = elements.select("doc", "elem_id", F.col("parent").alias("section")).where("section is not null and section <> ''")
    out = at
    for _ in range(depth):
        at = at.join(up, ["doc", "section"]).select("doc", "elem_id", F.col("above").alias("section")).where("section is not null and section <> ''")
        out = out.unionByName(at)
    return out.distinct()


def is_sentence(kind: Column) -> Column:
    return F.lower(kind).isin("s", "sentence")


def is_paragraph(kind: Column) -> Column:
    return F.lower(kind).isin("p", "paragraph")


def is_section(kind: Column) -> Column:
    return F.lower(kind).isin("sec", "section", "div")


def for_indexing(text: Column | str) -> Column:
    """The words of a sentence for an index or a query: without citations, tags and stopwords, in small letters, by blanks."""
    return F.array_join(X.without_stopwords(X.tokens(X.clean_xml(X.remove_bracketed_citations(X.remove_citations(text))))), " ")


def large_clusters(citations: DataFrame, least: int, most_queries: int | None = None) -> DataFrame:
    """Citations (with multi) in clusters of at least ``least``; a report of the first ``most_queries`` by doc and start where asked."""
    rows = citations.where(F.col("multi") >= least)
    return rows if most_queries is None else rows.orderBy("doc", "start").limit(most_queries)


def by_class(queries: DataFrame, classes: list[str], zones: int = 0) -> DataFrame:
    """(query_id, kind, value): each query under each of its classes, null classes left out; with ``zones`` also under a zone that depends on its id alone."""
    out = queries.unpivot("query_id", classes, "kind", "value").where("value is not null")
    if zones:
        out = out.unionByName(queries.select("query_id", F.lit("random").alias("kind"), F.concat(F.lit("zone"), F.pmod(F.xxhash64("query_id"), F.lit(zones))).alias("value")))
    return out


def rebuilt(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query_id, term, count, pos): the structured query made again from what is shown of it, its citation and author tokens left out."""
    words = F.filter(X.tokens(F.regexp_replace(text, r"__(?:cit|author|ref)\w*", " ")), lambda t: ~t.rlike(r"^\d"))
    long = queries.select(F.col(key).alias("query_id"), F.posexplode(X.without_stopwords(words)).alias("pos", "term"))
    return long.groupBy("query_id", "term").agg(F.count("*").alias("count"), F.min("pos").alias("pos"))


def baseline_terms(queries: DataFrame, key: str, text: str, stopwords: list[str]) -> DataFrame:
    """(query_id, term, count): all words of more than one letter that are no stopwords."""
    words = F.filter(X.tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(stopwords))
    return queries.select(F.col(key).alias("query_id"), F.explode(words).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("count"))


def keyword_terms(queries: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """(query_id, term, count): words of a text that are among its keywords (query_id, term)."""
    return queries.select(F.col(key).alias("query_id"), F.explode(X.tokens(text)).alias("term")).join(keywords.select("query_id", "term").distinct(), ["query_id", "term"], "left_semi").groupBy("query_id", "term").agg(F.count("*").alias("count"))


def reinserted(sentences: DataFrame, lost: DataFrame) -> DataFrame:
    """Sentences (doc, ord, text) with lost citations (doc, ord, cit_id) put back before the final stop of their sentence, in order of the id."""
    tags = lost.groupBy("doc", "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_set("cit_id")), lambda c: F.concat(F.lit("<CIT ID="), c, F.lit("/>"))), " ").alias("__t"))
    j = sentences.join(tags, ["doc", "ord"], "left")
    missing = F.col("__t").isNotNull() & F.col("text").isNotNull()
    stop = F.regexp_extract("text", r"([.!?\s]*)$", 1)
    body = F.expr("substring(text, 1, length(text) - length(regexp_extract(text, '([.!?\\\\s]*)$', 1)))")
    return j.withColumn("text", F.when(missing, F.concat(body, F.lit(" "), F.col("__t"), stop)).otherwise(F.col("text"))).drop("__t")
