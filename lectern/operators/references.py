"""Matching of references to papers, citation links, self-citation and the predicates on citations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.keys import guid_key


def names(col: Column | str) -> Column:
    """Family names of a list in small letters; blanks dropped, empty for null."""
    parts = F.split(F.lower(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))), r"\s*[;,]\s*")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def full_names(authors: Column) -> Column:
    """Given and family names of an array of author structs, in small letters; blank names dropped, empty for null."""
    whole = F.transform(F.coalesce(authors, F.array().cast("array<struct<given:string,family:string>>")), lambda a: F.trim(F.lower(F.concat_ws(" ", a["given"], a["family"]))))
    return F.filter(whole, lambda x: x != "")


def year_number(col: Column | str) -> Column:
    """The first year between 1800 and 2099 in a text, else null."""
    got = F.regexp_extract(col, r"(1[89]\d\d|20\d\d)", 1)
    return F.when(got != "", got).cast("int")


def same_first_author(a: Column, b: Column) -> Column:
    return F.coalesce(F.get(a, 0) == F.get(b, 0), F.lit(False))


def overlapping_authors(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def should_ignore(from_authors: Column, to_authors: Column, from_year: Column, from_collection: Column | None = None, to_collection: Column | None = None, max_year: int = 9999, max_overlap: int = 9999, no_first_author: bool = False) -> Column:
    """Whether a citation is left out: other collection, too late a citing paper, too many shared authors, or the same first author."""
    out = F.coalesce(from_year > max_year, F.lit(False)) | (overlapping_authors(from_authors, to_authors) > max_overlap)
    if no_first_author:
        out = out | same_first_author(from_authors, to_authors)
    if from_collection is not None and to_collection is not None:
        out = out | F.coalesce(from_collection != to_collection, F.lit(False))
    return out


def current(papers: DataFrame) -> DataFrame:
    """One row a paper: the latest import of each GUID that isn't deleted. Rows without a GUID are left out."""
    w = Window.partitionBy(guid_key("GUID")).orderBy(F.desc_nulls_last("time_created"), F.desc_nulls_last("norm_title"), F.desc_nulls_last("corpus_id"))
    return papers.where(F.col("GUID").isNotNull() & F.col("time_deleted").isNull()).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k").withColumn("GUID", guid_key("GUID"))


def match_references(refs: DataFrame, papers: DataFrame) -> DataFrame:
    """(ref_id, guid, matched_by): the paper of each reference by the first key that hits - doi, corpus id, guid, title with a shared surname.

    ``refs``: ref_id, doi, corpus_id, guid, norm_title, surnames (array); ``papers``: guid and the same. Each key is one equi join over its
    non-empty values; the hit of least priority and guid is kept. References without a hit are left out. Values with quotes or backslashes match nothing.
    """
    hits = None
    usable = lambda c: F.col(c).isNotNull() & (F.col(c) != "") & ~F.col(c).rlike(r'["\\]')
    for priority, key in enumerate(("doi", "corpus_id", "guid")):
        left = refs.where(usable(key)).select("ref_id", F.col(key).alias("__key"))
        right = papers.where(usable(key)).select(F.col(key).alias("__key"), F.col("guid"))
        part = left.join(right, "__key").select("ref_id", F.lit(priority).alias("priority"), "guid")
        hits = part if hits is None else hits.unionByName(part)
    left = refs.where(usable("norm_title") & (F.size("surnames") > 0)).select("ref_id", "norm_title", F.explode(F.array_distinct("surnames")).alias("surname"))
    right = papers.where(usable("norm_title") & (F.size("surnames") > 0)).select("norm_title", "guid", F.explode(F.array_distinct("surnames")).alias("surname"))
    hits = hits.unionByName(left.join(right, ["norm_title", "surname"]).select("ref_id", F.lit(3).alias("priority"), "guid"))
    best = hits.groupBy("ref_id").agg(F.min(F.struct("priority", "guid")).alias("m"))
    by = F.element_at(F.array(*map(F.lit, ("doi", "corpus_id", "guid", "title"))), F.col("m.priority") + 1)
    return best.select("ref_id", F.col("m.guid").alias("guid"), by.alias("matched_by"))


def match_by_author(records: DataFrame, people: DataFrame) -> DataFrame:
    """(rec_id, author_id): by author id where given, else by equal given, middle and family name. The least id at ties."""
    by_id = records.where("author_id is not null").join(people.select("author_id").distinct(), "author_id").select("rec_id", "author_id")
    rest = records.join(by_id.select("rec_id"), "rec_id", "left_anti").drop("author_id")
    by_name = rest.join(people, ["given", "middle", "family"]).groupBy("rec_id").agg(F.min("author_id").alias("author_id"))
    return by_id.unionByName(by_name)


def greedy_by_words(cited: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc, cited_id, ref_id): for the cited papers of a document, in order, the remaining reference of greatest word overlap.

    ``cited``: doc, cited_id, ord, year, surnames, words; ``refs``: doc, ref_id, words. A reference must hold the year, a surname, and more than a quarter of the
    words. Pairs are found by joins on words; only these few are matched one to one, document by document.
    """
    c = cited.select("doc", "cited_id", "ord", "year", "surnames", F.size(F.array_distinct("words")).alias("size"), F.explode(F.array_distinct("words")).alias("word"))
    r = refs.select("doc", "ref_id", F.array_distinct("words").alias("ref_words"), F.explode(F.array_distinct("words")).alias("word"))
    pairs = c.join(r, ["doc", "word"]).groupBy("doc", "cited_id", "ord", "ref_id").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("year").alias("year"), F.first("surnames").alias("surnames"), F.first("ref_words").alias("ref_words"))
    pairs = pairs.where(F.array_contains("ref_words", F.col("year")) & F.arrays_overlap("surnames", "ref_words") & (F.col("n") > F.col("size") / 4)).select("doc", "cited_id", "ord", "ref_id", "n")

    def choose(pdf):  # noqa: ANN001, ANN202
        used, out = set(), []
        for _, g in pdf.sort_values(["ord", "cited_id"], kind="stable").groupby(["ord", "cited_id"], sort=False):
            left = g[~g["ref_id"].isin(used)].sort_values(["n", "ref_id"], ascending=[False, True])
            if len(left):
                used.add(left.iloc[0]["ref_id"])
                out.append(left.iloc[0])
        import pandas as pd

        return pd.DataFrame(out, columns=pdf.columns)[["doc", "cited_id", "ref_id"]]

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.groupBy("doc").applyInPandas(choose, f"doc {kinds['doc']}, cited_id {kinds['cited_id']}, ref_id {kinds['ref_id']}")


def match_citations(citations: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc, cit_id, ref_id, score): the reference of each in-text citation, scored by where its words name authors and year.

    ``citations``: doc, cit_id, words (array), year (text), n_authors kind (etal, two, one); ``refs``: doc, ref_id, surnames, year. A word at place i that
    equals a surname or the year adds max(0.1, 1 - 0.05 i); 0.5 is added where the number of authors fits; the years must lie within
    two of each other or one edit apart. The best of at least 0.3 is kept, the least ref_id at ties.
    """
    w = citations.select("doc", "cit_id", F.col("year").alias("cy"), "kind", F.posexplode("words").alias("i", "word"))
    r = refs.select("doc", "ref_id", F.col("year").alias("ry"), F.size("surnames").alias("n_names"), F.explode(F.array_distinct(F.concat("surnames", F.array(F.coalesce("year", F.lit("")))))).alias("word")).where("word <> ''")
    pairs = w.join(r, ["doc", "word"]).groupBy("doc", "cit_id", "ref_id", "cy", "ry", "kind", "n_names").agg(F.sum(F.greatest(F.lit(0.1), 1 - 0.05 * F.col("i"))).alias("s")).where("s >= 0.3")
    fits = F.when(F.col("kind") == "etal", F.col("n_names").between(2, 100)).when(F.col("kind") == "two", F.col("n_names") == 2).otherwise(F.col("n_names").between(1, 100))
    ok = F.expr("coalesce(length(cy) < 4 or length(ry) < 4 or abs(try_cast(left(cy, 4) as int) - try_cast(left(ry, 4) as int)) <= 2 or levenshtein(cy, ry) <= 1, true)")
    scored = pairs.where(ok).withColumn("score", F.col("s") + F.when(fits, 0.5).otherwise(0.0))
    best = Window.partitionBy("doc", "cit_id").orderBy(F.desc("score"), "ref_id")
    return scored.withColumn("k", F.row_number().over(best)).where("k = 1").select("doc", "cit_id", "ref_id", "score")


def resolvable(citations: DataFrame, matched: DataFrame) -> DataFrame:
    """One row a citation cluster: (doc, cluster, match_guids, multi). ``citations``: doc, cit_id, ref_id, cluster; unmatched members are left out."""
    return citations.join(matched, "ref_id").groupBy("doc", "cluster").agg(F.array_sort(F.collect_set("guid")).alias("match_guids"), F.count("*").alias("multi"))


def clusters(citations: DataFrame, gap: int = 7) -> DataFrame:
    """Adds cluster (from 1 within a sentence) and multi (its size): citations at most ``gap`` characters apart belong together. Needs doc, sentence, start, end."""
    w = Window.partitionBy("doc", "sentence").orderBy("start")
    new = F.coalesce((F.col("start") - F.lag("end").over(w) > gap).cast("int"), F.lit(1))
    c = citations.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(w)).drop("__new")
    return c.withColumn("multi", F.count("*").over(Window.partitionBy("doc", "sentence", "cluster")))


def link_lists(links: DataFrame) -> DataFrame:
    """(guid, n_out, n_in): distinct papers cited by and citing each paper; repeated pairs once."""
    pairs = links.select(guid_key("GUID_from").alias("a"), guid_key("GUID_to").alias("b")).where("a is not null and b is not null and a <> '' and b <> ''").distinct()
    long = pairs.select(F.col("a").alias("guid"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(pairs.select(F.col("b"), F.lit(0), F.lit(1)))
    return long.groupBy("guid").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def self_citations(links: DataFrame) -> DataFrame:
    """(guid, n_links, n_self): links of each citing paper and those that share an author with it. Repeated pairs count once."""
    pairs = links.select(guid_key("GUID_from").alias("guid"), guid_key("GUID_to").alias("to"), overlapping_authors(names("authors_from"), names("authors_to")).alias("n")).where("guid is not null and `to` is not null")
    pairs = pairs.groupBy("guid", "to").agg(F.max("n").alias("n"))
    return pairs.groupBy("guid").agg(F.count("*").alias("n_links"), F.sum((F.col("n") > 0).cast("int")).alias("n_self"))


def link_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows of either side alone, as ADD or REMOVE."""
    a, b = before.select(*key).distinct(), after.select(*key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("ADD")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("REMOVE")))


def reference_tree(links: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, guid, level): papers reached from each root by citations, each at its least level up to ``depth``; one join a level."""
    edges = links.select(guid_key("GUID_from").alias("guid"), guid_key("GUID_to").alias("to")).where("guid is not null and `to` is not null").distinct()
    seen = roots.select(F.col("guid").alias("root"), "guid", F.lit(0).alias("level")).distinct()
    front = seen
    for level in range(1, depth + 1):
        front = front.join(edges, "guid").select("root", F.col("to").alias("guid"), F.lit(level).alias("level")).distinct().join(seen, ["root", "guid"], "left_anti")
        seen = seen.unionByName(front)
    return seen


def title_segments(title: str, least: float) -> list[str]:
    """A title cut into one segment more than the edits that a title within the similarity can be away, each marked with the title's length and its number."""
    n = len(title)
    parts = int((1 - least) * int(n / least + 1e-9) + 1e-9) + 1
    size, longer = divmod(n, parts)
    ends = [k * size + max(0, k - parts + longer) for k in range(parts + 1)]
    return [f"{n} {k} {title[a:b]}" for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]


def title_probes(title: str, least: float) -> list[str]:
    """The marks of ``title_segments`` of which every title within the similarity has at least one.

    With t edits and t + 1 segments some segment k is whole, has k edits before it and at most t - k behind it, so it has moved by no more than that.
    """
    n, out = len(title), set()
    for other in range(math.ceil(n * least - 1e-9), int(n / least + 1e-9) + 1):
        edits = int((1 - least) * int(other / least + 1e-9) + 1e-9)
        size, longer = divmod(other, edits + 1)
        for k in range(edits + 1):
            at, width = k * size + max(0, k - edits - 1 + longer), size + (k >= edits + 1 - longer)
            lo = max(0, at - k, at + n - other - (edits - k))
            hi = min(n - width, at + k, at + n - other + edits - k)
            out.update(f"{other} {k} {title[a : a + width]}" for a in range(lo, hi + 1))
    return sorted(out)


def similar_titles(refs: DataFrame, papers: DataFrame, least: float = 0.9) -> DataFrame:
    """(ref_id, guid, similarity): all titles of the same year above the given edit similarity. Blocked by year and the segments of the
    papers' titles, of which such a pair always shares one at about the same place."""

    def blocks(df: DataFrame, key: str, cut: Callable[[str, float], list[str]]) -> DataFrame:
        def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for lo in range(0, len(b), 1000):
                    part = b.iloc[lo : lo + 1000]
                    yield part[[key, "year"]].assign(blocks=[cut(t, least) for t in part["norm_title"]])

        kind = df.schema[key].dataType.simpleString()
        marked = df.select(key, "year", "norm_title").mapInPandas(mark, f"{key} {kind}, year int, blocks array<string>")
        return marked.select(key, F.explode("blocks").alias("block"), "year").select(key, F.xxhash64("year", "block").alias("block"))

    a, b = (df.where("norm_title <> '' and year is not null") for df in (refs, papers))
    # Spark takes the exploded marks to be as small as the titles and would broadcast them through the driver.
    pairs = blocks(a, "ref_id", title_probes).join(blocks(b, "guid", title_segments).hint("merge"), "block").select("ref_id", "guid").distinct()
    whole = pairs.join(a.select("ref_id", "norm_title", "year").hint("merge"), "ref_id").join(b.select("guid", F.col("norm_title").alias("title"), F.col("year").alias("y")).hint("merge"), "guid").where("year = y")
    sim = 1 - F.levenshtein("norm_title", "title") / F.greatest(F.length("norm_title"), F.length("title"))
    return whole.select("ref_id", "guid", sim.alias("similarity")).distinct().where(F.col("similarity") > least)


def reference_of(refs: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """References (doc, ref_id, original_id, guid, ...) looked up by ``ref_id``, ``original_id`` or ``guid``: the first by ref_id of each (doc, value)."""
    j = wanted.select("doc", F.col("value").alias(by)).distinct().join(refs, ["doc", by])
    w = Window.partitionBy("doc", by).orderBy("ref_id")
    return j.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def in_collection(links: DataFrame, papers: DataFrame) -> DataFrame:
    """(guid, to): distinct links whose cited paper is in the collection (GUID)."""
    pairs = links.select(guid_key("GUID_from").alias("guid"), guid_key("GUID_to").alias("to")).where("guid <> '' and `to` <> ''").distinct()
    return pairs.join(papers.select(guid_key("GUID").alias("to")).distinct(), "to", "left_semi").select("guid", "to")


def tag_in_collection(refs: DataFrame, papers: DataFrame, guid: str = "guid") -> DataFrame:
    """References with in_collection; false for null."""
    there = papers.select(guid_key("GUID").alias("__g")).where("__g is not null").distinct().withColumn("__in", F.lit(True))
    return refs.withColumn("__g", guid_key(guid)).join(there, "__g", "left").withColumn("in_collection", F.coalesce("__in", F.lit(False))).drop("__g", "__in")


def untag_lost(citations: DataFrame, matched: DataFrame, gap: int = 7) -> DataFrame:
    """Citations (doc, sentence, start, end, ref_id) without those whose reference has no paper, clustered anew. ``matched``: ref_id, guid."""
    return clusters(citations.join(matched.select("ref_id").distinct(), "ref_id", "left_semi"), gap)


def load_references(cited: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc, ref_id, cited_id): every reference of a document with the cited paper that ``greedy_by_words`` gives it, null for the rest."""
    got = greedy_by_words(cited, refs)
    return refs.select("doc", "ref_id").join(got, ["doc", "ref_id"], "left").select("doc", "ref_id", "cited_id")


def merge_annotations(elements: DataFrame, annotations: DataFrame) -> DataFrame:
    """Elements (doc, sid, ...) with csc_type, csc_adv and csc_nov of the annotation of the same sentence id; the least of several, null without one."""
    a = annotations.groupBy("doc", "sid").agg(F.min(F.struct("csc_type", "csc_adv", "csc_nov")).alias("a"))
    return elements.join(a, ["doc", "sid"], "left").select(*elements.columns, "a.csc_type", "a.csc_adv", "a.csc_nov")


def overlap_by_index(tokens: DataFrame, others: DataFrame, index: DataFrame) -> DataFrame:
    """(doc, other, n_shared, weight): words that two token lists (doc, term; other, doc, term) share, with the sum of their inverse document frequency (term, df, n)."""
    shared = tokens.select("doc", "term").distinct().join(others.select("doc", "other", "term").distinct(), ["doc", "term"]).join(index.select("term", F.ln(F.col("n") / F.col("df")).alias("idf")), "term", "left")
    return shared.groupBy("doc", "other").agg(F.count("*").alias("n_shared"), F.coalesce(F.sum("idf"), F.lit(0.0)).alias("weight"))
