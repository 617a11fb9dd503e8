"""The store of papers, authors, missing papers and results: schemas, imports, lookups and scans, as tables and plans over them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.keys import guid_key
from lectern.operators.ranks import numbered

#: Schemas of the store's tables.
SCHEMAS: dict[str, str] = {
    "papers": "guid string, doi string, corpus_id string, filename string, norm_title string, surnames string, year string, num_in_collection_references int, num_references int, num_resolvable_citations int, num_citations int, num_inlinks int, import_id string, collection_id string, metadata string, time_created timestamp_ntz, time_modified timestamp_ntz",
    "authors": "author_id string, given string, middle string, family string, affiliations array<string>, papers array<string>, num_papers int",
    "links": "guid_from string, guid_to string, authors_from string, authors_to string, year_from string, year_to string, numcitations int, time_created timestamp_ntz",
    "missing_papers": "norm_title string, reference_counts int, metadata string, time_created timestamp_ntz",
    "exclusions": "experiment_id string, guid string, authors array<string>, guids_from array<string>",
}


def create_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Empty tables of every schema under ``path``, where there are none yet."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}")
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()}


def paper_rows(parsed: DataFrame, import_id: str, collection_id: str) -> DataFrame:
    """Rows of the papers table for parsed documents: normalised title, surnames, numbers of references and citations; links are counted later."""
    return parsed.select(
        "guid", "doi", F.col("pmid").alias("corpus_id"), F.lit(None).cast("string").alias("filename"), X.normalize_title("title").alias("norm_title"), F.array_join(F.transform("authors", lambda a: a["family"]), "; ").alias("surnames"), "year",
        F.lit(0).alias("num_in_collection_references"), F.size("refs").alias("num_references"), F.lit(0).alias("num_resolvable_citations"), F.size("citations").alias("num_citations"), F.lit(0).alias("num_inlinks"), F.lit(import_id).alias("import_id"), F.lit(collection_id).alias("collection_id"),
        F.to_json(F.struct("title", "year", "authors")).alias("metadata"), F.current_timestamp().cast("timestamp_ntz").alias("time_created"), F.current_timestamp().cast("timestamp_ntz").alias("time_modified"),
    )


def import_corpus(spark: SparkSession, path: str, out: str, import_id: str, collection_id: str, skip_present: bool = True) -> DataFrame:
    """Read all files under ``path``, put readable ones into the store under ``out`` and bring the counts of references in the collection up to date.

    One job reads and writes the documents; references are matched by normalised title and a surname. Papers already there stay where ``skip_present``. Returns the papers.
    """
    from lectern.operators.references import match_references
    from lectern.sources.papers_xml import read

    docs = read(spark, path).where("error is null or error = 'no body'").dropDuplicates(["guid"])
    if skip_present and _there(spark, f"{out}/documents"):
        docs = docs.join(spark.read.parquet(f"{out}/documents").select("guid"), "guid", "left_anti")
    docs.write.mode("append").parquet(f"{out}/documents")
    stored = spark.read.parquet(f"{out}/documents")
    papers = paper_rows(stored, import_id, collection_id)
    names = F.transform(F.split(F.lower("surnames"), "; "), lambda x: F.trim(x))
    of = papers.select("guid", "doi", "corpus_id", "norm_title", names.alias("surnames"))
    refs = stored.select("guid", F.inline("refs")).select(F.struct("guid", "ref_id").alias("ref_id"), "doi", F.col("pmid").alias("corpus_id"), F.lit(None).cast("string").alias("guid"), X.normalize_title("title").alias("norm_title"), F.transform("surnames", lambda x: F.lower(x)).alias("surnames"))
    hits = match_references(refs, of)
    links = hits.select(F.col("ref_id.guid").alias("guid_from"), F.col("guid").alias("guid_to")).distinct()
    links.write.mode("overwrite").parquet(f"{out}/links")
    links = spark.read.parquet(f"{out}/links")
    inside = links.groupBy(F.col("guid_from").alias("guid")).agg(F.count("*").cast("int").alias("__out"))
    cited = links.groupBy(F.col("guid_to").alias("guid")).agg(F.count("*").cast("int").alias("__in"))
    full = papers.join(inside, "guid", "left").join(cited, "guid", "left").withColumns({"num_in_collection_references": F.coalesce("__out", F.lit(0)), "num_inlinks": F.coalesce("__in", F.lit(0))}).drop("__out", "__in")
    full.write.mode("overwrite").parquet(f"{out}/papers")
    return spark.read.parquet(f"{out}/papers")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def random_files(files: DataFrame, name: str, n: int, seed: int) -> DataFrame:
    """n files drawn with replacement, each as likely; the same for one seed. A sampling operator."""
    rows = numbered(files.select(name), [name], "__no")
    total = rows.count()
    draws = rows.sparkSession.range(n).select((F.floor(F.rand(seed) * total) + 1).cast("bigint").alias("__no"), F.col("id").alias("draw"))
    return draws.join(rows, "__no").select("draw", name)


def exists(keys: DataFrame, rows: DataFrame, key: str, of: str) -> DataFrame:
    """``keys`` with there: whether ``rows`` have the key in column ``of``; GUIDs compare without regard to case and blanks, null is nowhere."""
    known = rows.where(F.col(of).isNotNull()).select(guid_key(of).alias("__k")).distinct().withColumn("__t", F.lit(True))
    return keys.withColumn("__k", guid_key(key)).join(known, "__k", "left").withColumn("there", F.coalesce("__t", F.lit(False))).drop("__k", "__t")


def missing_counts(seen: DataFrame) -> DataFrame:
    """(norm_title, n_again, most): how often a work was looked up again after its first time, and its greatest stored count. Null titles are left out."""
    return seen.where("norm_title is not null").groupBy("norm_title").agg((F.count("*") - 1).alias("n_again"), F.max("reference_counts").alias("most"))


def merged_authors(authors: DataFrame) -> DataFrame:
    """(guid, names, papers, affiliations): rows of one GUID as one author, each list without repeats and in order; lists may be empty, never null."""
    meta = F.from_json("metadata", "papers array<string>, affiliation array<struct<name:string>>")
    a = authors.select(F.col("GUID").alias("guid"), "full_name", meta.alias("m"))
    lists = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    clean = lambda c: F.filter(c, lambda x: x.isNotNull())
    return a.groupBy("guid").agg(F.array_sort(F.collect_set("full_name")).alias("names"), lists(clean(F.col("m.papers"))).alias("papers"), lists(clean(F.transform("m.affiliation", lambda x: x["name"]))).alias("affiliations"))


def query(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """A SELECT over the given tables, which are views for this statement only."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)


def scan(rows: DataFrame, sort: list[str] | None = None, most: int | None = None) -> DataFrame:
    """All rows, sorted and as many as asked for."""
    out = rows.orderBy(*sort) if sort else rows
    return out if most is None else out.limit(most)


def stream(rows: DataFrame, sort: list[str] | None = None) -> Iterator[Row]:
    """Rows one after another; the driver holds one partition."""
    return scan(rows, sort).toLocalIterator()


def exclude(old: DataFrame, experiment_id: str, found: DataFrame) -> DataFrame:
    """Exclusions (experiment_id, guid, authors, guids_from) with those of an experiment (guid, authors, guids_from) put in the place of its own."""
    own = found.select(F.lit(experiment_id).alias("experiment_id"), "guid", "authors", "guids_from")
    return old.join(own.select("experiment_id", "guid"), ["experiment_id", "guid"], "left_anti").unionByName(own)


def excluded_links(links: DataFrame, exclusions: DataFrame, experiment_id: str) -> DataFrame:
    """Links (guid_from, guid_to) without those that an experiment leaves out for their target."""
    gone = exclusions.where(F.col("experiment_id") == experiment_id).select(F.col("guid").alias("guid_to"), F.explode("guids_from").alias("guid_from"))
    return links.join(gone, ["guid_from", "guid_to"], "left_anti")


def metadata_of(papers: DataFrame, ids: list[str]) -> DataFrame:
    """Papers of the given GUIDs without their lists of links; a comma list may stand for several."""
    wanted = [i.strip().lower() for x in ids for i in x.split(",") if i.strip()]
    return papers.where(guid_key("guid").isin(wanted)).drop("inlinks", "outlinks", "num_inlinks")


def subset(rows: DataFrame, order: list[str], items: list[int]) -> DataFrame:
    """The rows at the given places, counted from 0 in the order; adds item."""
    t = numbered(rows, order, "__no").withColumn("item", F.col("__no") - 1).drop("__no")
    return t.where(F.col("item").isin(items))


def read_contexts(spark: SparkSession, path: str, max_items: int | None = None, batch: int | None = None) -> DataFrame:
    """Feature contexts of JSON lines, packed or not; as many as asked for, in minibatches (column batch) where a size is given."""
    t = spark.read.json(path)
    t = t if max_items is None else t.limit(max_items)
    return t if batch is None else t.withColumn("batch", F.floor(F.monotonically_increasing_id() / batch))


def second_annotator(items: DataFrame, annotated: DataFrame, most: int = 100) -> DataFrame:
    """Items (query_id, ...) that a first annotator has done, the first ``most`` by id: what a second one is given. A top-k report."""
    return items.join(annotated.select("query_id").distinct(), "query_id", "left_semi").orderBy("query_id").limit(most)


def selection_trace(chosen: DataFrame, measured: DataFrame) -> DataFrame:
    """One row a query: its chosen terms as term:score in order of rank, beside its metrics."""
    item = F.struct("rank", F.format_string("%s:%s", "term", F.round("score", 4).cast("string")).alias("t"))
    terms = chosen.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), " ").alias("terms"))
    return terms.join(measured, "query_id", "left")


def patent_reference(text: str) -> dict[str, Column]:
    """Columns kind, authors, title, number and year read from a reference of another kind: a patent where an inventor and an assignee are named, else author. title. rest year."""
    c = F.regexp_replace(F.regexp_replace(F.col(text), r"(?is)<ext-link.*?</ext-link>", " "), r"(?is)</?[a-z-]+[^<>]*>", " ")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)accessed\s.*?\d{4}", " "), r"\s+", " "))
    is_patent = c.rlike(r"(?i)\binventors?\b.*\bassignee\b.*\bpatent\b")
    got = lambda rx, k: F.nullif(F.trim(F.regexp_extract(c, rx, k)), F.lit(""))
    patent, other = r"(?i)^(.+?),?\s*inventors?\b.*?\bassignee\.?\s*(.+?)\.\s.*?\bpatent\s+(.+?)\.", r"^(.+?)\.\s+(.+?)\.\s.*?\b(\d{4})\.?$"
    return {
        "kind": F.when(is_patent, "patent").when(c.rlike(other), "other"), "authors": F.when(is_patent, got(patent, 1)).otherwise(got(other, 1)), "title": F.when(is_patent, got(patent, 2)).otherwise(got(other, 2)),
        "number": F.when(is_patent, got(patent, 3)), "year": F.when(is_patent, got(r"((?:1[89]|20)\d\d)", 1)).otherwise(got(other, 3)),
    }


def cleaned_references(text: str) -> Column:
    """Reference text with blanks after punctuation and years, In before a name set apart, and references run together cut where an author list with a year begins."""
    c = F.regexp_replace(F.regexp_replace(F.col(text), "­", ""), r"(?i)\bin\s*proceedings\s+of\s+", "In Proceedings of ")
    for pattern, by in ((r"\b([Ii]n)(?=[A-Z0-9])", "$1 "), (r"([,;\"])(?=[^\s\"])", "$1 "), (r"([a-z?!]\.)(?=[A-Z])", "$1 "), (r"\b((?:19|20)\d\d[a-g]?\)?\.?)(?=[A-Za-z&\"'])", "$1 "), (r"(?:\r?\n\s*){3,}", "\n\n"), (r"(\w\.) +(?=(?:[A-Z][\w'-]+, (?:[A-Z]\. ?)+(?:and |, )?)+\((?:19|20)\d\d)", "$1\n\n")):
        c = F.regexp_replace(c, pattern, by)
    return c


def upsert_papers(old: DataFrame, new: DataFrame, links: DataFrame) -> DataFrame:
    """The papers table with new rows put in by guid, stamped as modified now, and every paper's num_inlinks counted from the links (guid_from, guid_to)."""
    from lectern.sources.records import upsert

    stamped = new.withColumn("time_modified", F.current_timestamp().cast("timestamp_ntz"))
    counts = links.select("guid_from", "guid_to").distinct().groupBy(F.col("guid_to").alias("guid")).agg(F.count("*").cast("int").alias("__n"))
    return upsert(old, stamped, "guid").join(counts, "guid", "left").withColumn("num_inlinks", F.coalesce("__n", F.lit(0))).drop("__n")
