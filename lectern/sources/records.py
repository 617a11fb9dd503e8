"""Readers and writers of records: bibliography text, edge lists, JSON documents, annotation text, result tables; and the papers store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.ranks import numbered, running


def bibliography(lines: DataFrame, value: str = "value") -> DataFrame:
    """Records of the form ``id = {..} author = {..;..} title = {..} venue = {..} year = {..}`` in whole texts: one row each; missing fields are null."""
    record = F.explode(F.regexp_extract_all(value, F.lit(r"(?s)id\s*=\s*\{[^}]*\}(?:(?!\bid\s*=).)*"), F.lit(0)))
    field = lambda n: F.nullif(F.regexp_extract("r", rf"(?s)\b{n}\s*=\s*\{{([^}}]*)\}}", 1), F.lit(""))
    return lines.select(record.alias("r")).select(*[field(n).alias(n) for n in ("id", "author", "title", "venue", "year")])


def edges(lines: DataFrame, value: str = "value") -> DataFrame:
    """``from ==> to`` lines in small letters, each pair once; lines of fewer than three parts are left out."""
    p = F.split(F.trim(F.lower(value)), r"\s+")
    return lines.select(p.alias("p")).where("size(p) >= 3").select(F.get("p", F.lit(0)).alias("from"), F.get("p", F.lit(2)).alias("to")).distinct()


def categories(lines: DataFrame, value: str = "value") -> DataFrame:
    """``id: title`` lines."""
    return lines.where(F.contains(value, F.lit(":"))).select(F.trim(F.split_part(value, F.lit(":"), F.lit(1))).alias("id"), F.trim(F.regexp_replace(value, r"^[^:]*:", "")).alias("title"))


def annotations(lines: DataFrame, order: str, value: str = "value") -> DataFrame:
    """(id, annotator, keyword) of blocks ``#ID:``, ``#KEYWORDS:``; a block's second keyword line is annotator 2's. ``order`` numbers the lines."""
    b = running(lines, [order], F.col(value).startswith("#ID:"), "block")
    ids = b.where(F.col(value).startswith("#ID:")).select("block", F.trim(F.expr(f"substring({value}, 5)")).alias("id"))
    kw = b.where(F.col(value).startswith("#KEYWORDS:")).withColumn("annotator", F.row_number().over(Window.partitionBy("block").orderBy(order)))
    kw = kw.select("block", "annotator", F.explode(F.split(F.trim(F.expr(f"substring({value}, 11)")), r"\s*[,;]\s*")).alias("keyword")).where("keyword <> ''")
    return kw.join(ids, "block").select("id", "annotator", "keyword")


def annotation_text(queries: DataFrame) -> DataFrame:
    """(value) blocks to be typed into, one for each query_id: its number, words and an empty keyword line."""
    one = queries.groupBy("query_id").agg(F.min("query_text").alias("t"))
    n = numbered(one, ["query_id"], "n")
    return n.select(F.concat_ws("\n", F.concat(F.lit("#ID: "), "query_id"), F.concat(F.lit("#NUM "), F.col("n").cast("string")), F.concat(F.lit("#WORDS "), "t"), F.lit("#KEYWORDS:")).alias("value"))


def positional_labels(sentences: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of a line-aligned file put beside a document's sentences; blank throughout a document whose counts differ. Both need doc and ord."""
    w = Window.partitionBy("doc").orderBy("ord")
    s = sentences.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("doc")))
    x = labels.withColumn("k", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy("doc"))).select("doc", "k", "m", "label")
    return s.join(x, ["doc", "k"], "left").withColumn("label", F.when(F.col("n") == F.col("m"), F.col("label")).otherwise("")).drop("k", "n", "m")


def contexts_around(lines: DataFrame, before: int = 4, after: int = 3) -> DataFrame:
    """(doc, at, context): the lines around each line whose label holds a c. Needs doc, ord, text, label."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(-before, after)
    return lines.withColumn("context", F.array_join(F.collect_list("text").over(w), " ")).where(F.contains("label", F.lit("c"))).select("doc", F.col("ord").alias("at"), "context")


def split_collection(lines: DataFrame, order: str, value: str = "value", end: str = "</doc>") -> DataFrame:
    """(doc_no, text): a file of many documents cut at its closing lines."""
    ends = (F.trim(value) == end).cast("int")
    n = running(lines, [order], ends, "__upto").withColumn("doc_no", F.col("__upto") - F.coalesce(ends, F.lit(0)))
    return n.groupBy("doc_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "\n").alias("text"))


# ---- store: tables in parquet, changed by rewriting ----
def upsert(old: DataFrame, new: DataFrame, key: str, partial: bool = False) -> DataFrame:
    """``old`` with the rows of ``new`` by key: replaced whole, or field by field where ``partial`` and the new field isn't null."""
    if not partial:
        return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
    fresh = new.select(key, *[F.col(c).alias(f"__{c}") for c in new.columns if c != key])
    j = old.join(fresh, key, "full")
    return j.select(key, *[F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in fresh.columns else F.col(c) for c in old.columns if c != key])


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def delete(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


def export(rows: DataFrame, path: str, kind: str) -> None:
    """Write as ``csv``, ``tsv``, ``json``, ``jsonl.gz``, ``orc`` or ``parquet``; missing metrics are 0 in tsv."""
    w = {
        "csv": lambda: rows.write.mode("overwrite").option("header", True).csv(path),
        "tsv": lambda: rows.na.fill(0).na.fill("0").write.mode("overwrite").option("header", True).option("sep", "\t").csv(path),
        "json": lambda: rows.write.mode("overwrite").json(path), "jsonl.gz": lambda: rows.write.mode("overwrite").option("compression", "gzip").json(path),
        "orc": lambda: rows.write.mode("overwrite").orc(path), "parquet": lambda: rows.write.mode("overwrite").parquet(path),
    }
    w[kind]()


def results_by_class(rows: DataFrame, path: str, cls: str) -> None:
    rows.write.mode("append").partitionBy(cls).parquet(path)


def weights_table(spark: SparkSession, path: str) -> DataFrame:
    """(query_class, field, weight) of a tab-separated table with a field to each column."""
    t = spark.read.option("header", True).option("sep", "\t").csv(path)
    first, fields = t.columns[0], t.columns[1:]
    return t.unpivot(first, fields, "field", "weight").select(F.col(first).alias("query_class"), "field", F.expr("try_cast(weight as double)").alias("weight"))
