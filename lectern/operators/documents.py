"""Representations of documents: whole, passages, zones, sections, contexts of those who cite them; and windows around citations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X

#: Characters of contexts from which a new block begins.
BLOCK_CHARS = 8192


def ordered_text(elements: DataFrame, by: list[str], text: str = "text", order: str = "ord", sep: str = " ") -> DataFrame:
    """The texts of each group joined in order; ties in order go by the text, nulls are skipped."""
    items = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(order), F.col(text).alias("t")))))
    return elements.groupBy(*by).agg(F.array_join(F.transform(items, lambda x: x["t"]), sep).alias("text"))


def passages(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, offset, passage): windows of ``size`` words from the start, and again from half a window on."""
    words = X.tokens(text)
    starts = lambda at: F.when(F.size(words) > at, F.sequence(F.lit(at), F.size(words) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    each = F.explode(F.array_union(starts(0), starts(size // 2)))
    out = docs.where(F.col(text).isNotNull()).select(key, words.alias("w"), each.alias("offset"))
    return out.select(key, "offset", F.array_join(F.slice("w", F.col("offset") + 1, size), " ").alias("passage"))


def zoned(elements: DataFrame, guid: str, zone: Column, text: str = "text", order: str = "ord") -> DataFrame:
    """(guid, zone, text): a document's text by zone; null zones are ``none``."""
    return ordered_text(elements.withColumn("zone", F.coalesce(zone, F.lit("none"))), [guid, "zone"], text, order)


def random_zone(key: Column, zones: int) -> Column:
    """A zone that depends on the key alone, as a control."""
    return F.concat(F.lit("zone"), F.pmod(F.xxhash64(key), F.lit(zones)))


def sections(elements: DataFrame, guid: str = "guid", section: str = "parent") -> DataFrame:
    """(guid, abstract, body): the first section by order, and the rest."""
    w = Window.partitionBy(guid)
    first = elements.withColumn("first", F.min_by(section, F.struct("ord", section)).over(w))
    own = F.col(section) == F.col("first")
    parts = first.withColumn("zone", F.when(own, "abstract").otherwise("body"))
    return ordered_text(parts, [guid, "zone"]).groupBy(guid).agg(F.max(F.when(F.col("zone") == "abstract", F.col("text"))).alias("abstract"), F.coalesce(F.max(F.when(F.col("zone") == "body", F.col("text"))), F.lit("")).alias("body"))


def inlink_contexts(contexts: DataFrame, links: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(guid, inlink_context, n_contexts): the citing contexts of each paper. ``contexts``: guid (citing), ctx_id, text; ``links``: guid (citing), to. ``exclude``: guid of citing papers left out."""
    c = contexts if exclude is None else contexts.join(exclude.select("guid").distinct(), "guid", "left_anti")
    j = links.select("guid", "to").distinct().join(c.where("text is not null"), "guid")
    return ordered_text(j.select(F.col("to").alias("guid"), F.col("ctx_id").alias("ord"), "text"), ["guid"]).join(j.groupBy(F.col("to").alias("guid")).agg(F.count("*").alias("n_contexts")), "guid").select("guid", F.col("text").alias("inlink_context"), "n_contexts")


def inlink_blocks(contexts: DataFrame, links: DataFrame, exclude: DataFrame | None = None, size: int = BLOCK_CHARS) -> DataFrame:
    """(guid, block, text, n_contexts): the citing contexts of each paper as ``inlink_contexts`` orders them, in numbered blocks of about ``size`` characters,
    so that no row grows with the number of citing papers. A block exceeds ``size`` by less than one context."""
    c = contexts if exclude is None else contexts.join(exclude.select("guid").distinct(), "guid", "left_anti")
    j = links.select("guid", "to").distinct().join(c.where("text is not null"), "guid").select(F.col("to").alias("guid"), F.col("ctx_id").alias("ord"), "text")
    before = F.sum(F.length("text").cast("bigint") + 1).over(Window.partitionBy("guid").orderBy("ord", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("text") - 1
    cut = j.withColumn("block", F.floor(before / size))
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("text").alias("t")))), lambda x: x["t"])
    return cut.groupBy("guid", "block").agg(F.array_join(items, " ").alias("text"), F.count("*").alias("n_contexts"))


def digests(blocks: DataFrame, trim: bool = False) -> DataFrame:
    """(guid, digest, n_contexts): MD5 of each paper's blocks (guid, block, text, n_contexts) joined by blanks, read one after the other; blanks at the ends left out for ``trim``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guid, n, md5, some, begun, held = None, 0, None, False, False, ""
        for b in batches:
            out = []
            for g, text, k in zip(b["guid"], b["text"], b["n_contexts"], strict=True):
                if md5 is None or g != guid:
                    if md5 is not None:
                        out.append((guid, md5.hexdigest(), n))
                    guid, n, md5, some, begun, held = g, 0, hashlib.md5(), False, False, ""
                part = held + (" " if some else "") + text
                if trim:
                    part = part if begun else part.lstrip(" ")
                    kept = part.rstrip(" ")
                    part, held = kept, part[len(kept) :]
                    begun = begun or part != ""
                md5.update(part.encode())
                n, some = n + int(k), True
            if out:
                yield pd.DataFrame(out, columns=["guid", "digest", "n_contexts"])
        if md5 is not None:
            yield pd.DataFrame([(guid, md5.hexdigest(), n)], columns=["guid", "digest", "n_contexts"])

    # By a hash of its own: an exchange by the guid itself is left out above a union by the guid, whose sides need not be cut alike.
    rows = blocks.select("guid", "block", "text", "n_contexts").repartition(F.xxhash64("guid")).sortWithinPartitions("guid", "block")
    return rows.mapInPandas(read, "guid string, digest string, n_contexts bigint")


def mashup(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """(guid, all_text): a paper's own text and its inlink context together, either alone where the other is missing."""
    return inside.join(outside, "guid", "full").select("guid", F.trim(F.concat_ws(" ", "text", "inlink_context")).alias("all_text"))


def append_fields(docs: DataFrame, extra: list[str], to: list[str]) -> DataFrame:
    return docs.withColumns({c: F.concat_ws(" ", c, *extra) for c in to})


def locate(text: Column, mark: Column) -> Column:
    """Place of a citation mark as a whole word, from 1, 0 if none."""
    return F.regexp_instr(text, F.concat(mark, F.lit(r"(?!\w)")))


def word_window(words: Column, at: Column, left: int, right: int) -> Column:
    """The ``left`` words before and ``right`` words after place ``at`` (from 1)."""
    start = F.greatest(at - left, F.lit(1))
    return F.concat(F.slice(words, start, at - start), F.slice(words, at + 1, right))


def word_windows(words: Column, at: Column, sizes: list[tuple[int, int]]) -> Column:
    """All window sizes at once: an array of (method, words)."""
    return F.array(*[F.struct(F.lit(f"window{a}_{b}").alias("method"), word_window(words, at, a, b).alias("words")) for a, b in sizes])


_SELECT = re.compile(r"^(?:(?:(\d)up)?_?(?:(\d)down)?(_withinpara)?|(paragraph)|(1only))$", re.I)


def sentence_window(sentences: DataFrame, citing: DataFrame, param: str, clip: bool = False) -> DataFrame:
    """(doc, cit_ord, ord, text): the sentences that a parameter such as ``2up_1down``, ``1up_1down_withinpara``, ``paragraph`` or ``1only`` selects around citing ones.

    ``sentences``: doc, para, ord, text; ``citing``: doc, cit_ord. With ``clip`` a window cut off at the document's start loses all upper
    sentences, as some experiments had it.
    """
    m = _SELECT.match(param)
    if not m or not param:
        raise ValueError(f"no such selection: {param}")
    c = citing.join(sentences.select("doc", F.col("ord").alias("cit_ord"), F.col("para").alias("cit_para")), ["doc", "cit_ord"])
    j = c.join(sentences, "doc")
    if m.group(4):
        return j.where("para = cit_para").select("doc", "cit_ord", "ord", "text")
    up, down = (0, 0) if m.group(5) else (int(m.group(1) or 0), int(m.group(2) or 0))
    cond = F.col("ord").between(F.col("cit_ord") - up, F.col("cit_ord") + down)
    if m.group(3):
        cond = cond & (F.col("para") == F.col("cit_para"))
    if clip and up:
        cond = cond & ((F.col("ord") >= F.col("cit_ord")) | (F.col("cit_ord") > up))
    return j.where(cond).select("doc", "cit_ord", "ord", "text")


def position_chunk(position: Column, length: Column, chunks: int) -> Column:
    """Which of ``chunks`` equal parts of a document a place lies in, from 1."""
    return (F.floor(position / length * chunks) + 1).cast("int")


def trim_to_citing(elements: DataFrame, citing: DataFrame, on: list[str]) -> DataFrame:
    """The elements of paragraphs that cite a target."""
    return elements.join(citing.select(*on).distinct(), on, "left_semi")


def nearest_lower(stranded: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc, item, ord): each stranded (doc, item, at) goes to the last sentence at or before its place. One sort by document, no pairs."""
    long = sentences.select("doc", F.col("ord").alias("at"), F.lit(0).alias("kind"), F.col("ord"), F.lit(None).cast(stranded.schema["item"].dataType).alias("item")).unionByName(
        stranded.select("doc", "at", F.lit(1).alias("kind"), F.lit(None).cast(sentences.schema["ord"].dataType).alias("ord"), "item")
    )
    w = Window.partitionBy("doc").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn("ord", F.last("ord", ignorenulls=True).over(w)).where("kind = 1").select("doc", "item", "ord")


def cap_by_class(rows: DataFrame, cls: str, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each class, in order."""
    w = Window.partitionBy(cls).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")
