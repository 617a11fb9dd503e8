"""References in the XML of citation parsers, paths into XML, and documents written as XML and HTML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a reference and the elements that hold them, in the order in which a title is looked for.
FIELDS = {"title": ("title", "article-title"), "year": ("date", "year"), "volume": ("volume",), "pages": ("pages",), "journal": ("journal", "source"), "publisher": ("publisher",), "location": ("location",), "booktitle": ("booktitle",), "raw": ("rawstring", "mixed-citation")}
REFERENCE = "title string, year string, volume string, pages string, journal string, publisher string, location string, booktitle string, raw string, kind string, authors array<string>, surnames array<string>"
_IN = re.compile(r"[,.]\s?In:?\s(\w.*)$")
_THESIS = re.compile(r",\s((?:doctoral |msc |phd )?(?:thesis|dissertation)\b.*)$", re.I)


def path_select(root: ET.Element, path: str) -> list[ET.Element]:
    """Elements at a path of names; a step with a question mark may be absent."""
    at = [root]
    for step in path.strip("/").split("/"):
        name, optional = step.rstrip("?"), step.endswith("?")
        found = [c for e in at for c in e if isinstance(c.tag, str) and c.tag.rpartition("}")[2].lower() == name.lower()]
        at = found or (at if optional else [])
    return at


def _reference(c: ET.Element) -> dict:
    first = lambda names: next(("".join(x.itertext()).strip(" .") for n in names for x in c.iter() if isinstance(x.tag, str) and x.tag.lower() == n), "")
    r = {k: first(v) for k, v in FIELDS.items()}
    # A title that the parser put elsewhere.
    if len(r["title"]) < 2:
        for other in ("journal", "location"):
            if len(r[other]) > 2:
                r["title"], r[other] = r[other], ""
                break
    for rx in (_IN, _THESIS):
        if m := rx.search(r["title"]):
            r["journal"] = m[1] + (" " + r["journal"] if r["journal"] else "")
            r["title"] = r["title"][: m.start()].strip(" ,")
    r["title"] = re.sub(r"[.,;]\s?In\s*$", "", r["title"])
    authors = ["".join(a.itertext()).strip() for a in c.iter() if isinstance(a.tag, str) and a.tag.lower() in ("author", "name", "string-name")]
    family = [a.split(",")[0].strip() if "," in a else (a.split() or [""])[-1] for a in authors]
    return r | {"kind": "booktitle" if r["booktitle"] else "journal" if r["journal"] else None, "authors": authors, "surnames": [f for f in family if f]}


def parsed_references(files: DataFrame) -> DataFrame:
    """(name, number, fields): the references in the output (name, xml) of a citation parser, numbered from 1; files that are no XML have none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["name", "number", *[f.split()[0] for f in REFERENCE.split(", ")]]
        for b in batches:
            out = []
            for name, xml in zip(b["name"], b["xml"], strict=True):
                try:
                    root = ET.fromstring(xml or "")
                except ET.ParseError:
                    continue
                cited = [e for e in root.iter() if isinstance(e.tag, str) and e.tag.lower() in ("citation", "element-citation", "mixed-citation", "ref")]
                out += [{"name": name, "number": k, **_reference(c)} for k, c in enumerate([c for c in cited if not any(d in cited for d in c.iter() if d is not c)], 1)]
            yield pd.DataFrame(out, columns=columns)

    return files.select("name", "xml").mapInPandas(read, f"name string, number int, {REFERENCE}")


def _escaped(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _cited(c: Column, by: str) -> Column:
    return F.regexp_replace(_escaped(c), r"&lt;CIT ID=(\w+)\s*/&gt;", by)


def _assembled(elements: DataFrame, piece: Column, sep: str = "") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", piece.alias("x")))), lambda i: i["x"]), sep)


def to_jats(elements: DataFrame, papers: DataFrame) -> DataFrame:
    """(guid, xml): documents (elements in order; papers with guid, title, year) as JATS articles of headers and paragraphs, citations as xref."""
    body = F.when(F.col("elem_type") == "section", F.concat(F.lit("<title>"), _escaped(F.col("header")), F.lit("</title>"))).otherwise(F.concat(F.lit("<p>"), _cited(F.col("text"), '<xref ref-type="bibr" rid="$1"/>'), F.lit("</p>")))
    text = elements.groupBy("guid").agg(_assembled(elements, body).alias("__b"))
    front = F.concat(F.lit("<front><article-meta><title-group><article-title>"), _escaped(F.col("title")), F.lit("</article-title></title-group><pub-date pub-type=\"pub\"><year>"), _escaped(F.col("year")), F.lit("</year></pub-date></article-meta></front>"))
    return papers.select("guid", "title", "year").join(text, "guid", "left").select("guid", F.concat(F.lit("<article>"), front, F.lit("<body><sec>"), F.coalesce("__b", F.lit("")), F.lit("</sec></body></article>")).alias("xml"))


#: Renderers by kind of element: a column of HTML each, from header and text. Own ones can be passed beside them.
RENDERERS: dict[str, Callable[[], Column]] = {
    "section": lambda: F.concat(F.lit("<h2>"), _escaped(F.col("header")), F.lit("</h2>")),
    "s": lambda: F.concat(F.lit('<span class="s">'), _cited(F.col("text"), '<a class="cit" href="#$1">[$1]</a>'), F.lit("</span>")),
    "p": lambda: F.concat(F.lit("<p>"), _cited(F.col("text"), '<a class="cit" href="#$1">[$1]</a>'), F.lit("</p>")),
}


def to_html(elements: DataFrame, renderers: dict[str, Callable[[], Column]] | None = None, references: DataFrame | None = None) -> DataFrame:
    """(guid, html): documents rendered element by element in order, each by the renderer of its kind, paragraphs' where there is none; with a list of references (guid, ref_id, text) below."""
    use = RENDERERS | (renderers or {})
    piece = use["p"]()
    for kind, r in use.items():
        piece = F.when(F.col("elem_type") == kind, r()).otherwise(piece)
    out = elements.groupBy("guid").agg(_assembled(elements, piece, "\n").alias("html"))
    if references is None:
        return out
    item = F.concat(F.lit('<li id="'), "ref_id", F.lit('">'), _escaped(F.col("text")), F.lit("</li>"))
    lists = references.groupBy("guid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_id", item.alias("x")))), lambda i: i["x"]), "").alias("__r"))
    return out.join(lists, "guid", "left").select("guid", F.concat("html", F.when(F.col("__r").isNotNull(), F.concat(F.lit("\n<ol>"), "__r", F.lit("</ol>"))).otherwise("")).alias("html"))


def replaced_references(annotated: DataFrame, originals: DataFrame) -> DataFrame:
    """Annotated files (pmid, xml) whose <ref-list> is that of the original file of the same id; those without an original, or without a list, stay."""
    own = originals.select("pmid", F.regexp_extract("xml", r"(?s)(<ref-list\b.*</ref-list>)", 1).alias("__list"))
    j = annotated.join(own, "pmid", "left")
    parts = F.split("xml", r"(?s)<ref-list\b.*</ref-list>", 2)
    whole = F.concat(F.get(parts, F.lit(0)), "__list", F.get(parts, F.lit(1)))
    return j.withColumn("xml", F.when((F.coalesce("__list", F.lit("")) != "") & (F.size(parts) == 2), whole).otherwise(F.col("xml"))).drop("__list")


def write_files(documents: DataFrame, path: str, content: str, by: str = "guid") -> None:
    """A folder with one text a document in the rows' partitions, named by its id in column ``by``."""
    documents.select(by, F.col(content).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def without_soft_hyphens(col: Column | str) -> Column:
    """Text of a page reader without soft hyphens, ligatures and letters of compatibility in their plain forms."""
    from lectern.functions.annotate import nfkd

    return nfkd(F.replace(F.col(col) if isinstance(col, str) else col, F.lit("­"), F.lit("")))
