"""Scientific papers in XML as nested rows: metadata, elements in order, references and citations.

Dialects are told apart by their roots. Paragraphs with mixed content can't be split by the built-in XML functions without losing the order of
their parts, so each file is parsed once in a batch function; everything after is columns.
"""

from __future__ import annotations

import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the beginning of a file shows of its dialect.
DIALECTS = [("sapienta", r"<ebiroot|<SAPIENTA|<annotationART"), ("azscixml", r"<PAPER\b[\s\S]*?<(?:S|A-S)\b[^>]*\b(?:AZ|IA)="), ("scixml", r"<PAPER\b"), ("paperxml", r"<Article\b|<paper>\s*<title"), ("jats", r"<article\b|JATS|nlm\.nih\.gov")]
#: Publication dates by preference.
DATE_TYPES = ["pmc-release", "epub", "ppub", "pub", ""]

SCHEMA = """guid string, dialect string, title string, year string, doi string, pmid string, authors array<struct<given:string,family:string,affiliation:string>>,
elements array<struct<elem_id:string,elem_type:string,parent:string,ord:int,header:string,text:string,zone:string>>,
refs array<struct<ref_id:string,title:string,year:string,surnames:array<string>,doi:string,pmid:string,text:string>>,
citations array<struct<cit_id:string,ref_id:string,elem_id:string>>, error string"""


def dialect(text: str) -> str | None:
    return next((name for name, rx in DIALECTS if re.search(rx, text)), None)


def _text(e: ET.Element | None) -> str:
    return re.sub(r"\s+", " ", "".join(e.itertext())).strip() if e is not None else ""


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""


class _Reader:
    """One document. Citation elements become <CIT ID=citN/> in the text they stand in."""

    CITES = {"xref": "rid", "ref": "refid", "cit": "id"}
    PARAGRAPHS = {"p": "p", "s": "s", "a-s": "s", "li": "p-li", "footnote": "footnote", "fn": "footnote", "region": "p"}
    SECTIONS = {"sec", "div", "section", "abstract", "body"}
    HEADERS = {"title", "header", "head"}
    BIBLIOGRAPHY = {"ref-list", "referencelist", "reflist", "bibliography"}

    def __init__(self) -> None:
        self.elements: list[dict] = []
        self.citations: list[dict] = []
        self.refs: list[dict] = []

    def inner(self, e: ET.Element, elem_id: str) -> str:
        out = [e.text or ""]
        for c in e:
            t = _tag(c)
            key = self.CITES.get(t)
            target = {k.lower(): v for k, v in c.attrib.items()}.get(key, "") if key else ""
            if key and (t != "xref" or c.attrib.get("ref-type", "bibr") == "bibr") and target:
                for one in target.split():
                    cit = f"cit{len(self.citations)}"
                    self.citations.append({"cit_id": cit, "ref_id": one, "elem_id": elem_id})
                    out.append(f"<CIT ID={cit}/>")
            else:
                out.append(self.inner(c, elem_id))
            out.append(c.tail or "")
        return "".join(out)

    def add(self, kind: str, parent: str, text: str = "", header: str | None = None, zone: str | None = None, elem_id: str | None = None) -> str:
        name = elem_id or f"{kind}{len(self.elements)}"
        self.elements.append({"elem_id": name, "elem_type": kind, "parent": parent, "ord": len(self.elements), "header": header, "text": text, "zone": zone})
        return name

    def walk(self, e: ET.Element, parent: str) -> None:
        for c in e:
            t = _tag(c)
            if t in self.BIBLIOGRAPHY:
                for r in c.iter():
                    if _tag(r) in ("ref", "reference"):
                        self.refs.append(self.reference(r))
            elif t in self.SECTIONS:
                header = next((_text(h) for h in c if _tag(h) in self.HEADERS), "Abstract" if t == "abstract" else None)
                self.walk(c, self.add("section", parent, header=header) if t != "body" else parent)
            elif t in self.PARAGRAPHS:
                sentences = [s for s in c.iter() if s is not c and _tag(s) in ("s", "a-s")]
                if sentences:
                    p = self.add("p", parent)
                    for s in sentences:
                        self.sentence(s, p)
                elif t in ("s", "a-s"):
                    self.sentence(c, parent)
                else:
                    name = f"p{len(self.elements)}"
                    self.elements.append({"elem_id": name, "elem_type": self.PARAGRAPHS[t], "parent": parent, "ord": len(self.elements), "header": None, "text": "", "zone": None})
                    self.elements[-1]["text"] = re.sub(r"\s+", " ", self.inner(c, name)).strip()
            elif t not in self.HEADERS and t not in ("front", "metadata", "back-matter"):
                self.walk(c, parent)

    def sentence(self, s: ET.Element, parent: str) -> None:
        a = {k.lower(): v for k, v in s.attrib.items()}
        ann = next((x for x in s if _tag(x) == "coresc1" or _tag(x).startswith("annotation")), None)
        zone = a.get("az") or (ann.attrib.get("type") if ann is not None else None) or a.get("ia")
        name = f"s{len(self.elements)}"
        self.elements.append({"elem_id": name, "elem_type": "s", "parent": parent, "ord": len(self.elements), "header": None, "text": "", "zone": zone})
        self.elements[-1]["text"] = re.sub(r"\s+", " ", self.inner(s, name)).strip()

    def reference(self, r: ET.Element) -> dict:
        find = lambda *names: next((x for x in r.iter() if _tag(x) in names), None)
        source, article = find("source", "journal"), find("article-title", "title")
        kind = next((x.attrib.get("publication-type", "") for x in r.iter() if "publication-type" in x.attrib), "")
        title = _text(source) if kind == "book" and source is not None else _text(article) or _text(source) or "<NO TITLE>"
        ids = {x.attrib.get("pub-id-type", ""): _text(x) for x in r.iter() if _tag(x) == "pub-id"}
        names = [_text(x) for x in r.iter() if _tag(x) == "surname"]
        year = _text(find("year", "date")) or (m.group() if (m := re.search(r"(?:1[89]|20)\d\d[a-z]?", _text(r))) else "")
        return {"ref_id": r.attrib.get("id") or r.attrib.get("ID") or f"ref{len(self.refs)}", "title": title, "year": year, "surnames": names, "doi": ids.get("doi"), "pmid": ids.get("pmid"), "text": _text(r)}


def parse(text: str | None, name: str = "") -> dict:
    """One document as a row of SCHEMA; a file that can't be read has only its name's guid and an error."""
    guid = str(uuid.uuid5(uuid.NAMESPACE_DNS, name or text or ""))
    empty = {"guid": guid, "dialect": None, "title": None, "year": None, "doi": None, "pmid": None, "authors": [], "elements": [], "refs": [], "citations": [], "error": None}
    if not text or not text.strip():
        return empty | {"error": "empty"}
    kind = dialect(text)
    if kind is None:
        return empty | {"error": "unknown dialect"}
    try:
        root = ET.fromstring(text.encode("utf-8") if not text.lstrip().startswith("<?xml") else re.sub(r"^\s*<\?xml[^>]*\?>", "", text).encode("utf-8"))
    except ET.ParseError as e:
        return empty | {"dialect": kind, "error": f"not well-formed: {e}"}
    find = lambda *names: next((x for x in root.iter() if _tag(x) in names), None)
    dates = {d.attrib.get("pub-type") or d.attrib.get("date-type") or "": d for d in root.iter() if _tag(d) == "pub-date"}
    best = next((dates[t] for t in DATE_TYPES if t in dates), None)
    year = _text(next((x for x in best if _tag(x) == "year"), None)) if best is not None else _text(find("year"))
    ids = {x.attrib.get("pub-id-type", ""): _text(x) for x in root.iter() if _tag(x) == "article-id"}
    places = {a.attrib.get("id", ""): _text(a) for a in root.iter() if _tag(a) == "aff"}
    authors = []
    for c in root.iter():
        if _tag(c) in ("contrib", "author") and not any(c in list(r.iter()) for r in root.iter() if _tag(r) in _Reader.BIBLIOGRAPHY):
            part = {_tag(x): _text(x) for x in c.iter()}
            rid = next((x.attrib.get("rid", "") for x in c.iter() if _tag(x) == "xref" and x.attrib.get("ref-type") == "aff"), "")
            family = part.get("surname") or (part.get(_tag(c), "").split() or [""])[-1]
            authors.append({"given": part.get("given-names", ""), "family": family, "affiliation": places.get(rid)})
    reader = _Reader()
    reader.walk(root, "")
    body = any(_tag(x) == "body" for x in root.iter())
    return empty | {
        "dialect": kind, "title": _text(find("article-title", "title")) or None, "year": year or None, "doi": ids.get("doi"), "pmid": ids.get("pmid"), "authors": authors,
        "elements": reader.elements, "refs": reader.refs, "citations": reader.citations, "error": None if body or kind not in ("jats", "sapienta") else "no body",
    }


def read(spark: SparkSession, path: str) -> DataFrame:
    """All files under ``path`` as SCHEMA rows, one a file."""
    return parsed(spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path).select(F.input_file_name().alias("name"), F.col("value").alias("xml")))


def parsed(files: DataFrame) -> DataFrame:
    """SCHEMA rows of (name, xml) rows."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([parse(x, n.rpartition("/")[2]) for n, x in zip(b["name"], b["xml"], strict=True)], columns=["guid", "dialect", "title", "year", "doi", "pmid", "authors", "elements", "refs", "citations", "error"])

    return files.mapInPandas(each, SCHEMA)


def exploded(papers: DataFrame, part: str) -> DataFrame:
    """Rows of ``elements``, ``refs``, ``citations`` or ``authors`` beside the guid."""
    return papers.select("guid", F.inline(part))


def to_scixml(elements: DataFrame) -> DataFrame:
    """(guid, xml): documents written as sections, paragraphs and sentences in order, citations as <REF>."""
    esc = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    cits = F.regexp_replace(esc, r"&lt;CIT ID=(\w+)\s*/>", '<REF ID="$1"/>')
    head = F.replace(F.replace(F.coalesce("header", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    zone = F.coalesce(F.concat(F.lit(' AZ="'), "zone", F.lit('"')), F.lit(""))
    one = F.when(F.col("elem_type") == "section", F.concat(F.lit("<HEADER>"), head, F.lit("</HEADER>"))).when(F.col("elem_type") == "s", F.concat(F.lit("<S"), zone, F.lit(">"), cits, F.lit("</S>"))).otherwise(F.concat(F.lit("<P>"), cits, F.lit("</P>")))
    items = F.array_sort(F.collect_list(F.struct("ord", one.alias("x"))))
    return elements.groupBy("guid").agg(F.concat(F.lit("<PAPER><BODY>"), F.array_join(F.transform(items, lambda i: i["x"]), ""), F.lit("</BODY></PAPER>")).alias("xml"))


def save_json(papers: DataFrame, path: str) -> None:
    papers.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents saved as JSON lines, nested as SCHEMA; missing parts are null."""
    return spark.read.schema(SCHEMA.replace("\n", " ")).json(path)
