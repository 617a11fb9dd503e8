"""Text functions that no built-in expresses, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import NUMBERED

_APA = re.compile(r"(?P<a1>[A-Z][\w'’-]+)(?: (?:and|&) (?P<a2>[A-Z][\w'’-]+)| (?P<etal>et al\.?))?,? ?(?P<open>\()?(?P<year>(?:1[89]|20)\d\d[a-z]?)(?(open)\))")
_CITATION = "array<struct<id:int,text:string,a1:string,a2:string,etal:boolean,year:string,nums:array<int>>>"


def nfkd(col: Column | str) -> Column:
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")

    return f(col)


def guid_of(*cols: Column | str) -> Column:
    """A GUID that depends on the given texts alone."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: str(uuid.uuid5(uuid.NAMESPACE_DNS, t)), na_action="ignore")

    return f(F.concat_ws("\u0001", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols]))


def _annotated(text: str | None, style: str | None) -> dict:
    if text is None:
        return {"text": None, "citations": []}
    found: list[dict] = []

    def mark(c: dict) -> str:
        found.append(c | {"id": len(found) + 1})
        return f"<CIT ID={len(found)}/>"

    blank = {"a1": None, "a2": None, "etal": None, "year": None, "nums": None}
    if style == "APA":
        text = _APA.sub(lambda m: mark(blank | {"text": m.group(), "a1": m["a1"], "a2": m["a2"], "etal": bool(m["etal"]), "year": m["year"]}), text)
    elif style == "AFI":

        def number(m: re.Match) -> str:
            nums: list[int] = []
            for p in m.group()[1:-1].split(","):
                ends = [int(x) for x in re.findall(r"\d+", p)]
                nums += range(ends[0], ends[1] + 1) if len(ends) == 2 and ends[0] <= ends[1] <= 9999 else ends
            return mark(blank | {"text": m.group(), "nums": nums})

        text = re.sub(NUMBERED, number, text)
    return {"text": text, "citations": found}


def annotate_citations(text: Column | str, style: Column | str) -> Column:
    """(text, citations): citations of the style (APA, AFI) replaced by <CIT ID=n/> and taken apart; other styles leave the text as it is."""

    @F.pandas_udf(f"text string, citations {_CITATION}")
    def f(t: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_annotated(a, b) for a, b in zip(t, s, strict=True)], columns=["text", "citations"])

    return f(text, style)


def author_mentions(text: Column | str, surnames: Column | str) -> Column:
    """Mentions of the given surnames, with a year that follows, as one __author each."""

    @F.pandas_udf("string")
    def f(t: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for x, ns in zip(t, names, strict=True):
            own = [re.escape(n) for n in (ns if ns is not None else []) if n and any(c.isupper() for c in n)]
            if x is None or not own:
                out.append(x)
                continue
            one = rf"(?:{'|'.join(sorted(own, key=len, reverse=True))})(?: et al\.?)?(?:,? \(?(?:1[89]|20)\d\d[a-z]?\)?)?"
            out.append(re.sub(rf"\b{one}(?:(?:,| and| &) {one})*", "__author", x))
        return pd.Series(out)

    return f(text, surnames)


def formulaic(text: Column | str, patterns: dict[str, list[str]], concepts: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """F_<type>: whether any pattern of the type occurs. @CONCEPT stands for any of its words, JJ, NN and RB for any word, a blank for any white space."""
    out = {}
    for name, ps in patterns.items():
        alternatives = []
        for p in ps:
            parts = []
            for w in p.split(" "):
                if w.startswith("@"):
                    parts.append("(?:" + "|".join(re.escape(x) for x in (concepts or {}).get(w[1:], [])) + ")")
                else:
                    parts.append(r"\w+" if w in ("JJ", "NN", "RB") else re.escape(w))
            alternatives.append(r"\b" + r"\s+".join(parts) + ("" if parts[-1] == r"\w+" else r"\b"))
        out[f"F_{name}"] = F.coalesce(F.col(text).rlike("(?i)" + "|".join(alternatives)) if isinstance(text, str) else text.rlike("(?i)" + "|".join(alternatives)), F.lit(False))
    return out
