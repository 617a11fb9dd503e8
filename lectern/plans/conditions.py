"""Condition strings of corpus queries as column expressions.

``field:value``, ``field:"two words"``, ``field:[1990 TO 2010]``, ``field:>2000`` and ``_exists_:field``, joined by AND, OR, NOT and brackets.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEX = re.compile(r'\s*(\(|\)|\bAND\b|\bOR\b|\bNOT\b|[\w.]+:(?:"[^"]*"|\[[^\]]*\]|[<>]=?[^\s()]+|[^\s()]+))')


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        out.append(m.group(1))
        at = m.end()
    return out


def nested_fields(text: str) -> list[str]:
    """Fields with a dot in their names, outside of quotes, each once in order."""
    return list(dict.fromkeys(re.findall(r"\b(\w+(?:\.\w+)+):", re.sub(r'"[^"]*"', '""', text))))


def _leaf(term: str) -> Column:
    field, _, value = term.partition(":")
    if field == "_exists_":
        return F.col(value).isNotNull()
    c = F.col(field)
    if m := re.match(r"\[(.+?) TO (.+?)\]$", value):
        out = F.lit(True)
        for end, low in ((m.group(1), True), (m.group(2), False)):
            if end != "*":
                x = F.lit(float(end)) if re.fullmatch(r"-?\d+(\.\d+)?", end) else F.lit(end)
                side = c if not re.fullmatch(r"-?\d+(\.\d+)?", end) else c.try_cast("double")
                out = out & ((side >= x) if low else (side <= x))
        return F.coalesce(out, F.lit(False))
    if m := re.match(r"([<>]=?)(.+)$", value):
        x = c.try_cast("double")
        return F.coalesce({"<": x < float(m.group(2)), "<=": x <= float(m.group(2)), ">": x > float(m.group(2)), ">=": x >= float(m.group(2))}[m.group(1)], F.lit(False))
    value = value.strip('"')
    if "*" in value:
        return F.coalesce(F.lower(c).like(value.lower().replace("%", r"\%").replace("*", "%")), F.lit(False))
    return F.coalesce(F.lower(c.cast("string")) == value.lower(), F.lit(False))


def parse(text: str) -> Column:
    """NOT binds before AND, AND before OR; terms side by side are joined by AND. An empty string holds for all."""
    ts = tokens(text) if text and text.strip() else []
    if not ts:
        return F.lit(True)

    def either() -> Column:
        out = both()
        while ts and ts[0] == "OR":
            ts.pop(0)
            out = out | both()
        return out

    def both() -> Column:
        out = one()
        while ts and ts[0] not in ("OR", ")"):
            if ts[0] == "AND":
                ts.pop(0)
            out = out & one()
        return out

    def one() -> Column:
        if not ts:
            raise ValueError("a condition is missing")
        t = ts.pop(0)
        if t == "NOT":
            return ~one()
        if t == "(":
            out = either()
            if not ts or ts.pop(0) != ")":
                raise ValueError("a bracket is open")
            return out
        if t in (")", "AND", "OR"):
            raise ValueError(f"unexpected {t}")
        return _leaf(t)

    out = either()
    if ts:
        raise ValueError(f"unexpected {ts[0]}")
    return out


def select(df: DataFrame, conditions: str = "", corpus: str = "", fields: list[str] | None = None, sort: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows that meet the conditions and the corpus-wide filter, sorted and cut as asked."""
    out = df.where(parse(corpus) & parse(conditions))
    if sort:
        out = out.orderBy(*[F.desc(s[1:]) if s.startswith("-") else F.asc(s) for s in sort])
    if limit is not None:
        out = out.limit(limit)
    return out.select(*fields) if fields else out


def test_files(papers: DataFrame, explicit: list[str] | None = None, conditions: str = "", ignore: DataFrame | None = None, sort: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Papers to test on: those listed, else those that meet the conditions and aren't to be ignored."""
    if explicit:
        return papers.where(F.col("guid").isin(explicit))
    out = papers.where(parse(conditions))
    if ignore is not None:
        out = out.join(ignore.select("guid"), "guid", "left_anti")
    if sort:
        out = out.orderBy(*sort)
    return out.limit(most) if most is not None else out
