"""Variant spellings of names typed by people.

Merge-and-rematch resolution: records are parsed into names, blocked by evidence that two spellings can share (an affiliation or a paper
beside either end of a family name), compared, and merged where each is the other's best match. A merged profile has the union of
its records' spellings, initials, affiliations and papers and enters blocking again, until nothing merges any more. Profiles whose
full given names, middle initials or group names contradict each other don't merge, however well some spellings agree.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import full_frames
from lectern.operators.skew import spread_join

#: Forms of given names, the full name first.
NICKNAMES = """
alexander alex sandy al xander; alexandra alex sandra sasha; andrew andy drew; anthony tony; anastasia stacy ana; barbara barb babs; benjamin ben benny; charles charlie chuck; christopher chris kit; christina chris tina; daniel dan danny; david dave davy; deborah deb debbie debra; dorothy dot dottie dolly;
edward ed eddie ted ned; elizabeth liz beth betty eliza lizzie lisa; eleanor ellie nell; francisco paco pancho fran; francis frank fran; franklin frank; frederick fred freddy freddie; friedrich fritz; gabriel gabe; gerald jerry gerry; gregory greg; giuseppe beppe peppe; harold harry hal; henry harry hank; isabella bella isa; ivana iva;
jacob jake; james jim jimmy jamie; jennifer jen jenny; jessica jess jessie; johannes hans jo johan; john jack johnny jon; jonathan jon johnny; joseph joe joey; josephine jo josie; joshua josh; judith judy; katherine kate kathy katie kat kay; kenneth ken kenny; lawrence larry laurie; leonard len lenny leo; louis lou; margaret maggie meg peggy marge greta; martha marty; martin marty; matthew matt; michael mike mick mickey; michelle shelly;
nathaniel nate nat; nathan nate; nicholas nick nicky; nicole nicky; olga olya; pamela pam; patricia pat patty trish tricia; patrick pat paddy; peter pete; philip phil; raymond ray; rebecca becky becca; richard rick dick rich richie ricky; robert rob bob bobby robbie; ronald ron ronnie; samantha sam; samuel sam sammy; stephen steve steven; steven steve; stephanie steph; susan sue susie; theodore ted theo teddy; thomas tom tommy; timothy tim; valerie val; vanessa nessa; victoria vicky tori; vincent vince vin; walter walt; william bill will billy willy liam; zachary zach zack; ekaterina katya kate; dmitri dima mitya; tomas tom; vladimir vova; mohammed mo
"""
_CANON: dict[str, set[str]] = {}
for _line in NICKNAMES.replace("\n", " ").split(";"):
    _names = _line.split()
    for _n in _names:
        _CANON.setdefault(_n, set()).add(_names[0])
#: Words of titles and degrees, of groups, and forms of words in names of institutions.
_TITLES = set("dr prof professor mr mrs ms miss sir dame rev phd ph.d md m.d msc bsc ma ba dphil jr sr ii iii iv esq dipl ing hon".split())
_PARTICLES = set("de del della der den di da dos du van von zu la le al el ibn bin ter ten".split())
_GROUP_TYPES = {"consortium": "consortium", "collaboration": "collaboration", "network": "network", "group": "group", "working": "", "team": "team", "project": "project", "taskforce": "taskforce", "initiative": "initiative", "committee": "committee", "alliance": "alliance", "society": "society", "association": "association", "investigators": "investigators", "panel": "panel", "board": "board", "partnership": "partnership", "council": "council"}
_GROUP = re.compile(r"\b(?:consortium|collaboration|network|(?:working|study|research|interest) group|task force|project|team|initiative|committee|alliance|society|association|investigators|panel|partnership|council|on behalf of|cons\.|collab\.|netw\.|working grp\.?|wkg\.? grp\.?|grp\.|task f\.|assoc\.|comm\.)(?=\W|$)", re.I)
_INSTITUTION = {"univ": "university", "u": "university", "uni": "university", "inst": "institute", "tech": "technology", "natl": "national", "nat": "national", "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory", "acad": "academy", "sci": "sciences", "science": "sciences", "res": "research", "ctr": "centre", "center": "centre", "cent": "centre", "coll": "college", "polytech": "polytechnic", "poly": "polytechnic", "hosp": "hospital", "fac": "faculty", "dept": "department", "sch": "school"}
_UNIT = re.compile(r"^\s*(?:dept|department|school|sch|faculty|fac|division|div|section|chair|lab(?:oratory)? (?:of|for)|institute (?:of|for) \w+)\b[^,]*,\s*", re.I)
#: Profiles of one block, or askers of one pair, that a task compares.
BLOCK = 1000
_SEP, _EDGE = "\x1f", "a bigint, b bigint, place boolean, paper boolean, score double"
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "a", "œ": "o", "ı": "i", "ð": "d", "þ": "th"})
_UMLAUT = re.compile(r"(?<=[b-df-hj-np-tv-z])([aou])e(?=[b-df-hj-np-tv-z])|^([aou])e(?=[b-df-hj-np-tv-z])")


def fold(text: str) -> str:
    """Small letters without accents; ae, oe and ue as the letters they stand for."""
    t = text.lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t.translate(_LETTERS)) if not unicodedata.combining(c))
    return _UMLAUT.sub(lambda m: m.group(1) or m.group(2), t)


def institution(name: str | None) -> str:
    """The institution of an affiliation without its unit, with words in one form and order; empty if none."""
    if not name:
        return ""
    t = _UNIT.sub("", name)
    words = [_INSTITUTION.get(w, w) for w in re.findall(r"[^\W_]+", fold(t)) if w not in ("of", "the", "and", "for", "at", "in")]
    return " ".join(sorted(set(words)))


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits with swaps of neighbours, ``most`` + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        prev2, prev = prev, row
    return min(prev[-1], most + 1)


def parse_group(name: str) -> tuple[str, str, str]:
    """(own name, topic, type) of a group, folded; topic may be empty."""
    t = re.sub(r"\b(?:on behalf of|for|by)\b|\bthe\b", " ", fold(name))
    t = re.sub(r"task\s+force|\bt\.?f\.(?=\W|$)", "taskforce", t)
    if "," in t:
        head, _, tail = t.partition(",")
        t = f"{tail} {head}"
    words = [w for w in re.findall(r"[^\W_]+", t)]
    kind, rest = "", []
    for w in words:
        full = next((v for k, v in _GROUP_TYPES.items() if w == k or len(w) >= 3 and k.startswith(w)), None)
        if full is None:
            rest.append(w)
        elif full:
            kind = full
    return (rest[0] if rest else ""), (rest[1] if len(rest) > 1 else ""), kind


def parse_person(full: str | None, surname: str | None, meta: dict) -> list[tuple[str, str, str]]:
    """(family, given, middle initials) as typed and, where the order is open, the other way round. Given may be an initial or empty."""
    text = fold(full or " ".join(str(meta.get(k) or "") for k in ("given", "middle", "family")))
    text = re.sub(r"\b(?:ph\.?\s?d|m\.d|d\.?phil|m\.?sc|b\.?sc)\b\.?|[*†‡§¹²³\d]+", " ", text)
    caps = bool(full) and any(len(w) > 2 and w.isupper() for w in re.findall(r"[^\W\d_]+", full))
    comma = [p.strip(" .") for p in text.split(",")]
    comma = [p for p in comma if p and p.replace(".", "") not in _TITLES]
    known = fold(surname or str(meta.get("family") or "")).strip(" .,")

    def words(s: str) -> list[str]:
        return [w for w in re.findall(r"[^\W_]+(?:[-’'][^\W_]+)*", re.sub(r"\.", ". ", s)) if w not in _TITLES]

    def split_given(ws: list[str]) -> tuple[str, str]:
        if not ws:
            return "", ""
        first, rest = ws[0], ws[1:]
        return first, "".join(w[0] for w in rest)

    def family_of(ws: list[str]) -> str:
        return " ".join(w for w in ws if w not in _PARTICLES) or " ".join(ws)

    def strip_article(f: str) -> str:
        return re.sub(r"^(?:al|el|ibn|bin|o|d)[-’'](?=\w{3})", "", f)

    out: list[tuple[str, str, str]] = []
    if len(comma) >= 2:
        g, m = split_given(words(comma[1]))
        out.append((family_of(words(comma[0])), g, m))
    else:
        ws = words(comma[0]) if comma else []
        ws = [w for w in ws if w not in _PARTICLES] or ws
        if not ws:
            return []
        if len(ws) == 1:
            out.append((ws[0], "", ""))
        else:
            last = ws[-1]
            # Initials after the name: "NAME AB" or "Name A B".
            if (caps and len(last) <= 3 and not re.search(r"[aeiou].*[aeiou]", last)) or all(len(w) == 1 for w in ws[1:]) or (caps and len(last) <= 2):
                tail = "".join(ws[1:])
                if len(ws[0]) > 2:
                    out.append((ws[0], tail[0], tail[1:]))
            if not out:
                g, m = split_given(ws[:-1])
                out.append((last, g, m))
                if len(ws) == 2 and len(ws[0]) > 1 and len(ws[1]) > 1 or (len(ws) == 3 and len(ws[2]) > 1 and len(ws[1]) == 1 and len(ws[0]) > 1):
                    out.append((ws[0], ws[-1], ws[1][0] if len(ws) == 3 else ""))
                if len(ws) >= 3 and len(ws[-1]) == 1 and len(ws[0]) > 2:
                    out.append((ws[0], ws[1], ws[-1]))
    out = [(strip_article(f), g, m) for f, g, m in out]
    kf = strip_article(family_of(words(known))) if known else ""
    # The surname column may be the given name where parts were swapped, so it chooses nothing; it only adds a reading of its own.
    if kf and len(comma) < 2 and all(kf != f for f, _, _ in out) and full and kf in text:
        rest = [w for w in words(text) if w not in kf.split() and w not in _PARTICLES]
        g, m = split_given(rest)
        out.append((kf, g, m))
    return list(dict.fromkeys(out))


def _given_score(a: str, b: str) -> float:
    if not a or not b:
        return 0.3
    if len(a) == 1 or len(b) == 1:
        ca, cb = {a[0]} | {c[0] for c in _CANON.get(a, ())}, {b[0]} | {c[0] for c in _CANON.get(b, ())}
        return (0.5 if len(a) == len(b) == 1 else 0.6) if ca & cb else 0.0
    if a == b:
        return 1.0
    if ({a} | _CANON.get(a, set())) & ({b} | _CANON.get(b, set())):
        return 0.95
    d = distance(a, b, 2)
    if d == 1 and min(len(a), len(b)) >= 4:
        return 0.85
    if d == 1 and min(len(a), len(b)) == 3 and a[0] == b[0]:
        return 0.7
    if d == 2 and min(len(a), len(b)) >= 7:
        return 0.7
    for x in _CANON.get(a, ()):
        if len(x) >= 5 and distance(x, b, 1) == 1:
            return 0.7
    for x in _CANON.get(b, ()):
        if len(x) >= 5 and distance(x, a, 1) == 1:
            return 0.7
    return 0.0


def _family_score(a: str, b: str) -> float:
    if a == b:
        return 1.0
    pa, pb = re.split(r"[\s-]+", a), re.split(r"[\s-]+", b)
    if len(pa) != len(pb) and (set(pa) <= set(pb) or set(pb) <= set(pa)):
        return 0.9
    d = distance(a, b, 2)
    if d == 1 and min(len(a), len(b)) >= 4:
        return 0.85
    if d == 2 and min(len(a), len(b)) >= 8:
        return 0.75
    if len(pa) != len(pb) and any(len(x) >= 5 and distance(x, y, 1) <= 1 for x in pa for y in pb):
        return 0.75
    return 0.0


def compare(one: list[tuple[str, str, str, str]], two: list[tuple[str, str, str, str]]) -> float:
    """How well two profiles' spellings (kind, family, given, middles) agree, 0 where they contradict."""
    if {v[0] for v in one} != {v[0] for v in two}:
        return 0.0
    if one[0][0] == "g":
        best = 0.0
        topics1, topics2 = {v[2] for v in one} - {""}, {v[2] for v in two} - {""}
        if topics1 and topics2 and not any(a == b or a.startswith(b) or b.startswith(a) or distance(a, b, 2) <= 1 for a in topics1 for b in topics2):
            return 0.0
        for _, n1, t1, k1 in one:
            for _, n2, t2, k2 in two:
                if k1 and k2 and k1 != k2:
                    return 0.0
                d = distance(n1, n2, 2)
                if d == 0 or d <= 2 and len(n1) >= 6:
                    best = max(best, (1.0 - 0.15 * d) * (1.0 if t1 and t2 else 0.8))
        return best
    full = clash = 0
    best = 0.0
    middles1, middles2 = {v[3][0] for v in one if v[3]}, {v[3][0] for v in two if v[3]}
    if middles1 and middles2 and not middles1 & middles2:
        return 0.0
    for _, f1, g1, _m1 in one:
        for _, f2, g2, _m2 in two:
            fs = _family_score(f1, f2)
            if fs == 0.0:
                continue
            gs = _given_score(g1, g2)
            if len(g1) > 1 and len(g2) > 1:
                full += 1
                clash += gs == 0.0
            if gs >= 0.3 and (gs >= 0.5 or fs >= 1.0):
                best = max(best, fs * gs + (0.02 if middles1 & middles2 else 0.0))
    # Full given names that agree nowhere contradict each other, whatever initials agree.
    if full and clash == full:
        return 0.0
    return best


@full_frames
def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for guid, full, surname, metadata in zip(b["id"], b["full_name"], b["surname"], b["metadata"], strict=True):
            try:
                meta = json.loads(metadata) if metadata else {}
            except ValueError:
                meta = {}
            meta = meta if isinstance(meta, dict) else {}
            affiliations = {institution(a.get("name")) for a in meta.get("affiliation") or [] if isinstance(a, dict)} - {""}
            papers = {str(p).strip().lower() for p in meta.get("papers") or [] if p}
            text = full or surname or ""
            if _GROUP.search(text):
                n, t, k = parse_group(text)
                spellings = [("g", n, t, k)] if n else []
            else:
                spellings = [("p", f, g, m) for f, g, m in parse_person(full, surname, meta)]
            keys = set()
            for kind, f, g, _m in spellings:
                parts = [p for p in re.split(r"[\s-]+", f) if len(p) >= 2] if kind == "p" else [f]
                initials = {g[:1], *(c[0] for c in _CANON.get(g, ()))} if kind == "p" else {""}
                for p in parts:
                    n = min(4, max(2, len(p) // 2))  # a slip leaves one end whole
                    for end in (f"<{p[:n]}", f"{p[-n:]}>"):
                        keys |= {f"a|{a}|{end}|{i}" for a in affiliations for i in initials}
                        keys |= {f"b|{x}|{end}" for x in papers}
                    if kind == "p" and len(g) > 1:
                        keys |= {f"c|{p}|{g[0]}", f"c|<{p[:4]}|{min(_CANON.get(g, {g}))}", f"c|{p[-4:]}>|{min(_CANON.get(g, {g}))}"}
                    elif kind == "g":
                        keys.add(f"c|{p}|{_m}")
            name = "|".join(sorted(map(str, spellings)))
            if not spellings:
                forms = []
            elif affiliations:
                forms = [f"{name}|{','.join(sorted(affiliations))}"]
            else:
                forms = [f"{name}|{x}" for x in sorted(papers)] if spellings[0][0] == "g" or any(g for _, _, g, _ in spellings) else []
            rows.append((guid, [_SEP.join(s) for s in spellings], sorted(keys), bool(affiliations), forms))
        yield pd.DataFrame(rows, columns=["id", "s", "keys", "placed", "forms"])


def _spellings(packed) -> list[tuple[str, ...]]:  # noqa: ANN001
    return [tuple(s.split(_SEP)) for s in packed]


def _least(group: bool, place: bool, paper: bool) -> float:
    """The agreement of spellings that is enough beside the evidence."""
    return 0.45 if paper else (0.6 if group else 0.5) if place else 0.84


@full_frames
def _scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b, place, paper, score): the score of a pair, -1 where it doesn't match."""
    memo: dict[tuple, float] = {}
    for b in batches:
        scores = []
        for one, two, place, paper in zip(b["s1"], b["s2"], b["place"], b["paper"], strict=True):
            key = (tuple(sorted(one)), tuple(sorted(two)))
            s = memo.get(key)
            if s is None:
                if len(memo) > 200_000:
                    memo.clear()
                s = memo[key] = compare(_spellings(key[0]), _spellings(key[1])) if key[0] and key[1] else 0.0
            ok = s > 0 and s >= _least(key[0][0].startswith("g"), place, paper)
            scores.append(s + 0.5 * paper + 0.4 * place if ok else -1.0)
        yield b[["a", "b", "place", "paper"]].assign(score=scores)


@full_frames
def _gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(pid, into) of groups that come whole and in order: two profiles that merge (turn 0), then those that ask to join them, best first.

    Each is compared with the union of all that joined before it. A part of the askers other than the first meets the same two profiles, but
    joins into a profile of its own, which asks again in the next round.
    """
    now, base, union, head = None, False, set(), None
    for b in batches:
        out = []
        for into, part, turn, pid, s, place, paper in zip(b["into"], b["part"], b["turn"], b["pid"], b["s"], b["place"], b["paper"], strict=True):
            if now != (into, part):
                now, union, head = (into, part), set(), int(into) if part == 0 else None
            if turn == 0:
                union.update(s)
                if part == 0 and pid != into:
                    out.append((int(pid), int(into)))
                continue
            one = _spellings(s)
            if compare(_spellings(sorted(union)), one) >= _least(one[0][0] == "g", place, paper):
                union.update(s)
                if head is None:
                    head = int(pid)
                else:
                    out.append((int(pid), head))
        yield pd.DataFrame(out, columns=["pid", "into"])


def weak_edges(profiles: DataFrame, names: DataFrame, block: int = BLOCK, stand: bool = True) -> DataFrame:
    """(a, b): profiles (pid, s, placed) that agree by name alone and have no other such partner. ``names``: pid, key.

    Counts only where one of the two has no affiliation. Where three profiles or more have the same spellings, each has two such partners among them or is
    met by two, so none has a sole partner: they need not ask, and two of them stand for all where others ask. Without ``stand`` all meet all.
    """
    p = profiles.withColumn("t", F.array_join(F.array_sort("s"), "\n"))
    if stand:
        common = p.groupBy("t").agg(F.count("*").alias("n"), F.min("pid").alias("p1"), F.max("pid").alias("p2")).where("n >= 3").drop("n")
        p = p.join(common, "t", "left").select("pid", "placed", F.col("p1").isNotNull().alias("crowd"), F.expr("p1 is null or pid in (p1, p2)").alias("stands"))
    else:
        p = p.select("pid", "placed", F.lit(False).alias("crowd"), F.lit(True).alias("stands"))
    known = names.join(p, "pid")
    asks = known.where("not placed and not crowd").select(F.col("pid").alias("a"), "key")
    right = known.where("stands").select(F.col("pid").alias("b"), "key")
    pairs = spread_join(asks, right, "key", "b", block).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    scored = _with_profiles(pairs.select("a", "b", F.lit(False).alias("place"), F.lit(False).alias("paper")), profiles).mapInPandas(_scores, _EDGE).where("score > 0")
    ends = scored.select(F.explode(F.array("a", "b")).alias("p"), "a", "b")
    sole = ends.groupBy("p").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.count("*").alias("n")).where("n = 1")
    return sole.groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 2").select("a", "b")


def _with_profiles(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    side = lambda c, s: profiles.select(F.col("pid").alias(c), F.col("s").alias(s))
    return pairs.join(side("a", "s1"), "a").join(side("b", "s2"), "b")


def _best_merges(edges: DataFrame, profiles: DataFrame, block: int) -> DataFrame:
    """(pid, into): profiles that are each other's best match merge, and those whose best match is in such a pair join them where they agree with the whole."""
    ends = edges.where("score > 0").withColumn("p", F.explode(F.array("a", "b")))
    best = ends.groupBy("p").agg(F.max(F.struct("score", F.xxhash64("a", "b").alias("h"), "a", "b", "place", "paper")).alias("best")).select("p", "best.*")
    mutual = best.groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 2")
    seats = mutual.select(F.col("a").alias("into"), F.explode(F.array("a", "b")).alias("member"))
    other = F.when(F.col("p") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member")
    # Both ends of a mutual pair have it as their best, so an asker is one whose best is no such pair.
    asks = best.join(mutual.select("a", "b"), ["a", "b"], "left_anti").select(F.col("p").alias("pid"), "score", "h", "place", "paper", other).join(seats, "member").drop("member")
    parts = asks.groupBy("into").agg(F.count("*").alias("n")).select("into", F.ceil(F.col("n") / block).cast("int").alias("k"))
    two = seats.join(parts, "into", "left").select("into", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)).alias("part"), F.lit(0).alias("turn"), F.col("member").alias("pid"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("h"), F.lit(True).alias("place"), F.lit(True).alias("paper"))
    rest = asks.join(parts, "into").select("into", F.pmod(F.xxhash64("pid"), F.col("k")).cast("int").alias("part"), F.lit(1).alias("turn"), "pid", "score", "h", "place", "paper")
    group = two.unionByName(rest).join(profiles.select("pid", "s"), "pid")
    group = group.repartition("into", "part").sortWithinPartitions("into", "part", "turn", F.desc("score"), F.desc("h"), "pid")
    return group.mapInPandas(_gather, "pid bigint, into bigint")


def resolve(authors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(guid, entity): the entity of every GUID, named by the least GUID in it.

    GUIDs are compared without regard to case and blanks and given as first written; rows of one GUID count as one record with all
    their spellings; null GUIDs are left out, and records without a readable name stand alone. Names, affiliations and
    papers may be null, and metadata no JSON. Rounds end when no profile merges; each merge leaves one profile less, so they end.

    A merged profile's block keys are the union of its records', so the pairs that meet are found once and follow the merges; a round compares anew only those with
    a changed side. A block of more than ``block`` profiles is spread over shards. Each round's tables are written and those of the round before deleted.
    """
    from lectern.functions.keys import guid_key
    from lectern.operators.ranks import numbered
    from lectern.plans.session import discard, written

    named = authors.where(F.col("GUID").isNotNull()).select(guid_key("GUID").alias("key"), F.col("GUID").alias("guid"), "full_name", "surname", "metadata")
    ids = numbered(named.groupBy("key").agg(F.min("guid").alias("guid")), ["key"], "id")
    rows = named.select("key", "full_name", "surname", "metadata").distinct().join(ids.select("key", "id"), "key").drop("key")
    records = written(rows.mapInPandas(_records, "id bigint, s array<string>, keys array<string>, placed boolean, forms array<string>"), "people")
    # Round 0: equal readings at the same institution, or without any on the same paper, are one profile; however many there are, they meet in no pair.
    by_form = records.select("id", F.explode("forms").alias("form"))
    least = by_form.groupBy("form").agg(F.min("id").alias("pid"))
    equal = by_form.join(least, "form").select("id", "pid").unionByName(records.select("id", F.col("id").alias("pid"))).groupBy("id").agg(F.min("pid").alias("pid"))
    # A record whose rows read differently keeps the least profile; such profiles may point at one another, so follow once more.
    first = written(equal, "first")
    assign = written(first.join(first.select(F.col("id").alias("pid"), F.col("pid").alias("next")), "pid", "left").select("id", F.coalesce("next", "pid").alias("pid")), "assign")
    own = records.join(assign, "id")
    profiles = written(own.groupBy("pid").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"), F.max("placed").alias("placed")), "profiles")
    keys = own.select("pid", F.explode("keys").alias("key")).distinct()
    names = written(keys.where("key like 'c|%'"), "names")
    meets = keys.where("key not like 'c|%'")
    found = spread_join(meets.select(F.col("pid").alias("a"), "key"), meets.select(F.col("pid").alias("b"), "key"), "key", "b", block).where("a < b")
    pairs = written(found.groupBy("a", "b").agg(F.max(F.col("key").like("a|%")).alias("place"), F.max(F.col("key").like("b|%")).alias("paper")).withColumn("score", F.lit(None).cast("double")), "pairs")
    discard(first, records)
    while True:
        fresh = _with_profiles(pairs.where("score is null").drop("score"), profiles).mapInPandas(_scores, _EDGE)
        edges = written(pairs.where("score is not null").unionByName(fresh), "edges")
        merges = written(_best_merges(edges, profiles, block), "merges")
        if merges.isEmpty():
            called = names.join(assign.select(F.col("id").alias("pid"), F.col("pid").alias("now")), "pid").select(F.col("now").alias("pid"), "key").distinct()
            weak = weak_edges(profiles, called, block)
            discard(merges)
            merges = written(weak.select(F.col("b").alias("pid"), F.col("a").alias("into")), "merges")
            if merges.isEmpty():
                break
        old = [assign, profiles, pairs, edges, merges]
        moved = lambda df, c: df.join(merges.select(F.col("pid").alias(c), F.col("into").alias(f"{c}_into")), c, "left")  # noqa: B023, E731
        now = lambda c: F.coalesce(f"{c}_into", c)
        assign = written(moved(assign, "pid").select("id", now("pid").alias("pid")), "assign")
        profiles = written(moved(profiles, "pid").groupBy(now("pid").alias("pid")).agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"), F.max("placed").alias("placed")), "profiles")
        # Those that others merged into have changed too.
        grown = merges.select(F.col("into").alias("g")).distinct()
        step = moved(moved(edges, "a"), "b").select(now("a").alias("x"), now("b").alias("y"), "place", "paper", "score").where("x <> y")
        step = step.join(grown.withColumnRenamed("g", "x").withColumn("gx", F.lit(True)), "x", "left").join(grown.withColumnRenamed("g", "y").withColumn("gy", F.lit(True)), "y", "left")
        score = F.when(F.col("gx").isNull() & F.col("gy").isNull(), F.col("score"))
        step = step.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("place").alias("place"), F.max("paper").alias("paper"), F.max(score).alias("score"))
        pairs = written(step, "pairs")
        discard(*old)
    discard(profiles, names, pairs, edges, merges)
    out = assign.join(ids, "id").select("guid", "pid")
    return out.join(out.groupBy("pid").agg(F.min("guid").alias("entity")), "pid").select("guid", "entity")


def same_pairs(resolved: DataFrame, block: int = BLOCK) -> DataFrame:
    """(guid_1, guid_2) with guid_1 < guid_2 for all pairs within an entity; a large entity is spread over shards."""
    one = resolved.select("entity", F.col("guid").alias("a"))
    two = resolved.select("entity", F.col("guid").alias("b"))
    return spread_join(one, two, "entity", "b", block).where("a < b").select(F.col("a").alias("guid_1"), F.col("b").alias("guid_2"))
