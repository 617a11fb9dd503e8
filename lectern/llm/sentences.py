"""Sentence boundaries across languages and scripts.

A text is cut by semi-Markov dynamic programming: of all ways to cut it at its candidate boundaries, the one whose spans score highest
in sum is taken. A span is scored as a whole, by its length, its opening words, its closing words and whether quotations and
brackets balance within it. Opening words and abbreviations are learned from all texts at hand (openings from the starts of
texts, abbreviations from words whose dots are followed by small letters), beside fixed lists.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import full_frames

#: Words whose dot never ends a sentence (before a name, a number or a further word), in lower case without the last dot.
NEVER = set(
    "dr prof mr mrs ms mx st rev hon gen col capt sgt lt sen rep gov messrs fig figs eq eqs ref refs sec sect sects ch chap chaps vol vols no nos pp p tab tabs app apps ex viz approx esp vs cf e.g i.e e.g. ca incl resp ed eds dept univ op cit art para def thm prop lem cor alg ibid "
    "jan feb mar apr jun jul aug sep sept oct nov dec "
    "hr fr vgl bzw z.b d.h u.a z z. d s. nr abb abs bd bde kap anm s sog evtl ggf zzgl inkl dipl ing "
    "m mm mme mlle mlles cf p.ex ex art chap éd "
    "sr sra srta dra ud uds pág págs núm núms art cap p.ej ej véase "
    "см рис табл стр гл т.е т т.д т.п проф акад им ул св др напр ср п пп "
    "κ κα βλ σελ σελ. π.χ πχ αρ κεφ εικ πίν "
    "د أ م ص "
    "डॉ श्री प्रो ดร ศ ผศ รศ นพ พญ".split()
)
#: Abbreviations that may also stand at the end of a sentence.
MAYBE = set("etc al a.m p.m u.s u.k u.n e.u jr sr ph.d m.d b.a m.a d.c inc ltd co corp bros г гг в вв usw u.s.w κ.λπ κλπ κ.ά etc ff f".split())
#: Frequent English openings.
OPENERS = set("the a an it its we our this that these those in on at for with by to from as when if while although because since after before such many most some no not none each every both either neither there here he she they his her their i you what who why how where is are was were do does did can could should would among across within between under over during unlike following according citing earlier later however moreover furthermore thus hence therefore then finally first second third let see table figure further all any one two three".split())
_MONTHS = re.compile(r"(?:Jan|Feb|Mär|Maer|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez)[a-zäöü]*\b")

_STRONG = "!?。！？।॥።፧؟۔։။។｡‼⁇⁈⁉"
_CLOSERS = "\"'”’»)]}›）］｝」』】〉》〕"
_MARK = r"(?:[  ]?\[\d[\d,;\s–—-]*\])+|[¹²³⁰⁴-⁹]+"
_SPACE = r"[\s ​﻿]"
_PUNCTUATION = (
    rf"(?P<end>[{_STRONG}.…]+(?:[  ]?[!?]+)*|(?<=[\p{{Greek}}»\)’\"”]);|;)"
    rf"(?P<close>(?:[{re.escape(_CLOSERS)}]|[   ](?=[»›])[»›])*)(?P<mark>(?:{_MARK})?)(?P<gap>{_SPACE}*)"
)
_CANDIDATE = regex.compile(_PUNCTUATION)
#: Where a low quotation mark opens, the high one closes.
_CANDIDATE_LOW = regex.compile(_PUNCTUATION.replace("(?P<close>(?:[", "(?P<close>(?:[“"))
_THAI_GAP = regex.compile(r"(?<=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{N}A-Za-zÀ-ɏ][ๆฯ]?)\s+(?=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])")
_OPEN = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "［": "］", "{": "}", "‹": "›", "《": "》", "【": "】", "‚": "‘"}
_CLOSE = {c for c in _OPEN.values()}
_QUOTES = "“«„「『‹\"‚"
_WORD_BEFORE = regex.compile(r"(?:[\p{L}\p{M}](?:[\p{L}\p{M}\p{N}]|[./’'-](?=[\p{L}\p{M}]))*|\p{N}+(?:[.,]\p{N}+)*)$")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Words with dots inside, each as one.
_DOTTABLE = regex.compile(r"[\p{L}\p{M}]+(?:\.[\p{L}\p{M}]+)+")
_ITEM = regex.compile(r"(?:\(?(?:\d{1,3}|[a-zA-Z]|[ivxlc]{1,5})[.)]|[•▪·*–-])\s+(?=\S)")
_CASELESS = regex.compile(r"[\p{Lo}]")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


@dataclass
class Model:
    """Learned counts: openings of texts, and abbreviations."""

    openings: dict[str, float] = field(default_factory=dict)
    abbreviations: set[str] = field(default_factory=set)


def opening(text: str, at: int = 0) -> str:
    """The opening unit: the first word, or the first four characters in scripts without spaces."""
    head = text[at : at + 48].lstrip(" \"'“”«»„「『(—–-¿¡ ")
    if head and _UNSPACED.match(head):
        return head[:4]
    m = _TOKEN.search(head)
    return m.group().lower() if m else ""


def _dotted(text: str) -> Iterator[tuple[str, bool]]:
    for m in regex.finditer(r"([\p{L}\p{M}]+(?:\.[\p{L}\p{M}]+)*)\.(?=(\s*[\p{Ll},;:)]))?", text):
        yield m.group(1).lower(), m.group(2) is not None


def train(texts: DataFrame, text: str) -> Model:
    """Count openings and dotted words over all texts, in each batch first. Openings of a thousandth of their script's texts are kept."""

    @full_frames
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for t in b[text].dropna():
                t = t.strip()
                if o := opening(t):
                    seen["o", o] += 1
                    seen["n", "thai" if _UNSPACED.match(o) else "word"] += 1
                for w, inside in _dotted(t):
                    seen["d" if inside else "e", w] += 1
                seen.update(("w", w.lower()) for w in [*_TOKEN.findall(t), *_DOTTABLE.findall(t)])
            yield pd.DataFrame([(k, w, n) for (k, w), n in seen.items()], columns=["kind", "word", "n"])

    counts = texts.select(text).mapInPandas(count, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    # A share of its kind's texts bounds what is kept: at most 2000 openings; dotted words are first held against their own counts.
    total = {r["word"]: r["n"] for r in counts.where("kind = 'n'").collect()}
    least = max(2, sum(total.values()) // 2000)
    openings = {r["word"]: math.log(r["n"]) for r in counts.where(f"kind = 'o' and n >= {least}").collect()}
    by_word = counts.where("kind in ('d', 'e', 'w')").groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in "dew"])
    # A word that stands with a dot in nine of ten cases, mostly before small letters, and often enough to say so.
    found = by_word.where((F.col("d") >= max(3, least)) & (F.col("d") >= 0.5 * (F.col("d") + F.col("e"))) & (F.col("d") + F.col("e") >= 0.9 * F.col("w"))).select("word").collect()
    return Model(openings, {r["word"] for r in found if len(r["word"]) >= 2} - MAYBE)


def _pairs(text: str) -> dict[int, int]:
    """The place of each closing quotation mark or bracket with that of its opening. What has no partner is in no pair.

    A straight mark opens after a blank or an opening and before what is no blank, and closes after what is no blank; others, such as inches, are no quotations.
    """
    stack, pairs = [], {}
    straight = -1
    for i, c in enumerate(text):
        if c == '"':
            if straight >= 0:
                if not text[i - 1].isspace():
                    pairs[i], straight = straight, -1
            elif (i == 0 or not (text[i - 1].isalnum() or text[i - 1] in ".!?,;")) and not text[i + 1 : i + 2].isspace():
                straight = i
        elif stack and c in _CLOSE and _OPEN[text[stack[-1]]] == c or (c == "”" and stack and text[stack[-1]] == "„"):
            pairs[i] = stack.pop()
        elif c in _CLOSE and c != "“" and c != "‘":
            # A close without its partner on top: unwind to it if it is there, else it is no bracket.
            for d in range(len(stack) - 1, -1, -1):
                if _OPEN[text[stack[d]]] == c:
                    pairs[i] = stack[d]
                    del stack[d:]
                    break
        elif c in _OPEN:
            stack.append(i)
    return pairs


def _depths(pairs: dict[int, int], at: list[int]) -> list[int]:
    """For each of the ascending positions the number of quotations and brackets it lies in."""
    steps = sorted([(o + 1, 1) for o in pairs.values()] + [(z + 1, -1) for z in pairs])
    out, k, depth = [], 0, 0
    for p in at:
        while k < len(steps) and steps[k][0] <= p:
            depth += steps[k][1]
            k += 1
        out.append(depth)
    return out


def _opening_score(text: str, at: int, model: Model, strong: bool) -> float:
    if at >= len(text):
        return 0.0
    c = text[at]
    if c in ",;:،؛、，；：%/&=+<>" or (c in _CLOSERS and c not in "\"'“[("):
        return -9.0
    dash = c in "—–-―"
    k = at + 1 if dash else at
    while k < len(text) and text[k] in "  ¿¡":
        k += 1
    if dash:
        return 1.0 if k < len(text) and (text[k].isupper() or text[k - 1] in "¿¡") else -7.0
    if m := _ITEM.match(text, at):
        after = text[m.end() : m.end() + 1]
        if not after.islower() and (text[at].isdigit() or text[at] in "(•▪·" or strong):
            return 1.5
    if c == "(" or c == "[":
        inner = text[at + 1 : at + 3]
        return 0.5 if inner[:1].isupper() and inner[1:2].islower() | (inner[1:2] == " ") else -5.0
    if c in _QUOTES or c in "'‘":
        return 1.0
    word = opening(text, at)
    known = 2.0 if word in OPENERS or word in model.openings else 0.0
    if c in "¿¡":
        return 2.0
    if c.isupper() or unicodedata.category(c) == "Lt":
        return 1.0 + known
    if c.islower():
        m = _TOKEN.match(text, at)
        token = m.group() if m else c
        return 0.5 if len(token) > 3 and any(x.isupper() for x in token[1:4]) else -7.0
    if c.isdigit():
        return 0.0
    if _CASELESS.match(c):
        return 1.0 + known
    return 0.0


def _closing_score(text: str, start: int, end: str, after: int, model: Model) -> float:
    """Score of the punctuation ``end`` at ``start`` as the close of a sentence; ``after`` is where the next would begin."""
    if any(c in _STRONG for c in end) or end in ";;":
        return 4.0
    if len(end) > 1 or end == "…":
        return 0.0 if text[start - 1 : start].isspace() or not _UNSPACED.match(text[start - 1 : start] or " ") else -3.0
    m = _WORD_BEFORE.search(text, max(0, start - 40), start)
    word = m.group().lower() if m else ""
    if not word:
        return 2.0
    if len(word) == 1 and m.group().isupper():
        return -4.0
    if word in MAYBE or (word in "дп" and text[max(0, m.start() - 4) : m.start()].strip().endswith("т.")):
        return -0.8
    if word in NEVER or word.rpartition(".")[2] in ("b", "h", "e", "g") and "." in word:
        return -9.0
    if word[0].isdigit():
        before = text[max(0, m.start() - 40) : m.start()].rstrip()
        led = _WORD_BEFORE.search(before[:-1])
        # A number that begins a sentence numbers it; one after an abbreviation belongs to that.
        if text[start + 1 : start + 2].isspace() and not (before[-1:] == "." and led and (led.group().lower() in NEVER or led.group().lower() in model.abbreviations)) and (not before or before[-1] in _STRONG + ".”»)]" or text[max(0, m.start() - 2) : m.start()].endswith("\n")):
            return -9.0 if len(word) <= 3 else 2.0
        if len(word) <= 2 and _MONTHS.match(text, after):
            return -9.0
        return 3.0
    if len(word) == 1:
        return -4.0 if not _CASELESS.match(word) else 1.0
    if word in model.abbreviations:
        return -4.0
    if "." in word and all(len(x) <= 2 for x in word.split(".")):
        return -1.5
    return 3.0


#: What a cut inside of a quotation or bracket costs a level: more than any close and opening can score, so that its inner sentences never outweigh it.
INSIDE = 10.0
#: Characters beyond which a span is charged by its length.
LONG = 400
PER_CHARACTER = 0.002


def split(text: str | None, model: Model | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, without white space at its ends. Null, empty and blank texts have none.

    Spans reach back to the start of the text: one of more than LONG characters is charged in proportion, so of all such spans to one end the best is
    that of the greatest best[i] + PER_CHARACTER * start, which is carried along, and only nearer starts are tried one by one.
    """
    if not text or not text.strip():
        return []
    model = model or Model()
    ends, starts, score = [0], [0], [0.0]
    closings: list[tuple[int, int, float, bool]] = []
    for m in (_CANDIDATE_LOW if "„" in text else _CANDIDATE).finditer(text):
        after = m.end()
        end = m.group("end")
        if after >= len(text):
            continue
        nxt = text[after]
        if not m.group("gap"):
            strong = any(c in _STRONG for c in end)
            before = text[max(0, m.start() - 4) : m.start()]
            wide = bool(_UNSPACED.match(nxt)) or any(c in "。！？।॥።｡؟" for c in end)
            glued = before[-3:].isalpha() and before[-1:].islower() and nxt.isupper() and not regex.search(r"[/@:]\S*$", text[max(0, m.start() - 40) : m.start()])
            if not (wide or (glued and (text[after + 1 : after + 2].islower() or text[after + 1 : after + 2] == " ")) or (strong and (nxt.isupper() or nxt in "¿¡“«„「『(—")) or (m.group("close") + m.group("mark") and (nxt.isupper() or nxt in _QUOTES))):
                continue
        closings.append((m.end("mark"), after, _closing_score(text, m.start(), end, after, model), any(c in _STRONG for c in end)))
    if regex.search(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]", text):
        for m in _THAI_GAP.finditer(text):
            unit = text[m.end() : m.end() + 4]
            native = bool(_UNSPACED.match(text[m.start() - 1]))
            known = unit in model.openings
            closings.append((m.start(), m.end(), (0.5 if native else -4.5) + (1.5 if known else 0.0), False))
    closings = sorted({c[0]: c for c in closings}.values())
    for e, s, c, strong in closings:
        ends.append(e)
        starts.append(s)
        score.append(c + _opening_score(text, s, model, strong))
    ends.append(len(text.rstrip()))
    starts.append(len(text))
    score.append(0.0)
    pairs = _pairs(text)
    depth = _depths(pairs, ends)
    # A quotation that opens a sentence doesn't end it where a caseless letter goes on: what was said comes before who said it.
    for j in range(len(ends)):
        o = pairs.get(ends[j] - 1, -1)
        if o >= 0 and text[o] in _QUOTES and starts[j] < len(text) and _CASELESS.match(text[starts[j]]):
            before = text[:o].rstrip()[-1:]
            if not before or before in _STRONG + ".…'\"’" or before in _CLOSE:
                score[j] -= 8.0
    n = len(ends)
    best, back = [0.0] + [-math.inf] * (n - 1), [0] * n
    lead = len(text) - len(text.lstrip())
    starts[0] = lead
    far, carried, carried_from = 0, -math.inf, 0
    for j in range(1, n):
        gain = score[j] - INSIDE * depth[j]
        while far < j and ends[j] - starts[far] > LONG:
            if best[far] + PER_CHARACTER * starts[far] > carried:
                carried, carried_from = best[far] + PER_CHARACTER * starts[far], far
            far += 1
        if far:
            best[j], back[j] = carried - PER_CHARACTER * (ends[j] - LONG) + gain, carried_from
        for i in range(far, j):
            size = ends[j] - starts[i]
            if size <= 0:
                continue
            s = best[i] + gain
            if size < 3:
                s -= 4.0
            elif size < 8 and j < n - 1 and not _UNSPACED.match(text[starts[i]]):
                s -= 0.8
            if s > best[j]:
                best[j], back[j] = s, i
    cuts, j = [], n - 1
    while j > 0:
        cuts.append((starts[back[j]], ends[j]))
        j = back[j]
    out = []
    for a, z in reversed(cuts):
        piece = text[a:z]
        a, z = a + len(piece) - len(piece.lstrip(_BLANK)), z - (len(piece) - len(piece.rstrip(_BLANK)))
        if a < z:
            out.append((a, z))
    return out


_BLANK = "".join(chr(c) for c in range(0x3001) if chr(c).isspace()) + "​﻿"


def sentences(texts: DataFrame, row_id: str, text: str = "text", model: Model | None = None) -> DataFrame:
    """(row_id, sent_no, start_pos, end_pos) of every sentence of every row; sent_no counts from 1.

    The model is trained on ``texts`` unless given. Null, empty and blank texts have no sentences; repeated rows come out repeatedly;
    other columns are not read.
    """
    spread = texts.sparkSession.sparkContext.broadcast(model or train(texts, text))

    @full_frames
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, n, a, z) for r, t in zip(b[row_id], b[text], strict=True) for n, (a, z) in enumerate(split(t, spread.value), 1)]
            yield pd.DataFrame(rows, columns=[row_id, "sent_no", "start_pos", "end_pos"])

    kind = texts.schema[row_id].dataType.simpleString()
    return texts.select(row_id, text).where(F.col(row_id).isNotNull() & (F.length(text) > 0)).mapInPandas(cut, f"`{row_id}` {kind}, sent_no int, start_pos int, end_pos int")
