"""Noise in text from scanned pages.

The lines of a text are labelled by a linear chain model (Viterbi over body, heading, figures, furniture and break) with layout
features: width against the column, whether the next word would still have fit, alignment, page-number grammars, capitals, form feeds. What the
features weigh is set, what follows what is learned from all texts.
Furniture is dropped, and in what is left words cut at line ends, words with blanks inside and misread words are repaired against a
lexicon counted over all texts; paragraphs are put together from the labels.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import full_frames

BODY, HEADING, FIGURES, FURNITURE, BREAK = range(5)
#: Words in the lexicon, a bound on what is spread to the workers: the most frequent of those seen at least twice.
LEXICON_WORDS = 200_000

_NUMBER = r"(?:\d{1,5}|(?=[ivxlc])(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})|(?=[IVXLC])(?:X[CL]|L?X{0,3})(?:I[XV]|V?I{0,3}))"
_PAGE_ONLY = re.compile(rf"^\s*(?:[-–—~•·|*]+\s*)?(?:\[\s*)?(?:(?:page|p\.|pg\.?|seite)\s*)?{_NUMBER}(?:\s*(?:of|/)\s*\d{{1,5}})?(?:\s*\])?(?:\s*[-–—~•·|*]+)?\s*$", re.I)
_PAGE_BESIDE = re.compile(rf"^\s*{_NUMBER}\s{{3,}}\S.*[A-Za-z]|^\s*\S.*\S\s{{3,}}{_NUMBER}\s*$")
_FIGURES = re.compile(r"^\s*[-+]?\d[\d.,%]*(?:\s+[-+±]?\d[\d.,%]*)+\s*$")
_HEADING = re.compile(r"^\s*(?:\d{1,2}(?:\.\d{1,2}){0,3}\.?|[A-Z]\.(?:\d+\.?)?|(?:Section|Chapter|Appendix)\s+\w+[.:]?) \S")
_HEADING_WORD = re.compile(r"^\s*(?:abstract|introduction|conclusions?|references|acknowledge?ments?|appendix|related work|discussion|results|methods?|experiments?|evaluation|data|background)\s*$", re.I)
_NOTICE = re.compile(r"©|\(c\)\s*\d{4}|\bcopyright\b|all rights reserved|downloaded (?:from|by|on)|manuscript (?:received|submitted|accepted)|^\s*(?:received|accepted|revised|submitted|published)(?: online)?:? .{0,30}\d|preprint|arxiv:|^\s*(?:doi|issn|isbn)\b|https?://\S+\s*$|for (?:personal|internal) use|this article is licensed|permission (?:of|to)|page \d", re.I)
_JOURNAL = re.compile(r"\b(?:Vol(?:ume)?|No|Issue)\.?\s*\w{1,5}\s*(?:,|$|\()|\(\d{4}[a-z]?\)\s*$|^\W*(?:Journal|Proceedings|Transactions|Letters|Annals|Bulletin|Review|Workshop|Conference|Symposium|Advances|Lecture Notes)\b")
_NAMES = re.compile(r"^\W*(?:[^\W\d_][\w.’'-]*\s+)?[^\W\d_][\w’'-]*(?:(?:,| and| &| et al\.?)\s*(?:[^\W\d_][\w’'-]*)?){0,4}\W*$")
_TERMINAL = re.compile(r"[.!?:;。][\"'”’»)\]]*(?:\s*\[[\d,;\s–-]+\])?\s*$")
_CUT = re.compile(r"(?<=[^\W\d_])([-‐‑­¬])\s*$")
_CLIPPED = re.compile(r"[^\W_](?:\.\.\.|…)(?:\s{3,}\w+)?$")
_SOFT = "­¬"


def _mostly_capitals(words: list[str]) -> bool:
    return bool(words) and all(w[:1].isupper() or w.lower() in ("and", "of", "the", "in", "on", "for", "et", "al", "al.", "&", "von", "van", "de", "der") for w in words)


#: Where the learning of transitions begins: pages' matter stands together, body goes on with body.
FIRST_STEPS = [[0.5, 0.0, 0.0, -0.6, 0.0], [0.5, -1.0, 0.0, -0.6, 0.0], [0.0, 0.0, 0.5, -0.6, 0.0], [-0.3, 0.0, -0.6, 1.2, 0.3], [0.0, 0.0, 0.0, 0.2, 0.0]]
#: Part of the learned log odds that counts beside the layout of a line, and their bound.
STEP_PART, STEP_BOUND = 0.5, 2.0


def steps_from(counts: list[list[float]]) -> list[list[float]]:
    """Transition weights: how much likelier a label follows another than it stands anywhere, in log odds, from counted pairs of neighbours."""
    n = [[c + 1.0 for c in row] for row in counts]
    total = sum(map(sum, n))
    share = [sum(row[q] for row in n) / total for q in range(5)]
    return [[STEP_PART * max(-STEP_BOUND, min(STEP_BOUND, math.log(row[q] / sum(row) / share[q]))) for q in range(5)] for row in n]


def learn_steps(texts: DataFrame, text: str = "text") -> list[list[float]]:
    """Transitions learned from all texts: their lines are labelled with FIRST_STEPS, and the pairs of neighbouring labels counted (a step of Viterbi training)."""

    @full_frames
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for t in b[text].dropna():
                if t.strip():
                    own = label(t)
                    seen.update(zip(own, own[1:], strict=False))
        yield pd.DataFrame([(a, b, n) for (a, b), n in seen.items()], columns=["a", "b", "n"])

    counts = [[0.0] * 5 for _ in range(5)]
    for r in texts.select(text).mapInPandas(count, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        counts[r["a"]][r["b"]] = float(r["n"])
    return steps_from(counts)


def label(text: str, step: list[list[float]] | None = None) -> list[int]:
    """The label of every line of a text."""
    step = step or FIRST_STEPS
    lines = text.split("\n")
    bare = [x.replace("\f", "") for x in lines]
    widths = sorted(len(x.rstrip()) for x in bare if x.strip() and not _PAGE_BESIDE.match(x) and not _PAGE_ONLY.match(x))
    column = widths[min(len(widths) - 1, int(0.9 * len(widths)))] if widths else 0
    filled = [k for k, x in enumerate(bare) if x.strip()]
    following = {a: b for a, b in zip(filled, filled[1:], strict=False)}
    bodily = [bool(x.strip()) and (x.strip()[:1].islower() or len(x.rstrip()) >= 0.85 * column or bool(_CUT.search(x))) and not _PAGE_BESIDE.match(x) and not _PAGE_ONLY.match(x) for x in bare]
    scores: list[list[float]] = []
    for k, raw in enumerate(lines):
        line = bare[k]
        s = line.strip()
        if not s:
            scores.append([-99, -99, -99, -99, 0])
            continue
        words = s.split()
        body, head, figures, furniture = 1.5, -2.0, -4.0, -1.0
        if raw.startswith("\f"):
            furniture += 4.0
        if _FIGURES.match(s) and not _PAGE_ONLY.match(s):
            figures += 10.0
        if _PAGE_ONLY.match(s):
            furniture += 7.0
        elif _PAGE_BESIDE.match(line):
            furniture += 6.0
        if _HEADING.match(s) and len(words) <= 9 and not _TERMINAL.search(s) and any(c.isalpha() for c in words[1]) and words[1][:1].isupper():
            head += 7.0
        if _HEADING_WORD.match(s):
            head += 4.0
        if _NOTICE.search(s) and len(words) <= 12:
            furniture += 4.0
        if _JOURNAL.search(s) and len(words) <= 12:
            furniture += 2.5
        letters = [c for c in s if c.isalpha()]
        if len(letters) > 5 and sum(c.isupper() for c in letters) > 0.8 * len(letters):
            furniture += 3.0
        elif letters and _mostly_capitals([w.strip(".,()") for w in words]) and not any(w[:1].islower() and len(w) > 3 for w in words):
            furniture += 2.0
            if _NAMES.match(s) and len(words) <= 6:
                furniture += 1.0
        # A body line is short only where the next word wouldn't have fit, or where its paragraph ends.
        nxt = bare[following[k]].strip().split() if k in following else []
        size = len(line.rstrip())
        fit = bool(nxt) and size + 1 + len(nxt[0]) <= column - 2
        ended = bool(_TERMINAL.search(s))
        if s[:1].islower():
            body += 3.0
        if _CUT.search(s):
            body += 4.0
        if size >= 0.92 * column:
            body += 2.0
        if ended:
            body += 2.0
        elif fit and s[:1].isupper():
            furniture += 2.5
            if k in following and (following[k] != k + 1):
                furniture += 0.5
        if s[:1].isupper() and _CLIPPED.search(s):
            furniture += 4.0
        # The shape of a title: capitals at both ends, no punctuation.
        if len(words) >= 3 and s[:1].isupper() and words[-1][:1].isupper() and not re.search(r"[,;:.()\[\]“”?!]", s) and sum(w[:1].isupper() for w in words) <= 3 and size < 0.85 * column:
            furniture += 1.5
        # The text before and after it flows on as if the line weren't there.
        before = next((bare[p] for p in range(k - 1, -1, -1) if bodily[p]), "")
        after = next((bare[p] for p in range(k + 1, len(lines)) if bodily[p]), "")
        if s[:1].isupper() and before and not _TERMINAL.search(before):
            if after.strip()[:1].islower():
                furniture += 2.0
            if (cut := _CUT.search(before)) and before[: cut.start()].split()[-1][:1].islower():
                furniture += 4.0
        if k == filled[-1] and not ended and s[:1].isupper():
            furniture += 1.0
        scores.append([body, head, figures, furniture, -99])
    best, back = list(scores[0]), []
    for sc in scores[1:]:
        choice = [max(range(5), key=lambda p, q=q: best[p] + step[p][q]) for q in range(5)]
        best = [best[choice[q]] + step[choice[q]][q] + sc[q] for q in range(5)]
        back.append(choice)
    q = max(range(5), key=best.__getitem__)
    out = [q]
    for choice in reversed(back):
        q = choice[q]
        out.append(q)
    return out[::-1]


#: What is read for what is printed, misread first.
CONFUSIONS: list[tuple[str, str]] = [
    *[(a, b) for a, bs in {"1": "li", "0": "o", "5": "s", "6": "b", "8": "b", "9": "g", "|": "li", "!": "li", "$": "s", "ſ": "sf", "f": "ts", "t": "flr", "c": "eo", "e": "co", "o": "aec", "a": "o", "l": "it", "i": "ljt", "j": "i", "b": "h", "h": "b", "q": "g", "g": "q", "u": "nv", "n": "u", "v": "yu", "y": "v", "r": "t", "s": "a", "z": "2", "d": "a"}.items() for b in bs],
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("cl", "d"), ("d", "cl"), ("in", "m"), ("m", "in"), ("ni", "m"), ("m", "ni"), ("nn", "m"), ("li", "h"), ("h", "li"), ("lı", "h"), ("fi", "h"), ("ti", "n"), ("tl", "d"), ("ci", "a"), ("iv", "w"), ("iii", "m"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"),
]
_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _a, _b in CONFUSIONS:
    _BY_FIRST.setdefault(_a[0], []).append((_a, _b))
_ODD = re.compile(r"[0-9|!$ſ]")
_WORD = re.compile(r"[^\W_]+(?:[|!$][^\W_]+)*")
_TOKEN = re.compile(r"\S+")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "|$") + "“”‘’„«»…–—¿¡©†‡§•·"


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


@dataclass
class Lexicon:
    """Counts of words in lower case, and of letter triples in them."""

    counts: dict[str, int]

    def __post_init__(self) -> None:
        triples: Counter = Counter()
        for w, n in self.counts.items():
            if n >= 3 and w.isalpha():
                p = f"^{w}$"
                for k in range(len(p) - 2):
                    triples[p[k : k + 3]] += min(n, 50)
        self.triples, self.all_triples = triples, max(1, sum(triples.values()))
        self.memo: dict[str, str | None] = {}

    def n(self, word: str) -> int:
        return self.counts.get(word, 0)

    def looks(self, word: str) -> float:
        p = f"^{word}$"
        return sum(math.log((self.triples.get(p[k : k + 3], 0) + 0.1) / self.all_triples) for k in range(len(p) - 2)) / max(1, len(p) - 2)

    @staticmethod
    def _variants(word: str) -> set[str]:
        out = set()
        for k, c in enumerate(word):
            for a, b in _BY_FIRST.get(c, ()):
                if word.startswith(a, k):
                    out.add(word[:k] + b + word[k + len(a) :])
            if ord(c) > 127 and (p := _plain(c)) != c:
                out.add(word[:k] + p + word[k + 1 :])
        return out

    def corrected(self, word: str) -> str | None:
        """What a misread word in lower case should read, or None if it stands."""
        if word not in self.memo:
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[word] = self._corrected(word)
        return self.memo[word]

    def _corrected(self, word: str) -> str | None:
        if len(word) < 2 or word.isdigit():
            return None
        odd = bool(_ODD.search(word)) and any(c.isalpha() for c in word)
        own = self.n(word)
        need = max(2, own + 1) if odd else max(6, 10 * own)
        one = self._variants(word)
        found = [(self.n(v), v) for v in one if self.n(v) >= need and not _ODD.search(v)]
        if not found and len(word) >= 4:
            need2 = max(3 if odd else 20, 15 * own)
            two = {x for v in one for x in self._variants(v)} - {word}
            found = [(self.n(v), v) for v in two if self.n(v) >= need2 and not _ODD.search(v)]
        if found:
            best = max(found)[1]
            return best
        if odd and len(word) >= 4 and sum(map(str.isalpha, word)) >= 0.6 * len(word) and not re.search(r"\d{2,}|\d$", word[:-1] if not word[-1] == "5" and not word[-1] in "10" else word[:-1]):
            # Not in the lexicon however read: the likeliest letters.
            options = {word}
            for _ in range(3):
                options |= {v for o in options for v in self._variants(o) if sum(map(bool, map(_ODD.match, v))) < sum(map(bool, map(_ODD.match, o)))}
            clean = [o for o in options if not _ODD.search(o)]
            if clean:
                return max(clean, key=lambda o: (self.looks(o), o))
        return None


def _like(shape: str, word: str) -> str:
    """``word`` with the capitals of ``shape``."""
    if len(shape) > 1 and shape.upper() == shape and any(c.isalpha() for c in shape[1:]):
        return word.upper()
    return word[:1].upper() + word[1:] if shape[:1].isupper() else word


def _repair_word(token: str, lex: Lexicon) -> str | None:
    """The token without punctuation around it and with misread parts corrected, or None if nothing is."""
    parts = re.split(r"([-–‐’'/])", token)
    changed = False
    for k in range(0, len(parts), 2):
        p = parts[k]
        if (m := _WORD.fullmatch(p)) and (c := lex.corrected(m.group().lower())) is not None:
            parts[k] = _like(p, c)
            changed = True
    return "".join(parts) if changed else None


def _joined(a: str, hyphen: str, b: str, lex: Lexicon) -> str:
    """One word of two pieces; the hyphen stays if it is the word's own."""
    whole, apart = a + b, f"{a}-{b}"
    if hyphen in _SOFT:
        return whole
    tail, lead = a.rpartition("-")[2].lower(), b.partition("-")[0].lower()
    if b[:1].isupper() and b[1:2].islower():
        return apart
    n_whole, n_apart = lex.n((tail + lead)), lex.n(f"{tail}-{lead}")
    if lex.n(apart.lower()) > n_whole:
        return apart
    if n_whole or a[:1].isupper() and not (lex.n(tail) > 20 and lex.n(lead) > 20):
        return whole if n_whole >= n_apart else apart
    if n_apart:
        return apart
    if lex.n(tail) >= 20 and lex.n(lead) >= 20 and len(tail) > 2 and len(lead) > 3:
        return apart
    return whole


def repairs(text: str | None, lex: Lexicon, step: list[list[float]] | None = None) -> tuple[list[tuple[int, str, str]], list[str]]:
    """((line_no, noise, repaired) without repeats, paragraphs) of one text. Null and blank texts have neither."""
    if not text or not text.strip():
        return [], []
    lines = text.split("\n")
    labels = label(text, step)
    out: dict[tuple[int, str, str], None] = {}
    for k, q in enumerate(labels):
        if q == FURNITURE:
            out[k + 1, "furniture", ""] = None
    kept = [k for k, q in enumerate(labels) if q in (BODY, HEADING, FIGURES)]
    clean: dict[int, str] = {}
    skip_first: set[int] = set()
    for at, k in enumerate(kept):
        line = lines[k].replace("\f", "")
        tokens = [m.group() for m in _TOKEN.finditer(line)]
        words: list[str] = []
        if k in skip_first and tokens:
            tokens = tokens[1:]
        if labels[k] == FIGURES:
            clean[k] = " ".join(tokens)
            continue
        i = 0
        while i < len(tokens):
            t = tokens[i]
            core = t.strip(_EDGE)
            lead = t[: t.find(core)] if core else ""
            # A word cut at the end of the line.
            if i == len(tokens) - 1 and labels[k] == BODY and (m := _CUT.search(line)) and (body := [x for x in kept[at + 1 :] if labels[x] == BODY]):
                follow = _TOKEN.search(lines[body[0]].replace("\f", ""))
                first = t.rstrip(_EDGE + _SOFT + "‐‑").lstrip(_EDGE)
                second = follow.group() if follow else ""
                piece = second.strip(_EDGE)
                if first and piece and piece[0].isalpha():
                    whole = _joined(first, m.group(1), piece, lex)
                    low = whole.lower()
                    if not lex.n(low) and (fixed := _repair_word(whole, lex)):
                        whole = fixed
                    out[k + 1, "hyphen", whole] = None
                    skip_first.add(body[0])
                    words.append(lead + whole + second[second.find(piece) + len(piece) :])
                    i += 1
                    continue
            # Letters set apart.
            if len(core) == 1 and core.isalpha() and i + 2 < len(tokens):
                z = i
                while z < len(tokens) and (c := tokens[z].strip(_EDGE)) and len(c) == 1 and c.isalpha():
                    z += 1
                    if tokens[z - 1] != c and z - 1 > i:
                        break
                if z - i >= 4:
                    letters = "".join(x.strip(_EDGE) for x in tokens[i:z])
                    skip = 1 if not lex.n(letters.lower()) and lex.n(letters[1:].lower()) else 0
                    if skip:
                        words.append(t)
                    word = letters[skip:]
                    if not lex.n(word.lower()) and (fixed := _repair_word(word, lex)):
                        word = fixed
                    out[k + 1, "space", word] = None
                    last = tokens[z - 1]
                    words.append(("" if skip else lead) + word + last[last.find(last.strip(_EDGE)) + 1 :])
                    i = z
                    continue
            if not core or not any(c.isalpha() for c in core):
                words.append(t)
                i += 1
                continue
            # A blank inside a word: two or three pieces whose union is far more frequent than its rarest piece.
            done = False
            for width in (2, 3):
                if i + width > len(tokens) or t[len(lead) + len(core) :]:
                    break
                pieces = tokens[i : i + width]
                end = pieces[-1].rstrip(_EDGE)
                if any(not p.isalpha() for p in pieces[1:-1]) or not end.isalpha() or not core.replace("-", "").isalpha():
                    continue
                if i + width == len(tokens) and _CUT.search(line):
                    continue
                union = core + "".join(pieces[1:-1]) + end
                low = union.lower()
                n, rarest = lex.n(low), min(lex.n(core.lower()), *(lex.n(p.lower()) for p in [*pieces[1:-1], end]))
                if n >= 3 and n >= 8 * rarest and not (width == 2 and min(len(core), len(end)) == 1 and core in "aAI"):
                    out[k + 1, "space", union] = None
                    words.append(lead + union + pieces[-1][len(end) :])
                    i += width
                    done = True
                    break
            if done:
                continue
            fixed = _repair_word(core, lex)
            if fixed is not None:
                out[k + 1, "char", fixed] = None
                words.append(lead + fixed + t[len(lead) + len(core) :])
            else:
                words.append(t)
            i += 1
        clean[k] = " ".join(words)
    return list(out), _paragraphs(lines, labels, kept, clean)


def _paragraphs(lines: list[str], labels: list[int], kept: list[int], clean: dict[int, str]) -> list[str]:
    """Body lines in one, a new paragraph at headings, figures, indents, and breaks that no page matter explains."""
    out: list[str] = []
    current: list[str] = []
    last = -1
    for k in kept:
        between = labels[last + 1 : k] if last >= 0 else []
        indent = lines[k].startswith("   ") and labels[k] == BODY
        cut = last >= 0 and (
            labels[k] != BODY or labels[last] != BODY or indent or (BREAK in between and FURNITURE not in between) or (BREAK in between and bool(_TERMINAL.search(lines[last])) and lines[k].strip()[:1].isupper() and len(lines[last].rstrip()) < 0.8 * max(map(len, lines)))
        )
        if cut and current:
            out.append(" ".join(x for x in current if x))
            current = []
        current.append(clean.get(k, ""))
        last = k
    if current:
        out.append(" ".join(x for x in current if x))
    return [p for p in out if p.strip()]


def count_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) in lower case over all texts, hyphened words also as a whole; pieces at cut line ends are left out. Counted in each batch first."""

    @full_frames
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word = re.compile(r"[^\W_]+(?:[-‐][^\W\d_]+)*")
        for b in batches:
            seen: Counter = Counter()
            for t in b[text].dropna():
                t = re.sub(r"\S+[-‐‑­¬]\s*\n[\s\S]{0,3}?\S+", " ", t)
                for w in word.findall(t.lower()):
                    if len(w) <= 40 and not w.isdigit():
                        seen[w] += 1
                        if "-" in w:
                            seen.update(w.split("-"))
            yield pd.DataFrame({"word": list(seen), "n": pd.Series(list(seen.values()), dtype="int64")})

    return texts.select(text).mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def train(texts: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> Lexicon:
    rows = count_words(texts, text).where("n > 1").orderBy(F.desc("n"), "word").limit(words).toPandas()
    return Lexicon(dict(zip(rows["word"], rows["n"].astype(int), strict=True)))


def page_noise(texts: DataFrame, row_id: str, text: str = "text", lexicon: Lexicon | None = None, words_from: DataFrame | None = None) -> DataFrame:
    """(row_id, line_no, noise, repaired) of each disturbance in each row; see ``repairs``. Lines count from 1.

    The lexicon is trained on ``words_from`` (else on ``texts``) unless given. Rows with a null, empty or blank text give none; repeated
    rows give theirs repeatedly; other columns are not read.
    """
    lexicon = lexicon or train(words_from if words_from is not None else texts, text)
    spread = texts.sparkSession.sparkContext.broadcast((lexicon.counts, learn_steps(texts, text)))

    @full_frames
    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, step = Lexicon(spread.value[0]), spread.value[1]
        for b in batches:
            rows = [(r, *x) for r, t in zip(b[row_id], b[text], strict=True) for x in repairs(t, lex, step)[0]]
            yield pd.DataFrame(rows, columns=[row_id, "line_no", "noise", "repaired"])

    kind = texts.schema[row_id].dataType.simpleString()
    return texts.select(row_id, text).where(F.length(text) > 0).mapInPandas(mend, f"`{row_id}` {kind}, line_no int, noise string, repaired string")


def paragraphs(texts: DataFrame, row_id: str, text: str = "text", lexicon: Lexicon | None = None, words_from: DataFrame | None = None) -> DataFrame:
    """(row_id, par_no, paragraph): the repaired text, paragraphs counted from 1."""
    lexicon = lexicon or train(words_from if words_from is not None else texts, text)
    spread = texts.sparkSession.sparkContext.broadcast((lexicon.counts, learn_steps(texts, text)))

    @full_frames
    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, step = Lexicon(spread.value[0]), spread.value[1]
        for b in batches:
            rows = [(r, n, p) for r, t in zip(b[row_id], b[text], strict=True) for n, p in enumerate(repairs(t, lex, step)[1], 1)]
            yield pd.DataFrame(rows, columns=[row_id, "par_no", "paragraph"])

    kind = texts.schema[row_id].dataType.simpleString()
    return texts.select(row_id, text).where(F.length(text) > 0).mapInPandas(mend, f"`{row_id}` {kind}, par_no int, paragraph string")
