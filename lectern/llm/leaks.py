"""Evaluation passages inside training documents.

Texts are reduced to words (case, accents, punctuation, mark-up and marks left aside). Every window of ``least`` words, of items and documents alike, is
embedded by random walks over its words (CGK: at step j the word under the pointer is put out and the pointer moves on if the random bit of (j, word) is set),
which turn edit distance into Hamming distance; signatures of sampled coordinates of several walks are the LSH tables. Colliding windows are verified by
their exact edit distance. Equal windows walk alike, so with no edits allowed two tables lose nothing; with edits, walks, samples and coordinates are those of
PLANS, whose recall is measured against brute force by the tests.
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import full_frames, put

LEAST_WORDS = 12
#: (walks, samples of each, coordinates in a signature) by the edits allowed; more edits take the last.
PLANS = ((2, 2, 6), (6, 4, 4), (10, 8, 3))
#: Characters of item text in one block of the index; a task holds one block after another against each batch of documents.
BLOCK_CHARS = 16_000_000

_BLOCK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|td|tr|th|table|h[1-6]|section|sec|title|hr|CIT|xref|ref)\b[^<>]{0,200}>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->", re.S)
_REFERENCE = re.compile(r"\[\s*(?:refs?\.?\s*)?\d+[a-z]?(?:\s*[,;–—−-]\s*\d+[a-z]?)*\s*\]|\[\s*(?:citation needed|note \d+|\*+|†|‡)\s*\]", re.I)
_COMMAND = re.compile(r"\\(?:emph|textbf|textit|texttt|textsc|underline|mathrm|text)\s*(?=\{)")
_WORD = re.compile(r"[^\W_]+")
#: Letters whose marks don't decompose (fixed values), and characters that are not seen.
_FOLDED = str.maketrans({"ø": "o", "Ø": "o", "đ": "d", "Đ": "d", "ł": "l", "Ł": "l", "ß": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ı": "i", "ħ": "h", "ŧ": "t", "ð": "d", "þ": "th"})


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, with all that is left aside removed. Null has none."""
    if not text:
        return []
    t = html.unescape(text) if "&" in text else text
    if "<" in t:
        t = _TAG.sub("", _BLOCK_TAG.sub(" ", t))
    if "\\" in t:
        t = _COMMAND.sub("", t)
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t.translate(_FOLDED)) if not (o := ord(c)) > 127 or unicodedata.category(c) not in ("Mn", "Cf", "Me", "Cc") or 0x80 <= o < 0xA0)
    if "[" in t:
        t = _REFERENCE.sub(" ", t)
    return _WORD.findall(t.casefold())


def _hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 for w in ws), dtype=np.uint64, count=len(ws))


class Walks:
    """Random walks and coordinate samples, the same everywhere for one seed."""

    def __init__(self, least: int, edits: int = 0, seed: int = 7):
        walks, samples, coordinates = PLANS[min(edits, len(PLANS) - 1)]
        rng = np.random.default_rng(seed)
        self.least, self.length = least, 3 * least
        self.coins = rng.integers(0, 2**63, (walks, self.length), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # Later coordinates are past the end of most walks and tell windows apart less; sample from the first two thirds.
        self.picks = [[np.sort(rng.choice(2 * least, coordinates, replace=False)) for _ in range(samples)] for _ in range(walks)]
        self.mix = rng.integers(0, 2**63, (walks, samples, coordinates), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signatures(self, hashed: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row a table, one column a window starting at ``starts`` in ``hashed``."""
        rows = []
        for w in range(len(self.coins)):
            at = starts.copy()
            end = starts + self.least
            sums = [np.zeros(len(starts), np.uint64) for _ in self.picks[w]]
            for j in range(max(p[-1] for p in self.picks[w]) + 1):
                inside = at < end
                sym = np.where(inside, hashed[np.minimum(at, len(hashed) - 1)], np.uint64(0))
                for s, pick in enumerate(self.picks[w]):
                    k = int(np.searchsorted(pick, j))
                    if k < len(pick) and pick[k] == j:
                        sums[s] += (sym ^ (sym >> np.uint64(29))) * self.mix[w, s, k]
                at += (((sym * self.coins[w, j]) >> np.uint64(63)).astype(np.int64)) & inside
            rows += sums
        return np.stack(rows) if rows else np.zeros((0, len(starts)), np.uint64)


def edit_distance(a: list, b: list, most: int) -> int:
    """Edits between two word lists, ``most`` + 1 if more."""
    if most == 0:
        return 0 if a == b else 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


class ItemIndex:
    """Signatures of all windows of a block of items, sorted, with their places."""

    def __init__(self, items: list[tuple[int, str | None]], least: int, walks: Walks):
        self.flat: list[str] = []
        owner, starts = [], []
        for i, t in items:
            ws = words(t)
            n = max(0, len(ws) - least + 1)
            starts.append(np.arange(len(self.flat), len(self.flat) + n))
            owner.append(np.full(n, i, np.int64))
            self.flat += ws
        self.hashed = _hashes(self.flat)
        self.starts, self.owner = np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*owner, np.zeros(0, np.int64)])
        sig = walks.signatures(self.hashed, self.starts) if len(self.starts) else np.zeros((0, 0), np.uint64)
        self.order = [np.argsort(r, kind="stable") for r in sig]
        self.sorted = [r[o] for r, o in zip(sig, self.order, strict=True)]


def _near(one: np.ndarray, at: np.ndarray, two: np.ndarray, to: np.ndarray, least: int, edits: int) -> np.ndarray:
    """Whether at least ``least`` - ``edits`` words of each second window stand in the first, moved by no more than ``edits``: so they do in all windows within as many edits."""
    held = np.zeros(len(at), np.int64)
    for k in range(least):
        word, some = two[to + k], np.zeros(len(at), bool)
        for move in range(-edits, edits + 1):
            if 0 <= k + move < least:
                some |= one[at + k + move] == word
        held += some
    return held >= least - edits


#: Candidate pairs of windows that are looked at together.
PAIRS = 1_000_000


def _match(batch: pd.DataFrame, doc_id: str, text: str, index: ItemIndex, walks: Walks, edits: int) -> Iterator[tuple[object, int]]:
    least = walks.least
    for lo in range(0, len(batch), 256):
        part = batch.iloc[lo : lo + 256]
        docs = [words(t) for t in part[text]]
        starts, at, flat, owner = [], 0, [], []
        for k, ws in enumerate(docs):
            if (n := len(ws) - least + 1) > 0:
                starts.append(np.arange(at, at + n))
                owner.append(np.full(n, k))
                flat += ws
                at += len(ws)
        if not starts or not len(index.starts):
            continue
        s, own = np.concatenate(starts), np.concatenate(owner)
        hashed = _hashes(flat)
        sig = walks.signatures(hashed, s)
        found: set[tuple[int, int]] = set()
        for row, table, order in zip(sig, index.sorted, index.order, strict=True):
            left, right = np.searchsorted(table, row), np.searchsorted(table, row, side="right")
            hit = np.flatnonzero(right > left)
            size = (right - left)[hit]
            step = max(1, PAIRS // max(1, int(size.max(initial=1))))
            for a in range(0, len(hit), step):
                h, n = hit[a : a + step], size[a : a + step]
                mine = np.repeat(h, n)
                theirs = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left[h], n)]
                ok = _near(hashed, s[mine], index.hashed, index.starts[theirs], least, edits)
                for w, i in zip(mine[ok], theirs[ok], strict=True):
                    pair = (int(own[w]), int(index.owner[i]))
                    if pair not in found and edit_distance(flat[s[w] : s[w] + least], index.flat[index.starts[i] : index.starts[i] + least], edits) <= edits:
                        found.add(pair)
        ids = part[doc_id].tolist()
        yield from ((ids[k], item) for k, item in sorted(found))


_LOADED: dict[str, object] = {}


def _loaded(name: str) -> ItemIndex:
    """A block of the index, read once by each Python worker while it is the one in use."""
    from pyspark import SparkFiles

    if name not in _LOADED:
        if len(_LOADED) >= 2:
            _LOADED.clear()
        with open(SparkFiles.get(name), "rb") as f:
            _LOADED[name] = pickle.load(f)
    return _LOADED[name]


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST_WORDS, edits: int = 0) -> DataFrame:
    """(doc_id, item_id) for each document that repeats ``least`` words in a row of an item, up to ``edits`` words put in, left out or changed.

    Every window of every document is held against every item in one reading of the documents. Null, empty and short texts on either side match nothing;
    a pair comes once for each row of ``docs`` (rows that repeat an id give it once for each). Other columns are not read. The index of the items is made once,
    in blocks of about BLOCK_CHARS characters, and handed to the workers as files; the driver sees one block of item texts at a time.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).alias("words")).where("item is not null and words is not null").distinct()
    walks, names = Walks(least, edits), []
    block, held = [], 0

    def ship() -> None:
        names.append(put(spark, pickle.dumps(ItemIndex(block, least, walks), pickle.HIGHEST_PROTOCOL), "items"))

    for r in items.toLocalIterator():
        block.append((r["item"], r["words"]))
        held += len(r["words"])
        if held >= BLOCK_CHARS:
            ship()
            block, held = [], 0
    ship()

    @full_frames
    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Walks(least, edits)
        for b in batches:
            found = sorted({(k, y) for name in names for k, y in _match(b.assign(**{doc_id: range(len(b))}), doc_id, text, _loaded(name), own, edits)})
            yield pd.DataFrame({doc_id: b[doc_id].iloc[[k for k, _ in found]].to_numpy(), "item_id": pd.Series([y for _, y in found], dtype="int64")})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).where(F.length(text) > 0).mapInPandas(match, f"`{doc_id}` {kind}, item_id bigint")
