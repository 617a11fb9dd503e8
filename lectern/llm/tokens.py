"""Encoding of a corpus by a public byte-level BPE vocabulary.

Frequent words are compiled with their ids into a minimal acyclic transducer (states with the same right language are shared,
ids are outputs along the arcs), which is written to the shared folder and memory-mapped by the workers. A word that the
transducer lacks is merged exactly. The result is that of the public tokenizer without special tokens.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import full_frames

#: Fixed value: the splitting pattern published with the vocabulary. White space is Unicode's.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words in the transducer, a bound on its size; others are merged where they occur, so the result doesn't depend on it.
LEXICON_WORDS = 60_000
#: Words that a worker remembers before it forgets all.
MEMO_WORDS = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks (which are the ids) of the byte strings of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(k): int(v) for k, v in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact byte-pair merging: the adjacent pair of least rank first, the leftmost at ties. O(n log n) by a heap."""
    known = ranks.get(word)
    if known is not None:
        return [known]
    n = len(word)
    part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, size = heapq.heappop(heap)
        if part[i] is None or (j := right[i]) >= n or len(part[i]) + len(part[j]) != size or ranks.get(part[i] + part[j]) != rank:
            continue
        part[i] += part[j]
        part[j] = None
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(part[i] + part[right[i]])) is not None:
                heapq.heappush(heap, (r, i, len(part[i]) + len(part[right[i]])))
        if (h := left[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
            heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
    return [ranks[p] for p in part if p is not None]


class Transducer:
    """Minimal acyclic transducer from byte strings to lists of ids, in flat arrays.

    State s owns the arcs first[s] .. first[s + 1]; arc a reads label[a], goes to target[a] and puts out the ids
    out[out_at[a] .. out_at[a + 1]]. final[s] points into the same pool for the ids put out at the end of a word, or is -1.
    """

    ARRAYS = ("first", "label", "target", "out_at", "out", "final_at", "final")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.first, self.label, self.target, self.out_at, self.out, self.final_at, self.final = (arrays[k] for k in self.ARRAYS)

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> Transducer:
        """Build from sorted words; finished states are merged by their right language (outputs included)."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final ids or None, ((byte, ids, target), ...))

        def close(node: list) -> int:
            key = (node[0], tuple((b, o, t) for b, o, t in node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        # A node is [final ids or None, [[byte, ids, node or state], ...]]; outputs are pushed towards the root as words are added.
        root: list = [None, []]
        path: list[list] = [root]
        last = b""
        for word in sorted(entries):
            ids = tuple(entries[word])
            k = 0
            while k < min(len(last), len(word)) and last[k] == word[k]:
                k += 1
            cls._close_below(path, k, close)
            # Keep on the common prefix only what both have; push the rest of the old output down.
            rest = ids
            for d in range(k):
                arc = path[d][1][-1]
                old, m = arc[1], 0
                while m < min(len(old), len(rest)) and old[m] == rest[m]:
                    m += 1
                arc[1], down = old[:m], old[m:]
                rest = rest[m:]
                if down:
                    child = path[d + 1]
                    if child[0] is not None:
                        child[0] = down + child[0]
                    for x in child[1]:
                        x[1] = down + x[1]
            for d in range(k, len(word)):
                child: list = [None, []]
                path[d][1].append([word[d], rest if d == k else (), child])
                path.append(child)
            if k == len(word):
                path[-1][0] = rest
            else:
                path[-1][0] = ()
            last = word
        cls._close_below(path, 0, close)
        start = close(root)
        return cls(cls._flat(states, start))

    @staticmethod
    def _close_below(path: list[list], depth: int, close) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            path[-1][1][-1][2] = close(node)

    @staticmethod
    def _flat(states: list[tuple], start: int) -> dict[str, np.ndarray]:
        order = [start] + [i for i in range(len(states)) if i != start]
        number = {old: new for new, old in enumerate(order)}
        first, label, target, out_at, out, final_at, final = [0], [], [], [0], [], [0], []
        for old in order:
            end, arcs = states[old]
            for b, ids, t in arcs:
                label.append(b)
                target.append(number[t])
                out.extend(ids)
                out_at.append(len(out))
            first.append(len(label))
            final.extend(() if end is None else (*end, -1))  # -1 closes the ids of a final state
            final_at.append(len(final))
        pack = lambda x, t: np.asarray(x, dtype=t)
        return {"first": pack(first, np.int32), "label": pack(label, np.uint8), "target": pack(target, np.int32), "out_at": pack(out_at, np.int32), "out": pack(out, np.int32), "final_at": pack(final_at, np.int32), "final": pack(final, np.int32)}

    def find(self, word: bytes) -> list[int] | None:
        s, ids = 0, []
        first, label, target, out_at = self.first, self.label, self.target, self.out_at
        for b in word:
            a, z = int(first[s]), int(first[s + 1])
            k = a + int(np.searchsorted(label[a:z], b))
            if k >= z or label[k] != b:
                return None
            if (o := out_at[k]) < (e := out_at[k + 1]):
                ids += self.out[o:e].tolist()
            s = int(target[k])
        a, z = int(self.final_at[s]), int(self.final_at[s + 1])
        if a == z:
            return None
        return ids + self.final[a : z - 1].tolist()

    def to_bytes(self) -> bytes:
        """A header of array lengths, then the arrays, each aligned to 8 bytes."""
        blobs = [np.ascontiguousarray(self.a[k]).tobytes() for k in self.ARRAYS]
        head = np.asarray([len(self.a[k]) for k in self.ARRAYS], dtype=np.int64).tobytes()
        return head + b"".join(b + b"\0" * (-len(b) % 8) for b in blobs)

    @classmethod
    def map(cls, path: str) -> Transducer:
        """Memory-map a file written by ``to_bytes``: all workers of a machine share its pages."""
        whole = np.memmap(path, dtype=np.uint8, mode="r")
        sizes = whole[: 8 * len(cls.ARRAYS)].view(np.int64)
        at, arrays = 8 * len(cls.ARRAYS), {}
        for k, n in zip(cls.ARRAYS, sizes, strict=True):
            kind = np.dtype(np.uint8 if k == "label" else np.int32)
            arrays[k] = whole[at : at + int(n) * kind.itemsize].view(kind)
            at += (int(n) * kind.itemsize + 7) // 8 * 8
        return cls(arrays)


class Encoder:
    """Text to ids: transducer first, exact merging for the rest, with a bounded memory of words."""

    def __init__(self, ranks: dict[bytes, int], lexicon: Transducer | None):
        self.ranks, self.lexicon, self.memo = ranks, lexicon, {}
        self.split = regex.compile(PATTERN).findall

    def word(self, w: str) -> list[int]:
        raw = w.encode("utf-8", "replace")
        found = self.lexicon.find(raw) if self.lexicon and len(raw) <= 64 else None
        ids = merge(raw, self.ranks) if found is None else found
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        if len(w) <= 64:
            self.memo[w] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        memo = self.memo
        for w in self.split(text or ""):
            ids = memo.get(w)
            out += self.word(w) if ids is None else ids
        return out


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts, counted in each batch before the shuffle. Words over 64 characters are left to merging."""

    @full_frames
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = regex.compile(PATTERN).findall
        seen: Counter = Counter()
        for b in batches:
            for t in b[text].dropna():
                seen.update(w for w in split(t) if len(w) <= 64)
            if len(seen) > 200_000:
                yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
                seen.clear()
        yield pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())}, dtype=object).astype({"n": "int64"})

    return docs.select(text).mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text: str, ranks: dict[bytes, int], words: int = LEXICON_WORDS) -> Transducer:
    """The transducer of the ``words`` most frequent words of all texts (ties by the word)."""
    top = word_counts(docs, text).where("n > 1").orderBy(F.desc("n"), "word").limit(words).toPandas()
    return Transducer.compile({(raw := w.encode("utf-8", "replace")): merge(raw, ranks) for w in top["word"]})


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids) of every document by the vocabulary, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts give the empty list; every row of ``docs``
    gives a row, repeated rows and null ids included. Other columns are not read. ``vocabulary`` is the path of a .tiktoken file on the driver;
    the workers get it, as they do the lexicon, from the shared folder.
    """
    from pyspark import SparkFiles

    from lectern.llm.shared import put

    spark = docs.sparkSession
    path = vocabulary or vocabulary_path()
    name = put(spark, build_lexicon(docs, text, load_ranks(path), words).to_bytes(), "lexicon")
    with open(path, "rb") as f:
        ranks = put(spark, f.read(), "vocabulary")

    @full_frames
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = SparkFiles.get(name)
        enc = Encoder(load_ranks(SparkFiles.get(ranks)), Transducer.map(local) if os.path.getsize(local) else None)
        for b in batches:
            yield pd.DataFrame({doc_id: b[doc_id], "ids": [enc.encode(t) for t in b[text]]})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInPandas(encode, f"`{doc_id}` {kind}, ids array<int>")
