"""English stemming (the published Snowball English algorithm), in Arrow batches with a memo of words."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_V = "aeiouy"
#: Doubles that are cut, letters before li, exceptional words, and suffixes with what they become.
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.compile(rf"[{_V}][^{_V}]").search(w, start)
        return m.end() if m else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.search(rf"[^{_V}][{_V}][^{_V}wxY]$|^[{_V}][^{_V}]$", w))


@lru_cache(200_000)
def stem(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) <= 2:
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    w = w.lstrip("'")
    w = re.sub(rf"^y|(?<=[{_V}])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(rf"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    if m := re.search(r"(?:eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(?:ingly|edly|ing|ed)$", w)) and re.search(rf"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for suffix in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1:
                if suffix == "ogi":
                    w = w[:-1] if w[at - 1 : at] == "l" else w
                elif suffix == "li":
                    w = w[:at] if w[at - 1 : at] in _LI else w
                else:
                    w = w[:at] + _STEP2[suffix]
            break
    for suffix in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if suffix == "ative":
                w = w[:at] if at >= r2 else w
            elif at >= r1:
                w = w[:at] + _STEP3[suffix]
            break
    for suffix in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stemmed(words: Column | str) -> Column:
    """Words stemmed; markers that begin with two underscores stay as they are. Null for null."""

    @F.pandas_udf("array<string>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda ws: None if ws is None else [w if w is None or w.startswith("__") else stem(w) for w in ws])

    return f(words)
