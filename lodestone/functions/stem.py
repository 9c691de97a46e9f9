"""English stemming by the published Porter2 rules (snowballstem.org, "The English (Porter2) stemming algorithm")."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
V = "[aeiouy]"


def _regions(w: str) -> tuple[int, int]:
    m = re.match(r"(gener|commun|arsen)", w) or re.search(rf"{V}[^aeiouy]", w)
    r1 = m.end() if m else len(w)
    m = re.search(rf"{V}[^aeiouy]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.match(r"^[aeiouy][^aeiouy]$", w))


def _longest(w: str, endings) -> str:
    return max((e for e in endings if w.endswith(e)), key=len, default="")


def stem(w: str) -> str:
    if len(w) <= 2 or not w.isascii():
        return w
    if w in WHOLE:
        return WHOLE[w]
    if w in KEPT:
        return w
    w = re.sub(rf"^y|(?<={V})y", "Y", w)
    r1, r2 = _regions(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(V, w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search(V, w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if re.search(r"[^aeiouy][yY]$", w) and len(w) > 2:
        w = w[:-1] + "i"
    end = _longest(w, [*STEP2, "ogi", "li"])
    if end and len(w) - len(end) >= r1:
        if end in STEP2:
            w = w[: -len(end)] + STEP2[end]
        elif end == "ogi" and w[:-3].endswith("l"):
            w = w[:-1]
        elif end == "li" and w[:-2].endswith(tuple("cdeghkmnrt")):
            w = w[:-2]
    end = _longest(w, [*STEP3, "ative"])
    if end and len(w) - len(end) >= r1:
        if end in STEP3:
            w = w[: -len(end)] + STEP3[end]
        elif len(w) - 5 >= r2:
            w = w[:-5]
    end = _longest(w, [*STEP4, "ion"])
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))) or (w.endswith("ll") and len(w) - 1 >= r2):
        w = w[:-1]
    return w.lower()


def stem_column(col: str) -> Column:
    """Stems of a string column, in Arrow batches; give it different words only."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(stem, na_action="ignore")

    return run(F.col(col))


def stem_lists(words: Column) -> Column:
    """The stems of an array of words, each at the place of its word.  A batch's different words are stemmed once, and a worker keeps the last 262,144."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        known = lru_cache(1 << 18)(stem) if not hasattr(stem_lists, "known") else stem_lists.known
        stem_lists.known = known
        flat = lists.flatten().dictionary_encode()
        stems = pa.array([None if w is None else known(w) for w in flat.dictionary.to_pylist()], pa.string())
        sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), stems.take(flat.indices), mask=lists.is_null())

    return run(words)


def stem_set(words: Column) -> Column:
    """The different stems of an array of words, in order, as one string."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return s.map(lambda ws: " ".join(sorted({known.get(w) or known.setdefault(w, stem(w)) for w in ws})), na_action="ignore")

    return run(words)
