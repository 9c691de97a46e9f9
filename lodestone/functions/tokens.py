"""Token counts by a vocabulary file of the tokenizers library."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"


@cache
def _tokenizer(path: str | None):
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path(VOCABULARY))
    return Tokenizer.from_file(path)


class Counts:
    """Token counts of texts.  In the public vocabulary a space between two characters that are no white space always begins a new piece, so a text without white space before a space is cut at its spaces, and each different word is
    encoded once as long as it is known (at most WORDS of them).  Other texts, those that hold an added token, and all texts by another file are encoded whole."""

    WORDS, PART = 500_000, 500
    LOOSE = re.compile(r"\s ")

    def __init__(self, path: str | None):
        self.encoder, self.cut = _tokenizer(path), path is None
        self.added = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.encoder.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.cut:
            return self._encoded(texts)
        loose = [i for i, t in enumerate(texts) if self.LOOSE.search(t) or any(a in t for a in self.added)]
        out = dict(zip(loose, self._encoded([texts[i] for i in loose]), strict=True))
        words = {i: t.split(" ") for i, t in enumerate(texts) if i not in out}
        if len(self.known) > self.WORDS:
            self.known.clear()
        new = list({w for x in words.values() for w in x[1:]} - self.known.keys())
        self.known.update(zip(new, self._encoded([f" {w}" for w in new]), strict=True))
        first = dict(zip(words, self._encoded([x[0] for x in words.values()]), strict=True))
        known = self.known.__getitem__
        return [out[i] if i in out else first[i] + sum(map(known, words[i][1:])) for i in range(len(texts))]


@cache
def _counts(path: str | None) -> Counts:
    return Counts(path)


def token_count(col: str, path: str | None = None) -> Column:
    """Number of tokens, special ones left out; null texts have 0.  Each worker loads the file once; a batch is encoded in parts of some megabytes."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        counts, out, texts = _counts(path), [], [x or "" for x in s]
        for k in range(0, len(texts), Counts.PART):
            out += counts(texts[k : k + Counts.PART])
        return pd.Series(out, dtype="int64")

    return run(F.col(col))
