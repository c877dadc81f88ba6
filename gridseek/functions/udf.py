"""Text functions with state that the built-in expressions can't hold; Arrow batches."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from gridseek.functions.text import token_size


@F.pandas_udf(StringType())
def nfd(texts: pd.Series) -> pd.Series:
    """Canonical decomposition."""
    return texts.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")


def pieces_of(word: str, vocabulary: frozenset[str], longest: int = 100) -> list[str]:
    """The longest pieces first, those inside a word with ##; an unknown or very long word is one [UNK]."""
    if len(word) > longest:
        return ["[UNK]"]
    out, at = [], 0
    while at < len(word):
        to = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
        if to is None:
            return ["[UNK]"]
        out.append(("##" if at else "") + word[at:to])
        at = to
    return out


def tokens_of(text: str | None, vocabulary: frozenset[str]) -> list[str]:
    """Tokens by a given vocabulary: lower case without accents, punctuation apart, then pieces."""
    plain = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if unicodedata.category(c) != "Mn")
    apart = "".join(f" {c} " if unicodedata.category(c)[0] == "P" or c in "$+<=>^`|~" else c for c in plain)
    return [p for w in apart.split() for p in pieces_of(w, vocabulary)]


def word_pieces(text: Column, vocabulary: frozenset[str]) -> Column:
    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tokens_of(t, vocabulary))

    return run(text)


def size_in_tokens(text: Column, vocabulary: frozenset[str] | None = None) -> Column:
    """What budgets of tokens count: pieces of a vocabulary, or without one words and single other characters."""
    return token_size(text) if vocabulary is None else F.size(word_pieces(text, vocabulary))


def template_of(sentence: str, entities: list[tuple[str, str]], least: float = 0.85) -> str:
    """Each entity's span replaced by its tag, the longest entity first; without an exact place, the window of as many words that is alike enough."""
    for tag, entity in sorted(entities, key=lambda e: -len(e[1])):
        if entity and entity in sentence:
            sentence = sentence.replace(entity, tag, 1)
            continue
        words, n = sentence.split(" "), len(entity.split())
        best = max(((SequenceMatcher(None, " ".join(words[i : i + n]).lower(), entity.lower()).ratio(), -i) for i in range(len(words) - n + 1)), default=(0.0, 0))
        if n and best[0] >= least:
            i = -best[1]
            sentence = " ".join([*words[:i], tag, *words[i + n :]])
    return sentence


@F.pandas_udf(StringType())
def templates(sentences: pd.Series, tags: pd.Series, entities: pd.Series) -> pd.Series:
    return pd.Series([template_of(s, list(zip(t, e, strict=True))) for s, t, e in zip(sentences, tags, entities, strict=True)])


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table in one number: a bit is 0 where the row grows."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        both = row & places.get(x, 0)
        row = (row + both | row - both) & full
    return len(b) - row.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of words."""

    def one(h: str, r: str) -> float:
        a, b = h.lower().split(), r.lower().split()
        n = common_length(a, b)
        return 2 * n / (len(a) + len(b)) if n else 0.0

    return pd.Series([one(h, r) for h, r in zip(hyp, ref, strict=True)])
