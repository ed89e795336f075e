"""Large vocabularies: all terms that a folded text has, in one pass of one automaton, whatever the number of terms.

Terms are folded like the text. `substring` finds them anywhere, `word` where a word boundary stands at both ends, as the
patterns of small vocabularies have it: a boundary lies between a word's character (a letter, digit or underscore) and
another one, or an end of the text. The automaton goes to each worker once; its terms are configuration and bounded by
MAX_TERMS. Null texts have no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TERMS = 1_000_000


def build(terms: list[str]):
    """Folded terms -> an automaton whose words hold (length, numbers of the terms that are this one). Empty ones are everywhere, and left out here."""
    import ahocorasick

    if len(terms) > MAX_TERMS:
        raise ValueError(f"{len(terms)} terms; the bound is {MAX_TERMS}")
    at: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        if t:
            at.setdefault(t, []).append(i)
    a = ahocorasick.Automaton()
    for t, numbers in at.items():
        a.add_word(t, (len(t), tuple(numbers)))
    if at:
        a.make_automaton()
    return a, tuple(i for i, t in enumerate(terms) if not t)


def found(automaton, text: str, word: bool) -> set[int]:
    """Numbers of the terms in a text."""
    out: set[int] = set()
    is_word = lambda c: c.isalnum() or c == "_"
    for end, (n, numbers) in automaton.iter(text) if len(automaton) else ():
        if numbers[0] in out:
            continue
        s, e = end + 1 - n, end + 1
        if word and not (((s > 0 and is_word(text[s - 1])) != is_word(text[s])) and ((e < len(text) and is_word(text[e])) != is_word(text[end]))):
            continue
        out.update(numbers)
    return out


def terms_in(hay: Column, terms: list[str], folded: list[str], mode: str) -> Column:
    """The terms that folded text has, in the order of the list. Not for use inside higher-order functions."""
    spark = SparkSession.active()
    share = spark.sparkContext.broadcast((build(folded), terms))
    word = mode == "word"

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        (automaton, everywhere), names = share.value
        for texts in batches:
            yield pd.Series([[] if t is None else [names[i] for i in sorted(found(automaton, t, word).union(() if word else everywhere))] for t in texts], dtype=object)

    return hits(hay)
