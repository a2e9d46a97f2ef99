"""Text -> lexemes, in a plain and an English configuration."""

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.functions.stemmer import stem

WORD = r"[\p{L}\p{N}]+"

# The English stop words of PostgreSQL's text search.
STOP_WORDS_ENGLISH = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he
    him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be
    been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under
    again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t can
    will just don should now
    """.split()
)


def stop_words(config: str = "english") -> tuple[str, ...]:
    return STOP_WORDS_ENGLISH if config == "english" else ()


@lru_cache(maxsize=200_000)
def _cached_stem(word: str) -> str:
    return stem(word)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_english(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stem every word of each array, one Arrow batch at a time."""
    for batch in words:
        yield batch.map(lambda ws: None if ws is None else [_cached_stem(w) for w in ws])


def lexemes(text: Column, config: str = "english") -> Column:
    """Distinct lexemes of a text.

    ``simple`` keeps every lower-cased word and stays inside the JVM.
    ``english`` drops stop words and reduces the distinct rest to stems.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    if config == "simple":
        return words
    if config == "english":
        stops = F.array(*[F.lit(w) for w in STOP_WORDS_ENGLISH])
        return F.array_distinct(stem_english(F.array_except(words, stops)))
    raise ValueError(f"unknown text configuration: {config}")
