"""Correction of words by an index of deletion neighbourhoods, for vocabularies and word lists of any size.

Two words of few differences have a form in common that each gives when as few letters are left out. Every term is filed under all its forms, a word looks up
its own, and only the terms that it meets so are compared with it: an equal join instead of a loop over the terms for each word. The rules are
those of functions.text.fuzzy_term: words of FUZZY_MIN to FUZZY_MAX bytes with one of the usual first letters, terms of the same first letter
and of FUZZY_SPAN bytes more or fewer at most, the most similar one, the first of equals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T


def most_left_out(length: Column, threshold: float) -> Column:
    """How many letters two words of the threshold's similarity may differ in, if one has this length and the other FUZZY_SPAN more at most."""
    return F.floor((length + vocab.FUZZY_SPAN) * (1 - threshold) + 1e-9).cast("int")


def forms(word: Column, threshold: float) -> Column:
    """What is left of a word but its first letter when up to most_left_out letters are left out."""

    def shorter(words: Column) -> Column:
        without = lambda w, i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w)))
        one = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: without(w, i))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.flatten(F.transform(words, one)))

    bytes_of = T.byte_text(word)
    level = F.array(bytes_of.substr(F.lit(2), F.length(bytes_of)))
    out = level
    for k in range(1, math.floor((vocab.FUZZY_MAX + vocab.FUZZY_SPAN) * (1 - threshold) + 1e-9) + 1):
        level = F.when(most_left_out(F.length(bytes_of), threshold) >= k, shorter(level)).otherwise(F.array().cast("array<string>"))
        out = F.concat(out, level)
    return F.array_distinct(out)


def index(terms: DataFrame, term: str = "term", place: str = "place", threshold: float = vocab.FUZZY_THRESHOLD) -> DataFrame:
    """first, form, term and place: each term under all its forms. place settles ties."""
    rows = terms.select(F.col(f"`{term}`").alias("term"), F.col(f"`{place}`").alias("place")).where(F.octet_length("term").between(1, vocab.FUZZY_MAX + vocab.FUZZY_SPAN))
    return rows.select(F.substring(T.byte_text(F.col("term")), 1, 1).alias("first"), F.explode(forms(F.col("term"), threshold)).alias("form"), "term", "place")


def corrections(words: DataFrame, filed: DataFrame, word: str = "word", threshold: float = vocab.FUZZY_THRESHOLD) -> DataFrame:
    """word, option and score of each distinct lower-case word that resembles a filed term enough."""
    own = words.select(F.col(f"`{word}`").alias("word")).where(F.octet_length("word").between(vocab.FUZZY_MIN, vocab.FUZZY_MAX) & F.col("word").rlike(f"^[{vocab.FUZZY_FIRST}]")).distinct()
    asked = own.select("word", F.substring("word", 1, 1).alias("first"), F.explode(forms(F.col("word"), threshold)).alias("form"))
    met = asked.join(filed, ["first", "form"]).select("word", "term", "place").distinct().where(F.abs(F.length("term") - F.octet_length("word")) <= vocab.FUZZY_SPAN)
    scored = met.withColumn("score", T.similarity(F.col("word"), F.col("term"))).where(F.col("score") >= threshold)
    best = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "place"))
    return scored.withColumn("_best", best).where(F.col("_best") == 1).select("word", F.col("term").alias("option"), "score")
