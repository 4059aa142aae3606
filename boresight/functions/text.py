"""Column functions on description texts: tokens and their classes, similarity, terminology. All run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab

TOKEN_TYPE = "struct<value:string,type:string,text:string,corrected_from:string,score:double>"


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)])


def spaces_trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+\z", "")


def token_pattern(end: str) -> str:
    return "(?i)(?:" + "|".join(re.escape(p).replace(r"\ ", " ").replace(r"\-", "-") for p, _ in vocab.phrases()) + f"){end}|\\S+"


def words(text: Column) -> Column:
    """The tokens of a text: a phrase of the vocabulary, else a run without white space."""
    return F.regexp_extract_all(text, F.lit(token_pattern(r"(?=\s|\z)")), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_text(text: Column) -> Column:
    """A character for each UTF-8 byte, so that lengths and distances count bytes."""
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(byte_text(a), byte_text(b))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length in bytes; 1 for two empty texts."""
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - levenshtein(a, b) / longer.cast("double"))


def best(word: Column, options: Column, threshold: float, strict: bool = False) -> Column:
    """struct(option, score) of the most similar option, the first of equals; null below threshold."""

    def step(acc: Column, option: Column) -> Column:
        score = similarity(word, option)
        better = (score > acc["score"]) if strict else (score >= threshold) & (score > acc["score"])
        return F.when(better, F.struct(option.alias("option"), score.alias("score"))).otherwise(acc)

    start = F.struct(F.lit(None).cast("string").alias("option"), F.lit(0.0 if strict else -1.0).alias("score"))
    return F.aggregate(options, start, step, lambda acc: F.when(acc["option"].isNotNull() & (acc["score"] >= threshold), acc))


def closest_match(word: Column, options: Column) -> Column:
    return best(word, options, -1.0)


def fuzzy_match(word: Column, options: Column, threshold: float) -> Column:
    return best(word, options, threshold)


def fuzzy_match_ignoring_case(word: Column, options: Column, threshold: float) -> Column:
    """As fuzzy_match on lower-cased texts; the option is returned as it was given, and its score must exceed 0."""
    pairs = F.transform(options, lambda o: F.struct(ascii_lower(o).alias("low"), o.alias("own")))

    def step(acc: Column, x: Column) -> Column:
        score = similarity(ascii_lower(word), x["low"])
        return F.when((score >= threshold) & (score > acc["score"]), F.struct(x["own"].alias("option"), score.alias("score"))).otherwise(acc)

    start = F.struct(F.lit(None).cast("string").alias("option"), F.lit(0.0).alias("score"))
    return F.aggregate(pairs, start, step, lambda acc: F.when(acc["option"].isNotNull(), acc))


def fuzzy_term(word: Column, threshold: float = vocab.FUZZY_THRESHOLD) -> Column:
    """struct(option, score) of the vocabulary word meant by a lower-case word, or null."""
    by_letter: dict[str, list[str]] = {}
    for term, _ in vocab.single_words():
        by_letter.setdefault(term[0], []).append(term)
    terms = F.create_map(*[x for k, group in by_letter.items() for x in (F.lit(k), F.array(*map(F.lit, group)))])
    near = F.filter(F.element_at(terms, F.substring(word, 1, 1)), lambda t: F.abs(F.length(t) - F.octet_length(word)) <= vocab.FUZZY_SPAN)
    gate = F.octet_length(word).between(vocab.FUZZY_MIN, vocab.FUZZY_MAX) & word.rlike(f"^[{vocab.FUZZY_FIRST}]")
    return F.when(gate, best(word, near, threshold))


def classified(tokens: Column, extra: dict[str, str] | None = None, threshold: float | None = vocab.FUZZY_THRESHOLD) -> Column:
    """array<struct<value, type, text, corrected_from, score>> of an array of tokens. value: as written, or the word meant where the
    spelling was corrected (corrected_from, score); text: value in lower case; type: its class or 'unknown'. extra: more terms -> class. threshold: of spelling correction by likeness; None:
    only known misspellings are corrected."""
    classes = dict(vocab.phrases()) | dict(vocab.single_words()) | (extra or {})
    known, wrong = literal_map(classes), literal_map(vocab.typos())
    null = lambda kind: F.lit(None).cast(kind)

    def one(token: Column) -> Column:
        low = ascii_lower(token)
        kind = F.when(F.octet_length(token) < vocab.WORD_BYTES, F.try_element_at(known, low))
        plain = F.struct(token.alias("value"), F.coalesce(kind, F.lit("unknown")).alias("type"), low.alias("text"), null("string").alias("corrected_from"), null("double").alias("score"))
        meant = F.try_element_at(wrong, low)
        # an array of one is a name for what is used several times
        guess = F.array(F.when(meant.isNotNull(), F.struct(meant.alias("option"), F.lit(vocab.TYPO_SCORE).alias("score"))).otherwise(F.lit(None) if threshold is None else fuzzy_term(low, threshold)))
        mended = F.transform(guess, lambda g: F.when(g.isNull(), plain).otherwise(F.struct(g["option"].alias("value"), F.try_element_at(known, g["option"]).alias("type"), g["option"].alias("text"), token.alias("corrected_from"), g["score"].alias("score"))))
        return F.when(kind.isNotNull() | (F.octet_length(token) >= vocab.WORD_BYTES), plain).otherwise(F.get(mended, F.lit(0)))

    return F.transform(tokens, one)


def expand_abbreviations(text: Column) -> Column:
    """Plain substring replacement in the fixed order, without regard to word ends."""
    for short, long in vocab.ABBREVIATIONS:
        text = F.replace(text, F.lit(short), F.lit(long))
    return text


def american_colour(text: Column) -> Column:
    return F.replace(text, F.lit("colour"), F.lit("color"))
