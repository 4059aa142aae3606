"""Parsing: a text column becomes a typed record. Row by row, inside the JVM, so it runs the same on streams.

The steps are columns of their own (text -> tokens -> fields), which Spark keeps as a chain of projections: an expression that is used
several times is computed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from . import enrich, validate

MADE_GROUND = r"(?i)^(MADE GROUND|FILL|TOPSOIL)"

FIELDS = [
    "raw_description", "material_type", "consistency", "density", "secondary_constituents", "primary_soil_type", "secondary_primary_soil_type", "geological_formation", "is_made_ground", "made_ground_label",
    "rock_strength", "weathering_grade", "rock_structure", "primary_rock_type", "color", "moisture_content", "plasticity_index", "particle_size", "strength", "guidance", "structure", "confidence", "warnings",
    "spelling_corrections", "is_valid",
]


def free_prefix(columns: list[str]) -> str:
    """A prefix that no column begins with."""
    p = "_parse_"
    while any(c.lower().startswith(p) for c in columns):
        p += "_"
    return p


def preprocess(df: DataFrame, text: str = "description", prefix: str = "_") -> DataFrame:
    """Adds {prefix}label (made-ground label), {prefix}formation and {prefix}body (what is left to parse)."""
    p = prefix
    df = df.withColumn(f"{p}body", T.spaces_trimmed(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    df = df.withColumn(f"{p}label", F.upper(F.nullif(F.regexp_extract(f"{p}body", MADE_GROUND, 1), F.lit(""))))
    df = df.withColumn(f"{p}body", F.when(F.col(f"{p}label").isNotNull(), F.regexp_replace(F.regexp_replace(f"{p}body", MADE_GROUND, ""), r"^[ :\t-]+", "")).otherwise(F.col(f"{p}body")))
    body, last = F.col(f"{p}body"), F.col(f"{p}last")
    df = df.withColumn(f"{p}last", F.when((F.length(body) > 2) & body.endswith(")"), last_parenthesis(body)))
    df = df.withColumn(f"{p}formation", F.nullif(F.regexp_replace(F.substring(body, F.length(body) - last + 2, last - 2), r"^[ \t]+|[ \t]+\z", ""), F.lit("")))
    rest = F.regexp_replace(F.substring(body, F.lit(1), F.length(body) - last), r"^[ \t]+|[ \t]+\z", "")
    return df.withColumn(f"{p}body", F.when(F.col(f"{p}formation").isNotNull(), rest).otherwise(body)).drop(f"{p}last")


def last_parenthesis(text: Column) -> Column:
    """The length of the parenthesis that a text ends with, whatever is nested in it; null if it is never opened."""

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece == ")", 1).when(piece == "(", -1).otherwise(0)
        return F.when(acc["done"], acc).otherwise(F.struct(depth.alias("depth"), (acc["length"] + F.length(piece)).alias("length"), (depth == 0).alias("done")))

    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done"))
    backwards = F.reverse(F.regexp_extract_all(text, F.lit("[()]|[^()]+"), F.lit(0)))
    return F.aggregate(backwards, begin, step, lambda acc: F.when(acc["done"], acc["length"]))


def held(df: DataFrame, own: list[Column], value: Column, name: str) -> DataFrame:
    """own columns and value, as a column the optimizer does not look through: without this, filters and generators above would have the
    whole chain of expressions below copied into them, several times over."""
    return df.select(*own, F.explode(F.array(value)).alias(name))


def meanings(terms: dict[str, tuple[str, str]]) -> dict[str, str]:
    """Word -> what it means, for all words that mean something."""
    known = {w: vocab.MEANING.get(w, w) for w, _ in vocab.phrases() + vocab.single_words()}
    return {w: m for w, m in (known | {w: m for w, (_, m) in terms.items()}).items() if m}


def first_of(kinds: Column, meant: Column, kind: str) -> Column:
    """What the first token of a class that means something means. kinds, meant: by token, its class if it means something, and the meaning."""
    return F.get(meant, F.array_position(kinds, F.lit(kind)).cast("int") - 1)


def consumed(tokens: Column, i: Column) -> Column:
    """Whether token i belongs to the proportion before it."""
    return F.get(tokens, i)["type"].isin("adjective", "soil_type") & F.coalesce(F.get(tokens, i - 1)["type"] == "proportion", F.lit(False))


def secondary(tokens: Column) -> Column:
    adjective = T.literal_map(vocab.ADJECTIVE)

    def one(t: Column, i: Column) -> Column:
        after = F.get(tokens, i + 1)
        pair = (t["type"] == "proportion") & F.coalesce(after["type"].isin("adjective", "soil_type"), F.lit(False))
        joined = F.struct(t["value"].alias("amount"), F.coalesce(F.try_element_at(adjective, after["text"]), after["value"]).alias("soil_type"))
        alone = F.struct(F.lit("moderately").alias("amount"), t["text"].alias("soil_type"))
        return F.when(pair, joined).when((t["type"] == "adjective") & ~consumed(tokens, i), alone)

    return F.array_compact(F.transform(tokens, one))


def parse(df: DataFrame, text: str = "description", out: str = "d", terms: dict[str, str | tuple[str, str]] | None = None, threshold: float | None = vocab.FUZZY_THRESHOLD) -> DataFrame:
    """df with a struct column out of all FIELDS. terms: further words (lower case) -> class (of the vocabulary's classes), or -> (class,
    what the word means), for words that stand for another, as abbreviations do; they go before the vocabulary's own. threshold: of
    spelling correction by likeness; None: none."""
    extra = {w: (t, w) if isinstance(t, str) else t for w, t in (terms or {}).items()}
    own = [F.col(f"`{c}`") for c in df.columns if c != out]
    p = free_prefix(df.columns)
    df = preprocess(df.select(*own), text, p)
    kept = [*own, F.col(f"{p}label"), F.col(f"{p}formation")]
    df = held(df.withColumn(f"{p}words", T.words(F.col(f"{p}body"))), kept, T.classified(F.col(f"{p}words"), {w: kind for w, (kind, _) in extra.items()}, threshold), f"{p}tokens")
    tokens = F.col(f"{p}tokens")
    df = df.withColumn(f"{p}meant", F.transform(tokens, lambda t: F.try_element_at(T.literal_map(meanings(extra)), t["text"])))
    df = df.withColumn(f"{p}kinds", F.zip_with(tokens, f"{p}meant", lambda t, m: F.when(m.isNotNull(), t["type"])))
    rock = F.exists(tokens, lambda t: t["type"].isin(vocab.ROCK_CLASSES))
    # free: the tokens no proportion has taken, with the text before each
    free = F.filter(F.transform(tokens, lambda t, i: F.struct(t["type"].alias("type"), t["text"].alias("text"), F.get(tokens, i - 1)["text"].alias("before"), consumed(tokens, i).alias("taken"))), lambda t: (t["type"] == "soil_type") & ~t["taken"])
    df = df.withColumn(f"{p}material", F.when(rock, "rock").otherwise("soil")).withColumn(f"{p}soils", free)
    soil, soils = F.col(f"{p}material") == "soil", F.col(f"{p}soils")
    later = F.filter(F.slice(soils, 2, F.greatest(F.size(soils), F.lit(1))), lambda t: t["before"] == "and")
    first = lambda kind: first_of(F.col(f"{p}kinds"), F.col(f"{p}meant"), kind)
    values = {
        "raw_description": F.col(f"`{text}`"), "material_type": F.col(f"{p}material"),
        "consistency": F.when(soil, first("consistency")), "density": F.when(soil, first("density")), "secondary_constituents": secondary(tokens),
        "primary_soil_type": F.when(soil, F.upper(F.get(soils, F.lit(0))["text"])), "secondary_primary_soil_type": F.when(soil, F.upper(F.get(later, F.lit(0))["text"])),
        "geological_formation": F.col(f"{p}formation"), "is_made_ground": F.col(f"{p}label").isNotNull(), "made_ground_label": F.col(f"{p}label"),
        "rock_strength": F.when(~soil, first("rock_strength")), "weathering_grade": F.when(~soil, first("weathering_grade")), "rock_structure": F.when(~soil, first("rock_structure")),
        "primary_rock_type": F.when(~soil, F.upper(first("rock_type"))), "color": first("color"), "moisture_content": first("moisture_content"),
        "plasticity_index": first("plasticity_index"), "particle_size": first("particle_size"),
        "spelling_corrections": F.transform(F.filter(tokens, lambda t: t["corrected_from"].isNotNull()), lambda t: F.struct(t["corrected_from"].alias("original"), t["value"].alias("corrected"), t["score"].cast("float").alias("score"))),
    }
    df = held(df, own, F.struct(*[v.alias(k) for k, v in values.items()]), f"{p}fields")
    return completed(df, lambda k: F.col(f"{p}fields")[k], own, out)


def completed(df: DataFrame, d, own: list[Column], out: str) -> DataFrame:
    """Adds strength, guidance, warnings, confidence and validity to the fields that d gives, and gathers all in one struct."""
    p = free_prefix(df.columns)
    df = df.withColumn(f"{p}warnings", validate.warnings(d)).withColumn(f"{p}is_valid", validate.is_valid(d))
    values = {k: d(k) for k in FIELDS} | {
        "strength": enrich.strength(d("material_type"), d("primary_soil_type"), d("consistency"), d("density"), d("rock_strength")),
        "guidance": F.when(d("material_type") == "soil", enrich.guidance(d("primary_soil_type"), d("secondary_constituents"))), "structure": F.lit(None).cast("string"), "confidence": validate.confidence(F.col(f"{p}warnings")),
        "warnings": F.col(f"{p}warnings"), "is_valid": F.col(f"{p}is_valid"),
    }
    return held(df, own, F.struct(*[values[k].alias(k) for k in FIELDS]), out)


def once(df: DataFrame, make: Callable[[DataFrame], DataFrame], text: str = "description") -> DataFrame:
    """df with the columns that make adds to a table of its distinct texts (one column, of the same name), in place of any so called: each text goes through make once,
    however often it occurs. Costs a shuffle of the texts; where few are distinct, they are broadcast back."""
    key = free_prefix(df.columns) + "text"
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism  # given, as parsing takes more time than the bytes tell
    made = make(df.select(f"`{text}`").distinct().repartition(tasks))
    new = [c for c in made.columns if c != text]
    made = made.select(F.col(f"`{text}`").alias(key), *[f"`{c}`" for c in new])
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new]).join(made, F.col(f"`{text}`").eqNullSafe(F.col(key))).drop(key)


def parse_distinct(df: DataFrame, text: str = "description", out: str = "d") -> DataFrame:
    """As parse, each distinct text once."""
    return once(df, lambda texts: parse(texts, text, out), text)
