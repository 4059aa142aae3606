"""Descriptions as JSON and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from . import parse

READ = (
    "material_type string, raw_description string, consistency string, density string, primary_soil_type string, secondary_primary_soil_type string, geological_formation string, is_made_ground boolean, "
    "made_ground_label string, rock_strength string, weathering_grade string, rock_structure string, primary_rock_type string, color string, moisture_content string, plasticity_index string, particle_size string, "
    "secondary_constituents array<struct<amount:string,soil_type:string>>, confidence double, is_valid boolean"
)


def two(value: Column) -> Column:
    return F.round(value.cast("double"), 2).cast("decimal(12,2)")


def compact(d: Column) -> Column:
    """Compact JSON in a fixed order of keys; nulls left out, strings escaped, numbers with two decimals (percentages with none)."""
    s, g = d["strength"], d["guidance"]
    whole = lambda x: F.format_string("%.0f", x)
    shares = F.transform(g["constituents"], lambda c: F.struct(c["soil_type"].alias("soil_type"), F.concat(whole(c["lower"]), F.lit("-"), whole(c["upper"])).alias("percentage_range"), whole(c["typical"]).cast("int").alias("typical_percentage")))
    first = ["raw_description", "material_type", "consistency", "density", "primary_soil_type", "secondary_primary_soil_type", "geological_formation"]
    then = ["made_ground_label", "rock_strength", "weathering_grade", "rock_structure", "primary_rock_type", "color", "moisture_content", "plasticity_index", "particle_size"]
    return F.to_json(
        F.struct(
            *[d[k].alias(k) for k in first], F.when(d["is_made_ground"], F.lit(True)).alias("is_made_ground"), *[d[k].alias(k) for k in then],
            s["type"].alias("strength_parameter_type"), s["units"].alias("strength_parameter_units"), two(s["lower"]).alias("strength_lower_bound"), two(s["upper"]).alias("strength_upper_bound"), two(s["typical"]).alias("strength_typical_value"), two(s["confidence"]).alias("strength_confidence"),
            shares.alias("constituent_proportions"), two(g["confidence"]).alias("constituent_confidence"), d["secondary_constituents"].alias("secondary_constituents"), d["warnings"].alias("warnings"), two(d["confidence"]).alias("confidence"), d["is_valid"].alias("is_valid"),
        )
    )


def pretty(d: Column) -> Column:
    return F.to_json(F.from_json(compact(d), "map<string,string>"), {"pretty": "true"})


def summary(d: Column) -> Column:
    """One line for people."""
    main = F.coalesce(d["primary_rock_type"], d["primary_soil_type"], F.lit("-"))
    return F.concat_ws(" | ", d["raw_description"], d["material_type"], F.coalesce(d["rock_strength"], d["consistency"], d["density"], F.lit("-")), main, F.format_string("confidence %.2f", d["confidence"]), F.when(d["is_valid"], "valid").otherwise("invalid"), F.nullif(F.array_join(d["warnings"], "; "), F.lit("")))


def known(value: Column, words: list[str], upper: bool = False) -> Column:
    """value in its usual form where it is one of words, else null."""
    low = F.lower(value)
    good = F.when(low.isin([w.lower() for w in words]) & (F.octet_length(value) < vocab.WORD_BYTES), low)
    return F.upper(good) if upper else good


def words_of(kind: str) -> list[str]:
    return [w for w, k in vocab.phrases() + vocab.single_words() if k == kind and vocab.MEANING.get(w, w) == w]


def from_json(df: DataFrame, text: str = "json", out: str = "d") -> DataFrame:
    """df with a description struct read from a column of JSON objects: missing fields and unknown words are null, strength, guidance and
    warnings are worked out again. A text that is no object of that kind gives null."""
    own = [F.col(f"`{c}`") for c in df.columns if c != out]
    j = F.from_json(F.col(f"`{text}`"), f"{READ}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    j = F.when(F.ltrim(F.col(f"`{text}`")).startswith("{"), j)
    df = df.select(*own, j.alias("_json"))
    x = lambda k: F.col("_json")[k]
    values = {
        "raw_description": x("raw_description"), "material_type": F.coalesce(known(x("material_type"), ["soil", "rock"]), F.lit("soil")), "consistency": known(x("consistency"), vocab.CONSISTENCY), "density": known(x("density"), vocab.DENSITY),
        "secondary_constituents": F.coalesce(x("secondary_constituents"), F.array().cast("array<struct<amount:string,soil_type:string>>")), "primary_soil_type": known(x("primary_soil_type"), words_of("soil_type"), True), "secondary_primary_soil_type": known(x("secondary_primary_soil_type"), words_of("soil_type"), True),
        "geological_formation": x("geological_formation"), "is_made_ground": F.coalesce(x("is_made_ground"), F.lit(False)), "made_ground_label": x("made_ground_label"), "rock_strength": known(x("rock_strength"), vocab.ROCK_STRENGTH), "weathering_grade": known(x("weathering_grade"), vocab.WEATHERING),
        "rock_structure": known(x("rock_structure"), words_of("rock_structure")), "primary_rock_type": known(x("primary_rock_type"), words_of("rock_type"), True), "color": known(x("color"), words_of("color")), "moisture_content": known(x("moisture_content"), words_of("moisture_content")),
        "plasticity_index": known(x("plasticity_index"), words_of("plasticity_index")), "particle_size": known(x("particle_size"), words_of("particle_size")), "spelling_corrections": F.array().cast("array<struct<original:string,corrected:string,score:float>>"),
    }
    df = df.select(*own, *[v.alias(f"_parse_{k}") for k, v in values.items()], (F.col("_json").isNotNull() & x("_corrupt").isNull()).alias("_good"))
    done = parse.completed(df, lambda k: F.col(f"_parse_{k}"), [*own, F.col("_good")], out)
    return done.select(*own, F.when(F.col("_good"), F.col(out)).alias(out))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Description structs of JSON files that hold an object or an array of objects each; items that are no objects are left out."""
    whole = spark.read.text(path, wholetext=True).withColumn("value", F.trim("value"))
    items = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    rows = whole.select(F.explode(items).alias("json")).where(F.col("json").startswith("{"))
    return from_json(rows).where("d is not null")
