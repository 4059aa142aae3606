"""Texts from description structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from .enrich import strength
from .validate import is_cohesive, is_granular

NO_PARTS = "array<struct<amount:string,soil_type:string>>"
# What variations run through.
VARIED_CONSISTENCY, VARIED_DENSITY = ["soft", "firm", "stiff", "very stiff"], ["loose", "medium dense", "dense", "very dense"]
VARIED_ROCK = ["weak", "moderately weak", "moderately strong", "strong", "very strong"]


def state(d) -> Column:
    return F.coalesce(d["consistency"], d["density"])


def parts(d) -> Column:
    """The constituents as one text, or null."""
    return F.nullif(F.array_join(F.transform(d["secondary_constituents"], lambda p: F.concat_ws(" ", p["amount"], p["soil_type"])), " "), F.lit(""))


def weathered(d) -> Column:
    """The grade and the word: a grade that already says so says it twice."""
    return F.concat(d["weathering_grade"], F.lit(" weathered"))


def generate(d) -> Column:
    soil = F.concat_ws(" ", state(d), parts(d), d["particle_size"], d["primary_soil_type"])
    rock = F.concat_ws(" ", d["rock_strength"], weathered(d), d["rock_structure"], d["primary_rock_type"])
    return F.when(d["material_type"] == "rock", rock).otherwise(soil)


def concise(d) -> Column:
    return F.when(d["material_type"] == "rock", F.concat_ws(" ", d["rock_strength"], d["primary_rock_type"])).otherwise(F.concat_ws(" ", state(d), d["primary_soil_type"]))


def verbose(d) -> Column:
    soil = F.concat_ws(" ", d["color"], d["moisture_content"], state(d), d["plasticity_index"], parts(d), d["particle_size"], d["primary_soil_type"])
    rock = F.concat_ws(" ", d["color"], d["moisture_content"], d["rock_strength"], weathered(d), d["rock_structure"], d["primary_rock_type"])
    return F.when(d["material_type"] == "rock", rock).otherwise(soil)


def standard(d) -> Column:
    """Each word with a space after it but the primary type, so a text without one ends in a space."""
    spaced = lambda *words: F.concat(*[F.coalesce(F.concat(w, F.lit(" ")), F.lit("")) for w in words])
    soil = F.concat(spaced(state(d), parts(d)), F.coalesce(d["primary_soil_type"], F.lit("")))
    rock = F.concat(spaced(d["rock_strength"], weathered(d), d["rock_structure"]), F.coalesce(d["primary_rock_type"], F.lit("")))
    return F.when(d["material_type"] == "rock", rock).otherwise(soil)


def with_strength(d) -> Column:
    s = d["strength"]
    return F.when(s.isNotNull(), F.format_string("%s (%s: %.1f-%.1f %s)", generate(d), s["type"], s["lower"], s["upper"], s["units"])).otherwise(generate(d))


def label(d) -> Column:
    return F.coalesce(F.when(d["material_type"] == "rock", d["primary_rock_type"]).otherwise(d["primary_soil_type"]), F.lit("Unknown"))


class Fields(dict):
    """Field name -> Column; fields that aren't given are null."""

    def __missing__(self, name: str) -> Column:
        return F.array().cast(NO_PARTS) if name == "secondary_constituents" else F.lit(None).cast("string")


def from_properties(**fields: Column) -> Column:
    """The text of typed arguments."""
    return generate(Fields(fields))


def variations(d) -> Column:
    """array<string>: the description with each usual strength word; empty for peat, organic and untyped soil. A consistency that is
    there goes before a varied density."""
    field = lambda name: d[name]
    names = ("material_type", "consistency", "density", "secondary_constituents", "particle_size", "primary_soil_type", "rock_strength", "weathering_grade", "rock_structure", "primary_rock_type")
    own = {n: field(n) for n in names}
    over = lambda name, words: F.array(*[generate(own | {name: F.lit(w)}) for w in words])
    soil = F.when(is_cohesive(d["primary_soil_type"]), over("consistency", VARIED_CONSISTENCY)).when(is_granular(d["primary_soil_type"]), over("density", VARIED_DENSITY)).otherwise(F.array().cast("array<string>"))
    return F.when(d["material_type"] == "rock", over("rock_strength", VARIED_ROCK)).otherwise(soil)


def chance(number: Column, salt: str) -> Column:
    """A whole number that looks random, from the first 15 hexadecimal digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(salt), number.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def random_descriptions(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n rows (i, description, material_type, ...) drawn from the usual words; row i depends on seed + i only."""
    draw = lambda salt, options: F.element_at(F.array(*map(F.lit, options)), (chance(F.col("id") + seed, salt) % len(options) + 1).cast("int"))
    soil = draw("material", ["soil", "rock"]) == "soil"
    primary = F.when(soil, draw("soil", ["CLAY", "SILT", "SAND", "GRAVEL"]))
    df = spark.range(n).select(
        F.col("id").alias("i"), F.when(soil, "soil").otherwise("rock").alias("material_type"), primary.alias("primary_soil_type"), F.when(is_cohesive(primary), draw("state", vocab.CONSISTENCY[:6])).alias("consistency"), F.when(is_granular(primary), draw("state", vocab.DENSITY)).alias("density"),
        F.when(soil & (draw("part", [0, 1]) == 1), F.array(F.struct(draw("amount", list(vocab.PROPORTION)).alias("amount"), draw("kind", list(vocab.ADJECTIVE.values())).alias("soil_type")))).otherwise(F.array().cast(NO_PARTS)).alias("secondary_constituents"),
        F.when(~soil, draw("strength", vocab.ROCK_STRENGTH)).alias("rock_strength"), F.when(~soil, draw("rock", ["LIMESTONE", "SANDSTONE", "MUDSTONE", "GRANITE"])).alias("primary_rock_type"),
    )
    fields = Fields({c: F.col(c) for c in df.columns})
    return df.withColumn("description", generate(fields)).withColumn("strength", strength(*[F.col(c) for c in ("material_type", "primary_soil_type", "consistency", "density", "rock_strength")]))
