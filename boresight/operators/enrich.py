"""Look-ups of strength and proportion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab

STRENGTH_TYPE = "struct<type:string,units:string,lower:float,upper:float,typical:float,confidence:float>"


def lookup(kind: str, word: Column) -> Column:
    """The strength struct of a word, or null."""
    table, units, confidence = vocab.STRENGTH[kind]
    rows = F.create_map(*[x for w, (lo, hi, mid) in table.items() for x in (F.lit(w), F.struct(F.lit(kind).alias("type"), F.lit(units).alias("units"), F.lit(lo).cast("float").alias("lower"), F.lit(hi).cast("float").alias("upper"), F.lit(mid).cast("float").alias("typical"), F.lit(confidence).cast("float").alias("confidence")))])
    return F.try_element_at(rows, word)


def strength(material: Column, primary: Column, consistency: Column, density: Column, rock_strength: Column) -> Column:
    soil = material == "soil"
    return F.when(soil & primary.isin(vocab.COHESIVE), lookup("cu", consistency)).when(soil & primary.isin(vocab.GRANULAR), lookup("SPT-N", density)).when(material == "rock", lookup("UCS", rock_strength))


def midpoint(lower: Column, upper: Column) -> Column:
    return (lower + upper) / 2


def within(value: Column, lower: Column, upper: Column) -> Column:
    return value.between(lower, upper)


def descriptor(kind: str, value: Column) -> Column:
    """The word for a measured value; limits belong to the higher word."""
    limits, names = vocab.INVERSE[kind]
    out = F.when(value < limits[0], names[0])
    for limit, name in zip(limits[1:], names[1:-1], strict=True):
        out = out.when(value < limit, name)
    return F.when(value.isNotNull(), out.otherwise(names[-1]))


def proportion(percent: Column) -> Column:
    limits, names = vocab.PROPORTION_LIMITS
    out = F.when(percent < limits[0], F.lit(names[0]).cast("string"))
    for limit, name in zip(limits[1:], names[1:-1], strict=True):
        out = out.when(percent < limit, name)
    return F.when(percent.isNotNull(), out.otherwise(names[-1]))


def guidance(primary: Column, secondary: Column) -> Column:
    """Likely shares of the constituents: struct<constituents, confidence>; null where nothing resolves. An amount counts only as written
    in lower case, and bounds may cross when several constituents are large."""
    shares = F.create_map(*[x for w, (lo, hi, mid) in vocab.PROPORTION.items() for x in (F.lit(w), F.array(F.lit(float(lo)), F.lit(float(hi)), F.lit(float(mid))))])

    def row(name: Column, lower: Column, upper: Column, typical: Column) -> Column:
        return F.struct(name.alias("soil_type"), lower.cast("float").alias("lower"), upper.cast("float").alias("upper"), typical.cast("float").alias("typical"))

    known = F.filter(secondary, lambda s: F.try_element_at(shares, s["amount"]).isNotNull())
    at = lambda s, k: F.element_at(F.try_element_at(shares, s["amount"]), k)
    parts = F.transform(known, lambda s: row(s["soil_type"], at(s, 1), at(s, 2), at(s, 3)))
    rest = F.aggregate(known, F.lit(100.0), lambda left, s: left - at(s, 3))
    main = row(F.lower(primary), F.greatest(F.lit(35.0), rest - 15), F.least(F.lit(95.0), rest + 15), F.greatest(F.lit(35.0), rest))
    whole = F.when(primary.isNotNull(), F.concat(F.array(main), parts)).otherwise(parts)
    n = F.size(secondary)
    confidence = F.when(n == 0, 0.9).when(n == 1, 0.8).when(n == 2, 0.7).otherwise(0.6).cast("float")
    return F.when(F.size(whole) > 0, F.struct(whole.alias("constituents"), confidence.alias("confidence")))
