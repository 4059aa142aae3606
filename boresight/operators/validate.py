"""Validation of parsed descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import ascii_lower


def is_cohesive(primary: Column) -> Column:
    return F.coalesce(primary.isin(vocab.COHESIVE), F.lit(False))


def is_granular(primary: Column) -> Column:
    return F.coalesce(primary.isin(vocab.GRANULAR), F.lit(False))


def valid_cohesive(primary: Column, consistency: Column) -> Column:
    return ~is_cohesive(primary) | consistency.isNotNull()


def valid_granular(primary: Column, density: Column) -> Column:
    return ~is_granular(primary) | density.isNotNull()


def suggested_descriptor(primary: Column) -> Column:
    return F.when(is_cohesive(primary), "consistency").when(is_granular(primary), "density")


def rules(d) -> list[tuple[str, Column, bool]]:
    """(warning, condition, whether it invalidates) in the order of emission. d: field name -> Column."""
    soil, cohesive, granular = d("material_type") == "soil", is_cohesive(d("primary_soil_type")), is_granular(d("primary_soil_type"))
    return [
        ("rock_with_soil", (d("material_type") == "rock") & ascii_lower(d("raw_description")).rlike(vocab.SOIL_KEYWORDS), True),
        ("no_consistency", soil & cohesive & d("consistency").isNull(), False),
        ("density_on_cohesive", soil & cohesive & d("density").isNotNull(), True),
        ("no_density", soil & granular & d("density").isNull(), False),
        ("consistency_on_granular", soil & granular & d("consistency").isNotNull(), True),
        ("plasticity_on_granular", soil & granular & d("plasticity_index").isNotNull(), True),
        ("rock_strength_on_soil", soil & d("rock_strength").isNotNull(), True),
    ]


def warnings(d) -> Column:
    return F.array_compact(F.array(*[F.when(on, F.lit(f"[high] {vocab.WARNINGS[name]}")) for name, on, _ in rules(d)]))


def is_valid(d) -> Column:
    bad = F.lit(False)
    for _, on, invalidates in rules(d):
        if invalidates:
            bad |= F.coalesce(on, F.lit(False))
    return ~bad


def confidence(warning_list: Column) -> Column:
    return F.greatest(F.lit(0.1), 1 - 0.15 * F.size(warning_list)).cast("float")


def adjusted(value: Column, exact: Column, fuzzy: Column, warned: Column, threshold: float = 0.0, up: float = 0.1, down: float = 0.1, factor: float = 0.95) -> Column:
    """An adjusted confidence, kept in 0..1: up for exact matches, down for fuzzy ones, scaled by factor where there are warnings; null below
    threshold."""
    out = value + F.when(exact, up).otherwise(0.0) - F.when(fuzzy, down).otherwise(0.0)
    out = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(warned, out * factor).otherwise(out)))
    return F.when(out >= threshold, out)
