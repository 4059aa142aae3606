"""Uncertainty of boundaries and interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import spatial

# Confidence level from which -> z score.
Z_SCORES = ((0.99, 2.576), (0.95, 1.960), (0.90, 1.645), (0.80, 1.282))
Z_OTHERWISE = 1.645


def z_score(level: float) -> float:
    return next((z for from_, z in Z_SCORES if level >= from_), Z_OTHERWISE)


def contains(lower: Column, upper: Column, value: Column) -> Column:
    return value.between(lower, upper)


def width(lower: Column, upper: Column) -> Column:
    return upper - lower


def boundary(strata: DataFrame, radius: float, level: float = 0.95) -> DataFrame:
    """For every stratum the confidence intervals of its top, bottom and thickness from strata of other boreholes within radius (horizontally),
    weighted by inverse horizontal distance; wide ones where there are none."""
    p = spatial.points(strata)
    # the strata of a borehole at one place have the same neighbours, and weigh the same for them: pairs of such groups are met, with their sums
    keys = ["borehole_id", "px", "py"]
    sums = [f(c).alias(f"{n}_{c[6:]}") for c in ("depth_top", "depth_bottom") for n, f in (("known", F.count), ("mean", F.avg), ("off", F.var_pop))]
    groups = stored(p.groupBy(*keys).agg(F.count("*").alias("n"), *sums), "places")
    near = spatial.within(groups, groups, radius, ("px", "py")).where(F.col("borehole_id") != F.col("b_borehole_id"))
    w = F.when(F.col("distance") < spatial.NEAR, 1000.0).otherwise(1 / F.col("distance"))
    near = stored(near.select(*keys, *[F.col(f"b_{c}").alias(c) for c in groups.columns if c not in keys], "distance", w.alias("w")), "near")
    all_w, of = F.sum(F.col("w") * F.col("n")), lambda c: F.col("w") * F.col(f"known_{c}")
    mean = near.groupBy(*keys).agg(all_w.alias("_w"), *[(F.sum(of(c) * F.col(f"mean_{c}")) / all_w).alias(c) for c in ("top", "bottom")], F.sum("n").alias("_n"), F.min("distance").alias("d"))
    off = lambda c: F.sum(of(c) * (F.col(f"off_{c}") + (F.col(f"mean_{c}") - F.col(c)) * (F.col(f"mean_{c}") - F.col(c))))
    var = near.join(mean.hint(spatial.MERGE), keys).groupBy(*keys).agg(*[(off(c) / F.first("_w")).alias(f"var_{c}") for c in ("top", "bottom")])
    z, s = z_score(level), lambda v: F.sqrt(v) / F.sqrt(F.col("n").cast("double"))
    rows = p.join(mean.join(var.hint(spatial.MERGE), keys).withColumnRenamed("_n", "n").hint(spatial.MERGE), keys, "left")
    alone = F.col("n").isNull()
    out = ["id", F.coalesce("n", F.lit(0)).alias("n_nearby")]
    for name, own, m, v, wide in (("top", F.col("depth_top"), F.col("top"), F.col("var_top"), 2.0), ("bottom", F.col("depth_bottom"), F.col("bottom"), F.col("var_bottom"), 2.0), ("thickness", F.col("thickness"), F.col("bottom") - F.col("top"), F.col("var_top") + F.col("var_bottom"), 1.0)):
        middle, margin = F.when(alone, own).otherwise(m), F.when(alone, wide).otherwise(z * s(v))
        out += [(middle - margin).alias(f"{name}_lower"), (middle + margin).alias(f"{name}_upper"), middle.alias(f"{name}_mean")]
    quality = 0.3 + 0.4 * F.least(F.lit(1.0), F.col("n") / 5) + 0.3 * F.exp(-F.col("d") / 30)
    return rows.select(*out, F.when(alone, 0.2).otherwise(quality).alias("quality"))


def boundary_reliable(quality: Column, threshold: float) -> Column:
    return quality >= threshold


def quality_grade(confidence: Column, nearest: Column) -> Column:
    return F.when((confidence > 0.9) & (nearest < 20), "excellent").when((confidence > 0.7) & (nearest < 50), "good").when(confidence > 0.5, "fair").otherwise("poor")


def interpolation_quality(targets: DataFrame, strata: DataFrame, k: int) -> DataFrame:
    """targets: target_id, px, py, pz. Confidence, nearest distance, neighbours and variance of the soil share among the k nearest; 0, infinite, 0, 0
    without strata."""
    found = spatial.nearest(targets, spatial.points(strata), k, key="target_id")
    per = found.groupBy("target_id").agg(F.min("distance").alias("nearest_distance"), F.count("*").alias("num_neighbours"), F.avg((F.col("b_material_type") == "soil").cast("double")).alias("_p"))
    per = per.withColumn("variance", F.col("_p") * (1 - F.col("_p")))
    steady = F.when(F.col("variance") < 0.1, 0.9).when(F.col("variance") < 0.25, 0.7).otherwise(0.4)
    per = per.withColumn("confidence", F.exp(-F.col("nearest_distance") / 50) * steady).drop("_p")
    return targets.select("target_id").join(per.hint(spatial.MERGE), "target_id", "left").select("target_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("nearest_distance", F.lit(float("inf"))).alias("nearest_distance"), F.coalesce("num_neighbours", F.lit(0)).alias("num_neighbours"), F.coalesce("variance", F.lit(0.0)).alias("variance"))


def is_high_quality(confidence: Column, nearest: Column) -> Column:
    return (confidence > 0.7) & (nearest < 50)


def leave_one_out(strata: DataFrame, k: int) -> DataFrame:
    """One row: how many strata the vote of their k nearest others tells rightly; accuracy null without strata."""
    p = spatial.points(strata)
    guess = spatial.vote(spatial.nearest(p, p, k, unless=F.col("id") == F.col("b_id")), ["id"])
    told = p.select("id", "material_type").join(guess, "id", "left").withColumn("material", F.coalesce("material", F.lit("soil")))
    right = F.count(F.when(F.col("material") == F.col("material_type"), 1))
    return told.agg(F.try_divide(right, F.count("*")).alias("accuracy"), right.alias("correct"), F.count("*").alias("total"))


def is_reliable(accuracy: Column) -> Column:
    return accuracy >= 0.8
