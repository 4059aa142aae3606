"""Units across boreholes: strata that resemble each other are one unit.

Whether two strata are alike depends on six words only (material, type, consistency and density, or strength and weathering), so
the ordered pass that opens or joins units runs over the distinct signatures (1488 at most) in order of first appearance, and the
result is joined back. That equals the pass over all strata: a signature is always like itself, and earlier units stay earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab

THRESHOLD = 0.7
SOIL = ("primary_soil_type", "consistency", "density")
ROCK = ("primary_rock_type", "rock_strength", "weathering_grade")
ORDERED = {"consistency": vocab.CONSISTENCY, "density": vocab.DENSITY, "rock_strength": vocab.ROCK_STRENGTH, "weathering_grade": vocab.WEATHERING}
SIGNATURE = ("material_type", *SOIL, *ROCK)


def similar_rows(a: dict, b: dict) -> bool:
    """The predicate on two signatures."""
    if a["material_type"] != b["material_type"]:
        return False
    score = criteria = 1.0
    for name in SOIL if a["material_type"] == "soil" else ROCK:
        if a[name] is None or b[name] is None:
            continue
        criteria += 1
        if name not in ORDERED:
            score += a[name] == b[name]
        else:
            apart = abs(ORDERED[name].index(a[name]) - ORDERED[name].index(b[name]))
            score += 0.8 if apart <= 1 else 0.4 if apart == 2 else 0.0
    return score / criteria >= THRESHOLD - 1e-6


def similarity(a: Column, b: Column) -> Column:
    """The score of two description structs, 0 for different materials."""

    def step(name: str) -> tuple[Column, Column]:
        both = a[name].isNotNull() & b[name].isNotNull()
        if name not in ORDERED:
            points = (a[name] == b[name]).cast("double")
        else:
            ranks = F.array(*map(F.lit, ORDERED[name]))
            apart = F.abs(F.array_position(ranks, a[name]) - F.array_position(ranks, b[name]))
            points = F.when(apart <= 1, 0.8).when(apart == 2, 0.4).otherwise(0.0)
        return F.when(both, points).otherwise(0.0), both.cast("double")

    def ratio(names: tuple) -> Column:
        steps = [step(n) for n in names]
        return (1 + sum((p for p, _ in steps[1:]), steps[0][0])) / (1 + sum((c for _, c in steps[1:]), steps[0][1]))

    return F.when(a["material_type"] != b["material_type"], 0.0).when(a["material_type"] == "soil", ratio(SOIL)).otherwise(ratio(ROCK))


def similar(a: Column, b: Column) -> Column:
    return similarity(a, b) >= THRESHOLD - 1e-6


def leaders(signatures: list[dict]) -> dict[int, int]:
    """For signatures in order of first appearance: the place of each one's unit leader."""
    heads, out = [], {}
    for i, s in enumerate(signatures):
        out[i] = next((h for h in heads if similar_rows(signatures[h], s)), i)
        if out[i] == i:
            heads.append(i)
    return out


def with_signature(df: DataFrame, d: str) -> DataFrame:
    """Adds _sig: the description's signature as one text."""
    return df.withColumn("_sig", F.concat_ws("|", *[F.coalesce(F.col(d)[n], F.lit("")) for n in SIGNATURE]))


def assign(df: DataFrame, order_by: str, d: str = "d", depth_top: str = "depth_top") -> DataFrame:
    """df with unit_id: 1 for the unit with the least mean depth, and so on; ties by first appearance. order_by: a column that gives the
    strata their order (distinct values)."""
    df = with_signature(df, d)
    seen = df.groupBy("_sig").agg(F.min(order_by).alias("first"), *[F.first(F.col(d)[n]).alias(n) for n in SIGNATURE], F.sum(depth_top).alias("depths"), F.count(depth_top).alias("n")).orderBy("first").collect()  # 1488 rows at most
    head = leaders([r.asDict() for r in seen])
    depths, counts = {}, {}
    for i, r in enumerate(seen):
        depths[head[i]] = depths.get(head[i], 0.0) + (r["depths"] or 0.0)
        counts[head[i]] = counts.get(head[i], 0) + r["n"]
    ranked = {h: k + 1 for k, h in enumerate(sorted(depths, key=lambda h: (depths[h] / max(1, counts[h]), h)))}
    if not seen:
        return df.drop("_sig").withColumn("unit_id", F.lit(None).cast("int"))
    ids = df.sparkSession.createDataFrame([(r["_sig"], ranked[head[i]]) for i, r in enumerate(seen)], "_key string, unit_id int")
    return df.join(F.broadcast(ids), F.col("_sig") == F.col("_key")).drop("_sig", "_key")


def summarise(assigned: DataFrame, order_by: str, d: str = "d", borehole: str = "borehole_id", depth_top: str = "depth_top", depth_bottom: str = "depth_bottom", description: str = "description") -> DataFrame:
    """A row per unit: extents, mean thickness, strata, boreholes (sorted), the first member's text."""
    return assigned.groupBy("unit_id").agg(
        F.min_by(F.col(d)["material_type"], order_by).alias("material_type"), F.min_by(description, order_by).alias("representative"), F.min(depth_top).alias("min_depth_top"), F.max(depth_top).alias("max_depth_top"),
        F.min(depth_bottom).alias("min_depth_bottom"), F.max(depth_bottom).alias("max_depth_bottom"), F.avg(F.col(depth_bottom) - F.col(depth_top)).alias("avg_thickness"), F.count("*").alias("n_strata"),
        F.countDistinct(borehole).alias("n_boreholes"), F.sort_array(F.collect_set(borehole)).alias("boreholes"),
    )


def table(units: DataFrame) -> DataFrame:
    """The summary as lines of text."""
    return units.select("unit_id", F.format_string("Unit %d: %s | %.2f-%.2f m | mean thickness %.2f m | %d strata in %d boreholes | %s", "unit_id", "material_type", "min_depth_top", "max_depth_bottom", "avg_thickness", "n_strata", "n_boreholes", "representative").alias("line"))
