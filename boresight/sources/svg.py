"""Strip logs: one SVG text per borehole."""

from __future__ import annotations

from dataclasses import dataclass
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SvgConfig:
    title: str = "STRIP LOG"
    scale: float = 50.0  # px per metre
    width: float = 700.0
    header: float = 80.0
    depth_width: float = 60.0
    legend_width: float = 80.0
    text_width: float = 360.0
    least_height: float = 24.0
    line_chars: int = 42
    show_confidence: bool = True
    show_warnings: bool = True
    show_strength: bool = True


# Hatch -> (fill, strokes of a 12 x 12 tile).
HATCHES = {
    "default": ("#ffffff", ""), "clay": ("#ececec", "M0 6H12"), "silt": ("#f2f2f2", "M0 3H5M7 9H12"), "sand": ("#fdfbf2", "M3 3h.1M9 6h.1M5 10h.1"), "gravel": ("#f8f8f8", "M2 4a2 2 0 1 0 4 0a2 2 0 1 0-4 0"),
    "sand-gravel": ("#faf8f0", "M2 4a2 2 0 1 0 4 0a2 2 0 1 0-4 0M9 9h.1"), "peat": ("#efe9e2", "M0 6Q3 2 6 6T12 6"), "made-ground": ("#f4f1f4", "M2 10L6 3L10 10Z"), "rock": ("#f0f3f6", "M0 12L6 4L12 12"),
}
CONFIDENCE = ((0.85, "#4caf50"), (0.6, "#ffb300"), (-1.0, "#e53935"))


def hatch(d: Column) -> Column:
    """The hatch of a description: made ground, then sand with gravel, then the soil, then rock."""
    a, b = d["primary_soil_type"], d["secondary_primary_soil_type"]
    soil = F.when(a.isin("SAND", "GRAVEL") & b.isin("SAND", "GRAVEL") & (a != b), "sand-gravel").when(a.isin("COBBLES", "BOULDERS"), "gravel").when(a == "ORGANIC", "peat").when(a.isNotNull(), F.lower(a))
    return F.when(d["is_made_ground"], "made-ground").when(d["material_type"] == "rock", "rock").otherwise(F.coalesce(soil, F.lit("default")))


def wrapped(text: str, width: int) -> list[str]:
    lines, line = [], ""
    for word in text.split():
        if line and len(line) + 1 + len(word) > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return [*lines, line] if line else lines


def drawn(strata: pd.DataFrame, name: str, c: SvgConfig) -> str:
    """The log of one borehole; strata in order of depth."""
    strata = strata.sort_values("depth_top", kind="stable")
    body = strata["depth_base"].max() * c.scale + 20
    top, legend = c.header + 30, 20 + c.depth_width
    text, right = legend + c.legend_width, legend + c.legend_width + c.text_width
    label = lambda x, y, size, s, more="": f'<text x="{x:.1f}" y="{y:.1f}" font-family="sans-serif" font-size="{size}"{more}>{s}</text>'
    tiles = "".join(f'<pattern id="{k}" width="12" height="12" patternUnits="userSpaceOnUse"><rect width="12" height="12" fill="{fill}"/><path d="{path}" fill="none" stroke="#555"/></pattern>' for k, (fill, path) in HATCHES.items())
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{c.width:.0f}" height="{c.header + 45 + body:.0f}"><defs>{tiles}</defs>', label(20, 22, 14, escape(c.title)), label(20, 42, 16, "BOREHOLE: " + escape(name))]
    first = strata.iloc[0]
    if pd.notna(first.get("easting")):
        out.append(label(20, 64, 11, escape(f"E{first.easting:.2f} N{first.northing:.2f} | GL {first.ground_level:.2f} m | {first.hole_type} | depth {first.final_depth:.2f} m")))
    out.append(f'<rect x="20" y="{top:.0f}" width="{c.width - 40:.0f}" height="{body:.0f}" fill="none" stroke="#000"/>')
    out += [label(x, top - 8, 11, s, ' font-weight="bold"') for x, s in ((20, "Depth"), (legend, "Legend"), (text, "Description"), (right, "Strength"))]
    for s in strata.itertuples():
        y, height = top + s.depth_top * c.scale, max(c.least_height, (s.depth_base - s.depth_top) * c.scale)
        out += [f'<rect x="{legend:.0f}" y="{y:.1f}" width="{c.legend_width:.0f}" height="{height:.1f}" fill="url(#{s.hatch})" stroke="#444"/>', label(26, y + 12, 10, f"{s.depth_top:.2f}"), label(26, y + height - 4, 10, f"{s.depth_base:.2f}")]
        said = s.description + (f" ({s.formation})" if s.formation else "")
        out += [label(text + 8, y + 12 + 12 * k, 10, escape(line)) for k, line in enumerate(wrapped(said, c.line_chars))]
        if c.show_confidence:
            colour = next(colour for above, colour in CONFIDENCE if round(s.confidence, 4) > above)
            out.append(f'<rect x="{text:.0f}" y="{y:.1f}" width="4" height="{height:.1f}" fill="{colour}"/>')
        if c.show_warnings and s.warnings:
            out.append(label(right - 14, y + 12, 11, f"⚠<title>{escape(s.warnings)}</title>"))
        if c.show_strength and s.strength:
            out.append(label(right + 6, y + 12, 9, escape(s.strength)))
    return "\n".join([*out, "</svg>"])


def logs(geol: DataFrame, loca: DataFrame | None = None, config: SvgConfig = SvgConfig()) -> DataFrame:  # noqa: B008
    """borehole_id and svg. geol: location_id, depth_top, depth_base, description, formation, d; loca: id and place of boreholes, the
    first of several rows counts. A borehole's strata are one task's, as they make one picture."""
    s = F.col("d.strength")
    rows = geol.select(F.col("location_id").alias("borehole_id"), "depth_top", "depth_base", "description", "formation", hatch(F.col("d")).alias("hatch"), F.col("d.confidence").cast("double").alias("confidence"), F.array_join("d.warnings", "; ").alias("warnings"), F.when(s.isNotNull(), F.format_string("%s: %.1f-%.1f %s", s["type"], s["lower"], s["upper"], s["units"])).alias("strength"))
    if loca is not None:
        names = ("easting", "northing", "ground_level", "hole_type", "final_depth")
        first = loca.groupBy(F.col("id").alias("borehole_id")).agg(F.min_by(F.struct(*names), "seq").alias("place"))
        rows = rows.join(first, "borehole_id", "left").select(*rows.columns, "place.*")
    return rows.groupBy("borehole_id").applyInPandas(lambda frame: pd.DataFrame({"borehole_id": frame["borehole_id"].iloc[:1], "svg": [drawn(frame, frame["borehole_id"].iloc[0], config)]}), "borehole_id string, svg string")


def write_logs(pictures: DataFrame, folder: str) -> None:
    """The picture of every borehole as one file in folder/borehole_id=..., written by the executors."""
    pictures.select("borehole_id", F.col("svg").alias("value")).repartition("borehole_id").write.mode("overwrite").partitionBy("borehole_id").text(folder)


def first_boreholes(loca: DataFrame, geol: DataFrame) -> DataFrame:
    """path, of_loca and of_geol: the first borehole of each file in the order of its rows, by either table; null where a table has no row of it."""
    first = lambda rows, c, name: rows.groupBy("path").agg(F.min_by(c, "seq").alias(name))
    return first(loca, "id", "of_loca").join(first(geol, "location_id", "of_geol"), "path", "full")


def first_borehole(loca: DataFrame, geol: DataFrame) -> str | None:
    """The first borehole in file order: of LOCA, else of GEOL."""
    row = loca.orderBy("seq").select("id").first() or geol.orderBy("seq").select("location_id").first()
    return row[0] if row else None
