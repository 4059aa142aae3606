"""CSV and text tables in, result columns out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jsonio, parse, units

PLAIN = ("material_type", "consistency", "density", "primary_soil_type", "primary_rock_type", "rock_strength", "weathering_grade", "color", "moisture_content")


@dataclass(frozen=True)
class CsvOptions:
    header: bool = True
    #: Names of the columns, where the first line of a file (without a header) may be too short to tell how many there are.
    columns: tuple[str, ...] = ()
    separator: str = ","
    column: str | int = "description"
    results: tuple[str, ...] = ("material_type", "consistency", "primary_soil_type", "confidence", "is_valid")
    borehole: str | int = "borehole_id"
    depth_top: str | int = "depth_top"
    depth_bottom: str | int = "depth_bottom"


def read_csv(spark: SparkSession, path: str, options: CsvOptions = CsvOptions()) -> DataFrame:  # noqa: B008
    """All columns as trimmed texts; short rows are kept with nulls."""
    how = {"header": options.header, "sep": options.separator, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "multiLine": False, "mode": "PERMISSIVE"}
    names = list(options.columns) or spark.read.csv(path, inferSchema=False, **how).columns
    # Spark reads empty cells as nulls: only those that a short row lacks stay so
    bad = "_bad"
    while bad in names:
        bad = f"_{bad}"
    rows = spark.read.option("columnPruning", "false").csv(path, schema=", ".join(f"`{c}` string" for c in [*names, bad]), columnNameOfCorruptRecord=bad, **how)
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.when(F.col(bad).isNull(), "")), r"^[ \t]+|[ \t]+$", "")
    return rows.select(*[cell(c).alias(c) for c in names])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """description: the trimmed lines of text files, blank ones left out."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("description")).where("description <> ''")


def resolved(df: DataFrame, column: str | int) -> str:
    """A column by name (the last of equal names) or by place from 0."""
    if isinstance(column, int) or (column not in df.columns and str(column).isdigit()):
        place = int(column)
        if place < len(df.columns):
            return df.columns[place]
    elif column in df.columns:
        return [c for c in df.columns if c == column][-1]
    raise ValueError(f"no column {column!r} in {df.columns}")


def short(value: Column) -> Column:
    """A float as its shortest text: 37, 12.5, 0.6."""
    return F.regexp_replace(value.cast("float").cast("string"), r"\.0$", "")


def result(name: str, d: Column) -> Column:
    """The text of a result column; an unknown name is empty."""
    s = d["strength"]
    known = {n: d[n] for n in PLAIN} | {
        "confidence": F.format_string("%.3f", d["confidence"]), "is_valid": d["is_valid"].cast("string"), "strength_lower": short(s["lower"]), "strength_upper": short(s["upper"]), "strength_typical": short(s["typical"]), "strength_unit": s["units"], "json": jsonio.compact(d),
    }
    return F.coalesce(known.get(name, F.lit("")), F.lit(""))


def with_results(df: DataFrame, options: CsvOptions = CsvOptions()) -> DataFrame:  # noqa: B008
    """df and its result columns; rows without the description column are dropped."""
    name = resolved(df, options.column)
    own = df.columns
    made = parse.free_prefix(own) + "results"
    results = F.struct(*[result(n, F.col("_d")).alias(f"_{k}") for k, n in enumerate(options.results)]) if options.results else F.lit(None)
    rows = parse.once(df.where(F.col(f"`{name}`").isNotNull()), lambda texts: parse.parse(texts, name, "_d").select(f"`{name}`", results.alias(made)), name)
    return rows.select(*[F.col(f"`{c}`") for c in own], *[F.col(made)[f"_{k}"].alias(n) for k, n in enumerate(options.results)])


def with_units(df: DataFrame, order_by: str, options: CsvOptions = CsvOptions()) -> DataFrame:  # noqa: B008
    """df with unit_id: rows whose depths are no numbers are dropped. order_by: a column that numbers the rows."""
    name, top, bottom = (resolved(df, c) for c in (options.column, options.depth_top, options.depth_bottom))
    rows = df.withColumn("_top", F.col(f"`{top}`").try_cast("double")).withColumn("_bottom", F.col(f"`{bottom}`").try_cast("double")).where("_top is not null and _bottom is not null")
    done = units.assign(parse.parse_distinct(rows.where(F.col(f"`{name}`").isNotNull()), name, "_d"), order_by, "_d", "_top")
    return done.select(*[F.col(f"`{c}`") for c in df.columns], "unit_id")


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated with a header; quoted where needed; nulls empty."""
    df.write.mode("overwrite").csv(path, header=True, sep=",", quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
