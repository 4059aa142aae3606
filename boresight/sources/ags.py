"""AGS4 files: quoted rows tagged GROUP, HEADING, UNIT, TYPE or DATA.

A file's rows depend on the GROUP and HEADING above them. scan() takes each file whole in one task (most files are small; many are many tasks) and yields one row per
DATA row with its fields by heading; all else is columns. checked() takes lines with their places instead, so that one file may be as large as a table: what stands
above a line is counted by sums within parts of a file and over its parts.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..operators import parse
from ..storage import stored

WHITE = " \t\r"
ENHANCED = ("GEOL_MTYP", "GEOL_CONS", "GEOL_DENS", "GEOL_PSOL", "GEOL_PRCK", "GEOL_RSTR", "GEOL_WETH", "GEOL_CONF", "GEOL_WARN")


def fields(line: str) -> list[str]:
    """The fields of a quoted row; two quotes stand for one."""
    return next(csv.reader([line]), [])


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def data_rows(content: str) -> Iterator[tuple[str, dict[str, str], list[str]]]:
    """(group, fields by heading, headings) of every DATA row."""
    group, headings = "", []
    for line in content.split("\n"):
        line = line.strip(WHITE)
        row = fields(line) if line else []
        if not row:
            continue
        if row[0] == "GROUP":
            group, headings = (row[1] if len(row) > 1 else ""), []
        elif row[0] == "HEADING":
            headings = row
        elif row[0] == "DATA":
            found: dict[str, str] = {}
            for name, value in zip(headings, row, strict=False):
                found.setdefault(name, value)
            yield group, found, headings


def scan(files: DataFrame) -> DataFrame:
    """path, seq, grp and fields (map) of every DATA row of files (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(path, i, group, found) for i, (group, found, _) in enumerate(data_rows(content or ""))]
                yield pd.DataFrame(rows, columns=["path", "seq", "grp", "fields"])

    return files.select("path", "content").mapInPandas(run, "path string, seq long, grp string, fields map<string,string>")


def number(field: Column) -> Column:
    """A number; 0 where it is missing or none."""
    return F.coalesce(field.try_cast("double"), F.lit(0.0))


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """proj (the first row of a file), loca and geol (parsed, with its formation) of scanned rows."""
    f = lambda name: F.col("fields")[name]
    text = lambda name: F.coalesce(f(name), F.lit(""))
    proj = rows.where("grp = 'PROJ'").groupBy("path").agg(F.min_by("fields", "seq").alias("fields"))
    proj = proj.select("path", *[text(n).alias(a) for n, a in (("PROJ_ID", "id"), ("PROJ_NAME", "name"), ("PROJ_LOC", "location"), ("PROJ_CLNT", "client"))])
    loca = rows.where("grp = 'LOCA'").select("path", "seq", text("LOCA_ID").alias("id"), *[number(f(n)).alias(a) for n, a in (("LOCA_NATE", "easting"), ("LOCA_NATN", "northing"), ("LOCA_GL", "ground_level"))], text("LOCA_TYPE").alias("hole_type"), number(f("LOCA_FDEP")).alias("final_depth"))
    geol = rows.where("grp = 'GEOL'").select("path", "seq", text("LOCA_ID").alias("location_id"), number(f("GEOL_TOP")).alias("depth_top"), number(f("GEOL_BASE")).alias("depth_base"), text("GEOL_DESC").alias("description"), f("GEOL_LEG").alias("legend_code"), f("GEOL_GEOL").alias("geology_code"), f("GEOL_FORM").alias("_form"))
    geol = parse.parse_distinct(geol)
    # the parsed formation counts only where the file has no such field, not where it is empty
    geol = geol.withColumn("formation", F.when(F.col("_form").isNull(), F.col("d.geological_formation")).otherwise(F.nullif("_form", F.lit("")))).drop("_form")
    return {"proj": proj, "loca": loca, "geol": geol}


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return tables(scan(whole_files(spark, path)))


def inspect(found: dict[str, DataFrame]) -> DataFrame:
    """path, borehole, easting, northing, ground_level, final_depth, n_strata, n_valid."""
    counts = found["geol"].groupBy("path", F.col("location_id").alias("id")).agg(F.count("*").alias("n_strata"), F.sum(F.col("d.is_valid").cast("long")).alias("n_valid"))
    return found["loca"].drop("seq").join(counts, ["path", "id"], "full").withColumn("n_strata", F.coalesce("n_strata", F.lit(0))).withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))


def quoted(*values: Column | str) -> Column:
    cell = lambda v: F.concat(F.lit('"'), F.replace(F.coalesce(v if isinstance(v, Column) else F.lit(v), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(",", *map(cell, values))


def enhanced(found: dict[str, DataFrame]) -> DataFrame:
    """Lines (path, part, seq, line) of the files written again with what was parsed; order by part and seq within a path."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    head = lambda part, *lines: [(part, i, line) for i, line in enumerate(lines)]
    row = lambda *v: ",".join(f'"{x}"' for x in v)
    geol = ("LOCA_ID", "GEOL_TOP", "GEOL_BASE", "GEOL_DESC", "GEOL_LEG", "GEOL_GEOL", "GEOL_FORM")
    fixed = [
        *head(0, row("GROUP", "PROJ"), row("HEADING", "PROJ_ID", "PROJ_NAME", "PROJ_LOC", "PROJ_CLNT"), row("UNIT", *[""] * 4), row("TYPE", "ID", "X", "X", "X")),
        *head(2, "", row("GROUP", "LOCA"), row("HEADING", "LOCA_ID", "LOCA_NATE", "LOCA_NATN", "LOCA_GL", "LOCA_TYPE", "LOCA_FDEP"), row("UNIT", "", "m", "m", "m", "", "m"), row("TYPE", "ID", "2DP", "2DP", "2DP", "PA", "2DP")),
        *head(4, "", row("GROUP", "GEOL"), row("HEADING", *geol, *ENHANCED), row("UNIT", "", "m", "m", *[""] * 13), row("TYPE", "ID", "2DP", "2DP", *["X"] * 11, "2DP", "X")),
    ]
    spark = found["loca"].sparkSession
    paths = found["proj"].select("path").union(found["loca"].select("path")).union(found["geol"].select("path")).distinct()
    frame = paths.crossJoin(F.broadcast(spark.createDataFrame(fixed, "part int, seq long, line string")))  # a dozen lines
    d = lambda n: F.col("d")[n]
    proj = found["proj"].select("path", F.lit(1).alias("part"), F.lit(0).cast("long").alias("seq"), quoted("DATA", *map(F.col, ("id", "name", "location", "client"))).alias("line"))
    loca = found["loca"].select("path", F.lit(3).alias("part"), "seq", quoted("DATA", F.col("id"), two("easting"), two("northing"), two("ground_level"), F.col("hole_type"), two("final_depth")).alias("line"))
    added = (d("material_type"), d("consistency"), d("density"), d("primary_soil_type"), d("primary_rock_type"), d("rock_strength"), d("weathering_grade"), F.format_string("%.2f", d("confidence")), F.array_join(d("warnings"), "; "))
    strata = found["geol"].select("path", F.lit(5).alias("part"), "seq", quoted("DATA", F.col("location_id"), two("depth_top"), two("depth_base"), F.col("description"), F.col("legend_code"), F.col("geology_code"), F.col("formation"), *added).alias("line"))
    return frame.unionByName(proj).unionByName(loca).unionByName(strata)


def write(lines: DataFrame, path: str) -> None:
    """One file's enhanced lines as text, in order. A file is small, so one task writes it."""
    lines.orderBy("part", "seq").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_files(lines: DataFrame, folder: str) -> None:
    """The lines (path, part, seq, line) of every path as one file in folder/path=..., in order: the executors write them, each file by one task and many tasks at a
    time, and Spark commits them together."""
    lines = lines.withColumn("path", F.coalesce("path", F.lit("")))  # Spark would sort a column that may be null once more, by itself alone
    lines.repartition("path").sortWithinPartitions("path", "part", "seq").select("path", "line").write.mode("overwrite").partitionBy("path").text(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, file (its place) and content of what write_files has written."""
    rows = spark.read.text(folder, wholetext=True)
    return rows.select("path", F.input_file_name().alias("file"), F.col("value").alias("content"))


#: Lines of a part of a file whose content is one value.
PART_LINES = 100_000


def lines_of(files: DataFrame, lines: int = PART_LINES) -> DataFrame:
    """path, part, n and line of files (path, content): n is the place within the part, parts are in order."""
    rows = files.select("path", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n", -1)).alias("n", "line"))
    return rows.select("path", F.floor(F.col("n") / lines).alias("part"), F.col("n").cast("long").alias("n"), "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files of any size, which Spark splits: a part is a split, known by where it begins."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))


def so_far(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """rows with the number of rows of each flag up to and with a row, in its file: sums within its part, and over the parts before."""
    rows = rows.select("*", *[flag.cast("long").alias(f"_{name}") for name, flag in flags.items()])
    parts = rows.groupBy("path", "part").agg(*[F.sum(f"_{name}").alias(f"_all_{name}") for name in flags])
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("path", "part", *[F.coalesce(F.sum(f"_all_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in flags])
    within = Window.partitionBy("path", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.select("*", *[F.sum(f"_{name}").over(within).alias(f"_own_{name}") for name in flags]).join(parts, ["path", "part"])
    return counted.select(*[c for c in rows.columns if c[1:] not in flags], *[(F.col(f"_own_{name}") + F.col(f"_before_{name}")).alias(name) for name in flags])


@F.pandas_udf(ArrayType(StringType()))
def split_row(line: pd.Series) -> pd.Series:
    return line.map(lambda x: fields(x) if x else [])


def checked(lines: DataFrame) -> DataFrame:
    """path, is_valid and issues (sorted) of files as lines (path, part, n, line). Every file has a line at least."""
    lines = lines.withColumn("line", F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+\z", ""))
    issue = lambda rows, text: rows.select("path", text.alias("issue"))
    found = [issue(lines.where(F.octet_length("line") != F.length("line")).select("path").distinct(), F.lit("Rule 1: characters beyond ASCII"))]
    every, lines = lines.select("path").distinct(), lines.where("line <> ''")
    found.append(issue(lines.where(~F.col("line").startswith('"')), F.lit("Rule 5/6: a row does not begin with a quote")))
    rows = lines.where(F.col("line").startswith('"')).select("path", "part", "n", split_row("line").alias("row")).withColumn("tag", F.get("row", F.lit(0)))
    rows = so_far(rows.where(F.col("tag").isin("GROUP", "HEADING", "UNIT", "TYPE", "DATA")), {"section": F.col("tag") == "GROUP", "heading": F.col("tag") == "HEADING"})
    rows = stored(rows, "rows")
    has = lambda tag: F.max(F.col("tag") == tag)
    sections = rows.groupBy("path", "section").agg(F.coalesce(F.max(F.when(F.col("tag") == "GROUP", F.coalesce(F.get("row", F.lit(1)), F.lit("")))), F.lit("")).alias("grp"), (has("HEADING") & has("UNIT") & has("TYPE")).alias("whole"), F.sum((F.col("tag") == "DATA").cast("long")).alias("n_data"))
    found.append(issue(sections.where((F.col("grp") != "") & ~F.col("whole")), F.format_string("Rule 2: GROUP %s lacks one of the rows HEADING, UNIT and TYPE", "grp")))
    # a row of LOCA by the heading above it in its own section
    heads = rows.where(F.col("tag") == "HEADING").select("path", "section", "heading", (F.array_position("row", F.lit("LOCA_ID")) - 1).cast("int").alias("place"))
    loca = rows.where(F.col("tag") == "DATA").join(sections.where(F.col("grp") == "LOCA").select("path", "section"), ["path", "section"])
    loca = loca.join(heads, ["path", "section", "heading"], "left").select("path", F.coalesce(F.when(F.col("place") >= 0, F.get("row", F.col("place"))), F.lit("")).alias("id"))
    found.append(issue(loca.where("id = ''"), F.lit("Rule 10: a row of LOCA has no LOCA_ID")))
    twice = loca.where("id <> ''").groupBy("path", "id").agg(F.count("*").alias("m")).where("m > 1")
    found.append(issue(twice.withColumn("k", F.explode(F.sequence(F.lit(2), F.col("m")))), F.format_string("Rule 10: LOCA_ID more than once: '%s'", "id")))
    count = lambda name: F.count(F.when(F.col("grp") == name, 1))
    counts = sections.where("section > 0").groupBy("path").agg(count("PROJ").alias("proj"), count("TRAN").alias("tran"), F.sum(F.when(F.col("grp") == "PROJ", F.col("n_data"))).alias("projects"))
    files = every.join(counts, "path", "left")  # a file without groups has no section
    lacks = F.array_compact(F.array(
        F.when(F.coalesce("proj", F.lit(0)) == 0, F.lit("Rule 13: there is no group PROJ")), F.when(F.coalesce("projects", F.lit(0)) != 1, F.lit("Rule 13: PROJ has no or several rows of data")),
        F.when(F.coalesce("tran", F.lit(0)) == 0, F.lit("Rule 14: there is no group TRAN")),
    ))
    found.append(files.select("path", F.explode(lacks).alias("issue")))
    issues = found[0]
    for more in found[1:]:
        issues = issues.unionByName(more)
    whole = every.join(issues.groupBy("path").agg(F.array_sort(F.collect_list("issue")).alias("issues")), "path", "left")
    return whole.select("path", F.col("issues").isNull().alias("is_valid"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))


def file_issues(content: str) -> Iterator[str]:
    if any(ord(c) > 127 for c in content):
        yield "Rule 1: characters beyond ASCII"
    groups: dict[str, int] = {}
    group, seen, headings, ids, projects = None, set(), [], set(), 0

    def incomplete() -> list[str]:
        return [f"Rule 2: GROUP {group} lacks one of the rows HEADING, UNIT and TYPE"] if group and not {"HEADING", "UNIT", "TYPE"} <= seen else []

    for line in content.split("\n"):
        line = line.strip(WHITE)
        if not line:
            continue
        if not line.startswith('"'):
            yield "Rule 5/6: a row does not begin with a quote"
            continue
        row = fields(line)
        tag = row[0] if row else ""
        if tag == "GROUP":
            yield from incomplete()
            group, seen, headings = (row[1] if len(row) > 1 else ""), set(), []
            groups[group] = groups.get(group, 0) + 1
        elif tag in ("HEADING", "UNIT", "TYPE"):
            seen.add(tag)
            headings = row if tag == "HEADING" else headings
        elif tag == "DATA" and group == "PROJ":
            projects += 1
        elif tag == "DATA" and group == "LOCA":
            name = dict(reversed(list(zip(headings, row, strict=False)))).get("LOCA_ID", "")
            if not name:
                yield "Rule 10: a row of LOCA has no LOCA_ID"
            elif name in ids:
                yield f"Rule 10: LOCA_ID more than once: '{name}'"
            ids.add(name)
    yield from incomplete()
    if "PROJ" not in groups:
        yield "Rule 13: there is no group PROJ"
    if projects != 1:
        yield "Rule 13: PROJ has no or several rows of data"
    if "TRAN" not in groups:
        yield "Rule 14: there is no group TRAN"


def validate(files: DataFrame) -> DataFrame:
    """path, is_valid, issues of files (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [list(file_issues(c or "")) for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "is_valid": [not x for x in found], "issues": found})

    return files.select("path", "content").mapInPandas(run, "path string, is_valid boolean, issues array<string>")
