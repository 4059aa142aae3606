"""Registered queries of sources, sinks, texts and settings. Those that need files write them to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as T
from ..operators import compliance, config, generate, jsonio, parse, spatial, uncertainty, units, validate
from ..sources import ags, csvio, svg, xlsx
from ..storage import shared_dir
from . import queries as core
from .strata import strata

#: JSON descriptions by name, some of them no descriptions at all. What they mean is in the oracle.
JSON_ITEMS = [
    '{"raw_description": "a", "material_type": "soil", "primary_soil_type": "CLAY", "consistency": "firm", "rock_strength": "strong"}',
    '{"raw_description": "b", "material_type": "rock", "primary_rock_type": "granite", "rock_strength": "Very Strong", "weathering_grade": "fresh"}',
    '{"raw_description": "c", "primary_soil_type": "sand", "density": "dense", "secondary_constituents": [{"amount": "slightly", "soil_type": "silty"}], "unheard": 1}',
    '{"raw_description": "d", "material_type": "mud", "primary_soil_type": "mud", "consistency": "runny"}',
    '{"raw_description": "e", "primary_soil_type": "GRAVEL", "consistency": "soft", "plasticity_index": "high plasticity", "is_made_ground": true}',
    '"no object"', "7", '{"raw_description": "f", "primary_soil_type": "SILT", "consistency": "stiff", "density": "loose"}',
]
#: AGS files by name, each but the first with something wrong. Which rules that breaks is in the oracle.
HEAD = {
    "PROJ": '"GROUP","PROJ"\n"HEADING","PROJ_ID"\n"UNIT",""\n"TYPE","ID"\n"DATA","P1"\n', "TRAN": '"GROUP","TRAN"\n"HEADING","TRAN_ISNO"\n"UNIT",""\n"TYPE","X"\n"DATA","1"\n',
    "LOCA": '"GROUP","LOCA"\n"HEADING","LOCA_ID"\n"UNIT",""\n"TYPE","ID"\n"DATA","BH1"\n',
}
SOUND = "".join(HEAD.values())
AGS_FILES = {
    "sound": SOUND, "accent": SOUND + '"DATA","Bé"\n', "no_type": SOUND.replace('"TYPE","X"\n', ""), "loose": SOUND + "DATA,BH2\n", "no_id": SOUND + '"DATA",""\n', "twice": SOUND + '"DATA","BH1"\n',
    "no_project": HEAD["TRAN"] + HEAD["LOCA"], "two_projects": SOUND.replace('"DATA","P1"\n', '"DATA","P1"\n"DATA","P2"\n'), "no_tran": HEAD["PROJ"] + HEAD["LOCA"], "empty": "",
}


def written(rows: DataFrame, tag: str) -> str:
    """The path of text files with the lines of rows (one column)."""
    path = shared_dir(rows.sparkSession, tag)
    rows.write.text(path)
    return path


def terminology(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("med dense SAND, sl. silty; v. stiff; colour: "), F.col("description"))
    return strata(spark, sf).select("stratum_id", T.expand_abbreviations(text).alias("expanded"), T.american_colour(text).alias("american"))


def validity_helpers(spark, sf):
    d = core.D()
    rows = core.parsed(spark, sf).withColumn("fixed", F.size(d["spelling_corrections"]) > 0).withColumn("warned", F.size(d["warnings"]) > 0)
    adjusted = validate.adjusted(d["confidence"].cast("double"), ~F.col("fixed"), F.col("fixed"), F.col("warned"), 0.8)
    return rows.select("stratum_id", validate.valid_cohesive(d["primary_soil_type"], d["consistency"]).alias("cohesive_ok"), validate.valid_granular(d["primary_soil_type"], d["density"]).alias("granular_ok"), validate.suggested_descriptor(d["primary_soil_type"]).alias("suggested"), F.round(adjusted, 4).alias("adjusted"))


def fuzzy_words(spark, sf):
    rows = core.distinct_words(spark, sf).withColumn("m", T.fuzzy_match(F.col("word"), core.terms(), 0.6)).withColumn("n", T.fuzzy_match_ignoring_case(F.upper("word"), core.terms(), 0.6))
    return rows.select("word", "m.option", F.round("m.score", 6).alias("score"), F.col("n.option").alias("folded"), F.round("n.score", 6).alias("folded_score"))


def boundary_levels(spark, sf):
    out = None
    for level in (0.995, 0.95, 0.9, 0.8, 0.5):
        rows = uncertainty.boundary(core.located(spark, sf), 13.0, level).select(F.lit(level).alias("level"), "id", *core.r6("top_lower", "top_upper", "bottom_lower"))
        out = rows if out is None else out.unionByName(rows)
    return out


def boundary_grades(spark, sf):
    rows = core.boundary_uncertainty(spark, sf)
    low, high = F.col("top_lower"), F.col("top_upper")
    return rows.select("id", F.round(uncertainty.width(low, high), 5).alias("width"), uncertainty.contains(low, high, F.col("top_mean") + 1).alias("holds"), uncertainty.boundary_reliable(F.col("quality"), 0.5).alias("reliable"))


def interpolation_grades(spark, sf):
    rows = core.interpolation_quality(spark, sf)
    c, d = F.col("confidence"), F.col("nearest_distance")
    return rows.select("target_id", uncertainty.quality_grade(c, d).alias("grade"), uncertainty.is_high_quality(c, d).alias("high"), uncertainty.is_reliable(c * 1.2).alias("reliable"))


def borehole_registry(spark, sf):
    rows = strata(spark, sf)
    holes = rows.select("borehole_id", (F.col("x") + F.col("stratum_id") % 3).alias("x"), "y", (F.col("z") - F.col("stratum_id") % 5).alias("z"), "stratum_id").where("stratum_id % 4 <> 1")
    return spatial.located(rows.select("stratum_id", "borehole_id", "depth_top"), holes, "stratum_id")


def kriging(spark, sf):
    return spatial.interpolate(core.targets(spark, sf), core.with_material(spark, sf), "kriging").select("target_id", "material")


def unit_lines(spark, sf):
    return units.table(units.summarise(units.assign(core.parsed(spark, sf), "stratum_id"), "stratum_id"))


def compliance_reports(spark, sf):
    return core.described(spark, sf, compliance.report(compliance.check(core.D())).alias("report"))


def summary_lines(spark, sf):
    return core.described(spark, sf, jsonio.summary(core.D()).alias("line"))


def json_files(spark, sf):
    whole = spark.range(1).select(F.lit("[" + ", ".join(JSON_ITEMS) + "]").alias("value"))
    one = spark.range(1).select(F.lit(JSON_ITEMS[0].replace('"a"', '"alone"')).alias("value"))
    rows = jsonio.read_json(spark, written(whole, "json")).unionByName(jsonio.read_json(spark, written(one, "json")))
    d = core.D()
    return rows.select(*[d[n].alias(n) for n in ("raw_description", "material_type", "primary_soil_type", "primary_rock_type", "consistency", "density", "rock_strength", "is_made_ground", "is_valid")], F.size(d["warnings"]).alias("n_warnings"), F.size(d["secondary_constituents"]).alias("n_parts"), d["strength"]["typical"].cast("double").alias("typical"))


def line_files(spark, sf):
    rows = strata(spark, sf).select(F.concat(F.lit("  "), F.col("description"), F.lit(" ")).alias("value"))
    return parse.parse(csvio.read_lines(spark, written(rows, "lines"))).groupBy("description", F.col("d.material_type").alias("material_type")).agg(F.count("*").alias("n"))


def csv_files(spark, sf):
    """Quoted cells, empty ones, and rows that end too soon, parted by semicolons."""
    quoted = F.concat(F.lit('" '), F.replace("description", F.lit('"'), F.lit('""')), F.lit(' "'))
    whole = F.concat_ws(";", F.col("stratum_id").cast("string"), F.lit('"a ""note"""'), quoted, F.col("depth_top").cast("string"))
    rows = strata(spark, sf).select(F.when(F.col("stratum_id") % 7 == 0, F.concat_ws(";", F.col("stratum_id").cast("string"), F.lit("short"))).otherwise(whole).alias("value"))
    options = csvio.CsvOptions(header=False, columns=("_c0", "_c1", "_c2", "_c3"), separator=";", column=2, results=("material_type", "consistency", "is_valid", "unheard"))
    done = csvio.with_results(csvio.read_csv(spark, written(rows, "csv"), options), options)
    return done.select(F.col("_c0").cast("long").alias("stratum_id"), F.col("_c1").alias("note"), F.col("_c2").alias("description"), F.col("_c3").alias("depth"), "material_type", "consistency", "is_valid", "unheard")


def csv_written(spark, sf):
    """The CSV sink read by Spark's own reader."""
    path = shared_dir(spark, "csv")
    csvio.write_csv(core.csv_results(spark, sf), path)
    back = spark.read.csv(path, header=True, quote='"', escape='"')
    return back.select(F.col("stratum_id").cast("long").alias("stratum_id"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in back.columns[1:]])


def csv_units(spark, sf):
    rows = strata(spark, sf).withColumn("depth_top", F.when(F.col("stratum_id") % 11 == 0, "n/a").otherwise(F.col("depth_top").cast("string")))
    return csvio.with_units(rows.select("stratum_id", "description", "depth_top", F.col("depth_bottom").cast("string").alias("depth_bottom")), "stratum_id").select("stratum_id", "unit_id")


def xlsx_files(spark, sf):
    """The XLSX sink and source; cells of numbers and of texts."""
    path = shared_dir(spark, "xlsx")
    books = xlsx.write_workbooks(strata(spark, sf).select("stratum_id", "description", "depth_top"), path, "stratum_id", "Lithology", freeze=True, auto_filter=True)
    back = xlsx.read_xlsx(spark, path, "Lithology").withColumn("name", F.element_at(F.split("_path", "/"), -1)).join(F.broadcast(books), "name")  # a row for each workbook
    return back.select((F.col("start") + F.col("_row")).alias("row"), F.col("stratum_id").cast("long").alias("stratum_id"), F.coalesce("description", F.lit("")).alias("description"), F.col("depth_top").cast("double").alias("depth_top"))


def ags_rules(spark, sf):
    files = spark.createDataFrame(list(AGS_FILES.items()), "path string, content string")  # a few
    return ags.validate(files).select("path", "is_valid", F.array_join(F.array_sort("issues"), "; ").alias("issues"))


def broken_files(spark, sf) -> DataFrame:
    """The AGS files of the strata, by the number of their site each with something else wrong (0: nothing)."""
    content, kind = F.col("content"), F.substring("path", 5, 9)
    site = F.regexp_extract(kind, "[0-9]+", 0).cast("int") % 10
    before_geol = lambda rows: F.replace(content, F.lit('\n\n"GROUP","GEOL"'), F.lit(f'\n{rows}\n\n"GROUP","GEOL"'))
    renamed = lambda group: F.replace(content, F.lit(f'"GROUP","{group}"'), F.lit('"GROUP","OTHR"'))
    changed = F.when(site == 1, F.concat(content, F.lit('\n"DATA","Bé"'))).when(site == 2, F.replace(content, F.lit('"TYPE","X"\n"DATA","1"'), F.lit('"DATA","1"')))
    changed = changed.when(site == 3, F.concat(content, F.lit("\nDATA,BH2\nmore"))).when(site == 4, before_geol('"DATA",""')).when(site == 5, before_geol('"DATA","TWIN"\n"DATA","TWIN"\n"DATA","TWIN"'))
    changed = changed.when(site == 6, renamed("PROJ")).when(site == 7, F.replace(content, F.lit('"DATA","P1","Synthetic"'), F.lit('"DATA","P1","Synthetic"\n"DATA","P2","Other"'))).when(site == 8, renamed("TRAN")).when(site == 9, F.lit(""))
    return core.ags_files(spark, sf).select("path", changed.otherwise(content).alias("content"))


def ags_lines(spark, sf):
    """The rules over lines, each file in parts of 7 lines."""
    return ags.checked(ags.lines_of(broken_files(spark, sf), 7)).select("path", "is_valid", F.array_join("issues", "; ").alias("issues"))


def hatches(spark, sf):
    return core.described(spark, sf, svg.hatch(core.D()).alias("hatch"))


def svg_facts(spark, sf):
    """What the strip logs show: strata, their hatches from the top, heights, strengths and warnings."""
    found = lambda pattern: F.regexp_extract_all("svg", F.lit(pattern), F.lit(1))
    rows = core.svg_logs(spark, sf)
    return rows.select("borehole_id", F.size(found(r"(url)\(#")).alias("n_strata"), F.array_join(found(r"url\(#([a-z-]+)\)"), ",").alias("hatches"), F.regexp_extract("svg", r'<svg [^>]*height="(\d+)"', 1).cast("long").alias("height"), F.size(found("(<title>)")).alias("n_warned"), F.array_join(found(r">((?:cu|SPT-N|UCS): [^<]*)<"), ",").alias("strengths"))


def first_boreholes(spark, sf):
    """The first borehole of each file, of the table of boreholes or, without one, of strata."""
    found = ags.tables(ags.scan(core.ags_files(spark, sf)))
    return svg.first_boreholes(found["loca"], found["geol"])


def ags_written(spark, sf):
    """The enhanced files, written by the executors and read back: path, k (the line's number) and line."""
    folder = shared_dir(spark, "ags")
    ags.write_files(core.ags_enhance(spark, sf), folder)
    lines = F.split(F.regexp_replace("content", "\n\\z", ""), "\n", -1)
    return ags.read_files(spark, folder).select("path", F.posexplode(lines).alias("k", "line"))


def svg_written(spark, sf):
    """The pictures of the strip logs, written by the executors and read back: a file for each borehole, and its frame."""
    folder = shared_dir(spark, "svg")
    svg.write_logs(core.svg_logs(spark, sf), folder)
    rows = spark.read.text(folder, wholetext=True)
    found = rows.groupBy("borehole_id").agg(F.count("*").alias("n_files"), F.max("value").alias("svg"))
    return found.select("borehole_id", "n_files", F.regexp_count("svg", F.lit("<svg")).cast("long").alias("n_frames"), F.regexp_extract("svg", r'<svg[^>]* height="(\d+)', 1).cast("long").alias("height"))


def configured(spark, sf):
    """Words of one's own, a stricter threshold, strict compliance."""
    settings = config.ParserConfig(min_confidence=0.8, fuzzy_threshold=0.9, strict=True, max_warnings=1, terms={"spongy": ("consistency", "soft"), "roots": "soil_type"})
    d = core.D()
    rows = parse.once(strata(spark, sf), lambda texts: config.parsed(texts, settings))
    return rows.select("stratum_id", d["consistency"].alias("consistency"), d["primary_soil_type"].alias("primary_soil_type"), F.size(d["spelling_corrections"]).alias("n_fixed"), F.size(d["warnings"]).alias("n_warnings"), d["is_valid"].alias("is_valid"), F.round("adjusted", 4).alias("adjusted"), "accepted")


def parse_distinct(spark, sf):
    names = [n for n in parse.FIELDS if n not in ("raw_description", "secondary_constituents", "strength", "guidance", "structure", "warnings", "spelling_corrections", "confidence")]
    rows = parse.parse_distinct(strata(spark, sf))
    return rows.select("stratum_id", *[core.D()[n].alias(n) for n in names], F.round(core.D()["confidence"].cast("double"), 4).alias("confidence"))


def from_properties(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))
    soil = generate.from_properties(material_type=F.lit("soil"), consistency=pick(vocab.CONSISTENCY), primary_soil_type=pick(["CLAY", "SILT"]), secondary_constituents=F.array(F.struct(pick(["slightly", "very"]).alias("amount"), F.lit("sandy").alias("soil_type"))))
    rock = generate.from_properties(material_type=F.lit("rock"), rock_strength=pick(vocab.ROCK_STRENGTH), weathering_grade=pick(vocab.WEATHERING), primary_rock_type=F.lit("CHALK"))
    return part.select(F.col("p_partkey").alias("part"), soil.alias("soil"), rock.alias("rock"))


QUERIES = {
    f.__name__: f
    for f in (
        terminology, validity_helpers, fuzzy_words, boundary_levels, boundary_grades, interpolation_grades, borehole_registry, kriging, unit_lines, compliance_reports, summary_lines, json_files, line_files, csv_files, csv_written,
        csv_units, xlsx_files, ags_rules, ags_lines, hatches, svg_facts, first_boreholes, ags_written, svg_written, configured, parse_distinct, from_properties,
    )
}
