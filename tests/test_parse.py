import random

import pytest
from pyspark.sql import functions as F

from boresight import vocab
from boresight.functions import text as T
from boresight.operators import anomaly, compliance, enrich, generate, jsonio, parse, spelling, units, validate

from .model import classify, tokens

CASES = [
    ("Firm CLAY", {"material_type": "soil", "consistency": "firm", "primary_soil_type": "CLAY", "confidence": 1.0, "is_valid": True}),
    ("Dense CLAY", {"density": "dense", "confidence": 0.7, "is_valid": False, "n_warnings": 2, "strength": None}),
    ("Strong SANDSTONE", {"material_type": "rock", "primary_rock_type": "SANDSTONE", "confidence": 0.85, "is_valid": False}),
    ("Strong CLAY", {"material_type": "rock", "rock_strength": "strong", "primary_soil_type": None, "is_valid": False}),
    ("Dense brown SAND and GRAVEL", {"primary_soil_type": "SAND", "secondary_primary_soil_type": "GRAVEL", "color": "brown"}),
    ("MADE GROUND: medium dense to dense brown sandy GRAVEL", {"is_made_ground": True, "made_ground_label": "MADE GROUND", "density": "medium dense to dense", "primary_soil_type": "GRAVEL"}),
    ("Soft to firm SAND", {"consistency": "soft to firm", "confidence": 0.7, "is_valid": False}),
    ("High plasticity SAND", {"plasticity_index": "high plasticity", "confidence": 0.7, "is_valid": False}),
    ("Firm ORGANIC CLAY", {"primary_soil_type": "ORGANIC", "strength": None}),
    ("Very soft to soft CLAY", {"consistency": None, "confidence": 0.85, "is_valid": True}),
    ("Filled CLAY", {"made_ground_label": "FILL", "primary_soil_type": "CLAY"}),
    ("Firm CLAY (LONDON (UPPER) CLAY)", {"geological_formation": "LONDON (UPPER) CLAY", "primary_soil_type": "CLAY"}),
    ("Firm CLAY ()", {"geological_formation": None}),
    ("Firm CLAY (made ground)", {"geological_formation": "made ground", "is_made_ground": False}),
    ("weathered LIMESTONE", {"material_type": "rock", "weathering_grade": None, "primary_rock_type": "LIMESTONE"}),
    ("dark grey CLAY", {"color": "dark gray"}),
    ("grey CLAY", {"color": "grey"}),
    ("", {"material_type": "soil", "confidence": 1.0, "primary_soil_type": None}),
    (None, {"material_type": "soil", "raw_description": None}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = parse.parse(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, description string"))
    return {r["i"]: r["d"] for r in df.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_fields(parsed, i):
    d = parsed[i].asDict(True)
    d["n_warnings"] = len(d["warnings"])
    for name, value in CASES[i][1].items():
        assert d[name] == (pytest.approx(value) if isinstance(value, float) else value), name


def test_constituents_and_guidance(spark):
    df = parse.parse(spark.createDataFrame([("Firm to stiff slightly sandy gravelly CLAY",), ("Very SAND",), ("Firn CLAI",)], "description string"))
    a, b, c = [r["d"] for r in df.collect()]
    assert [tuple(x) for x in a["secondary_constituents"]] == [("slightly", "sandy"), ("moderately", "gravelly")]
    assert tuple(a["guidance"]["constituents"][0]) == ("clay", 57, 87, 72)
    assert (a["strength"]["lower"], a["strength"]["upper"]) == (25, 100)
    assert b["primary_soil_type"] is None and [tuple(x) for x in b["secondary_constituents"]] == [("Very", "sandy")] and b["warnings"] == []
    assert [(x["original"], x["corrected"]) for x in c["spelling_corrections"]] == [("Firn", "firm"), ("CLAI", "clay")]


def test_tokens_against_model(spark):
    r = random.Random(5)
    pool = [w for w, _ in vocab.phrases() + vocab.single_words()] + list(vocab.typos()) + ["and", "with", "CLAY,", "sands", "café", "gravelly.", "x" * 70, "Grvel", "sandstoness"]
    texts = [" ".join(r.choice([str.upper, str.title, str.lower])(r.choice(pool)) for _ in range(r.randint(0, 9))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.classified(T.words(F.col("t"))).alias("x"))
    got = {row["i"]: [(x["value"], x["type"], x["corrected_from"]) for x in row["x"]] for row in df.collect()}
    for i, t in enumerate(texts):
        assert got[i] == [classify(k)[:3] for k in tokens(t)], t


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([("Firm CLAY", 1, "x", "y")], "description string, d int, `_parse_fields` string, `a.b` string")
    out = parse.parse(df, out="parsed")
    assert out.columns == [*df.columns, "parsed"] and out.first()["parsed"]["consistency"] == "firm"
    assert parse.parse(df.limit(0)).count() == 0


def test_distinct_path_equals_row_path(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["Firm CLAY", "Firm CLAY", "Dense SAND", None])], "i int, description string")
    a, b = ({r["i"]: r["d"] for r in f(df).collect()} for f in (parse.parse, parse.parse_distinct))
    assert {i: v for i, v in a.items() if i < 3} == {i: v for i, v in b.items() if i < 3}


def test_generators(spark):
    d = parse.parse(spark.createDataFrame([("Firm slightly sandy CLAY",), ("Strong slightly weathered LIMESTONE",), ("Firm",)], "description string"))
    c = F.col("d")
    rows = d.select(generate.generate(c), generate.concise(c), generate.standard(c), generate.with_strength(c), generate.label(c), F.size(generate.variations(c))).collect()
    assert tuple(rows[0]) == ("firm slightly sandy CLAY", "firm CLAY", "firm slightly sandy CLAY", "firm slightly sandy CLAY (cu: 25.0-50.0 kPa)", "CLAY", 4)
    assert tuple(rows[1]) == ("strong slightly weathered weathered LIMESTONE", "strong LIMESTONE", "strong slightly weathered weathered LIMESTONE", "strong slightly weathered weathered LIMESTONE (UCS: 50.0-100.0 MPa)", "LIMESTONE", 5)
    assert tuple(rows[2]) == ("firm", "firm", "firm ", "firm", "Unknown", 0)


def test_generated_texts_parse_back(spark):
    made = generate.random_descriptions(spark, 300, 3).cache()
    back = parse.parse(made.select("i", "description", "primary_soil_type", "primary_rock_type"))
    assert back.where(~F.coalesce("primary_soil_type", F.lit("")).eqNullSafe(F.coalesce("d.primary_soil_type", F.lit("")))).count() == 0
    assert made.exceptAll(generate.random_descriptions(spark, 300, 3)).count() == 0
    shifted = generate.random_descriptions(spark, 299, 4).select((F.col("i") + 1).alias("i"), "description")
    assert shifted.exceptAll(made.select("i", "description")).count() == 0


def test_audits(spark):
    d = parse.parse(spark.createDataFrame([("Dense CLAY",), ("Medium firm CLAY with sand some sandy",), ("Firm CLAY",), ("sandy sandy very clayey silty SAND",)], "description string"))
    rows = d.select(anomaly.detect(F.col("d")).alias("a"), compliance.check(F.col("d")).alias("c"), compliance.report(compliance.check(F.col("d"))).alias("r")).collect()
    assert [x["type"] for x in rows[0]["a"]["anomalies"]] == ["mismatched_strength_descriptor", "missing_strength_descriptor"] and rows[0]["a"]["overall_severity"] == "high"
    assert [x["type"] for x in rows[1]["c"]["issues"]] == ["non_standard_term", "invalid_descriptor_order", "invalid_proportion_term", "deprecated_terminology", "deprecated_terminology"]
    assert rows[2]["a"]["has_anomalies"] is False and rows[2]["a"]["overall_severity"] == "low" and rows[2]["c"]["is_compliant"]
    assert [x["type"] for x in rows[3]["a"]["anomalies"]] == ["missing_strength_descriptor", "unusual_constituent_combination", "excessive_constituents", "duplicate_constituents"]
    assert rows[2]["r"].startswith("✓") and rows[0]["r"].startswith("✗")


def test_lookups(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    assert v(enrich.descriptor("cu", F.lit(25.0))) == "firm" and v(enrich.descriptor("UCS", F.lit(0.5))) == "very weak" and v(enrich.descriptor("SPT-N", F.lit(50.0))) == "very dense"
    assert [v(enrich.proportion(F.lit(x))) for x in (4.0, 5.0, 12.0, 64.0, 65.0)] == [None, "slightly", "moderately", "very", "predominantly"]
    assert v(T.similarity(F.lit(""), F.lit(""))) == 1.0 and v(T.levenshtein(F.lit("café"), F.lit("cafe"))) == 2
    assert v(T.fuzzy_match_ignoring_case(F.lit("SAND"), F.array(F.lit("Sand"), F.lit("sandy")), 0.8))["option"] == "Sand"
    assert v(T.expand_abbreviations(F.lit("med dense SAND"))) == "medium dense SAND"
    assert v(validate.suggested_descriptor(F.lit("SILT"))) == "consistency"


def test_json(spark):
    df = jsonio.from_json(spark.createDataFrame([('{"material_type":"soil","consistency":"FIRM","primary_soil_type":"clay","rock_strength":"strong"}',), ("[1]",), ("{}",), ('{"material_type":"rock","primary_rock_type":"moon"}',)], "json string"))
    a, b, c, d = [r["d"] for r in df.collect()]
    assert a["consistency"] == "firm" and a["primary_soil_type"] == "CLAY" and not a["is_valid"] and "Rock strength" in a["warnings"][0]
    assert b is None and c["material_type"] == "soil" and d["primary_rock_type"] is None


def test_units(spark):
    texts = ["Firm brown CLAY", "Stiff CLAY", "Dense SAND", "Firm to stiff CLAY", "Strong LIMESTONE", "Very dense SAND", "Firm CLAY"]
    df = parse.parse(spark.createDataFrame([(i, f"BH{i % 2}", float(i), i + 1.0, t) for i, t in enumerate(texts)], "i long, borehole_id string, depth_top double, depth_bottom double, description string"))
    rows = df.collect()
    heads, want = [], []
    for r in rows:
        s = {n: r["d"][n] for n in units.SIGNATURE}
        k = next((k for k, h in enumerate(heads) if units.similar_rows(h, s)), len(heads))
        heads += [s] if k == len(heads) else []
        want.append(k)
    assigned = units.assign(df, "i")
    got = {r["i"]: r["unit_id"] for r in assigned.collect()}
    assert len(set(got.values())) == len(heads) and all((got[i] == got[j]) == (want[i] == want[j]) for i in got for j in got)
    assert units.summarise(assigned, "i").agg(F.sum("n_strata")).first()[0] == len(texts)
    assert units.assign(df.limit(0), "i").count() == 0


def test_settings(spark):
    from boresight.operators import config, parse

    with pytest.raises(ValueError, match="fuzzy_threshold"):
        config.ParserConfig(fuzzy_threshold=1.5)
    df = spark.createDataFrame([("spongy caly",), ("Firm boulder-clay",), ("Dense cla",), (None,)], "description string")
    own = config.ParserConfig(terms={"spongy": ("consistency", "soft"), "boulder-clay": ("soil_type", "clay")}, fuzzy=False, warnings=False)
    got = {r["description"]: r for r in config.parsed(df, own).collect()}
    assert got["spongy caly"]["d"]["consistency"] == "soft" and got["spongy caly"]["d"]["primary_soil_type"] == "CLAY"
    assert got["Dense cla"]["d"]["primary_soil_type"] is None and got["Dense cla"]["d"]["warnings"] == [] and got["Dense cla"]["accepted"]
    deep = "Stiff CLAY (" + "(" * 40 + "x" + ")" * 40 + ")"
    assert parse.parse(spark.createDataFrame([(deep,)], "description string")).first()["d"]["geological_formation"] == "(" * 40 + "x" + ")" * 40
    assert parse.parse_distinct(df).where("d is null").count() == 0 and parse.parse_distinct(df).count() == 4


def test_spelling_index_is_the_loop(spark):
    """The index of deletion neighbourhoods gives what comparing with every term gives."""
    r, terms = random.Random(4), [w for w, _ in vocab.single_words()]
    changed = lambda w: "".join(c for c in w if r.random() > 0.1) + r.choice(["", "", "s", "xy"])
    words = sorted({changed(r.choice(terms)) for _ in range(600)} | {r.choice(terms)[:k] for k in range(1, 6)} | {"", "conglomerrateee", "zzz", "sandstonéé", "mudstonemudstonemud"})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    filed = spelling.index(spark.createDataFrame(list(zip(terms, range(len(terms)))), "term string, place int"))
    loop = df.withColumn("m", T.fuzzy_term(F.col("word"))).where("m is not null").select("word", "m.option", "m.score").collect()
    assert sorted(map(tuple, spelling.corrections(df, filed).collect())) == sorted(map(tuple, loop)) and len(loop) > 100


def test_a_text_goes_through_the_parser_once(spark):
    """What is made of a text is made for each distinct one, nulls included, and comes back to all its rows."""
    texts = ["Firm CLAY", "Dense SAND", None, "Firm CLAY", "Firm CLAY", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, description string")

    def make(once):
        assert once.columns == ["description"] and once.count() == 3
        return parse.parse(once).select("description", F.col("d.material_type").alias("m"), F.monotonically_increasing_id().alias("id2"))

    got = parse.once(df, make).collect()
    assert sorted(r["id"] for r in got) == list(range(6)) and len({r["id2"] for r in got}) == 3
