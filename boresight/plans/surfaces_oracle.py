"""DuckDB SQL for the queries of surfaces, written from the rules and from what each made-up input says."""

from __future__ import annotations

from .. import vocab
from . import oracle
from .oracle import MATERIALS, ORACLE_SQL as CORE, PARSED, POINTS, SIGNATURES, parsed, text, values
from .strata import STRATA_SQL

STRATA = f"WITH strata AS ({STRATA_SQL})"
LINE = "'med dense SAND, sl. silty; v. stiff; colour: ' || description"
EXPANDED = LINE
for short, long in vocab.ABBREVIATIONS:
    EXPANDED = f"replace({EXPANDED}, {text(short)}, {text(long)})"

TERMS = "(SELECT w, ord FROM vocab WHERE kind = 'word')"
RATIO = "1 - levenshtein(w.w, v.w) / CAST(greatest(strlen(w.w), strlen(v.w)) AS DOUBLE)"
FUZZY = f"words AS (SELECT DISTINCT lower(token) AS w FROM tk0), best AS (SELECT w.w, v.w AS option, {RATIO} AS score FROM words w CROSS JOIN {TERMS} v WHERE {RATIO} >= 0.6 QUALIFY row_number() OVER (PARTITION BY w.w ORDER BY score DESC, v.ord) = 1)"
HATCH = """CASE WHEN label IS NOT NULL THEN 'made-ground' WHEN material_type = 'rock' THEN 'rock' WHEN primary_soil_type || secondary_primary_soil_type IN ('SANDGRAVEL', 'GRAVELSAND') THEN 'sand-gravel'
  WHEN primary_soil_type IN ('COBBLES', 'BOULDERS') THEN 'gravel' WHEN primary_soil_type = 'ORGANIC' THEN 'peat' ELSE coalesce(lower(primary_soil_type), 'default') END"""
SIGNED = SIGNATURES.rstrip().rstrip(",")
MADE = "row_number() OVER (PARTITION BY stratum_id ORDER BY ord)"
REPORT = f"""{oracle.ISSUES}, told AS (SELECT stratum_id, {MADE} AS k, count(*) OVER (PARTITION BY stratum_id) AS n, severity, description, suggestion, reference FROM issues),
lines AS (SELECT stratum_id, any_value(n) AS n, string_agg(E'\\n' || k || '. [' || severity || '] ' || description || E'\\n   Suggestion: ' || suggestion || E'\\n   Reference: ' || reference || E'\\n', '' ORDER BY k) AS issue_text FROM told GROUP BY 1)"""
UNITS = CORE["units"]
#: Another vocabulary, another threshold.
OWN = PARSED.replace("near AS (", "near0 AS (", 1).replace(f"score >= {vocab.FUZZY_THRESHOLD}", "score >= 0.9").replace(
    "vocab(w, type, ord, kind) AS (VALUES ", "vocab(w, type, ord, kind) AS (VALUES ('spongy', 'consistency', 900, 'own'), ('roots', 'soil_type', 901, 'own'), "
).replace("meanings(w, meaning) AS (VALUES ", "meanings(w, meaning) AS (VALUES ('spongy', 'soft'), ('roots', 'roots'), ").replace("near0 AS (", "near AS (", 1)
JSON_TEXT = "'{{' || concat_ws(',', {}) || '}}'"


def member(key: str, value: str) -> str:
    return f"'\"{key}\":' || {value}"


def quoted(value: str) -> str:
    return f"to_json({value})"


def two(value: str) -> str:
    return f"format('{{:.2f}}', round({value}, 2))"


JSON = JSON_TEXT.format(
    ", ".join(
        [member("raw_description", quoted("description")), member("material_type", quoted("material_type"))]
        + [member(k, quoted(v)) for k, v in (("consistency", "consistency"), ("density", "density"), ("primary_soil_type", "primary_soil_type"), ("secondary_primary_soil_type", "secondary_primary_soil_type"), ("geological_formation", "formation"))]
        + ["CASE WHEN label IS NOT NULL THEN '\"is_made_ground\":true' END"]
        + [member(k, quoted(v)) for k, v in (("made_ground_label", "label"), *[(n, n) for n in ("rock_strength", "weathering_grade", "rock_structure", "primary_rock_type", "color", "moisture_content", "plasticity_index", "particle_size")])]
        + [member("strength_parameter_type", quoted("s_type")), member("strength_parameter_units", quoted("s_units"))]
        + [f"CASE WHEN s_type IS NOT NULL THEN {member(k, two(v))} END" for k, v in (("strength_lower_bound", "s_lower"), ("strength_upper_bound", "s_upper"), ("strength_typical_value", "s_typical"), ("strength_confidence", "s_confidence"))]
        + [member("constituent_proportions", "'[' || props || ']'"), "CASE WHEN props IS NOT NULL THEN '\"constituent_confidence\":' || CASE n_sec WHEN 0 THEN '0.90' WHEN 1 THEN '0.80' WHEN 2 THEN '0.70' ELSE '0.60' END END"]
        + [member("secondary_constituents", "'[' || coalesce(secs, '') || ']'"), member("warnings", "'[' || coalesce(warns, '') || ']'"), member("confidence", two("confidence")), "'\"is_valid\":' || is_valid"]
    )
)
JSON_PARTS = f"""{oracle.GUIDANCE},
jp AS (SELECT stratum_id, string_agg('{{"soil_type":' || to_json(soil_type) || ',"percentage_range":"' || CAST(lower AS INT) || '-' || CAST(upper AS INT) || '","typical_percentage":' || CAST(typical AS INT) || '}}', ',' ORDER BY k) AS props FROM gd GROUP BY 1),
js AS (SELECT stratum_id, string_agg('{{"amount":' || to_json(amount) || ',"soil_type":' || to_json(soil_type) || '}}', ',' ORDER BY k) AS secs FROM sec GROUP BY 1),
jw AS (SELECT stratum_id, string_agg(to_json(warning), ',' ORDER BY rule) AS warns FROM warn GROUP BY 1)"""

SITE = "concat('site', CAST(floor(CAST(substr(borehole_id, 3) AS INT) / 10) AS INT), '.ags')"
COMMA = """'","'"""


def row(*fields: str) -> str:
    """A quoted row of SQL texts."""
    return "'\"' || " + f" || {COMMA} || ".join(f"replace({f}, '\"', '\"\"')" for f in fields) + " || '\"'"


def fixed(part: int, *lines: str) -> str:
    return " UNION ALL ".join(f"SELECT path, {part} AS part, CAST({i} AS BIGINT) AS seq, {text(line)} AS line FROM paths" for i, line in enumerate(lines))


heading = lambda *v: ",".join(f'"{x}"' for x in v)
GEOL = ("LOCA_ID", "GEOL_TOP", "GEOL_BASE", "GEOL_DESC", "GEOL_LEG", "GEOL_GEOL", "GEOL_FORM", "GEOL_MTYP", "GEOL_CONS", "GEOL_DENS", "GEOL_PSOL", "GEOL_PRCK", "GEOL_RSTR", "GEOL_WETH", "GEOL_CONF", "GEOL_WARN")
n = lambda c: f"coalesce({c}, '')"
# the first rows of data are those of PROJ and TRAN; then boreholes in order of their names, then strata
AGS_PARTS = f"""site AS (SELECT *, {SITE} AS path FROM p),
paths AS (SELECT DISTINCT path FROM site),
holes AS (SELECT path, borehole_id, min(x) AS x, min(y) AS y, min(z) AS z, max(depth_bottom) AS depth FROM site GROUP BY ALL),
hl AS (SELECT *, 1 + row_number() OVER (PARTITION BY path ORDER BY borehole_id) AS seq, count(*) OVER (PARTITION BY path) AS n FROM holes),
said AS (SELECT stratum_id, string_agg(warning, '; ' ORDER BY rule) AS warned FROM warn GROUP BY 1),
gl AS (SELECT site.*, warned, (SELECT any_value(n) FROM hl WHERE hl.path = site.path) + 1 + row_number() OVER (PARTITION BY path ORDER BY stratum_id) AS seq FROM site LEFT JOIN said USING (stratum_id)),
every AS ({fixed(0, heading("GROUP", "PROJ"), heading("HEADING", "PROJ_ID", "PROJ_NAME", "PROJ_LOC", "PROJ_CLNT"), heading("UNIT", "", "", "", ""), heading("TYPE", "ID", "X", "X", "X"))}
  UNION ALL SELECT path, 1, 0, {text(heading("DATA", "P1", "Synthetic", "", ""))} FROM paths
  UNION ALL {fixed(2, "", heading("GROUP", "LOCA"), heading("HEADING", "LOCA_ID", "LOCA_NATE", "LOCA_NATN", "LOCA_GL", "LOCA_TYPE", "LOCA_FDEP"), heading("UNIT", "", "m", "m", "m", "", "m"), heading("TYPE", "ID", "2DP", "2DP", "2DP", "PA", "2DP"))}
  UNION ALL SELECT path, 3, seq, {row("'DATA'", "borehole_id", two("x"), two("y"), two("z"), "'BH'", two("depth"))} FROM hl
  UNION ALL {fixed(4, "", heading("GROUP", "GEOL"), heading("HEADING", *GEOL), heading("UNIT", "", "m", "m", *[""] * 13), heading("TYPE", "ID", "2DP", "2DP", *["X"] * 11, "2DP", "X"))}
  UNION ALL SELECT path, 5, seq, {row("'DATA'", "borehole_id", two("depth_top"), two("depth_bottom"), "description", "''", "''", n("formation"), "material_type", n("consistency"), n("density"), n("primary_soil_type"), n("primary_rock_type"), n("rock_strength"), n("weathering_grade"), two("confidence"), n("warned"))} FROM gl)"""

RULE = {
    "head": "Rule 2: GROUP {} lacks one of the rows HEADING, UNIT and TYPE", "project": "Rule 13: there is no group PROJ", "one": "Rule 13: PROJ has no or several rows of data", "tran": "Rule 14: there is no group TRAN",
    "ascii": "Rule 1: characters beyond ASCII", "quoted": "Rule 5/6: a row does not begin with a quote", "key": "Rule 10: a row of LOCA has no LOCA_ID", "twice": "Rule 10: LOCA_ID more than once: 'BH1'",
}
BROKEN = {
    "sound": [], "accent": [RULE["ascii"]], "no_type": [RULE["head"].format("TRAN")], "loose": [RULE["quoted"]], "no_id": [RULE["key"]], "twice": [RULE["twice"]], "no_project": [RULE["one"], RULE["project"]],
    "two_projects": [RULE["one"]], "no_tran": [RULE["tran"]], "empty": [RULE["one"], RULE["project"], RULE["tran"]],
}


BY_SITE = {
    1: [RULE["ascii"]], 2: [RULE["head"].format("TRAN")], 3: [RULE["quoted"]] * 2, 4: [RULE["key"]], 5: [RULE["twice"].replace("BH1", "TWIN")] * 2, 6: [RULE["project"], RULE["one"]], 7: [RULE["one"]], 8: [RULE["tran"]],
    9: [RULE["project"], RULE["one"], RULE["tran"]],
}


def drawn(salt: str, words: list) -> str:
    return f"[{', '.join(map(text, words))}][CAST('0x' || substr(md5('{salt}-' || (i + 7)), 1, 15) AS BIGINT) % {len(words)} + 1]"


RANDOM = f"""WITH {values("strengths", "type, units, confidence, w, lower, upper, typical", oracle.STRENGTHS)},
r AS (SELECT i, {drawn("material", ["soil", "rock"])} AS m, {drawn("soil", ["CLAY", "SILT", "SAND", "GRAVEL"])} AS s, {drawn("state", vocab.CONSISTENCY[:6])} AS c, {drawn("state", vocab.DENSITY)} AS d,
  {drawn("part", [0, 1])} AS p, {drawn("amount", list(vocab.PROPORTION))} || ' ' || {drawn("kind", list(vocab.ADJECTIVE.values()))} AS parts, {drawn("strength", vocab.ROCK_STRENGTH)} AS rs, {drawn("rock", ["LIMESTONE", "SANDSTONE", "MUDSTONE", "GRANITE"])} AS rt
  FROM (SELECT unnest(range(1000)) AS i))
SELECT i, m AS material_type, CASE m WHEN 'rock' THEN rs || ' ' || rt ELSE concat_ws(' ', CASE WHEN s IN ('CLAY', 'SILT') THEN c ELSE d END, CASE WHEN p = 1 THEN parts END, s) END AS description,
  CASE m WHEN 'rock' THEN 'UCS' ELSE CASE WHEN s IN ('CLAY', 'SILT') THEN 'cu' ELSE 'SPT-N' END END AS strength_type FROM r"""

pick = lambda words: f"[{', '.join(map(text, words))}][p_partkey % {len(words)} + 1]"
BOUNDS = CORE["boundary_uncertainty"]
LEVELS = " UNION ALL ".join(f"SELECT {level}e0 AS level, id, top_lower, top_upper, bottom_lower FROM z{k}" for k, level in enumerate((0.995, 0.95, 0.9, 0.8, 0.5)))
MORE_BOUNDS = BOUNDS.replace(" AS top_upper,", " AS top_upper, round(coalesce(mu - 1.96 * sqrt(vu) / sqrt(n), depth_bottom - 2), 6) AS bottom_lower,")

ORACLE_SQL = {
    "terminology": f"{STRATA} SELECT stratum_id, {EXPANDED} AS expanded, replace({LINE}, 'colour', 'color') AS american FROM strata",
    "validity_helpers": parsed("""SELECT stratum_id, NOT cohesive OR consistency IS NOT NULL AS cohesive_ok, NOT granular OR density IS NOT NULL AS granular_ok, CASE WHEN cohesive THEN 'consistency' WHEN granular THEN 'density' END AS suggested,
      CASE WHEN a >= 0.8 THEN round(a, 4) END AS adjusted FROM (SELECT *, least(1, greatest(0, (confidence + CASE WHEN fixes > 0 THEN -0.1e0 ELSE 0.1e0 END) * CASE WHEN wn.n > 0 THEN 0.95e0 ELSE 1 END)) AS a
      FROM p LEFT JOIN wn USING (stratum_id) LEFT JOIN (SELECT stratum_id, count(*) AS fixes FROM tk WHERE corrected_from IS NOT NULL GROUP BY 1) USING (stratum_id))"""),
    "fuzzy_words": parsed("SELECT words.w AS word, option, round(score, 6) AS score, option AS folded, round(score, 6) AS folded_score FROM words LEFT JOIN best USING (w)", FUZZY),
    "boundary_levels": "WITH " + ", ".join(f"z{k} AS ({MORE_BOUNDS.replace('1.96', z)})" for k, z in enumerate(("2.576", "1.96", "1.645", "1.282", "1.645"))) + f" {LEVELS}",
    "boundary_grades": f"SELECT id, round(top_upper - top_lower, 5) AS width, top_mean + 1 BETWEEN top_lower AND top_upper AS holds, quality >= 0.5 AS reliable FROM ({BOUNDS})",
    "interpolation_grades": f"SELECT target_id, CASE WHEN confidence > 0.9 AND nearest_distance < 20 THEN 'excellent' WHEN confidence > 0.7 AND nearest_distance < 50 THEN 'good' WHEN confidence > 0.5 THEN 'fair' ELSE 'poor' END AS grade, confidence > 0.7 AND nearest_distance < 50 AS high, confidence * 1.2 >= 0.8 AS reliable FROM ({CORE['interpolation_quality']})",
    "borehole_registry": f"{STRATA}, last AS (SELECT borehole_id, max(stratum_id) AS k FROM strata WHERE stratum_id % 4 <> 1 GROUP BY 1) SELECT s.stratum_id, s.borehole_id, s.depth_top, h.x + h.stratum_id % 3 AS x, h.y, h.z - h.stratum_id % 5 AS z FROM strata s LEFT JOIN last USING (borehole_id) LEFT JOIN strata h ON h.stratum_id = last.k",
    "kriging": CORE["nearest_material"],
    "unit_lines": f"SELECT unit_id, format('Unit {{}}: {{}} | {{:.2f}}-{{:.2f}} m | mean thickness {{:.2f}} m | {{}} strata in {{}} boreholes | {{}}', unit_id, material_type, round(min_depth_top, 2), round(max_depth_bottom, 2), round(avg_thickness, 2), n_strata, n_boreholes, representative) AS line FROM ({UNITS})",
    "compliance_reports": parsed("SELECT stratum_id, CASE WHEN n IS NULL THEN E'✓ Compliant with BS 5930:2015\\n' ELSE E'✗ Non-compliant with BS 5930:2015\\n\\nIssues (' || n || E'):\\n' || issue_text END AS report FROM p LEFT JOIN lines USING (stratum_id)", REPORT),
    "summary_lines": parsed("""SELECT stratum_id, concat_ws(' | ', description, material_type, coalesce(rock_strength, consistency, density, '-'), coalesce(primary_rock_type, primary_soil_type, '-'), format('confidence {:.2f}', round(confidence, 2)), CASE WHEN is_valid THEN 'valid' ELSE 'invalid' END, w) AS line
      FROM p LEFT JOIN (SELECT stratum_id, string_agg(warning, '; ' ORDER BY rule) AS w FROM warn GROUP BY 1) USING (stratum_id)"""),
    "json_files": """SELECT * FROM (VALUES ('a', 'soil', 'CLAY', CAST(NULL AS VARCHAR), 'firm', CAST(NULL AS VARCHAR), 'strong', false, false, 1, 0, 37.0e0), ('b', 'rock', NULL, 'GRANITE', NULL, NULL, 'very strong', false, true, 0, 0, 150.0e0), ('c', 'soil', 'SAND', NULL, NULL, 'dense', NULL, false, true, 0, 1, 40.0e0),
      ('d', 'soil', NULL, NULL, NULL, NULL, NULL, false, true, 0, 0, NULL), ('e', 'soil', 'GRAVEL', NULL, 'soft', NULL, NULL, true, false, 3, 0, NULL), ('f', 'soil', 'SILT', NULL, 'stiff', 'loose', NULL, false, false, 1, 0, 75.0e0), ('alone', 'soil', 'CLAY', NULL, 'firm', NULL, 'strong', false, false, 1, 0, 37.0e0))
      t(raw_description, material_type, primary_soil_type, primary_rock_type, consistency, density, rock_strength, is_made_ground, is_valid, n_warnings, n_parts, typical)""",
    "line_files": parsed("SELECT trim(description) AS description, material_type, count(*) AS n FROM p WHERE trim(description) <> '' GROUP BY ALL"),
    "csv_files": parsed("SELECT stratum_id, 'a \"note\"' AS note, trim(description) AS description, CAST(depth_top AS VARCHAR) AS depth, material_type, coalesce(consistency, '') AS consistency, CAST(is_valid AS VARCHAR) AS is_valid, '' AS unheard FROM p WHERE stratum_id % 7 <> 0"),
    "csv_written": CORE["csv_results"],
    "csv_units": parsed("SELECT stratum_id, unit_id FROM member JOIN ranked USING (leader)", SIGNED).replace(f"strata AS ({STRATA_SQL})", f"strata AS (SELECT * FROM ({STRATA_SQL}) WHERE stratum_id % 11 <> 0)"),
    "xlsx_files": f"{STRATA} SELECT row_number() OVER (ORDER BY stratum_id) AS row, stratum_id, description, depth_top FROM strata",
    "ags_rules": "SELECT * FROM (VALUES " + ", ".join(f"({text(k)}, {'false' if v else 'true'}, {text('; '.join(sorted(v)))})" for k, v in BROKEN.items()) + ") t(path, is_valid, issues)",
    "ags_lines": f"""{STRATA}, site AS (SELECT DISTINCT {SITE} AS path, CAST(floor(CAST(substr(borehole_id, 3) AS INT) / 10) AS INT) % 10 AS k FROM strata),
      told AS (SELECT path, CASE k {" ".join(f"WHEN {k} THEN {text('; '.join(sorted(v)))}" for k, v in BY_SITE.items())} ELSE '' END AS issues FROM site) SELECT path, issues = '' AS is_valid, issues FROM told""",
    "hatches": parsed(f"SELECT stratum_id, {HATCH} AS hatch FROM p"),
    "svg_facts": parsed(f"""SELECT borehole_id, CAST(count(*) AS INT) AS n_strata, string_agg({HATCH}, ',' ORDER BY depth_top) AS hatches, CAST(round_even(80 + 45 + max(depth_bottom) * 50 + 20, 0) AS BIGINT) AS height, CAST(count(wn.n) AS INT) AS n_warned,
      coalesce(string_agg(CASE WHEN s_type IS NOT NULL THEN format('{{}}: {{:.1f}}-{{:.1f}} {{}}', s_type, round(s_lower, 1), round(s_upper, 1), s_units) END, ',' ORDER BY depth_top), '') AS strengths FROM p LEFT JOIN wn USING (stratum_id) GROUP BY 1"""),
    "first_boreholes": f"{STRATA} SELECT {SITE} AS path, min(borehole_id) AS of_loca, arg_min(borehole_id, stratum_id) AS of_geol FROM strata GROUP BY 1",
    "configured": parsed("""SELECT stratum_id, consistency, primary_soil_type, CAST(coalesce(fixes, 0) AS INT) AS n_fixed, CAST(least(1, coalesce(wn.n, 0)) AS INT) AS n_warnings, is_valid AND issues_n IS NULL AS is_valid, round(a, 4) AS adjusted, a >= 0.8 AS accepted FROM (
      SELECT *, CASE WHEN fixes > 0 THEN greatest(0, confidence - 0.1e0) ELSE least(1, confidence + 0.1e0) END * CASE WHEN wn.n > 0 THEN 0.95e0 ELSE 1 END AS a FROM p LEFT JOIN wn USING (stratum_id)
      LEFT JOIN (SELECT stratum_id, count(*) AS fixes FROM tk WHERE corrected_from IS NOT NULL GROUP BY 1) USING (stratum_id) LEFT JOIN (SELECT stratum_id, count(*) AS issues_n FROM issues GROUP BY 1) USING (stratum_id)) LEFT JOIN wn USING (stratum_id)""", oracle.ISSUES).replace(PARSED, OWN),
    "parse_distinct": CORE["parse_fields"],
    "from_properties": f"SELECT p_partkey AS part, {pick(vocab.CONSISTENCY)} || ' ' || {pick(['slightly', 'very'])} || ' sandy ' || {pick(['CLAY', 'SILT'])} AS soil, {pick(vocab.ROCK_STRENGTH)} || ' ' || {pick(vocab.WEATHERING)} || ' weathered CHALK' AS rock FROM part",
    "json_roundtrip": parsed(f"SELECT stratum_id, {JSON} AS json, true AS equal FROM p LEFT JOIN jp USING (stratum_id) LEFT JOIN js USING (stratum_id) LEFT JOIN jw USING (stratum_id)", JSON_PARTS),
    "random_descriptions": RANDOM,
    "ags_written": parsed("SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY part, seq) - 1 AS INT) AS k, line FROM every", AGS_PARTS),
    "svg_written": parsed("SELECT borehole_id, CAST(1 AS BIGINT) AS n_files, CAST(1 AS BIGINT) AS n_frames, CAST(round_even(80 + 45 + max(depth_bottom) * 50 + 20, 0) AS BIGINT) AS height FROM p GROUP BY 1"),
    "ags_enhance": parsed("SELECT * FROM every", AGS_PARTS),
}
