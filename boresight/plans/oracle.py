"""The same results in DuckDB SQL, written from the rules rather than from the Spark code; only the fixed values are shared."""

from __future__ import annotations

from .. import vocab
from .strata import STRATA_SQL


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"


WORD_LIST = [(w, k, i, "phrase") for i, (w, k) in enumerate(vocab.phrases())] + [(w, k, i, "word") for i, (w, k) in enumerate(vocab.single_words())]
PATTERN = "(?i)(?:" + "|".join(p for p, _ in vocab.phrases()) + r")(?:\s|$)|\S+"
MEANINGS = [(w, vocab.MEANING.get(w, w)) for w, _, _, _ in WORD_LIST]
ORDINALS = [(f, w, i) for f, words in (("consistency", vocab.CONSISTENCY), ("density", vocab.DENSITY), ("rock_strength", vocab.ROCK_STRENGTH), ("weathering_grade", vocab.WEATHERING)) for i, w in enumerate(words)]
STRENGTHS = [(kind, units, float(conf), w, float(lo), float(hi), float(mid)) for kind, (table, units, conf) in vocab.STRENGTH.items() for w, (lo, hi, mid) in table.items()]

FIRST = {"consistency": "soil", "density": "soil", "rock_strength": "rock", "weathering_grade": "rock", "rock_structure": "rock", "color": None, "moisture_content": None, "plasticity_index": None, "particle_size": None}
FIRST_SQL = ",\n".join(f"    arg_min(meaning, i) FILTER (WHERE type = '{k}' AND meaning IS NOT NULL) AS {k}" for k in FIRST)
KEEP_SQL = ",\n".join(f"  CASE WHEN m.material_type = '{on}' THEN f.{k} END AS {k}" if on else f"  f.{k}" for k, on in FIRST.items())

PARSED = rf"""
WITH RECURSIVE strata AS ({STRATA_SQL}),
{values("vocab", "w, type, ord, kind", WORD_LIST)},
{values("typo", "w, meant", list(vocab.typos().items()))},
{values("meanings", "w, meaning", MEANINGS)},
{values("adjectives", "noun, adjective", list(vocab.ADJECTIVE.items()))},
{values("ordinals", "field, w, ordinal", ORDINALS)},
{values("strengths", "type, units, confidence, w, lower, upper, typical", STRENGTHS)},
b0 AS (SELECT *, trim(description, E' \t\r\n') AS t0 FROM strata),
b1 AS (SELECT *, nullif(upper(regexp_extract(t0, '(?i)^(MADE GROUND|FILL|TOPSOIL)', 1)), '') AS label FROM b0),
b2 AS (SELECT *, CASE WHEN label IS NULL THEN t0 ELSE ltrim(substr(t0, length(label) + 1), E' :-\t') END AS t1 FROM b1),
pr AS (SELECT * FROM (SELECT stratum_id, t1, unnest(range(1, length(t1) + 1)) AS i FROM b2 WHERE length(t1) > 2 AND t1 LIKE '%)') WHERE substr(t1, i, 1) IN ('(', ')')),
dp AS (SELECT stratum_id, i, sum(CASE substr(t1, i, 1) WHEN ')' THEN 1 ELSE -1 END) OVER (PARTITION BY stratum_id ORDER BY i DESC) AS depth FROM pr),
op AS (SELECT stratum_id, max(i) AS opens FROM dp WHERE depth = 0 GROUP BY 1),
b3 AS (SELECT b2.*, opens, nullif(trim(substr(t1, opens + 1, length(t1) - opens - 1), E' \t'), '') AS formation FROM b2 LEFT JOIN op USING (stratum_id)),
body AS (SELECT * EXCLUDE (opens), CASE WHEN formation IS NULL THEN t1 ELSE trim(substr(t1, 1, opens - 1), E' \t') END AS body FROM b3),
tk0 AS (SELECT stratum_id, unnest(range(1, len(l) + 1)) AS i, trim(unnest(l)) AS token FROM (SELECT stratum_id, regexp_extract_all(body, '{PATTERN}') AS l FROM body)),
odd AS (SELECT DISTINCT lower(token) AS w FROM tk0 WHERE lower(token) NOT IN (SELECT w FROM vocab) AND lower(token) NOT IN (SELECT w FROM typo) AND strlen(token) < {vocab.WORD_BYTES}),
near AS (SELECT odd.w, v.w AS meant, 1 - levenshtein(odd.w, v.w) / CAST(greatest(strlen(odd.w), strlen(v.w)) AS DOUBLE) AS score, v.ord FROM odd JOIN vocab v ON v.kind = 'word' AND v.w[1] = odd.w[1]
  AND abs(strlen(v.w) - strlen(odd.w)) <= {vocab.FUZZY_SPAN} AND strlen(odd.w) BETWEEN {vocab.FUZZY_MIN} AND {vocab.FUZZY_MAX} AND regexp_matches(odd.w, '^[{vocab.FUZZY_FIRST}]')),
fuzzy AS (SELECT w, meant, score FROM near WHERE score >= {vocab.FUZZY_THRESHOLD} QUALIFY row_number() OVER (PARTITION BY w ORDER BY score DESC, ord) = 1),
fixed AS (SELECT w, meant, CAST({vocab.TYPO_SCORE} AS DOUBLE) AS score FROM typo UNION ALL SELECT w, meant, CAST(score AS DOUBLE) FROM fuzzy),
tk AS (SELECT t.stratum_id, t.i, coalesce(x.meant, t.token) AS value, coalesce(v.type, 'unknown') AS type, lower(coalesce(x.meant, t.token)) AS text, CASE WHEN x.meant IS NOT NULL THEN t.token END AS corrected_from, x.score
  FROM tk0 t LEFT JOIN fixed x ON x.w = lower(t.token) AND lower(t.token) NOT IN (SELECT w FROM vocab) LEFT JOIN vocab v ON v.w = lower(coalesce(x.meant, t.token))),
tw AS (SELECT tk.*, m.meaning, lag(type) OVER w AS before_type, lag(text) OVER w AS before_text, lead(type) OVER w AS after_type, lead(text) OVER w AS after_text, lead(value) OVER w AS after_value
  FROM tk LEFT JOIN meanings m ON m.w = tk.text WINDOW w AS (PARTITION BY stratum_id ORDER BY i)),
mat AS (SELECT s.stratum_id, CASE WHEN bool_or(type IN ('rock_type', 'rock_strength', 'weathering_grade', 'rock_structure')) THEN 'rock' ELSE 'soil' END AS material_type FROM strata s LEFT JOIN tk USING (stratum_id) GROUP BY 1),
firsts AS (SELECT stratum_id,
{FIRST_SQL},
    arg_min(upper(text), i) FILTER (WHERE type = 'rock_type') AS rock_type,
    arg_min(upper(text), i) FILTER (WHERE type = 'soil_type' AND before_type IS DISTINCT FROM 'proportion') AS soil1,
    min(i) FILTER (WHERE type = 'soil_type' AND before_type IS DISTINCT FROM 'proportion') AS at1 FROM tw GROUP BY 1),
seconds AS (SELECT t.stratum_id, arg_min(upper(t.text), t.i) AS soil2 FROM tw t JOIN firsts f ON f.stratum_id = t.stratum_id AND t.i > f.at1 WHERE t.type = 'soil_type' AND t.before_text = 'and' GROUP BY 1),
sec AS (SELECT stratum_id, row_number() OVER (PARTITION BY stratum_id ORDER BY i) AS k, amount, soil_type FROM (
  SELECT t.stratum_id, t.i, t.value AS amount, coalesce(a.adjective, t.after_value) AS soil_type FROM tw t LEFT JOIN adjectives a ON a.noun = t.after_text WHERE t.type = 'proportion' AND t.after_type IN ('adjective', 'soil_type')
  UNION ALL SELECT stratum_id, i, 'moderately', text FROM tw WHERE type = 'adjective' AND before_type IS DISTINCT FROM 'proportion')),
p0 AS (SELECT b.*, m.material_type,
{KEEP_SQL},
  CASE WHEN m.material_type = 'soil' THEN f.soil1 END AS primary_soil_type, CASE WHEN m.material_type = 'soil' THEN s.soil2 END AS secondary_primary_soil_type, CASE WHEN m.material_type = 'rock' THEN f.rock_type END AS primary_rock_type,
  coalesce((SELECT count(*) FROM sec WHERE sec.stratum_id = b.stratum_id), 0) AS n_sec, (SELECT string_agg(amount || ' ' || soil_type, ' ' ORDER BY k) FROM sec WHERE sec.stratum_id = b.stratum_id) AS sec_text
  FROM body b JOIN mat m USING (stratum_id) LEFT JOIN firsts f USING (stratum_id) LEFT JOIN seconds s USING (stratum_id)),
p1 AS (SELECT *, coalesce(primary_soil_type IN ('CLAY', 'SILT'), false) AS cohesive, coalesce(primary_soil_type IN ('SAND', 'GRAVEL', 'COBBLES', 'BOULDERS'), false) AS granular FROM p0),
warn AS (
  SELECT stratum_id, 1 AS rule, true AS bad, {text("[high] " + vocab.WARNINGS["rock_with_soil"])} AS warning FROM p1 WHERE material_type = 'rock' AND regexp_matches(lower(description), '{vocab.SOIL_KEYWORDS}')
  UNION ALL SELECT stratum_id, 2, false, {text("[high] " + vocab.WARNINGS["no_consistency"])} FROM p1 WHERE material_type = 'soil' AND cohesive AND consistency IS NULL
  UNION ALL SELECT stratum_id, 3, true, {text("[high] " + vocab.WARNINGS["density_on_cohesive"])} FROM p1 WHERE material_type = 'soil' AND cohesive AND density IS NOT NULL
  UNION ALL SELECT stratum_id, 4, false, {text("[high] " + vocab.WARNINGS["no_density"])} FROM p1 WHERE material_type = 'soil' AND granular AND density IS NULL
  UNION ALL SELECT stratum_id, 5, true, {text("[high] " + vocab.WARNINGS["consistency_on_granular"])} FROM p1 WHERE material_type = 'soil' AND granular AND consistency IS NOT NULL
  UNION ALL SELECT stratum_id, 6, true, {text("[high] " + vocab.WARNINGS["plasticity_on_granular"])} FROM p1 WHERE material_type = 'soil' AND granular AND plasticity_index IS NOT NULL),
wn AS (SELECT stratum_id, count(*) AS n, bool_or(bad) AS bad FROM warn GROUP BY 1),
p AS (SELECT p1.*, round(greatest(0.1e0, 1 - 0.15e0 * coalesce(wn.n, 0)), 4) AS confidence, NOT coalesce(wn.bad, false) AS is_valid,
  s.type AS s_type, s.units AS s_units, CAST(s.lower AS DOUBLE) AS s_lower, CAST(s.upper AS DOUBLE) AS s_upper, CAST(s.typical AS DOUBLE) AS s_typical, CAST(s.confidence AS DOUBLE) AS s_confidence
  FROM p1 LEFT JOIN wn USING (stratum_id) LEFT JOIN strengths s ON (s.type = 'cu' AND material_type = 'soil' AND cohesive AND s.w = consistency) OR (s.type = 'SPT-N' AND material_type = 'soil' AND granular AND s.w = density) OR (s.type = 'UCS' AND material_type = 'rock' AND s.w = rock_strength)),
"""

POINTS = f"""
WITH RECURSIVE strata AS ({STRATA_SQL}),
pt AS (SELECT *, stratum_id AS id, (depth_top + depth_bottom) / 2 AS mid_depth, depth_bottom - depth_top AS thickness, x AS px, y AS py, z - (depth_top + depth_bottom) / 2 AS pz FROM strata),
"""
#: A pair's distance, the target first.
D3 = "sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz))"
D2 = "sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py))"
TARGETS = "targets AS (SELECT borehole_id AS target_id, min(x) + 3.0e0 AS px, min(y) + 4.0e0 AS py, min(z) - 5.0e0 AS pz FROM strata GROUP BY 1),"


def parsed(select: str, more: str = "one AS (SELECT 1)") -> str:
    return f"{PARSED}{more}\n{select}"


#: The material mix of strata by rock tokens alone, for spatial queries.
MATERIALS = "mats AS (SELECT p.stratum_id AS id, p.material_type, p.borehole_id, p.depth_top, p.depth_bottom, x AS px, y AS py, z - (depth_top + depth_bottom) / 2 AS pz FROM p),"
state = "coalesce(consistency, density)"
doubled = "weathering_grade || ' weathered'"


def texts(consistency="consistency", density="density", rock_strength="rock_strength") -> str:
    return f"CASE WHEN material_type = 'rock' THEN concat_ws(' ', {rock_strength}, {doubled}, rock_structure, primary_rock_type) ELSE concat_ws(' ', coalesce({consistency}, {density}), sec_text, particle_size, primary_soil_type) END"


def variations() -> str:
    parts = []
    for cond, arg, words in (("material_type = 'soil' AND cohesive", "consistency", ["soft", "firm", "stiff", "very stiff"]), ("material_type = 'soil' AND granular", "density", ["loose", "medium dense", "dense", "very dense"]), ("material_type = 'rock'", "rock_strength", ["weak", "moderately weak", "moderately strong", "strong", "very strong"])):
        parts += [f"SELECT stratum_id, {k} AS k, {texts(**{arg: text(w)})} AS variation FROM p WHERE {cond}" for k, w in enumerate(words, 1)]
    return " UNION ALL ".join(parts)


def issues() -> str:
    row = lambda cond, *v: "SELECT stratum_id, " + ", ".join(f"{text(x)} AS {n}" for n, x in zip(("type", "severity", "description", "suggestion", "reference"), v, strict=True)) + f" FROM q WHERE {cond}"
    soil = "material_type = 'soil' AND primary_soil_type IS NOT NULL"
    parts = [row(f"contains(low, {text(t)})", "non_standard_term", "medium", f"The standard has no term '{t}'", how, "BS 5930:2015 §6.3") for t, how, _ in vocab.DEPRECATED[:2]]
    parts.append(row(f"{soil} AND first > 0 AND EXISTS (SELECT 1 FROM sec WHERE sec.stratum_id = q.stratum_id AND strpos(low, sec.soil_type) > first)", "invalid_descriptor_order", "medium", "A secondary constituent follows the primary soil type", "Put consistency or density first, then colour, secondary constituents and the primary type", "BS 5930:2015 §6.3"))
    parts.append(row(f"{soil} AND strpos(low, color) > 0 AND strpos(low, {state}) > 0 AND strpos(low, color) < strpos(low, {state})", "invalid_descriptor_order", "low", "The colour stands before consistency or density", "Put consistency or density before the colour", "BS 5930:2015 §6.3"))
    parts.append(row("n_sec > 0 AND regexp_matches(description, 'some|little|bit of')", "invalid_proportion_term", "high", "A proportion is given in words the standard does not have", "Choose slightly (5 to 20 %), moderately (20 to 35 %) or very (35 to 65 %)", "BS 5930:2015 §6.3.2.4"))
    parts.append(row(f"{soil} AND primary_soil_type IN ('SAND', 'GRAVEL') AND consistency IN ('soft', 'very soft')", "implausible_combination", "high", "Sand and gravel are never soft", "Choose a density from loose to very dense", "BS 5930:2015 §6.3.2.2"))
    parts.append(row(f"{soil} AND cohesive AND density IS NOT NULL", "implausible_combination", "high", "Clay and silt have a consistency, no density", "Choose a consistency from very soft to hard", "BS 5930:2015 §6.3.2.2"))
    parts.append(row("consistency NOT IN ('soft to firm', 'firm to stiff', 'stiff to very stiff') AND contains(description, 'to') AND regexp_matches(low[1:256], 'soft to stiff|firm to very stiff')", "excessive_range", "medium", "The range of consistency covers several steps", "Give one value, or two that are next to each other", "BS 5930:2015 §6.3.2.2"))
    parts += [row(f"contains(low, {text(t)})", "deprecated_terminology", "medium", f"The term '{t}' is out of use", how, where) for t, how, where in vocab.DEPRECATED]
    return " UNION ALL ".join(part.replace("SELECT stratum_id, ", f"SELECT stratum_id, {k} AS ord, ", 1) for k, part in enumerate(parts))


ISSUES = f"q AS (SELECT *, lower(description) AS low, strpos(lower(description), lower(primary_soil_type)) AS first FROM p), issues AS ({issues()})"
ANOMALIES = """anomalies AS (
  SELECT stratum_id, 'mismatched_strength_descriptor' AS type, 'high' AS severity, 'Cohesive soil ''' || lower(primary_soil_type) || ''' is described by density, which only granular soils have' AS description, 'Say how soft or stiff it is instead' AS suggestion FROM p WHERE material_type = 'soil' AND cohesive AND density IS NOT NULL AND consistency IS NULL
  UNION ALL SELECT stratum_id, 'mismatched_strength_descriptor', 'high', 'Granular soil ''' || lower(primary_soil_type) || ''' is described by consistency, which only cohesive soils have', 'Say how loose or dense it is instead' FROM p WHERE material_type = 'soil' AND granular AND consistency IS NOT NULL AND density IS NULL
  UNION ALL SELECT stratum_id, 'missing_strength_descriptor', 'medium', 'Cohesive soil ''' || lower(primary_soil_type) || ''' lacks a word for its consistency', 'Say how soft or stiff it is' FROM p WHERE material_type = 'soil' AND cohesive AND consistency IS NULL
  UNION ALL SELECT stratum_id, 'missing_strength_descriptor', 'medium', 'Granular soil ''' || lower(primary_soil_type) || ''' lacks a word for its density', 'Say how loose or dense it is' FROM p WHERE material_type = 'soil' AND granular AND density IS NULL
  UNION ALL SELECT stratum_id, 'unusual_constituent_combination', 'medium', 'A very clayey SAND may well be a sandy CLAY', 'Check whether clay governs its behaviour' FROM p JOIN sec USING (stratum_id) WHERE primary_soil_type = 'SAND' AND amount = 'very' AND soil_type = 'clayey'
  UNION ALL SELECT stratum_id, 'unusual_constituent_combination', 'medium', 'A very sandy CLAY may well be a clayey SAND', 'Check whether sand governs its behaviour' FROM p JOIN sec USING (stratum_id) WHERE primary_soil_type = 'CLAY' AND amount = 'very' AND soil_type = 'sandy'
  UNION ALL SELECT stratum_id, 'conflicting_properties', 'high', 'Consistency and density stand side by side, though a soil has one of them', 'Keep the one that suits the primary soil type' FROM p WHERE consistency IS NOT NULL AND density IS NOT NULL
  UNION ALL SELECT stratum_id, 'excessive_constituents', 'low', n_sec || ' secondary constituents are more than usual', 'Name those that matter most' FROM p WHERE n_sec > 3
  UNION ALL SELECT a.stratum_id, 'duplicate_constituents', 'low', 'The constituent ''' || a.soil_type || ''' stands twice', 'Name ''' || a.soil_type || ''' once' FROM sec a JOIN sec b ON a.stratum_id = b.stratum_id AND a.soil_type = b.soil_type AND a.k < b.k
  UNION ALL SELECT stratum_id, 'spelling_correction', 'low', '''' || corrected_from || ''' read as ''' || value || ''' (likeness ' || format('{:.2f}', score) || ')', NULL FROM tk WHERE corrected_from IS NOT NULL)"""

SIGNATURES = """
sg AS (SELECT *, concat_ws('|', material_type, coalesce(primary_soil_type, ''), coalesce(consistency, ''), coalesce(density, ''), coalesce(primary_rock_type, ''), coalesce(rock_strength, ''), coalesce(weathering_grade, '')) AS sig FROM p),
sigs AS (SELECT sig, min(stratum_id) AS first, any_value(material_type) AS material_type, any_value(primary_soil_type) AS primary_soil_type, any_value(primary_rock_type) AS primary_rock_type, any_value(consistency) AS consistency, any_value(density) AS density, any_value(rock_strength) AS rock_strength, any_value(weathering_grade) AS weathering_grade FROM sg GROUP BY 1),
so AS (SELECT s.*, c.ordinal AS o1, d.ordinal AS o2, r.ordinal AS o3, w.ordinal AS o4 FROM sigs s LEFT JOIN ordinals c ON c.field = 'consistency' AND c.w = consistency LEFT JOIN ordinals d ON d.field = 'density' AND d.w = density LEFT JOIN ordinals r ON r.field = 'rock_strength' AND r.w = rock_strength LEFT JOIN ordinals w ON w.field = 'weathering_grade' AND w.w = weathering_grade),
sp AS (SELECT a.first AS a_first, b.first AS b_first, CASE WHEN a.material_type <> b.material_type THEN 0.0e0 ELSE
  (1.0e0 + CASE WHEN a.primary_soil_type = b.primary_soil_type OR a.primary_rock_type = b.primary_rock_type THEN 1.0e0 ELSE 0.0e0 END
   + coalesce(CASE WHEN abs(a.o1 - b.o1) <= 1 THEN 0.8e0 WHEN abs(a.o1 - b.o1) = 2 THEN 0.4e0 ELSE 0.0e0 END, 0.0e0) + coalesce(CASE WHEN abs(a.o2 - b.o2) <= 1 THEN 0.8e0 WHEN abs(a.o2 - b.o2) = 2 THEN 0.4e0 ELSE 0.0e0 END, 0.0e0)
   + coalesce(CASE WHEN abs(a.o3 - b.o3) <= 1 THEN 0.8e0 WHEN abs(a.o3 - b.o3) = 2 THEN 0.4e0 ELSE 0.0e0 END, 0.0e0) + coalesce(CASE WHEN abs(a.o4 - b.o4) <= 1 THEN 0.8e0 WHEN abs(a.o4 - b.o4) = 2 THEN 0.4e0 ELSE 0.0e0 END, 0.0e0))
  / (1 + CASE WHEN a.primary_soil_type IS NOT NULL AND b.primary_soil_type IS NOT NULL OR a.primary_rock_type IS NOT NULL AND b.primary_rock_type IS NOT NULL THEN 1 ELSE 0 END
   + CASE WHEN a.o1 + b.o1 IS NULL THEN 0 ELSE 1 END + CASE WHEN a.o2 + b.o2 IS NULL THEN 0 ELSE 1 END + CASE WHEN a.o3 + b.o3 IS NULL THEN 0 ELSE 1 END + CASE WHEN a.o4 + b.o4 IS NULL THEN 0 ELSE 1 END) END AS score FROM so a CROSS JOIN so b),
sims AS (SELECT a_first, list(b_first) AS alike FROM sp WHERE score >= 0.7 - 1e-6 GROUP BY 1),
pass AS (SELECT CAST(NULL AS BIGINT) AS leader, (SELECT list(first ORDER BY first) FROM sigs) AS rest
  UNION ALL SELECT pass.rest[1], list_filter(pass.rest, lambda r: NOT list_contains(sims.alike, r)) FROM pass JOIN sims ON sims.a_first = pass.rest[1] WHERE len(pass.rest) > 0),
led AS (SELECT sp.b_first AS first, min(sp.a_first) AS leader FROM sp JOIN pass ON pass.leader = sp.a_first WHERE sp.score >= 0.7 - 1e-6 GROUP BY 1),
member AS (SELECT sg.*, led.leader FROM sg JOIN sigs USING (sig) JOIN led ON led.first = sigs.first),
ranked AS (SELECT leader, CAST(row_number() OVER (ORDER BY avg(depth_top), leader) AS INT) AS unit_id FROM member GROUP BY 1),
"""

DBSCAN = f"""
pairs AS (SELECT a.id, b.id AS b_id FROM pt a JOIN pt b ON a.id <> b.id AND {D3} <= 1.55),
core AS (SELECT id FROM pairs GROUP BY 1 HAVING count(*) >= 2),
reach AS (SELECT id, id AS root FROM core UNION SELECT pairs.b_id, reach.root FROM reach JOIN pairs ON pairs.id = reach.id JOIN core ON core.id = pairs.b_id),
comp AS (SELECT id, min(root) AS component FROM reach GROUP BY 1),
cl AS (SELECT id, CAST(dense_rank() OVER (ORDER BY component) - 1 AS INT) AS label FROM comp),
labels AS (SELECT pt.id, coalesce(cl.label, (SELECT min(c.label) FROM pairs JOIN cl c ON c.id = pairs.b_id WHERE pairs.id = pt.id), -2) AS label FROM pt LEFT JOIN cl ON cl.id = pt.id),
cp AS (SELECT pt.id, px, py, pz, label FROM pt JOIN labels USING (id) WHERE label >= 0),
centre AS (SELECT label, avg(px) AS px, avg(py) AS py, avg(pz) AS pz, count(*) AS n FROM cp GROUP BY 1),
"""
SILHOUETTE = f"""m AS (SELECT a.id, a.label, b.label AS other, avg({D3}) AS mean FROM cp a JOIN cp b ON a.id <> b.id GROUP BY ALL),
si AS (SELECT id, max(mean) FILTER (WHERE label = other) AS a, min(mean) FILTER (WHERE label <> other) AS b FROM m GROUP BY 1),
sil AS (SELECT coalesce(avg((b - a) / greatest(a, b)), 0) AS v FROM si WHERE a IS NOT NULL AND b IS NOT NULL)"""
BOULDIN = f"""sprd AS (SELECT a.label, b.px, b.py, b.pz, avg({D3}) AS s FROM cp a JOIN centre b USING (label) GROUP BY ALL),
wrst AS (SELECT a.label, max(CASE WHEN {D3} >= 1e-10 THEN (a.s + b.s) / {D3} ELSE 0 END) AS r FROM sprd a JOIN sprd b ON a.label <> b.label GROUP BY 1),
dbi AS (SELECT CASE WHEN count(*) >= 2 THEN avg(r) ELSE CAST('inf' AS DOUBLE) END AS v FROM wrst)"""
CALINSKI = """mn AS (SELECT avg(px) AS px, avg(py) AS py, avg(pz) AS pz FROM cp),
bg AS (SELECT sum(n * ((c.px - mn.px) * (c.px - mn.px) + (c.py - mn.py) * (c.py - mn.py) + (c.pz - mn.pz) * (c.pz - mn.pz))) AS b, count(*) AS k, sum(n) AS n FROM centre c CROSS JOIN mn),
wg AS (SELECT sum((a.px - c.px) * (a.px - c.px) + (a.py - c.py) * (a.py - c.py) + (a.pz - c.pz) * (a.pz - c.pz)) AS w FROM cp a JOIN centre c USING (label)),
chi AS (SELECT CASE WHEN k < 2 THEN 0 WHEN w < 1e-10 THEN CAST('inf' AS DOUBLE) ELSE (b / (k - 1)) / (w / (n - k)) END AS v FROM bg CROSS JOIN wg)"""
NEAR_TARGETS = f"nb AS (SELECT a.target_id, b.id AS b_id, b.material_type, {D3} AS distance FROM targets a CROSS JOIN mats b QUALIFY row_number() OVER (PARTITION BY a.target_id ORDER BY distance, b.id) <= 5)"
VOTE = "sum(CASE WHEN material_type = '{}' THEN CASE WHEN distance < 1e-10 THEN 1 ELSE 1 / pow(distance, 2) END ELSE 0 END)"
SOIL, ROCK = VOTE.format("soil"), VOTE.format("rock")
FIELDS = "material_type, consistency, density, primary_soil_type, secondary_primary_soil_type, formation AS geological_formation, label IS NOT NULL AS is_made_ground, label AS made_ground_label, rock_strength, weathering_grade, rock_structure, primary_rock_type, color, moisture_content, plasticity_index, particle_size, confidence, is_valid"
GUIDANCE = """shares(amount, lo, hi, mid) AS (VALUES ('slightly', 5.0e0, 12.0e0, 8.0e0), ('moderately', 12.0e0, 35.0e0, 20.0e0), ('very', 35.0e0, 65.0e0, 50.0e0)),
gk AS (SELECT stratum_id, row_number() OVER (PARTITION BY stratum_id ORDER BY k) AS k, soil_type, lo, hi, mid FROM sec JOIN shares USING (amount)),
gs AS (SELECT p.stratum_id, primary_soil_type, n_sec, 100 - coalesce((SELECT sum(mid) FROM gk WHERE gk.stratum_id = p.stratum_id), 0) AS rest FROM p WHERE material_type = 'soil'),
gd AS (SELECT stratum_id, 1 AS k, lower(primary_soil_type) AS soil_type, greatest(35, rest - 15) AS lower, least(95, rest + 15) AS upper, greatest(35, rest) AS typical, n_sec FROM gs WHERE primary_soil_type IS NOT NULL
  UNION ALL SELECT gk.stratum_id, gk.k + CASE WHEN gs.primary_soil_type IS NULL THEN 0 ELSE 1 END, gk.soil_type, lo, hi, mid, gs.n_sec FROM gk JOIN gs USING (stratum_id))"""


def inverse(kind: str) -> str:
    limits, names = vocab.INVERSE[kind]
    return "CASE " + " ".join(f"WHEN v < {limit} THEN {text(name)}" for limit, name in zip(limits, names, strict=False)) + f" ELSE {text(names[-1])} END"


r6 = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)

ORACLE_SQL = {
    "material_mix": parsed("SELECT material_type, coalesce(primary_rock_type, primary_soil_type, 'none') AS primary_type, count(*) AS n FROM p GROUP BY ALL"),
    "tokens": parsed("SELECT stratum_id, CAST(i - 1 AS INT) AS i, value, type, corrected_from, round(score, 4) AS score FROM tk"),
    "token_class_counts": parsed("SELECT type, count(*) AS n FROM tk GROUP BY 1"),
    "spelling_corrections": parsed("SELECT stratum_id, corrected_from AS original, value AS corrected, round(score, 4) AS score FROM tk WHERE corrected_from IS NOT NULL"),
    "preprocess": parsed("SELECT stratum_id, label, formation, body FROM body"),
    "parse_fields": parsed(f"SELECT stratum_id, {FIELDS} FROM p"),
    "secondary_constituents": parsed("SELECT stratum_id, CAST(k - 1 AS INT) AS k, amount, soil_type FROM sec"),
    "strength_lookup": parsed("SELECT stratum_id, s_type AS type, s_units AS units, s_lower AS lower, s_upper AS upper, s_typical AS typical, round(s_confidence, 4) AS confidence, (s_lower + s_upper) / 2 AS midpoint FROM p WHERE s_type IS NOT NULL"),
    "strength_inverse": f"WITH t AS (SELECT p_partkey AS part, p_partkey % 500 * 0.5e0 AS v, CAST(p_partkey % 100 AS DOUBLE) AS s FROM part) SELECT part, {inverse('cu')} AS cu, {inverse('SPT-N')} AS spt, {inverse('UCS')} AS ucs, CASE WHEN s < 5 THEN NULL WHEN s < 12 THEN 'slightly' WHEN s < 35 THEN 'moderately' WHEN s < 65 THEN 'very' ELSE 'predominantly' END AS proportion FROM t",
    "constituent_guidance": parsed("SELECT stratum_id, CAST(k - 1 AS INT) AS k, soil_type, CAST(lower AS DOUBLE) AS lower, CAST(upper AS DOUBLE) AS upper, CAST(typical AS DOUBLE) AS typical, CASE n_sec WHEN 0 THEN 0.9e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 0.7e0 ELSE 0.6e0 END AS confidence FROM gd", GUIDANCE),
    "validation_warnings": parsed("SELECT stratum_id, CAST(row_number() OVER (PARTITION BY stratum_id ORDER BY rule) - 1 AS INT) AS k, warning FROM warn"),
    "confidence_hist": parsed("SELECT confidence, is_valid, count(*) AS n FROM p GROUP BY ALL"),
    "anomalies": parsed("SELECT * FROM anomalies", ANOMALIES),
    "anomaly_severity": parsed("SELECT severity, count(*) AS n FROM (SELECT p.stratum_id, CASE coalesce(max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END), 1) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM p LEFT JOIN anomalies USING (stratum_id) GROUP BY 1) GROUP BY 1", ANOMALIES),
    "compliance_issues": parsed("SELECT * EXCLUDE (ord) FROM issues", ISSUES),
    "compliance_summary": parsed("SELECT is_compliant, count(*) AS n, CAST(sum(k) AS BIGINT) AS issues FROM (SELECT p.stratum_id, count(i.type) = 0 AS is_compliant, count(i.type) AS k FROM p LEFT JOIN issues i USING (stratum_id) GROUP BY 1) GROUP BY 1", ISSUES),
    "generate_formats": parsed(f"""SELECT stratum_id, {texts()} AS plain, CASE WHEN material_type = 'rock' THEN concat_ws(' ', rock_strength, primary_rock_type) ELSE concat_ws(' ', {state}, primary_soil_type) END AS concise,
      CASE WHEN material_type = 'rock' THEN concat_ws(' ', color, moisture_content, rock_strength, {doubled}, rock_structure, primary_rock_type) ELSE concat_ws(' ', color, moisture_content, {state}, plasticity_index, sec_text, particle_size, primary_soil_type) END AS verbose,
      CASE WHEN material_type = 'rock' THEN concat(rock_strength || ' ', {doubled} || ' ', rock_structure || ' ', primary_rock_type) ELSE concat({state} || ' ', sec_text || ' ', primary_soil_type) END AS standard,
      CASE WHEN s_type IS NULL THEN {texts()} ELSE format('{{}} ({{}}: {{:.1f}}-{{:.1f}} {{}})', {texts()}, s_type, round(s_lower, 1), round(s_upper, 1), s_units) END AS with_strength, coalesce(primary_rock_type, primary_soil_type, 'Unknown') AS label FROM p"""),
    "generate_variations": parsed(f"SELECT stratum_id, CAST(k - 1 AS INT) AS k, variation FROM ({variations()})"),
    "similar_pairs": parsed("SELECT a_first, b_first, round(score, 6) AS score FROM sp WHERE score >= 0.7 - 1e-6 AND a_first < b_first", SIGNATURES.rstrip().rstrip(",")),
    "similar_members": parsed("SELECT stratum_id, sigs.first FROM sg JOIN sigs USING (sig)", SIGNATURES.rstrip().rstrip(",")),
    "unit_assignments": parsed("SELECT stratum_id, unit_id FROM member JOIN ranked USING (leader)", SIGNATURES.rstrip().rstrip(",")),
    "units": parsed("""SELECT unit_id, arg_min(material_type, stratum_id) AS material_type, arg_min(description, stratum_id) AS representative, min(depth_top) AS min_depth_top, max(depth_top) AS max_depth_top, min(depth_bottom) AS min_depth_bottom, max(depth_bottom) AS max_depth_bottom,
      round(avg(depth_bottom - depth_top), 6) AS avg_thickness, count(*) AS n_strata, count(DISTINCT borehole_id) AS n_boreholes FROM member JOIN ranked USING (leader) GROUP BY 1""", SIGNATURES.rstrip().rstrip(",")),
    "borehole_summary": parsed("SELECT borehole_id, count(*) AS n_strata, max(depth_bottom) AS depth, count(DISTINCT formation) AS n_formations, CAST(sum(CASE WHEN is_valid THEN 1 ELSE 0 END) AS BIGINT) AS n_valid FROM p GROUP BY 1"),
    "region_filter": f"{POINTS} o AS (SELECT 1) SELECT id, borehole_id, mid_depth FROM pt WHERE x BETWEEN 12.5 AND 62.5 AND y BETWEEN 0 AND 50 AND mid_depth BETWEEN 2 AND 20",
    "unit_geometry": f"{POINTS} o AS (SELECT 1) SELECT id, format('{{:.2f}}', round(x, 2)) AS x_coord, format('{{:.2f}}', round(y, 2)) AS y_coord, format('{{:.2f}}', round(z, 2)) AS z_coord, format('{{:.2f}}', round(thickness, 2)) AS thickness_text, format('{{:.2f}}', round(mid_depth, 2)) AS mid_depth_text, format('{{:.2f}}', round(pz, 2)) AS elevation, round(atan2(y - 10.0e0, x - 20.0e0), 6) AS bearing FROM pt",
    "knn": f"{POINTS} n AS (SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY {D3}, b.id) AS rank, b.id AS neighbour_id, {D3} AS distance FROM pt a JOIN pt b ON a.borehole_id <> b.borehole_id AND {D3} <= 15) SELECT id, CAST(rank AS INT) AS rank, neighbour_id, round(distance, 6) AS distance FROM n WHERE rank <= 5",
    "distance_matrix": f"{POINTS} o AS (SELECT 1) SELECT a.id AS i, count(*) AS n, round(sum({D3}), 6) AS total, round(max({D3}), 6) AS furthest FROM pt a CROSS JOIN pt b GROUP BY 1",
    "pair_stats": f"{POINTS} d AS (SELECT {D3} AS distance FROM pt a JOIN pt b ON a.id < b.id) SELECT round(min(distance), 6) AS min_distance, round(max(distance), 6) AS max_distance, round(avg(distance), 6) AS mean_distance, count(*) AS n_pairs FROM d",
    "centroid_variance": f"{POINTS} o AS (SELECT 1) SELECT round(avg(px), 6) AS cx, round(avg(py), 6) AS cy, round(avg(pz), 6) AS cz, round(var_pop(px) + var_pop(py) + var_pop(pz), 6) AS spatial_variance FROM pt",
    "idw_weights": f"{POINTS} a AS (SELECT 30.0e0 AS px, 20.0e0 AS py, 95.0e0 AS pz), w AS (SELECT b.id, {D3} AS distance FROM pt b CROSS JOIN a) SELECT id, round(distance, 6) AS distance, round(1 / pow(distance, 2) / sum(1 / pow(distance, 2)) OVER (), 9) AS weight FROM w",
    "idw_vote": parsed(f"SELECT target_id, CASE WHEN {SOIL} >= {ROCK} THEN 'soil' ELSE 'rock' END AS material, round({SOIL}, 6) AS soil_weight, round({ROCK}, 6) AS rock_weight FROM nb GROUP BY 1", f"{MATERIALS}{TARGETS}{NEAR_TARGETS}"),
    "nearest_material": parsed("SELECT target_id, arg_min(material_type, (distance, b_id)) AS material FROM nb GROUP BY 1", f"{MATERIALS}{TARGETS}{NEAR_TARGETS}"),
    "interpolation_quality": parsed("""SELECT target_id, round(exp(-nearest_distance / 50) * CASE WHEN variance < 0.1 THEN 0.9 WHEN variance < 0.25 THEN 0.7 ELSE 0.4 END, 6) AS confidence, round(nearest_distance, 6) AS nearest_distance, num_neighbours, round(variance, 6) AS variance FROM (
      SELECT target_id, min(distance) AS nearest_distance, count(*) AS num_neighbours, avg(CASE WHEN material_type = 'soil' THEN 1.0e0 ELSE 0.0e0 END) * (1 - avg(CASE WHEN material_type = 'soil' THEN 1.0e0 ELSE 0.0e0 END)) AS variance FROM nb GROUP BY 1)""", f"{MATERIALS}{TARGETS}{NEAR_TARGETS}"),
    "loo_cv": parsed(f"SELECT CAST(correct AS DOUBLE) / total AS accuracy, correct, total FROM (SELECT count(*) FILTER (WHERE (CASE WHEN s >= r THEN 'soil' ELSE 'rock' END) = material_type) AS correct, count(*) AS total FROM (SELECT id, any_value(own) AS material_type, {SOIL} AS s, {ROCK} AS r FROM nn GROUP BY 1))", f"{MATERIALS} nn AS (SELECT a.id, a.material_type AS own, b.material_type, {D3} AS distance FROM mats a JOIN mats b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY distance, b.id) <= 3)"),
    "dbscan_labels": f"{POINTS} {DBSCAN} o AS (SELECT 1) SELECT id, label FROM labels",
    "cluster_sizes": f"{POINTS} {DBSCAN} o AS (SELECT 1) SELECT label, count(*) AS n_points FROM labels WHERE label >= 0 GROUP BY 1",
    "silhouette": f"{POINTS} {DBSCAN} {SILHOUETTE} SELECT round(v, 6) AS silhouette FROM sil",
    "davies_bouldin": f"{POINTS} {DBSCAN} {BOULDIN} SELECT round(v, 6) AS davies_bouldin FROM dbi",
    "calinski_harabasz": f"{POINTS} {DBSCAN} {CALINSKI} SELECT round(v, 4) AS calinski_harabasz FROM chi",
    "cluster_grade": f"{POINTS} {DBSCAN} {SILHOUETTE}, {BOULDIN}, {CALINSKI}, g AS (SELECT CASE WHEN s.v > 0.5 THEN 1 ELSE 0 END + CASE WHEN d.v < 1 THEN 1 ELSE 0 END + CASE WHEN c.v > 100 THEN 1 ELSE 0 END AS n FROM sil s, dbi d, chi c) SELECT (SELECT count(DISTINCT label) FROM labels WHERE label >= 0) AS num_clusters, (SELECT count(*) FROM labels WHERE label = -2) AS num_noise, CASE n WHEN 0 THEN 'poor' WHEN 1 THEN 'fair' WHEN 2 THEN 'good' ELSE 'excellent' END AS grade FROM g",
    "boundary_uncertainty": f"""{POINTS} nr AS (SELECT a.id, b.depth_top AS t, b.depth_bottom AS u, {D2} AS d, CASE WHEN {D2} < 1e-10 THEN 1000 ELSE 1 / {D2} END AS w FROM pt a JOIN pt b ON a.borehole_id <> b.borehole_id AND {D2} <= 13),
      mn AS (SELECT id, sum(w) AS sw, sum(w * t) / sum(w) AS mt, sum(w * u) / sum(w) AS mu, count(*) AS n, min(d) AS d FROM nr GROUP BY 1),
      vr AS (SELECT id, sum(w * (t - mt) * (t - mt)) / any_value(sw) AS vt, sum(w * (u - mu) * (u - mu)) / any_value(sw) AS vu FROM nr JOIN mn USING (id) GROUP BY 1),
      z AS (SELECT pt.*, mn.n, mn.d, mt, mu, vt, vu FROM pt LEFT JOIN mn USING (id) LEFT JOIN vr USING (id))
      SELECT id, coalesce(n, 0) AS n_nearby, round(coalesce(mt, depth_top), 6) AS top_mean, round(coalesce(mt - 1.96 * sqrt(vt) / sqrt(n), depth_top - 2), 6) AS top_lower, round(coalesce(mt + 1.96 * sqrt(vt) / sqrt(n), depth_top + 2), 6) AS top_upper,
      round(coalesce(mu - mt, thickness), 6) AS thickness_mean, round(coalesce(mu - mt + 1.96 * sqrt(vt + vu) / sqrt(n), thickness + 1), 6) AS thickness_upper, round(coalesce(0.3 + 0.4 * least(1.0, n / 5.0) + 0.3 * exp(-d / 30), 0.2), 6) AS quality FROM z""",
    "similarity_ratio": parsed("SELECT w.w AS word, v.w AS term, levenshtein(w.w, v.w) AS distance, round(1 - levenshtein(w.w, v.w) / CAST(greatest(strlen(w.w), strlen(v.w)) AS DOUBLE), 6) AS ratio FROM words w CROSS JOIN (SELECT w FROM vocab WHERE kind = 'word') v", "words AS (SELECT DISTINCT lower(token) AS w FROM tk0)"),
    "closest_match": parsed("SELECT word, option, round(score, 6) AS score FROM (SELECT w.w AS word, v.w AS option, 1 - levenshtein(w.w, v.w) / CAST(greatest(strlen(w.w), strlen(v.w)) AS DOUBLE) AS score FROM words w CROSS JOIN (SELECT w, ord FROM vocab WHERE kind = 'word') v QUALIFY row_number() OVER (PARTITION BY w.w ORDER BY score DESC, v.ord) = 1)", "words AS (SELECT DISTINCT lower(token) AS w FROM tk0)"),
    "spelling_index": parsed(f"SELECT word, option, round(score, 6) AS score FROM (SELECT w.w AS word, v.w AS option, 1 - levenshtein(w.w, v.w) / CAST(greatest(strlen(w.w), strlen(v.w)) AS DOUBLE) AS score FROM words w CROSS JOIN (SELECT w, ord FROM vocab WHERE kind = 'word') v WHERE strlen(w.w) BETWEEN 3 AND 15 AND w.w[1] = v.w[1] AND contains('{vocab.FUZZY_FIRST}', w.w[1]) AND abs(strlen(w.w) - strlen(v.w)) <= 3 AND score >= {vocab.FUZZY_THRESHOLD} QUALIFY row_number() OVER (PARTITION BY w.w ORDER BY score DESC, v.ord) = 1)", "words AS (SELECT DISTINCT lower(token) AS w FROM tk0)"),
    "ags_inspect": parsed("SELECT concat('site', CAST(floor(CAST(substr(borehole_id, 3) AS INT) / 10) AS INT), '.ags') AS path, borehole_id AS id, min(x) AS easting, min(y) AS northing, max(depth_bottom) AS final_depth, count(*) AS n_strata, CAST(sum(CASE WHEN is_valid THEN 1 ELSE 0 END) AS BIGINT) AS n_valid FROM p GROUP BY borehole_id"),
    "ags_validate": f"WITH strata AS ({STRATA_SQL}) SELECT DISTINCT concat('site', CAST(floor(CAST(substr(borehole_id, 3) AS INT) / 10) AS INT), '.ags') AS path, true AS is_valid, CAST(0 AS INT) AS n_issues FROM strata",
    "csv_results": parsed("SELECT stratum_id, description, material_type, coalesce(primary_soil_type, '') AS primary_soil_type, coalesce(primary_rock_type, '') AS primary_rock_type, coalesce(regexp_replace(CAST(s_lower AS VARCHAR), '\\.0$', ''), '') AS strength_lower, coalesce(regexp_replace(CAST(s_typical AS VARCHAR), '\\.0$', ''), '') AS strength_typical, coalesce(s_units, '') AS strength_unit, format('{:.3f}', confidence) AS confidence, CAST(is_valid AS VARCHAR) AS is_valid, '' AS other FROM p"),
}
