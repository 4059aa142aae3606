"""A deterministic table of strata made from the tables part and supplier, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Every second stratum has one of these, which between them reach each branch of the parser, the audits and the checks of compliance.
ODD = [
    "Firm loose sandy CLAY", "Soft SAND", "Very soft sandy GRAVEL", "Dense CLAY", "Slightly sandy slightly silty slightly gravelly very clayey SAND", "Stiff very sandy CLAY", "Firm sandy sandy silty CLAY",
    "Medium firm brown CLAY", "Moderately stiff silty CLAY", "Brown firm CLAY", "Firm CLAY slightly sandy", "Firm sandy CLAY with some gravel", "Stiff silty CLAY with a little sand", "Soft silty CLAY and a bit of peat",
    "Soft to stiff brown CLAY", "Firm to very stiff CLAY", "Quite firm CLAY", "Somewhat dense SAND", "Fairly dense silty SAND", "Firm CLAY with sand", "Firm CLAY with gravel", "Firm CLAY containing roots", "Dense SAND with traces of silt",
    "Stiff CLAY (LONDON CLAY (weathered) FORMATION)", "Dense SAND (a (b (c (d (e (f (g (h (i (j))))))))))", "Firm CLAY (unclosed and more", "Firm CLAY ()", "Firm CLAY x) (y))", "Stiff CLAY (one) (TWO)", "",
    "  ", "FILL", "fill: loose SAND", "Made ground - dense GRAVEL (LOCAL)", "Stiff " + "clay" * 17, "Strong fresh massive GRANITE", "Weak weathered fractured CHALK", "Very weak completely weathered SHALE",
    "Dense high plasticity SAND", "Firm organic CLAY", "Spongy PEAT", "Loose SAND and GRAVEL and COBBLES", "Stiff CLAY, with SAND.", "dense fine to medium sand", "Frim browm snady caly", "Sttiff grael and basallt", "stiff   silty  CLAY",
    "Non plastic SILT", "very dense COBBLES", "light grey moist stiff CLAY", "some sand", "Extremely strong QUARTZITE", "very sand", "moderately weathered strong jointed SANDSTONE", "Soft to firm low plasticity wet blue SILT", "hard very clayey very clayey SILT",
]
ODD_SQL = f"CASE CAST(floor(stratum_id / 2) % {len(ODD)} AS INT) " + " ".join(f"WHEN {k} THEN '{text}'" for k, text in enumerate(ODD)) + " END"

STRATA_SQL = f"""
WITH n AS (SELECT count(*) AS c FROM supplier),
k AS (SELECT p_partkey AS stratum_id, CAST(p_size AS BIGINT) AS s, CAST(p_partkey % c AS BIGINT) AS b,
             CAST(floor(p_partkey / CAST(c AS DOUBLE)) AS BIGINT) AS o FROM part CROSS JOIN n)
SELECT stratum_id, concat('BH', CAST(b AS VARCHAR(20))) AS borehole_id,
  CAST(o AS DOUBLE)*1.5e0 AS depth_top,
  CAST(o AS DOUBLE)*1.5e0 + 0.5e0 + CAST(stratum_id % 5 AS DOUBLE)*0.25e0 AS depth_bottom,
  CAST(b % 10 AS DOUBLE)*12.5e0 AS x, floor(CAST(b AS DOUBLE)/10.0e0)*12.5e0 AS y,
  100.0e0 - CAST(b % 7 AS DOUBLE)*0.5e0 AS z,
  CASE WHEN stratum_id % 2 = 0 THEN {ODD_SQL} ELSE concat(
    CASE WHEN stratum_id % 23 = 0 THEN 'MADE GROUND: ' WHEN stratum_id % 29 = 0 THEN 'Topsoil - ' ELSE '' END,
    CASE CAST((stratum_id * 7 + s) % 12 AS INT) WHEN 0 THEN 'Firm ' WHEN 1 THEN 'Stiff ' WHEN 2 THEN 'Dense '
      WHEN 3 THEN 'Medium dense ' WHEN 4 THEN 'Strong ' WHEN 5 THEN 'Soft to firm ' WHEN 6 THEN 'Frim '
      WHEN 7 THEN 'Moderately weak ' WHEN 8 THEN 'Very soft to soft ' WHEN 9 THEN 'Loose to medium dense '
      WHEN 10 THEN 'Very stiff ' ELSE '' END,
    CASE CAST((stratum_id * 3 + s) % 9 AS INT) WHEN 0 THEN 'brown ' WHEN 1 THEN 'dark grey ' WHEN 2 THEN 'slightly sandy '
      WHEN 3 THEN 'Very silty ' WHEN 4 THEN 'slightly weathered ' WHEN 5 THEN 'very clayey moist ' WHEN 6 THEN 'sandy gravelly '
      WHEN 7 THEN 'high plasticity ' ELSE 'fine to coarse ' END,
    CASE CAST((stratum_id + s) % 10 AS INT) WHEN 0 THEN 'CLAY' WHEN 1 THEN 'SAND' WHEN 2 THEN 'SAND and GRAVEL'
      WHEN 3 THEN 'LIMESTONE' WHEN 4 THEN 'SILT' WHEN 5 THEN 'CLAI' WHEN 6 THEN 'SANDSTONE' WHEN 7 THEN 'GRAVEL'
      WHEN 8 THEN 'PEAT' ELSE 'clay,' END,
    CASE WHEN stratum_id % 11 = 0 THEN ' (LONDON CLAY FORMATION)' ELSE '' END) END AS description
FROM k
"""


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = STRATA_SQL.replace("FROM supplier", "FROM {supplier}").replace("FROM part ", "FROM {part} ")
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("part", "supplier")}
    return spark.sql(sql, **tables)
