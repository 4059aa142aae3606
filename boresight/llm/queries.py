"""The contract queries of the training-data operators and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bytebpe, collocations, common, gridjoin, jaccard, lm, mixing, neighbours, packing, quality, secrets, sharding, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", common.held_out("doc_id", 0).alias("held_out"), "score", "predicted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    parts = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), narrow=True)  # as its SQL
    count = lambda kind: F.size(F.filter("_base", lambda s: s["rank"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined("_base").cast("binary"), 256).alias("base_sha256"), secrets.joined("_spans").alias("spans"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",))
    return quality.score(docs, model).select("doc_id", common.held_out("doc_id", 0).alias("held_out"), "score", "predicted")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dimensions = {"length": F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1.0), "source": sharding.place("source"), "lang": sharding.place("lang")}
    shards = sharding.kd_shards(docs, dimensions, leaves=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def op9_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridjoin.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.learn_and_score(table(spark, sf_dir, "documents"), ~common.held_out("doc_id", 1))
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    sha256 = lambda whole: hashlib.sha256(whole.encode()).hexdigest()
    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    rows = alignment.with_links(alignment.tokenise_digested(table(spark, sf_dir, "documents"), *paths, sha256, "groups_sha256", keep=["doc_id"]))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.phrases(table(spark, sf_dir, "documents"), longest=5, least=100)
    return collocations.best(collocations.scored(found, percent=100), most=2000)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bytebpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    hashed = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    rows = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), hashed.alias("ids_sha256"), "ids")
    return bytebpe.decode(rows, ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_packing": op2_packing, "op3_secrets": op3_secrets, "op4_ngram_jaccard": op4_ngram_jaccard, "op5_mixing": op5_mixing, "op6_quality": op6_quality, "op7_sharding": op7_sharding, "op8_neighbours": op8_neighbours, "op9_grid_join": op9_grid_join, "op10_lm_scoring": op10_lm_scoring, "op11_alignment": op11_alignment, "op12_collocations": op12_collocations, "op13_byte_bpe": op13_byte_bpe}
#: Words of a text, in DuckDB.
WORDS_SQL = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op3_secrets": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k(kind, rank, pattern, value) AS (VALUES ('assign', 0, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 12), ('access', 1, '(AKIA[A-Z0-9]+)', 18), ('hex', 2, '([0-9a-f]{16,})', 16), ('run', 3, '([A-Za-z0-9+/=_-]{20,})', 20)),
c AS (SELECT rid, kind, rank, value, t, string_split_regex(t, pattern) AS gaps, regexp_extract_all(t, pattern) AS hits, regexp_extract_all(t, pattern, 1) AS groups FROM d CROSS JOIN k WHERE regexp_matches(t, pattern)),
h AS (SELECT rid, kind, rank, value, hits[i] AS hit, groups[i] AS part,
    CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM c)),
base AS (SELECT rid, kind, rank, start, start + length(hit) AS stop FROM h WHERE rank < 3 AND length(part) >= value),
runs AS (SELECT *, row_number() OVER () AS id, regexp_full_match(hit, '[0-9a-fA-F]+') AS is_hex FROM h WHERE rank = 3 AND regexp_matches(hit, '[0-9]')
    AND NOT regexp_matches(hit, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|^[0-9_/=+-]+$|//|^/(?:[A-Za-z]+/)+|^[a-z]+(?:[-_/][a-z]+)*[-_/]?[0-9]{1,4}$')
    AND NOT regexp_matches(hit, '(?i)example|sample|dummy|placeholder|change_?me|redacted|your_|xxxx|0{8}|deadbeef|abcdefghij|klmnopqrst|0123456789|1234567890|qwertyuiop')),
win AS (SELECT id, pos, substr(CASE WHEN is_hex THEN lower(hit) ELSE hit END, pos + 1, 20) AS w FROM (SELECT *, unnest(range(0, length(hit) - 19)) AS pos FROM runs)),
ent AS (SELECT id, pos, -sum(n / 20.0 * log2(n / 20.0)) AS bits FROM (SELECT id, pos, ch, count(*) AS n FROM (SELECT id, pos, unnest(string_split(w, '')) AS ch FROM win) GROUP BY ALL) GROUP BY ALL),
hot AS (SELECT runs.rid, CASE WHEN is_hex THEN 'entropy_hex' ELSE 'entropy_base64' END AS kind, CASE WHEN is_hex THEN 3 ELSE 4 END AS rank, any_value(start) + min(pos) AS start, any_value(start) + max(pos) + 20 AS stop
    FROM ent JOIN runs USING (id) WHERE bits >= CASE WHEN is_hex THEN 3.0 ELSE 3.8 END - 1e-9 GROUP BY runs.id, runs.rid, is_hex),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM hot WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = hot.rid AND b.start <= hot.start AND b.stop >= hot.stop)),
j AS (SELECT rid, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (WHERE rank < 3) AS base,
    count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (rid)
""",
    "op4_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.replace("text,", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),")} AS l FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 3], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 3, 1) + 1)) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.root), w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY w.doc_id
""",
    "op9_grid_join": """
WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
""",
    "op12_collocations": r"""
WITH w AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS l FROM documents),
t AS (SELECT lang, CAST(sum(len(l)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, m, array_to_string(l[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, l, unnest(range(1, len(l) + 1)) AS i FROM w) CROSS JOIN (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(l)),
c AS (SELECT lang, m, phrase, count(*) AS a, string_split(phrase, ' ') AS p FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
k AS (SELECT lang, m, phrase, a, k, array_to_string(p[1:k], ' ') AS head, array_to_string(p[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c WHERE m > 1)),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, t.n, CAST(CAST(1000 AS HUGEINT) * k.a * t.n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
    FROM k JOIN c x ON x.lang = k.lang AND x.phrase = k.head JOIN c y ON y.lang = k.lang AND y.phrase = k.tail JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(p[1:m - 1], ' ') AS phrase, a FROM c WHERE m > 2 UNION ALL SELECT lang, array_to_string(p[2:], ' ') AS phrase, a FROM c WHERE m > 2) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b LEFT JOIN o USING (lang, phrase)
WHERE longer IS NULL OR 100 * longer < 100 * a QUALIFY rank <= 2000
""",
    "op5_mixing": rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len({WORDS_SQL}), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h, substr(md5(coalesce(text, '')), 1, 15) AS g FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
f AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS full_at FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
    - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), coalesce((SELECT arg_min(level, full_at) FROM l WHERE level <= full_at), CAST('inf' AS DOUBLE)) * weight) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(least(3, floor(target / source_size)) AS BIGINT) ELSE 0 END AS passes FROM t),
r AS (SELECT *, target - CAST(passes * source_size AS DOUBLE) AS rest FROM p),
c AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.passes, r.rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    d.size AS here FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(least(3, passes + CASE WHEN upto + upto - here <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c
""",
}
