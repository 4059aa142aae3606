"""The SQL of the contract queries gives the queries' rows on a made-up table."""

import random

import duckdb
import numpy as np
import pytest

from boresight.llm import queries, secrets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, path = random.Random(6), tmp_path_factory.mktemp("sf")
    alphabet = secrets.CLASSES["entropy_base64"][0]
    token = lambda a: "".join(r.choice(a) for _ in range(r.randint(12, 48)))
    base = [r.choice(["clay", "sand", "and", "firm", "the"]) + str(r.randrange(40)) for _ in range(60)]
    texts = []
    for i in range(80):
        words = list(base) if i % 4 == 0 else [r.choice(base) for _ in range(r.randint(0, 40))]
        for _ in range(i % 5):
            words.insert(r.randrange(len(words) + 1), r.choice([token(alphabet), token("0123456789abcdef"), "AKIA" + token("ABCDEFGH1234"), "Token: '" + token(alphabet), "password=" + token("abc1"), "é" + token("ab1")]))
        texts.append(" ".join(words))
    texts += ["", None, " \n", "one", "Two words"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")
    g = np.random.default_rng(1)
    v = g.normal(size=(120, 16)).astype("f4")
    v[40:60] = v[40] + 0.05 * g.normal(size=(20, 16))
    v[70:75] = v[70]
    vectors = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(120, None, 0), (121, [0.0] * 16, 0), (122, [float("nan")] * 16, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, folder, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, folder)
    want = db.sql(queries.ORACLE_SQL[name]).select(*[f'"{c}"' for c in got.columns]).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    if name == "op3_secrets":
        assert any("entropy_base64" in r[-1] for r in want) and any("access" in r[-1] for r in want)
