"""Every query with SQL of its own must give the same rows in DuckDB, on a small made-up part and supplier."""

import math

import duckdb
import pytest

from boresight.plans import oracle, queries, surfaces, surfaces_oracle


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, 1 + i * 7 % 50) for i in range(1, 161)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(i,) for i in range(1, 9)], "s_suppkey long").coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    db = duckdb.connect()
    for name in ("part", "supplier"):
        db.sql(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return str(folder), db


QUERIES, ORACLE = queries.QUERIES | surfaces.QUERIES, oracle.ORACLE_SQL | surfaces_oracle.ORACLE_SQL


def plain(rows):
    value = lambda v: round(v, 5) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, small, name):
    folder, db = small
    got = QUERIES[name](spark, folder)
    names = sorted(got.columns)
    want = db.sql(ORACLE[name])
    assert names == sorted(want.columns)
    assert plain(got.select(*names).collect()) == plain(want.select(*[f'"{n}"' for n in names]).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small[0]).count() > 0


def test_similar_pairs_lead_to_strata(spark, small):
    members = {r["stratum_id"]: r["first"] for r in queries.QUERIES["similar_members"](spark, small[0]).collect()}
    pairs = queries.QUERIES["similar_pairs"](spark, small[0]).collect()
    assert set(members) == {r["stratum_id"] for r in queries.QUERIES["unit_assignments"](spark, small[0]).collect()}
    assert pairs and {r[c] for r in pairs for c in ("a_first", "b_first")} <= {k for k, first in members.items() if k == first}


def broadcasts(spark, run):
    """The rows of each broadcast that run() makes, as Spark's own metrics tell them when all is done."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found, executions = [], store.executionsList()
    for k in range(before, executions.size()):
        number = executions.apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            if node.name() == "BroadcastExchange":
                metrics = [node.metrics().apply(j) for j in range(node.metrics().size())]
                found += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return found


@pytest.mark.parametrize("name", ["kriging", "idw_vote", "interpolation_quality", "interpolation_grades"])
def test_searches_broadcast_no_strata(spark, tmp_path, name):
    """However small the files: of a search for the nearest strata only the distinct texts, parsed, and single rows may be broadcast, in any of its steps."""
    spark.range(1, 4001).selectExpr("id AS p_partkey", "1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 201).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    texts = queries.strata(spark, str(tmp_path)).select("description").distinct().count()
    sent = broadcasts(spark, lambda: QUERIES[name](spark, str(tmp_path)).collect())
    assert texts < 1000 and sent and max(sent) <= texts
