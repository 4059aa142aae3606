import math
import random

import pytest
from pyspark.sql import functions as F

from boresight.operators import clustering, components, spatial, uncertainty
from boresight.sources import ags, csvio, svg, xlsx
from boresight.streaming import descriptions

SCHEMA = "id long, borehole_id string, x double, y double, z double, depth_top double, depth_bottom double, material_type string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def cloud(spark):
    r = random.Random(2)
    rows = [(i, f"BH{i % 7}", r.choice([0, 30, 60]) + r.random() * 4, r.random() * 4, 100.0, float(i % 5), i % 5 + 1.0, r.choice(["soil", "rock"])) for i in range(90)]
    return rows, table(spark, rows)


def point(r):
    return (r[2], r[3], r[4] - (r[5] + r[6]) / 2)


def test_knn_and_loo_against_brute_force(cloud):
    rows, df = cloud
    got = {}
    for r in spatial.knn(df, 3, 5.0).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour_id"]))
    for a in rows:
        near = sorted((math.dist(point(a), point(b)), b[0]) for b in rows if b[1] != a[1] and math.dist(point(a), point(b)) <= 5.0)[:3]
        assert [n for _, n in sorted(got.get(a[0], []))] == [n for _, n in near]
    right = 0
    for a in rows:
        near = sorted((math.dist(point(a), point(b)), b[0], b[7]) for b in rows if b[0] != a[0])[:4]
        w = {"soil": 0.0, "rock": 0.0}
        for d, _, m in near:
            w[m] += 1 / d**2
        right += ("soil" if w["soil"] >= w["rock"] else "rock") == a[7]
    row = uncertainty.leave_one_out(df, 4).first()
    assert (row["correct"], row["total"]) == (right, len(rows))


def test_dbscan_against_walk(cloud):
    rows, df = cloud
    eps, least = 1.2, 3
    near = {a[0]: [b[0] for b in rows if b[0] != a[0] and math.dist(point(a), point(b)) <= eps] for a in rows}
    labels, cluster = {}, 0
    for i in sorted(near):
        if i in labels:
            continue
        if len(near[i]) < least:
            labels[i] = -2
            continue
        labels[i], queue = cluster, list(near[i])
        while queue:
            j = queue.pop(0)
            if labels.get(j, -2) == -2:
                grow = j not in labels and len(near[j]) >= least
                labels[j] = cluster
                queue += near[j] if grow else []
        cluster += 1
    found = spatial.dbscan(df, eps, least)
    assert {r["id"]: r["label"] for r in found.collect()} == labels
    m = spatial.metrics(df, found).first()
    assert m["num_clusters"] == cluster and -1 <= m["silhouette"] <= 1


def test_small_cases(spark):
    df = table(spark, [(1, "A", 0.0, 0.0, 100.0, 0.0, 2.0, "soil"), (2, "B", 10.0, 0.0, 100.0, 0.0, 2.0, "rock"), (3, "C", 5.0, 0.0, 100.0, 4.0, 6.0, "soil")])
    assert spatial.pair_stats(df.where("id < 3")).first()["mean_distance"] == 10
    w = {r["id"]: r["weight"] for r in spatial.idw_weights(df, 5.0, 0.0, 99.0).collect()}
    assert sum(w.values()) == pytest.approx(1) and w[1] == pytest.approx(w[2])
    assert {r["id"]: r["weight"] for r in spatial.idw_weights(df, 0.0, 0.0, 99.0).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    assert [r["id"] for r in spatial.region(df, (0, 5), (0, 0), (0, 3)).collect()] == [1]
    b = {r["id"]: r for r in uncertainty.boundary(df, 6.0).collect()}
    assert b[1]["n_nearby"] == 1 and b[1]["top_mean"] == 4 and b[2]["n_nearby"] == 1
    alone = uncertainty.boundary(df.where("id = 1"), 6.0).first()
    assert (alone["top_lower"], alone["thickness_upper"], alone["quality"]) == (-2.0, 3.0, 0.2)
    assert spatial.centroid(df.limit(0)).first()["spatial_variance"] == 0.0
    target = spark.createDataFrame([("t", 1.0, 0.0, 99.0)], "target_id string, px double, py double, pz double")
    assert spatial.interpolate(target, df, "nearest").first()["material"] == "soil"
    assert spatial.interpolate(target, df.limit(0), "idw").first()["material"] == "soil"
    assert uncertainty.interpolation_quality(target, df, 3).first()["num_neighbours"] == 3
    assert [uncertainty.z_score(x) for x in (0.99, 0.95, 0.9, 0.8, 0.5)] == [2.576, 1.96, 1.645, 1.282, 1.645]


def test_components_on_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_dendrogram():
    import numpy as np

    x = np.array([[0.0], [1.0], [5.0]])
    assert [m[2] for m in clustering.dendrogram(x, "single")] == [1, 4] and [m[2] for m in clustering.dendrogram(x, "average")] == [1, 4.5]
    assert clustering.one_hop(np.array([[0.0], [1.0], [2.0], [9.0]]), 1.0, 1).tolist() == [0, 0, 1, -1] and clustering.cut([], 1.0) == []


AGS = '"GROUP","PROJ"\n"HEADING","PROJ_ID","PROJ_NAME"\n"UNIT","",""\n"TYPE","ID","X"\n"DATA","P1","A ""quoted"" site"\n\n"GROUP","LOCA"\n"HEADING","LOCA_ID","LOCA_NATE","LOCA_GL"\n"DATA","BH1","10.5","bad"\n"DATA","BH1","",""\n\n"GROUP","GEOL"\n"HEADING","LOCA_ID","GEOL_TOP","GEOL_BASE","GEOL_DESC"\n"DATA","BH1","0.0","1.5","Firm CLAY (LONDON CLAY)"\n"DATA","BH1","1.5","2.0","Dense CLAY & <more>"\nloose row\n'


def test_ags_round_trip(spark, tmp_path):
    (tmp_path / "a.ags").write_text(AGS)
    found = ags.read(spark, str(tmp_path / "a.ags"))
    assert found["proj"].first()["name"] == 'A "quoted" site'
    assert [(r["easting"], r["ground_level"]) for r in found["loca"].orderBy("seq").collect()] == [(10.5, 0.0), (0.0, 0.0)]
    geol = found["geol"].orderBy("seq").collect()
    assert geol[0]["formation"] == "LONDON CLAY" and geol[1]["formation"] is None
    issues = ags.validate(ags.whole_files(spark, str(tmp_path / "a.ags"))).first()["issues"]
    assert sorted(issues) == sorted(["Rule 2: GROUP LOCA lacks one of the rows HEADING, UNIT and TYPE", "Rule 10: LOCA_ID more than once: 'BH1'", "Rule 5/6: a row does not begin with a quote", "Rule 2: GROUP GEOL lacks one of the rows HEADING, UNIT and TYPE", "Rule 14: there is no group TRAN"])
    ags.write(ags.enhanced(found), str(tmp_path / "out"))
    again = ags.read(spark, str(tmp_path / "out"))
    assert [r["description"] for r in again["geol"].orderBy("seq").collect()] == [r["description"] for r in geol]
    pictures = svg.logs(found["geol"], found["loca"]).collect()
    assert len(pictures) == 1 and "&lt;more&gt;" in pictures[0]["svg"] and pictures[0]["svg"].endswith("</svg>") and svg.first_borehole(found["loca"], found["geol"]) == "BH1"


def test_csv_and_xlsx(spark, tmp_path):
    (tmp_path / "in.csv").write_text('ID,description,Depth_Top,Depth_Bottom\n1," Firm ""grey"" CLAY ",0.0,1.0\n2,Dense SAND,x,2.0\n3\n')
    df = csvio.read_csv(spark, str(tmp_path / "in.csv"))
    done = csvio.with_results(df, csvio.CsvOptions(results=("consistency", "strength_lower", "confidence", "unheard")))
    assert [(r["ID"], r["consistency"], r["strength_lower"], r["confidence"], r["unheard"]) for r in done.collect()] == [("1", "firm", "25", "1.000", ""), ("2", "", "30", "1.000", "")]
    by_place = csvio.with_results(df, csvio.CsvOptions(column=1, results=("density",)))
    assert by_place.count() == 2
    with pytest.raises(ValueError):
        csvio.resolved(df, "none")
    ids = csvio.with_units(df, "ID", csvio.CsvOptions(depth_top="Depth_Top", depth_bottom="Depth_Bottom"))
    assert [(r["ID"], r["unit_id"]) for r in ids.collect()] == [("1", 1)]
    csvio.write_csv(done, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    xlsx.write_xlsx(done.select("ID", "description", "unheard", "confidence"), str(tmp_path / "a.xlsx"), "Lithology", True, True)
    back = xlsx.read_xlsx(spark, str(tmp_path / "a.xlsx"), "Lithology").orderBy("_row").collect()
    assert [(r["ID"], r["description"], r["confidence"]) for r in back] == [("1", 'Firm "grey" CLAY', "1.000"), ("2", "Dense SAND", "1.000")]
    assert xlsx.column_index("AB3") == 27 and xlsx.column_name(27) == "AB"
    (tmp_path / "t.txt").write_text("Firm CLAY\n\n  Dense SAND \n")
    assert csvio.read_lines(spark, str(tmp_path / "t.txt")).count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Firm CLAY\nDense CLAY\n")
    stream = descriptions.enriched(descriptions.read_lines(spark, str(tmp_path / "in")))
    assert stream.isStreaming
    query = descriptions.start(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2 and out.where(F.col("anomalies.has_anomalies")).count() == 1


def test_ags_rules_by_lines(spark):
    """The rules over lines in parts of any size are those of whole files."""
    r = random.Random(8)
    rows = ['"GROUP","PROJ"', '"GROUP","LOCA"', '"GROUP","TRAN"', '"GROUP"', '"GROUP","GEOL"', '"HEADING","LOCA_ID","X"', '"HEADING","X","LOCA_ID"', '"HEADING","Y"', '"UNIT",""', '"TYPE","ID"', '"DATA","A","B"', '"DATA","B","A"', '"DATA","","C"', '"DATA"', "loose", "", '  "DATA","Bé ""x"""\t', '"OTHER"']
    files = [(f"f{k}", "\n".join(r.choice(rows) for _ in range(r.randint(0, 25)))) for k in range(60)] + [("none", None)]
    df = spark.createDataFrame(files, "path string, content string")
    whole = {x["path"]: sorted(x["issues"]) for x in ags.validate(df).collect()}
    for lines in (4, 1000):
        assert {x["path"]: x["issues"] for x in ags.checked(ags.lines_of(df, lines)).collect()} == whole


def test_dense_cells_and_far_points(spark):
    """Half the points in one small field, some in one place, cut into pieces: as by comparing all."""
    r = random.Random(1)
    rows = [(i, r.uniform(0, 1) if i % 2 else r.uniform(0, 500), r.uniform(0, 1) if i % 2 else r.uniform(0, 300), r.uniform(0, 20)) for i in range(300)] + [(1000 + i, 3.0, 3.0, 1.0) for i in range(20)]
    p = spark.createDataFrame(rows, "id long, px double, py double, pz double")
    far = lambda a, b: math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2)
    got = {}
    for x in spatial.nearest(p, p, 3, unless=F.col("id") == F.col("b_id"), most=30).collect():
        got.setdefault(x["id"], []).append((x["rank"], x["b_id"]))
    assert {k: sorted(v) for k, v in got.items()} == {a[0]: [(k + 1, b[0]) for k, b in enumerate(sorted((b for b in rows if b[0] != a[0]), key=lambda b: (far(a, b), b[0]))[:3])] for a in rows}
    near = spatial.within(p, p, 4.0, most=30).select("id", "b_id").collect()
    assert sorted(map(tuple, near)) == sorted((a[0], b[0]) for a in rows for b in rows if far(a, b) <= 4.0)
    few = spatial.pairs_once(p, size=50).select("id", "b_id").collect()
    assert sorted(map(tuple, few)) == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0])
    assert "CartesianProduct" not in spatial.pair_stats(p.select("*", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"), F.lit(0.0).alias("depth_top"), F.lit(1.0).alias("depth_bottom")).drop("px", "py", "pz"))._jdf.queryExecution().executedPlan().toString()


def field(spark, n, seed=5):
    r = random.Random(seed)
    rows = [(i, f"B{i % 9}", r.uniform(0, 90), r.uniform(0, 60), 100.0, float(i % 7), i % 7 + 1.0, "soil") for i in range(n)]
    return rows, table(spark, rows)


def test_sums_of_distances_in_tiles(spark):
    rows, df = field(spark, 200)
    far = lambda a, b: math.dist(point(a), point(b))
    for size in (30, 16384):
        got = {x["i"]: (x["n"], x["total"], x["furthest"]) for x in spatial.distance_sums(df, size).collect()}
        assert got == {a[0]: (200, pytest.approx(sum(far(a, b) for b in rows)), pytest.approx(max(far(a, b) for b in rows))) for a in rows}
        every = [far(a, b) for a in rows for b in rows if a[0] < b[0]]
        assert tuple(spatial.pair_stats(df, size).first()) == pytest.approx((min(every), max(every), sum(every) / len(every), len(every)))
    assert spatial.distance_sums(df.where("id = 3")).first()[1:] == (1, 0.0, 0.0) and spatial.distance_sums(df.where("id < 0")).count() == 0
    assert tuple(spatial.pair_stats(df.where("id < 0")).first()) == (0.0, 0.0, 0.0, 0)
    gap = spark.createDataFrame([*rows[:3], (9, "B", None, 0.0, 1.0, 0.0, 1.0, "soil")], SCHEMA)
    assert spatial.pair_stats(gap).first()["n_pairs"] == 6 and {x["n"] for x in spatial.distance_sums(gap).collect()} == {4}


@pytest.mark.parametrize("n_labels", [1, 2, 25])
def test_cluster_measures_against_brute_force(spark, n_labels, monkeypatch):
    rows, df = field(spark, 160)
    r = random.Random(3)
    label = {a[0]: r.choice([-2, *range(n_labels)]) if n_labels < 3 or a[0] % 5 == 0 else int(a[2] // 18) + 5 * int(a[3] // 12) for a in rows} | {159: 77}
    labels = spark.createDataFrame(list(label.items()), "id long, label int")
    far = lambda a, b: math.dist(a, b)
    parts = {}
    for a in rows:
        if label[a[0]] >= 0:
            parts.setdefault(label[a[0]], []).append(point(a))
    values = []
    for k, own in parts.items():
        for a in own if len(own) > 1 and len(parts) > 1 else []:
            mean = {j: sum(far(a, b) for b in other) / (len(other) - (j == k)) for j, other in parts.items()}
            near = min(v for j, v in mean.items() if j != k)
            values.append((near - mean[k]) / max(near, mean[k]))
    asked = {}
    real = spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda rows, tag, **options: asked.setdefault(tag, real(rows, tag, **options)) if tag == "asked" else real(rows, tag, **options))
    assert spatial.silhouette(df, labels).first()[0] == pytest.approx(sum(values) / len(values) if values else 0.0)
    assert asked["asked"].count() <= sum(map(len, parts.values())) * len(parts)
    centre = {k: tuple(sum(c) / len(own) for c in zip(*own)) for k, own in parts.items()}
    s = {k: sum(far(a, centre[k]) for a in own) / len(own) for k, own in parts.items()}
    worst = [max((s[k] + s[j]) / far(centre[k], centre[j]) for j in parts if j != k) for k in parts]
    for size in (4, 16384):
        assert spatial.davies_bouldin(df, labels, size).first()[0] == pytest.approx(sum(worst) / len(worst))


def test_silhouette_leaves_out_far_clusters(spark, monkeypatch):
    """Clusters in a row: a point's distances are computed to a few of them, however many there are."""
    rows = [(3 * k + j, "B", 20.0 * k, j * 0.5, 0.0, 0.0, 1.0, "soil") for k in range(300) for j in range(3)]
    asked, real = [], spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda rows, tag, **options: [t := real(rows, tag, **options), asked.append(t) if tag == "asked" else None][0])
    value = spatial.silhouette(table(spark, rows), spark.createDataFrame([(a[0], a[0] // 3) for a in rows], "id long, label int")).first()[0]
    assert 0.9 < value < 1 and asked[0].count() <= 4 * len(rows)


def test_copied_rows_are_not_broadcast(spark):
    """Files of repeated values are small, but not the rows once copied for cells, levels and tiles."""
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    df = spatial.points(field(spark, 200)[1])
    assert "Broadcast" not in plan(spatial.within(df, df, 5.0)) and "Broadcast" not in plan(spatial.pairs_once(df))
    targets = df.select(F.col("id").alias("target_id"), "px", "py", "pz")
    assert "Broadcast" not in plan(spatial.interpolate(targets, df, "idw")) and "Broadcast" not in plan(uncertainty.interpolation_quality(targets, df, 3))


def test_rows_in_cut_cells_are_not_broadcast(spark, monkeypatch):
    """A list of cut cells may be broadcast if it is short; the rows, copied for the cells around them, never, however small their file."""
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    left = spatial.stored(spark.range(2).select(F.col("id").alias("a")), "left").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2999)))).withColumn("d", F.lit("x"))
    right = spatial.stored(spark.range(9000).select(F.col("id").alias("b"), (F.col("id") % 3000).cast("int").alias("c"), F.lit("x").alias("d")), "right")
    found = spatial.meeting(left, right, ["c", "d"], most=2)
    assert "BroadcastHashJoin" in plan(found) and "BuildLeft" not in plan(found)
    assert found.count() == found.select("a", "b").distinct().count() == 18000 and found.where("c <> b % 3000").isEmpty()
    monkeypatch.setattr(spatial, "FEW_CELLS", 10)
    many = spatial.meeting(left, right, ["c", "d"], most=2)
    assert "Broadcast" not in plan(many) and many.exceptAll(found).isEmpty() and found.exceptAll(many).isEmpty()


def test_more_rows_than_a_workbook_holds(spark, tmp_path, monkeypatch):
    """Every row comes back, in order, from workbooks none of which is too long."""
    rows = spark.range(95).select(F.col("id").alias("k"), F.when(F.col("id") % 9 == 0, None).otherwise(F.concat(F.lit("t"), "id")).alias("text")).repartition(5)
    books = xlsx.write_workbooks(rows, str(tmp_path / "many"), "k", "S", most=20).orderBy("name").collect()
    assert sum(b["n"] for b in books) == 95 and max(b["n"] for b in books) <= 20 and [b["start"] for b in books] == [sum(x["n"] for x in books[:i]) for i in range(len(books))]
    start = {b["name"]: b["start"] for b in books}
    monkeypatch.setattr(xlsx, "READ_ROWS", 7)
    back = {start[r["_path"].split("/")[-1]] + r["_row"]: (r["k"], r["text"]) for r in xlsx.read_xlsx(spark, str(tmp_path / "many"), "S").collect()}
    assert back == {k + 1: (str(k), "" if k % 9 == 0 else f"t{k}") for k in range(95)}
    same = spark.range(50).select(F.lit(1).alias("k"))  # one value of the order for all
    assert max(b["n"] for b in xlsx.write_workbooks(same, str(tmp_path / "same"), "k", most=20).collect()) == 20
    xlsx.write_workbooks(rows.where("k < 0"), str(tmp_path / "none"), "k", "S")
    assert xlsx.read_xlsx(spark, str(tmp_path / "none"), "S").count() == 0 and len(list((tmp_path / "none").glob("*.xlsx"))) == 1


def test_boundaries_meet_by_place(spark, monkeypatch):
    """Strata of a borehole at one place meet their neighbours once, together."""
    rows = [(20 * b + k, f"B{b}", 10.0 * b, 0.0, 100.0, float(k), k + 1.0 + b % 3, "soil") for b in range(4) for k in range(20)]
    kept, real = {}, uncertainty.stored
    monkeypatch.setattr(uncertainty, "stored", lambda rows, tag: kept.setdefault(tag, real(rows, tag)))
    got = {r["id"]: r for r in uncertainty.boundary(table(spark, rows), 12.0).collect()}
    assert kept["near"].count() == 6 and len(got) == 80
    for a in rows:
        near = [b for b in rows if b[1] != a[1] and abs(a[2] - b[2]) <= 12]
        mean = sum(b[5] for b in near) / len(near)
        half = 1.96 * math.sqrt(sum((b[5] - mean) ** 2 for b in near) / len(near)) / math.sqrt(len(near))
        assert got[a[0]]["n_nearby"] == len(near) and got[a[0]]["top_mean"] == pytest.approx(mean) and got[a[0]]["top_upper"] == pytest.approx(mean + half)
