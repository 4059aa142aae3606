import collections
import functools
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boresight.llm import common, gridjoin, jaccard, lm, mixing, neighbours, packing, quality, queries, secrets, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, gram string, _b int"
WORD = "[^\x20\x09-\x0d]+"


def prose(r, n):
    return " ".join(r.choice(["the", "soil", "of", "firm", "river", "and", "stone", "laid", "over", "deep", "bed", "wet"]) + r.choice(["", "", ".", ","]) + r.choice(["", "", "s"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    base = prose(r, 120)
    out = []
    for i in range(60):
        words = base.split()
        for _ in range(i % 5):
            words[r.randrange(len(words))] = f"w{r.randrange(1000)}"
        out.append((i, " ".join(words) if i % 3 == 0 else prose(r, r.randint(1, 80)), "en", f"s{i % 4}" if i % 9 else None, i, 1.0, "g", 7))
    out += [(60 + i, base, "de", "hot", None, 1.0, "g", 7) for i in range(40)]  # copies
    out += [(100, None, None, None, None, None, None, None), (101, "", "en", "s1", 0, 0.0, "", 0), (102, " \n\t ", "en", "s1", 3, 0.0, "", 0), (103, "two words", "en", "s1", 9, 0.0, "", 0), (104, "TWO  words", "en", "s1", 9, 0.0, "", 0)]
    out += [(105, prose(r, 30_000), "en", "s2", 1, 0.0, "", 0), (106, "x" * 200_000, "en", "s2", 1, 0.0, "", 0), (None, base, "en", "s3", 1, 0.0, "", 0), (7, out[7][1], "en", "s3", 1, 0.0, "", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_sets(rows, n):
    out = []
    for row in rows:
        w = re.findall(WORD, lowered(row[1]))
        out.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    return out


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_against_all_pairs(docs, rows, n, percent):
    sets = shingle_sets(rows, n)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(row[0], least.get(find(i), row[0]))
    want = sorted((row[0] if row[0] is not None else -1, len(sets[i]), least[find(i)] if sets[i] else row[0]) for i, row in enumerate(rows))
    got = jaccard.near_duplicates(docs, n, percent).collect()
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in got) == want


def test_keep_one(docs, rows):
    kept = jaccard.keep_one(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(i for i in ids if i is not None) == sorted({i for i in ids if i is not None})
    assert 60 not in ids and 100 in ids and 101 in ids and None in ids
    assert jaccard.keep_one(docs.limit(0)).count() == 0 and jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_tells_rows_of_an_id_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (1, a), (2, a + " more"), (3, "other words alone in this text"), (4, b + " x"), (5, ""), (5, None), (1, a + " tail"), (None, a)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["text"][:2] if r["text"] else "") for r in kept if r["doc_id"] is not None) == [(1, "a0"), (1, "b0"), (3, "ot"), (5, ""), (5, "")] and sum(r["doc_id"] is None for r in kept) == 1


def test_jaccard_with_frequent_ngrams_dealt_to_several_tasks(spark):
    """Many sets that share a passage, near copies among them, against brute force."""
    r = random.Random(5)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for i in range(1500):
        words = passage + [f"v{r.randrange(40)}" for _ in range(3)] if i % 3 else list(rows[r.randrange(i)][1].split()) if i else passage
        rows.append((i, " ".join(words)))
    sets = shingle_sets(rows, 3)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {x["doc_id"]: x["component_id"] for x in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 80).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_packing(docs, rows, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    packed = packing.pack(packing.pieces(docs, path)).collect()
    pieces = collections.defaultdict(list)
    for p in packed:
        pieces[p["doc_id"]].append(p)
    assert len(packed) == sum(-(-(len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1) // 4096) for r in rows)
    for row in rows:
        ids = plain.encode(row[1] or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[row[0]], key=lambda p: p["piece"])[:: 2 if row[0] == 7 else 1]
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in own]).tolist() == ids and [p["start"] for p in own] == [4096 * k for k in range(len(own))]
    by = collections.defaultdict(list)
    for p in packed:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert len(by) <= -(-sum(p["length"] for p in packed) // 4096) + 2
    assert packing.pack(packing.pieces(docs.limit(0), path)).count() == 0
    joined = packing.sequences(spark.createDataFrame(packed)).first()
    assert len(joined["ids"]) == 4 * sum(n for _, n in by[joined["sequence_id"]])


def test_special_tokens_are_told_by_case():
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["Two <|ENDOFTEXT|> Words", "<|StartOfText|>", "A<|endoftext|>B, <|STARTOFTEXT|>X", "<|startoftext|> É Plain\tTEXT <| C |>", "NOTHING special", "", None, "(<|EndOfText|>)\x0b<|Other|> É<|endoftext|>Ä"]
    ids, sizes = packing.encode(path, pa.array(texts), 1)
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_sum_of_squares_places_where_squares_grow_least():
    r = random.Random(3)
    sizes = [r.randint(1, 30) for _ in range(400)]
    where, gaps = packing.sum_of_squares(np.array(sizes), 30), []
    for size, seq in zip(sizes, where, strict=True):
        def squares(g):
            return sum(c * c for k, c in collections.Counter(g).items() if 0 < k < 30)

        options = {k: squares([*gaps[:k], g - size, *gaps[k + 1 :]]) for k, g in enumerate(gaps) if g >= size}
        options[len(gaps)] = squares([*gaps, 30 - size])
        gaps = [*gaps, 30] if seq == len(gaps) else gaps
        assert options[seq] == min(options.values())
        gaps[seq] -= size


def test_secrets(spark):
    hexes, mixed = "4f9a0c1d2b3e58679a0b", "aB3xK9mQ2pLr7TzW4vNy8sD1"
    texts = [
        f"é password = '{mixed}' AKIA{'Q7' * 8} tail", f"token:short token={'abc123' * 3} {hexes}", f"see {mixed}, or x{mixed}y", "550e8400-e29b-41d4-a716-446655440000", "4785380592391139", None, "", "token=secret: abcdefghijklmnop",
        "API_KEY=\"" + "k" * 12 + '" apikey:' + "z" * 11, "the quick brown fox " * 2000, hexes * 2 + "\n" + hexes, "AKIAEXAMPLE", "a" * 60,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in secrets.scan(df).select("doc_id", secrets.joined("_base").alias("b"), secrets.joined("_spans").alias("s")).collect()}
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(texts):
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t or "") if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 16]
        assert got[i]["b"] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
    assert "entropy_base64:4:28" in got[2]["s"] and got[3]["s"] == "" and "entropy" not in got[4]["s"] and "entropy" not in got[0]["s"]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[0] == "é [SECRET]' [SECRET] tail" and clean[5] is None and clean[9] == texts[9]
    assert secrets.redact(df).columns == df.columns and secrets.scan(df.limit(0)).count() == 0


def test_secrets_that_resemble_harmless_text(spark):
    """A harmless word or two slashes inside a key do not hide it, nor do letters alone; harmless text stays."""
    r = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    key = lambda n, a=letters + "0123456789": "".join(r.choice(a) for _ in range(n))
    keys = [key(20) + "//" + key(18), key(11) + "//" + key(27), key(400) + "//" + key(1500) + "//" + key(90), key(40, letters), key(33, letters), letters[:9] + key(30)]
    texts = [f"é {k} end" for k in keys] + [f"see sample_key={key(40)}", f"your_token-{key(30)} x", "deadbeef" + key(40, "0123456789abcdef")]
    harmless = [
        "550e8400-e29b-41d4-a716-446655440000", "47853805-92391139-12345", "the-quick-brown-fox-jumps-over", "some/quite/long/path/to/file_12", "//Some/Quite/Long/Path/To/Files/abc",
        "EXAMPLEexample_sampleDummy", "G" * 40, "xX" * 30, "qwertyuiop1234567890klmnopqrst", "g" * 60, "x-" * 20_000, "y" * 50_000,
    ]
    df = spark.createDataFrame(list(enumerate(texts + harmless)), "doc_id int, text string")
    clean = {row["doc_id"]: row["text"] for row in secrets.redact(df).collect()}
    # windows at a key's ends may lie under the threshold
    assert [clean[i] for i in range(len(keys)) if not re.fullmatch(r"é \S{0,12}\[SECRET\]\S{0,12} end", clean[i])] == []
    assert all("[SECRET]" in clean[i] and not re.search("[A-Za-z0-9]{16}", clean[i]) for i in range(len(texts))) and clean[6].startswith("see sample") and clean[7].startswith("your_")
    assert [clean[len(texts) + i] for i in range(len(harmless))] == harmless


def test_window_entropy(spark):
    alphabet, window, bits = secrets.CLASSES["entropy_base64"]
    r = random.Random(8)
    tokens = ["".join(r.choice(r.choice([alphabet, "abc1"])) for _ in range(r.randint(20, 60))) for _ in range(60)]
    hot = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.hot_windows(F.col("t"), alphabet, window, bits).alias("h")).collect()
    for row in hot:
        t = row["t"]
        over = [k for k in range(len(t) - window + 1) if -sum(c / window * math.log2(c / window) for c in collections.Counter(t[k : k + window]).values()) >= bits - 1e-9]
        assert tuple(row["h"]) == ((over[0], over[-1] + window) if over else (-1, -1))


def test_mixing(docs, rows, tmp_path):
    found = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(WORD, t or ""))
    total = collections.Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    assert sum(r["size"] for r in found) == sum(total.values()) and len(found) == len(rows)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in found)
    targets = {r["source_size"]: r["target"] for r in found}
    assert sum(targets[total[s]] for s in total) == pytest.approx(sum(total.values()))
    assert all(t <= 3 * s + 1e-9 for s, t in targets.items())
    for s in total:
        taken = sum(r["taken"] for r in found if r["source_size"] == total[s])
        largest = max([r["size"] for r in found if r["source_size"] == total[s]])
        assert abs(taken - targets[total[s]]) <= 2 * largest
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    names = ("doc_id", "size", "source_size", "target", "taken")
    want = [tuple(r) for r in db.sql(queries.ORACLE_SQL["op5_mixing"]).select(*names).fetchall()]
    assert sorted(want, key=repr) == sorted([tuple(r[n] for n in names) for r in found], key=repr)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == sum(r["copies"] for r in found)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_sharding(docs, rows):
    dims = {"length": F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1.0), "source": sharding.place("source")}
    light = docs.where("doc_id is null or doc_id not in (105, 106)")
    got = sharding.kd_shards(light, dims, leaves=4).collect()
    load, slots = collections.Counter(), collections.defaultdict(list)
    texts = collections.defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1] or "")
    for r in got:
        assert any(r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) for t in texts[r["doc_id"]])
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(load) == {0, 1, 2, 3} and max(load.values()) - min(load.values()) <= 2 * max(r["size"] for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(rows) - 2
    assert sharding.kd_shards(docs.limit(0), dims, leaves=4).count() == 0 and sharding.kd_shards(docs, dims, leaves=1).count() == len(rows)


def test_sharding_cuts_at_weighted_medians(spark):
    """The tree against a plain one: each cut along the widest dimension, as near the wanted bytes as whole texts allow; many leaves."""
    r = random.Random(12)
    rows = [(i, "x" * r.randint(0, 300) + str(i % 900), r.random() * 5, r.random()) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a double, b double")
    got = {x["doc_id"]: x["shard"] for x in sharding.kd_shards(df, {"a": F.col("a"), "b": F.col("b")}, leaves=6).collect()}
    size, point = {i: len(t) + 1 for i, t, _, _ in rows}, {}
    for _, t, a, b in rows:
        point[t] = min(point.get(t, (a, b)), (a, b))
    low, span = [min(p[d] for p in point.values()) for d in (0, 1)], [max(p[d] for p in point.values()) - min(p[d] for p in point.values()) for d in (0, 1)]
    at = {i: [(point[t][d] - low[d]) / span[d] for d in (0, 1)] for i, t, _, _ in rows}

    def check(first, leaves):
        """The shards first .. first + leaves - 1 are one node: its cut parts them along the widest dimension."""
        if leaves == 1:
            return
        ids, left = [i for i, s in got.items() if first <= s < first + leaves], [i for i, s in got.items() if first <= s < first + leaves // 2]
        right = set(ids) - set(left)
        wide = max((0, 1), key=lambda d: max(at[i][d] for i in ids) - min(at[i][d] for i in ids))
        assert max(at[i][wide] for i in left) <= min(at[i][wide] for i in right) + 1e-5
        assert abs(sum(size[i] for i in left) - sum(size[i] for i in ids) * (leaves // 2) / leaves) <= 700
        check(first, leaves // 2), check(first + leaves // 2, leaves - leaves // 2)

    check(0, 6)
    many = collections.Counter(x["shard"] for x in sharding.kd_shards(df, {"a": F.col("a"), "b": F.col("b")}, target_bytes=2000).collect())
    assert len(many) == -(-sum(size.values()) // 2000) and sum(many.values()) == 1500


def test_mixing_of_repeated_ids(spark):
    """A source made of one id, or of equal rows, comes as near to its target as any; reruns agree."""
    rows = [(1, "a b c d e f g h i j", "one")] * 30 + [(1, f"w{i} " * 10, "one") for i in range(20)] + [(2, "x y z", "two")] * 40 + [(i, "q " * (i % 7), "three") for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).cache()
    found = mixing.mix(df).collect()
    for name in ("one", "two", "three"):
        size = sum(len(t.split()) for _, t, s in rows if s == name)
        own = [r for r in found if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5, name
    assert sorted(map(tuple, mixing.mix(df).collect())) == sorted(map(tuple, found))
    assert mixing.mixed(df).count() == sum(r["copies"] for r in found)


VECTORS = "vec_id long, embedding array<float>, label int, uid string, q double"


@pytest.fixture(scope="module")
def vectors(spark):
    g = np.random.default_rng(0)
    base = g.normal(size=(300, 24)).astype("f4")
    base[100:160] = base[100] + 0.05 * g.normal(size=(60, 24))
    base[200:240] = base[200]  # equal
    base[250] = 2 * base[200]
    rows = [(i, v.tolist(), 0, "u", 0.0) for i, v in enumerate(base)]
    rows += [(300, None, 0, "u", 0.0), (301, [0.0] * 24, 0, "u", 0.0), (302, [float("nan")] * 24, 0, "u", 0.0), (303, [None, *[1.0] * 23], 0, "u", 0.0), (304, [], 0, "u", 0.0)]
    return base.astype("f8"), spark.createDataFrame(rows, VECTORS)


def test_neighbours(vectors):
    base, df = vectors
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    found = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 300, 10):
        s = unit @ unit[q]
        order = [i for i in np.lexsort((np.arange(300), -np.round(s, 12))) if i != q][:5]
        assert len(found[q]) == 5 and all(score == pytest.approx(s[i], abs=1e-12) for i, score in found[q])
        hits += len(set(order) & {i for i, _ in found[q]})
    assert hits / 150 >= 0.9 and set(found) == set(range(0, 300, 10))
    assert [i for i, _ in found[210]] == [200, 201, 202, 203, 204]
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_among_near_copies(spark):
    """Cosines that single precision cannot tell apart, and scaled copies, where the smaller id comes first."""
    g = np.random.default_rng(3)
    base = (g.normal(size=64) + 1e-6 * g.normal(size=(400, 64))).astype("f8")
    base = np.concatenate([base, g.normal(size=64) * 2.0 ** g.permutation(np.arange(-60, 60))[:, None]])
    ids = g.permutation(len(base))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, base, strict=True)], "vec_id long, embedding array<double>").repartition(5)
    asked = {int(i): k for k, i in enumerate(ids) if i % 20 == 0}
    found = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    dot = lambda x, y: functools.reduce(lambda s, p: s + p, (x * y).T, np.zeros(len(base)))
    for q, k in asked.items():
        group = np.arange(400) if k < 400 else np.arange(400, len(base))
        score = dot(base, base[k]) / (np.sqrt(dot(base, base)) * np.sqrt(dot(base[k] + 0 * base, base[k])))
        want = [(int(ids[i]), float(score[i])) for i in sorted(group, key=lambda i: (-score[i], ids[i])) if i != k][:5]
        assert found[q] == want


def recall(df, base, asks):
    """The share of the five nearest, or of all there are, that are found, by query."""
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    found = collections.defaultdict(set)
    for r in neighbours.search(df, asks).collect():
        found[r["query_id"]].add(r["vec_id"])
    out = {}
    for q in [r["vec_id"] for r in df.where(asks).select("vec_id").collect()]:
        want = [i for i in np.argsort(-(unit @ unit[q]), kind="stable") if i != q][:5]
        out[q] = len(set(want) & found[q]) / max(1, len(want))
    return out


def test_neighbours_of_outliers_and_in_small_tables(spark):
    g = np.random.default_rng(5)
    frame = lambda base: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>").repartition(4)
    for n, width in ((1, 64), (4, 64), (20, 64), (12, 3), (6, 1)):
        base = g.normal(size=(n, width)) if width > 1 else np.arange(1.0, n + 1)[:, None]
        assert set(recall(frame(base), base, F.lit(True)).values()) <= {1.0} or n == 1, (n, width)
    base = np.concatenate([g.normal(size=(3, 64))[g.integers(0, 3, 3000)] + 0.1 * g.normal(size=(3000, 64)), g.normal(size=(60, 64))])
    got = recall(frame(base), base, F.expr("vec_id >= 3000 or vec_id % 50 = 0"))
    assert np.mean([r for q, r in got.items() if q >= 3000]) >= 0.95 and np.mean([r for q, r in got.items() if q < 3000]) >= 0.9


def test_neighbours_by_several_rotations(spark, monkeypatch):
    assert neighbours.lengths(50_000, 64) == [64] and neighbours.lengths(128 * 2048 + 1, 64) == [64, 1] and neighbours.lengths(10**9, 64) == [64, 64, 16]
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    monkeypatch.setattr(neighbours, "BROADCAST_BUCKETS", 100)
    assert neighbours.lengths(4000, 32) == [32, 2]
    assert neighbours.sure_from(32, (32, 2), 10) >= neighbours.sure_from(32, (32,), 10)
    g = np.random.default_rng(9)
    base = np.concatenate([np.repeat(g.normal(size=(390, 32)), 10, 0) + 0.15 * g.normal(size=(3900, 32)), g.normal(size=(100, 32))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(dict)
    for r in neighbours.search(df, F.expr("vec_id % 20 = 0 or vec_id >= 3980")).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    hits = {}
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -2
        hits[q] = len(set(np.argsort(-s)[:5]) & set(found)) / 5
        assert len(found) == 5 and all(v == pytest.approx(s[i], abs=1e-12) for i, v in found.items())
    assert len(got) == 219
    assert np.mean([h for q, h in hits.items() if q < 3900]) >= 0.95 and np.mean([h for q, h in hits.items() if q >= 3900]) >= 0.95


def test_grid_join(vectors):
    base, df = vectors
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    near = unit @ unit.T >= 0.95 - 1e-15
    got = {r["vec_id"]: r for r in gridjoin.near_duplicates(df).collect()}
    for i in range(300):
        todo, seen = [i], {i}
        while todo:
            fresh = set(np.flatnonzero(near[todo.pop()])) - seen
            seen |= fresh
            todo += fresh
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum() - 1, min(seen), min(seen) == i)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(300, 305))
    assert gridjoin.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("group_bytes", [1, 1 << 14, 1 << 20])
def test_grid_join_of_many_groups(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(gridjoin, "BLOCK", 64)
    monkeypatch.setattr(gridjoin, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(gridjoin, "PAIRS_PER_CORE", 1)
    g = np.random.default_rng(3)
    base = g.normal(size=(40, 16))[g.integers(0, 40, 1500)] + 0.28 * g.normal(size=(1500, 16)) * (g.random(1500) < 0.9)[:, None]
    got = {r["vec_id"]: r for r in gridjoin.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")).collect()}
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    root = gridjoin.roots(1500, [np.stack(np.nonzero(near))])
    assert [got[i]["n_links"] for i in range(1500)] == (near.sum(1) - 1).tolist()
    assert [got[i]["component_id"] for i in range(1500)] == root.tolist()


def test_classifiers(spark, tmp_path):
    r = random.Random(1)
    texts = [prose(r, r.randint(5, 120)) + (". You utter moron, scum" + ". " + prose(r, 20) if i % 4 == 0 else "") for i in range(600)]
    texts = [t.upper().replace(" ", "!! ") if i % 7 == 0 else t for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, lang string, label string, _t int")
    labels = spark.createDataFrame([(i, int(i % 7 != 0), int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    fm = quality.fit(docs, labels)
    for scored, truth in ((toxicity.score(docs, model), lambda i: i % 4 == 0), (quality.score(docs, fm), lambda i: i % 7 != 0)):
        held = [x for x in scored.collect() if x["doc_id"] < 600 and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
        assert sum(x["predicted"] == truth(x["doc_id"]) for x in held) / len(held) > 0.95
        assert scored.where("score between 0 and 1").count() == 602 and scored.columns[:5] == docs.columns
    found = toxicity.locate(docs.where("doc_id = 8"), model).collect()
    assert len(found) == 1 and "moron" in found[0]["words"]
    assert toxicity.score(docs, model, threshold=0.5).columns == docs.columns
    none = labels.limit(0)
    assert toxicity.score(docs, toxicity.fit(docs, none)).where("predicted = 1").count() == 0 and quality.score(docs, quality.fit(docs, none)).where("abs(score - 0.5) > 1e-9").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0 and quality.score(docs.limit(0), fm).count() == 0


def test_classifiers_on_odd_rows(spark, monkeypatch):
    """Long, empty and repeated rows, clashing names, numbers missing from metadata; the sample is bounded in bytes and rows."""
    r = random.Random(3)
    texts = [("you scum " if i % 3 == 0 else "good day ") + prose(r, 30) for i in range(200)] + [prose(r, 60_000) + " scum", "", None, "same scum"] + ["same"] * 4
    rows = [(i if i < 204 else 204, t, float(i % 3) if i % 10 else None, 7, 8.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n double, predicted int, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(205)], "doc_id long, quality int, toxic int")
    model, fm = toxicity.fit(docs, labels), quality.fit(docs, labels, metadata=("n",))
    for scored in (toxicity.score(docs, model), quality.score(docs, fm)):
        got = scored.collect()
        assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got) and len({x["score"] for x in got if x["doc_id"] == 204 and x["text"] == "same" and x["n"] == 1}) <= 1
    assert sum(x["predicted"] == (x["doc_id"] % 3 > 0) for x in quality.score(docs, fm).where("doc_id < 200").collect()) > 190
    sample, share = common.labelled_sample(docs, labels, "toxic", "doc_id", "text", (20, 30), 1 << 30)
    assert len(sample) <= 50 and set(share) == {0, 1} and 0 < share[0] < 1
    sizes = [len(t.as_py()) for t in common.labelled_sample(docs, labels, "toxic", "doc_id", "text", (500, 500), 5000)[0].column("_t")]
    assert 4000 < sum(sizes) <= 5000
    whole = [len(t.as_py()) for t in common.labelled_sample(docs, labels, "toxic", "doc_id", "text", (500, 500), 1 << 30)[0].column("_t")]
    assert max(whole) == max(len(t or "") for i, t in enumerate(texts) if zlib.crc32(str(rows[i][0]).encode()) % 5) and 0 in whole
    with pytest.raises(ValueError, match="metadata"):
        quality.score(docs, quality.fit(docs, labels, metadata=("score",)))


def test_factorisation_identity():
    g = np.random.default_rng(0)
    d = quality.WORDS + len(quality.STATISTICS)
    model = quality.Model(0.3, g.normal(size=d), g.normal(size=(d, quality.RANK)), np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)))
    stats = g.normal(size=(1, len(quality.STATISTICS)))
    place, value = np.array([3, 9]), np.array([0.5, 0.7])
    z, _ = quality.scores(model, np.array([0, 0]), place, value, stats)
    x, f = np.concatenate([value, np.clip(stats[0], -3, 3)]), np.concatenate([place, quality.WORDS + np.arange(len(quality.STATISTICS))])
    pairs = sum(x[i] * x[j] * model.factors[f[i]] @ model.factors[f[j]] for i in range(len(x)) for j in range(i))
    assert z[0] == pytest.approx(0.3 + x @ model.linear[f] + pairs)


@pytest.mark.parametrize(("order", "shard_bytes", "flush", "hot", "long"), [(2, 16 << 20, 2_500_000, 8, 64), (3, 16 << 20, 2_500_000, 8, 64), (3, 4000, 700, 40, 2), (2, 4000, 700, 40, 2)])
def test_language_model(docs, rows, monkeypatch, order, shard_bytes, flush, hot, long):
    """Against a plain model; with tiny shards, contexts dealt over several of them and short runs too."""
    import sys

    for name, value in (("SHARD_BYTES", shard_bytes), ("FLUSH", flush), ("HOT_SHARE", hot), ("LONG", long)):
        monkeypatch.setattr(lm, name, value)
    learn = [r for r in rows if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 != 1]
    split = lambda t: [*re.findall(WORD, lowered(t)), "</s>"]
    counts = collections.Counter(w for r in learn for w in split(r[1]))
    n, v = sum(counts.values()), len(counts)
    grams = {order: collections.Counter()}
    for r in learn:
        w = ["<s>"] * (order - 1) + split(r[1])
        grams[order].update(tuple(w[k : k + order]) for k in range(len(w) - order + 1))
    for level in range(order - 1, 0, -1):
        grams[level] = collections.Counter(g[1:] for g in grams[level + 1])

    def discounts(values):
        c = collections.Counter(values)
        return lm.discounts(np.array([c[k] for k in (1, 2, 3, 4)]))

    off = {level: discounts(g.values()) for level, g in grams.items()}
    take = lambda level, c: off[level][min(c, 3) - 1] if c else 0.0
    total, back = collections.Counter(), collections.Counter()
    for level, g in grams.items():
        for gram, c in g.items():
            total[level, gram[:-1]] += c
            back[level, gram[:-1]] += take(level, c)

    def p(gram):
        level = len(gram)
        below = p(gram[1:]) if level > 1 else 1 / (v + 1)
        key, c = (level, gram[:-1]), grams[level].get(gram, 0)
        return max(c - take(level, c), 0) / total[key] + back[key] / total[key] * below if total[key] else below

    start = ("of", "the", "soil")[: order - 1]
    assert sum(p((*start, w)) for w in counts) + p((*start, "never seen")) == pytest.approx(1)
    monkeypatch.setattr(sys.modules["boresight.llm.lm"], "OPEN_FILES", 20)
    got = collections.defaultdict(list)
    for r in lm.learn_and_score(docs, ~common.held_out("doc_id", 1), order=order).collect():
        got[r["doc_id"]].append(r)
    for row in rows:
        w, r = split(row[1]), got[row[0]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        w = ["<s>"] * (order - 1) + w
        assert r["score"] == pytest.approx(sum(math.log10(p(tuple(w[k : k + order]))) for k in range(len(w) - order + 1)))
    assert lm.learn_and_score(docs.limit(0), F.lit(True), order=order).count() == 0
    assert all(r["score"] == 0 and r["train_tokens"] == 0 for r in lm.learn_and_score(docs.limit(5), F.lit(False), order=order).collect())


def test_table_of_counts_beyond_32_bits(tmp_path):
    ctx, word, count = np.array([5, 5, 9], "u8"), np.array([1, 4, 2], "u4"), np.array([7_000_000_000, 254, 255])
    edge = np.array([0, 2])
    over = np.flatnonzero(count > 254)
    lm.put(f"file://{tmp_path}", "table2-0", [over, count[over], edge[:0], *[edge[:0]] * 4, ctx[edge], np.array([2, 3], "u4"), word, np.minimum(count, 255).astype("u1")])
    model = lm.Model(f"file://{tmp_path}", 4)
    times, total, off = lm.looked_up(model.arrays("table2", 0, lm.TABLE), np.array([5, 5, 7, 9, 9], "u8"), np.array([1, 4, 1, 2, 3]), np.array([0, 0.5, 0.6, 0.7]))
    assert times.tolist() == [7_000_000_000, 254, 0, 255, 0] and total.tolist() == [7_000_000_254, 7_000_000_254, 0, 255, 255] and off.tolist() == [1.4, 1.4, 0, 0.7, 0.7]
    for x in (np.array([0, 1, 1 << 40], "i8"), np.empty(0, "u4")):
        assert lm.unpacked(lm.packed(x), x.dtype.str, len(x)).tolist() == x.tolist()


def test_pipeline_stages(spark, docs, rows, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in (3, 5))) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, now, str(tmp_path)), "stage")
        assert out.columns == now.columns and out.dtypes == now.dtypes, name
        now = out
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert last.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect()), key=repr) == sorted(map(tuple, last.select("doc_id", "piece", "ids_crc32").collect()), key=repr)


def test_secrets_by_the_thousand(spark):
    """Time grows with the matches, not with their square; places are right beyond ASCII and with clashing column names."""
    r = random.Random(9)
    key = lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    lines = [f"é{i} password={key()} AKIA{'Q7' * 8} {key()} {i:016x} ü" for i in range(12_500)]
    text = "\n".join(lines)
    df = spark.createDataFrame([(1, text, "a", 2), (2, "no match", "b", 3)], "_base int, text string, _b string, _e int")
    began = time.time()
    clean = {row["_base"]: row["text"] for row in secrets.redact(df).collect()}
    found = secrets.scan(df, base="_found").select("_base", "_found", "_spans").where("_base = 1").first()
    assert time.time() - began < 90
    assert len(found["_found"]) == 37_500 and all(text[s["start"] : s["end"]].startswith(("password=", "AKIA", "0")) for s in found["_found"])
    assert clean[2] == "no match" and "password" not in clean[1] and clean[1].count("[SECRET]") >= 37_500 and re.sub(r"\S*\[SECRET\]\S*", "#", clean[1]).startswith("é0 # # # # ü\né1 # ")


def test_secrets_in_very_long_tokens(spark):
    """Long runs that allow-list patterns walk over exhaust no stack, in either scan."""
    texts = [unit * 100_000 + "1" for unit in ("a-", "/a", "a_")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for narrow in (True, False):
        assert {len(r["_spans"]) for r in secrets.scan(df, narrow=narrow).collect()} == {0}


def test_neighbours_of_extreme_size():
    """Vectors whose squares overflow or vanish have their cosines all the same, and others keep every bit of theirs."""
    g = np.random.default_rng(3)
    x = g.normal(size=(40, 8))
    uids = np.arange(40)
    row, at, score = neighbours.nearest(x[:5], x, uids, 4)
    plain = neighbours.dots(x[row], x[at]) / (np.sqrt(neighbours.dots(x[row], x[row])) * np.sqrt(neighbours.dots(x[at], x[at])))
    assert (plain == score).all()
    for size in (1e-170, 1e160):
        other, places, scores = neighbours.nearest(x[:5] * size, x * size, uids, 4)
        assert (other == row).all() and (places == at).all() and np.allclose(scores, score)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, now, str(tmp_path)), "stage")
        assert out.columns == now.columns and out.count() == 0, name
        now = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
