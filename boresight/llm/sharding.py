"""Sharding by a k-d tree over metadata.

All rows start in one node that is to become `leaves` leaves. A node of several leaves is split across the dimension in which
its rows reach widest (of the whole table's range), at the weighted median of their bytes (or, for an odd number of leaves, at
that share of them), until each leaf has the target bytes. Medians are found by histograms: bytes are summed by node and bucket
of the splitting key, and only the bucket where the cut falls is divided again.

The splitting key is (value in the dimension, hash of the text), and copies of a text share the least metadata among them, so a
group of copies lies at one point and a cut between two texts keeps it whole. A group is only cut when it is itself too large for a near equal split; then by a hash of the
row's id and place.

What comes to the driver is a row for each node of a level, so at most `leaves`; it goes back as a table that is joined.

Defined cases: null text: size 1, the hash of the empty text; null metadata: below all values; equal rows: spread by their
place in the stored table; an empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .mixing import SMALL_ROWS, hash60, small

#: A group of copies may move a cut by so much of a leaf's bytes.
TOLERANCE = 0.002
VALUE_BITS, TEXT_BITS, ROW_BITS, LEVEL_BITS = 20, 40, 30, 15
SLOT_ROWS = 100_000


def told(rows: DataFrame, nodes: dict[int, tuple], fields: str, how: str = "inner") -> DataFrame:
    """rows with what is known of their nodes; fields: names and types, the node's first. The table is built in the JVM from one literal."""
    names = [f.split(":")[0] for f in fields.split(",")]
    raw = json.dumps([dict(zip(names, (k, *v), strict=True)) for k, v in nodes.items()])
    table = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(raw), f"array<struct<{fields}>>")))
    return rows.join(F.broadcast(table) if len(nodes) <= SMALL_ROWS else table, F.col("node") == F.col(names[0]), how)


def cuts(rows: DataFrame, want: dict[int, float], bits: int) -> dict[int, tuple[int, float, float]]:
    """rows: node, size, _k. Per node the key value _k in which its wanted bytes fall, the bytes below that value, and the bytes at it."""
    prefix, below, found = dict.fromkeys(want, 0), dict.fromkeys(want, 0.0), {}
    for shift in range(bits - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = told(rows, {n: (p, float(want[n] - below[n])) for n, p in prefix.items()}, "_n:long,_prefix:long,_left:double")
        inside = inside.where(F.shiftright("_k", shift + LEVEL_BITS) == F.col("_prefix"))
        sums = inside.groupBy("node", F.shiftright("_k", shift).alias("bucket")).agg(F.sum("size").alias("bytes"), F.min("_k").alias("least"), F.max("_k").alias("most"), F.first("_left").alias("_left"))
        sums = sums.withColumn("upto", F.sum("bytes").over(Window.partitionBy("node").orderBy("bucket")))
        mark = F.struct("bucket", "bytes", "upto", "least", "most")
        hit = sums.groupBy("node").agg(F.min_by(mark, F.when(F.col("upto") > F.col("_left"), F.col("bucket"))).alias("hit"), F.max_by(mark, "bucket").alias("last"))
        for r in hit.collect():
            x = r["hit"] or r["last"]
            below[r["node"]] += x["upto"] - x["bytes"]
            if x["least"] == x["most"] or shift == 0:
                found[r["node"]] = (x["least"] if shift else x["bucket"], below[r["node"]], x["bytes"])
                prefix.pop(r["node"])
            else:
                prefix[r["node"]] = x["bucket"]
        if not prefix:
            break
    return found


def kd_shards(docs: DataFrame, dimensions: dict[str, Column], leaves: int | None = None, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard (0 .. leaves - 1) and slot (gapless in a shard). leaves, or as many as target_bytes asks for."""
    whole = F.coalesce(F.col(text), F.lit(""))
    dims = list(dimensions)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(whole), 64 - TEXT_BITS).alias("_text"),
        F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.monotonically_increasing_id()), 64 - ROW_BITS).alias("_row"), *[dimensions[d].cast("double").alias(f"_d{i}") for i, d in enumerate(dims)],
    )
    # copies of a text take the least metadata among them, so that all of a group lies at one point; a text of one row has its own
    points = [f"_d{i}" for i in range(len(dims))]
    rows = common.stored(rows, "points")
    groups = rows.groupBy(F.col("_text").alias("_g")).agg(F.min(F.struct(*points)).alias("_point"), F.count("*").alias("_copies")).where("_copies > 1")
    groups = small(common.stored(groups.select("_g", "_point"), "groups"))  # where they are many, Spark deals a hot text's rows to several tasks
    own = [F.when(F.col("_point").isNotNull(), F.col("_point")[p]).otherwise(F.col(p)).alias(p) for p in points]
    rows = rows.join(groups, F.col("_text") == F.col("_g"), "left").select("doc_id", "size", "text_crc32", "_text", "_row", *own)
    rows = common.stored(rows, "points")
    whole_table = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *[f(f"_d{i}").alias(f"{f.__name__}{i}") for i in range(len(dims)) for f in (F.min, F.max)]).first()
    total, n = whole_table["bytes"] or 0, whole_table["n"]
    leaves = leaves or max(1, -(-total // target_bytes))
    low = [whole_table[f"min{i}"] or 0.0 for i in range(len(dims))]
    span = [((whole_table[f"max{i}"] or 0.0) - low[i]) or 1.0 for i in range(len(dims))]
    scaled = [F.coalesce((F.col(f"_d{i}") - low[i]) / span[i], F.lit(-1e-9)) for i in range(len(dims))]
    top = (1 << VALUE_BITS) - 1
    keys = [F.shiftleft(F.greatest(F.lit(0), F.least(F.lit(top), F.floor(x * (top - 1)) + 1)).cast("long"), TEXT_BITS) + F.col("_text") for x in scaled]
    # node: the first leaf below it; many: how many leaves are below it
    rows, many = rows.withColumn("node", F.lit(0).cast("long")), {0: leaves}
    while n and any(k > 1 for k in many.values()):
        reach = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[(F.max(x) - F.min(x)).alias(f"w{i}") for i, x in enumerate(scaled)]).collect()
        bytes_of = {r["node"]: r["bytes"] for r in reach}
        split = {r["node"]: max(range(len(dims)), key=lambda i, r=r: r[f"w{i}"]) for r in reach if many[r["node"]] > 1}
        want = {k: bytes_of[k] * (many[k] // 2) / many[k] for k in split}
        keyed = told(rows, {k: (d + 1,) for k, d in split.items()}, "_m:long,_dim:int", "left").withColumn("_k", F.element_at(F.array(*keys), F.coalesce("_dim", F.lit(1)))).drop("_m")
        found = cuts(keyed.where("_dim is not null"), want, VALUE_BITS + TEXT_BITS)
        edge, deep = {k: value for k, (value, _, _) in found.items()}, {}
        for k, (_, below, here) in found.items():
            slack = TOLERANCE * bytes_of[k] / many[k]
            if want[k] - below <= slack:
                deep[k] = 0
            elif below + here - want[k] <= slack:
                deep[k] = 1 << ROW_BITS
        if inner := {k: want[k] - found[k][1] for k in found if k not in deep}:
            group = told(keyed, {k: (edge[k],) for k in inner}, "_m:long,_edge:long").where("_k = _edge")
            for k, (value, below, here) in cuts(group.select("node", "size", F.col("_row").alias("_k")), inner, ROW_BITS).items():
                deep[k] = value + (below + below + here <= 2 * inner[k])
        placed = told(keyed, {k: (edge[k], deep[k], many[k] // 2) for k in split}, "_m:long,_edge:long,_deep:long,_half:long", "left")
        right = F.col("_m").isNotNull() & ((F.col("_k") > F.col("_edge")) | ((F.col("_k") == F.col("_edge")) & (F.col("_row") >= F.col("_deep"))))
        rows = common.stored(placed.select(*[c for c in rows.columns if c != "node"], F.when(right, F.col("node") + F.col("_half")).otherwise(F.col("node")).alias("node")), "points")
        many = {k: v for k, v in many.items() if v == 1} | {x: y for k in split for x, y in ((k, many[k] // 2), (k + many[k] // 2, many[k] - many[k] // 2))}
    rows = rows.withColumnRenamed("node", "shard").withColumn("_part", F.pmod(F.col("_row"), F.lit(max(8, n // (leaves * SLOT_ROWS) + 1))))
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    counts = counts.select(F.col("shard").alias("_s"), F.col("_part").alias("_p"), (F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_first"))
    order = Window.partitionBy("shard", "_part").orderBy("_row", "doc_id", "text_crc32")
    rows = rows.join(counts, (F.col("shard") == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return rows.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_first") + F.row_number().over(order) - 1).cast("long").alias("slot"))


def place(column: str) -> Column:
    """A categorical column as a number from 0 to 1."""
    return F.when(F.col(column).isNotNull(), hash60(F.col(column)) / F.lit(float(1 << 60)))
