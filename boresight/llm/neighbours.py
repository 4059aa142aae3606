"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors by three rounds of random signs and the fast Hadamard transform and files each under the signed axis it
lies nearest to; where that leaves more than CHUNK vectors a bucket in the mean, under the axes of several such rotations, the last of
them cut to its first dimensions. So buckets grow in number with the table and not in size. A query looks into the PROBES buckets
nearest to it in each of TABLES tables, by the sum over rotations of the squared shortfall from its own axis; all vectors filed there are
its candidates. Buckets are dealt out in chunks of CHUNK vectors, a query visits every chunk of a bucket, and each visit returns only
its best few, so that neither a hot bucket nor a popular one gathers in one task. A visit ranks by the exact cosine in double precision
on the vectors as given, ties by the smaller id, whatever a product of matrices cannot rule out by more than its rounding; so the
nearest of all that lie in the buckets are kept, however many near copies lie beside them.

Equal vectors are one entry with its smallest ids, as many as an answer can hold, so a third of the table may be one vector. Entries
are numbered in the order of their smallest ids.

How likely a table files a vector of a given cosine under a probed axis is simulated, and so the least cosine is known from which
all tables together find a vector with a probability of RECALL; it rises with the number of rotations. What a query has missed is no farther than the k-th it has found; if
that, or the lack of a k-th, does not reach this cosine, the query visits all buckets of one table, which compares all entries. So no
group of queries, outliers and queries of small tables included, falls short in the mean.

With these parameters a random table of 64 dimensions, where neighbours are hardly nearer than others, is searched with a recall of
0.97 at about half the work of comparing all; at larger tables fewer probes do where data have structure.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, as query or candidate; shorter
vectors count as padded with zeros; ties go to the smaller id; a repeated id is one more candidate with that id, though never its own
neighbour; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

TABLES, PROBES, CHUNK, SEED = 8, 10, 2048, 11
#: The probability with which the k-th nearest found would have been found, below which a query visits all entries.
RECALL = 0.95
#: The most buckets whose sizes are broadcast; more are joined.
BROADCAST_BUCKETS = 1_000_000
#: Pairs of vectors compared exactly at a time.
PAIRS = 65_536


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles, padded with zeros to width."""
    lists = lists.cast(pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, turn: int = 0) -> np.ndarray:
    signs = np.random.default_rng((SEED, table, turn) if turn else (SEED, table)).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def lengths(n: int, width: int) -> list[int]:
    """The dimensions kept of each rotation of a table, so that n entries leave CHUNK in a bucket in the mean at most."""
    kept, buckets = [width], 2 * width
    while n > CHUNK * buckets:
        kept.append(min(width, 1 << (-(-n // (2 * CHUNK * buckets)) - 1).bit_length()))
        buckets *= 2 * kept[-1]
    return kept


def probed(parts: list[np.ndarray], probes: int) -> np.ndarray:
    """For each row the probes buckets nearest to it: a signed axis of every part, as one number."""
    rows = len(parts[0])
    bucket, cost = np.zeros((rows, 1), "i8"), np.zeros((rows, 1))
    for part in parts:
        both = np.concatenate([part, -part], 1)
        m = min(probes, both.shape[1])
        axes = np.argpartition(-both, m - 1, axis=1)[:, :m]
        value = np.take_along_axis(both, axes, 1)
        short = (value.max(1, keepdims=True) - value) ** 2
        bucket = (bucket[:, :, None] * both.shape[1] + axes[:, None, :]).reshape(rows, -1)
        cost = (cost[:, :, None] + short[:, None, :]).reshape(rows, -1)
        if bucket.shape[1] > probes:
            best = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
            bucket, cost = np.take_along_axis(bucket, best, 1), np.take_along_axis(cost, best, 1)
    return bucket


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)  # first, so that squares neither overflow nor vanish
    x = x / top
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def levelled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near 1: cosines keep all their bits, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The dot product of each row of x with the same row of y, summed in order."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    return total


def nearest(asking: np.ndarray, lying: np.ndarray, uids: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of asking the best rows of lying by the exact cosine, ties to the smaller uid: row, place in lying and score."""
    asking, lying = levelled(asking), levelled(lying)
    near = unit(asking) @ unit(lying).T
    least = np.partition(near, -best, axis=1)[:, -best, None] if near.shape[1] > best else -np.inf
    row, at = np.nonzero(near >= least - 8 * (asking.shape[1] + 8) * np.finfo(float).eps)  # more than both roundings can differ by
    score = np.empty(len(row))
    for start in range(0, len(row), PAIRS):
        i, j = row[start : start + PAIRS], at[start : start + PAIRS]
        score[start : start + PAIRS] = dots(asking[i], lying[j])
    score /= np.sqrt(dots(asking, asking))[row] * np.sqrt(dots(lying, lying))[at]
    order = np.lexsort((uids[at], -score, row))
    row, at, score = row[order], at[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < best
    return row[kept], at[kept], score[kept]


def filed(entries: DataFrame, width: int, kept: list[int], probes: int) -> DataFrame:
    """uid, table, axis (the bucket) and the vector: one row for each of the probes nearest buckets in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                x = unit(matrix(batch.column("vector"), width))
                for t in range(TABLES):
                    axes = probed([rotated(x, t, turn)[:, :d] for turn, d in enumerate(kept)], probes)
                    rows = np.repeat(np.arange(len(x)), axes.shape[1])
                    yield pa.RecordBatch.from_arrays([batch.column("uid").take(pa.array(rows)), pa.array(np.full(len(rows), t, "i4")), pa.array(axes.ravel()), batch.column("vector").take(pa.array(rows))], names=["uid", "table", "axis", "vector"])

    return entries.select("uid", "vector").mapInArrow(common.tidy(run), f"uid long, table int, axis long, vector {dict(entries.dtypes)['vector']}")


@cache
def sure_from(width: int, kept: tuple[int, ...], probes: int) -> float:
    """The least cosine from which a vector lies in one of the probes nearest buckets of some table with a probability of RECALL."""
    if kept == (width,) and probes >= 2 * width:
        return -2.0
    g, n = np.random.default_rng(SEED), max(500, min(4000, (1 << 20) // width))
    pairs = []
    for _ in kept:
        q, side = unit(g.normal(size=(n, width))), g.normal(size=(n, width))
        pairs.append((q, unit(side - (side * q).sum(1, keepdims=True) * q)))
    visited = probed([q[:, :d] for (q, _), d in zip(pairs, kept, strict=True)], probes)
    for c in np.arange(100, -1, -1) / 100:  # from where it falls short on
        lies = probed([(c * q + np.sqrt(1 - c * c) * side)[:, :d] for (q, side), d in zip(pairs, kept, strict=True)], 1)
        if 1 - (1 - (visited == lies).any(1).mean()) ** TABLES < RECALL:
            return c + 0.01
    return 0.0


def search(table: DataFrame, queries: Column, k: int = 5, probes: int = PROBES, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found for every row of table that queries is true for."""
    rows = common.stored(table.where(usable(vector)).select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"), queries.alias("asks")), "vectors")
    dim = rows.agg(F.max(F.size("vector"))).first()[0]
    width = max(2, 1 << max(0, int(dim or 1) - 1).bit_length())
    # k + 1 ids of equal vectors are enough: an answer leaves out one at most. The limit is applied before the shuffle too.
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("_r") <= k + 1)
    entries = common.stored(first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).orderBy(F.get("ids", F.lit(0))).withColumn("uid", F.monotonically_increasing_id()), "entries")
    asked = rows.where("asks").select(F.col("id").alias("query_id"), F.col("vector").alias("_v"))
    asked = common.stored(asked.join(entries.select("uid", "vector"), F.col("_v") == F.col("vector")).select("query_id", "uid"), "asked")

    kept = lengths(entries.count(), width)
    probes = min(probes, 2 * width) if len(kept) == 1 else probes
    points = common.stored(filed(entries, width, kept, 1), "filed")
    # a row for each bucket; the more entries the more buckets, so they are broadcast only where they are few
    chunks = common.stored(points.groupBy(F.col("table").alias("_t"), F.col("axis").alias("_a")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "chunks")
    few = F.broadcast if chunks.count() <= BROADCAST_BUCKETS else lambda df: df
    points = points.join(few(chunks), (F.col("table") == F.col("_t")) & (F.col("axis") == F.col("_a")))
    points = points.select("uid", "vector", "table", "axis", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int").alias("chunk"))
    probing = filed(entries.join(asked.select("uid").distinct(), "uid", "left_semi"), width, kept, probes)
    probing = probing.join(few(chunks), (F.col("table") == F.col("_t")) & (F.col("axis") == F.col("_a")))
    best = k + 2  # the query's own entry, and one more that holds its id

    def visit(asking: pa.Table, lying: pa.Table) -> pa.Table:
        q, uids, out = asking.column("uid").to_numpy(), lying.column("uid").to_numpy(), [(np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0))]
        if len(q) and len(uids):
            points = matrix(lying.column("vector").combine_chunks(), width)
            for start in range(0, len(q), 1024):
                row, at, score = nearest(matrix(asking.column("vector").slice(start, 1024).combine_chunks(), width), points, uids, best)
                out.append((q[start + row], uids[at], score))
        return pa.table(dict(zip(("q", "uid", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    def visited(probing: DataFrame) -> DataFrame:
        """q, ids and score of the best entries that lie under the axes of probing."""
        keys, order = ("table", "axis", "chunk"), Window.partitionBy("q").orderBy(F.col("score").desc(), "uid")
        probing = probing.select("uid", "vector", "table", "axis", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        found = probing.groupBy(*keys).cogroup(points.groupBy(*keys)).applyInArrow(visit, "q long, uid long, score double").dropDuplicates(["q", "uid"])
        found = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= best)
        return found.join(entries.select("uid", "ids"), "uid").select("q", "ids", "score")

    def answers(scored: DataFrame) -> DataFrame:
        each = asked.withColumnRenamed("uid", "q").join(scored, "q").select("query_id", "q", "score", F.explode("ids").alias("vec_id"))
        return each.where(F.col("vec_id") != F.col("query_id"))

    scored = common.stored(visited(probing), "scored")
    kth = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id"))
    sure = answers(scored).withColumn("_r", kth).where((F.col("_r") == k) & (F.col("score") >= sure_from(width, tuple(kept), probes)))
    short = asked.join(sure.select("query_id", F.col("q").alias("uid")), ["query_id", "uid"], "left_anti").select("uid").distinct()
    short = common.stored(short, "short")
    everywhere = entries.select("uid", "vector").join(short, "uid").crossJoin(few(chunks.where("_t = 0").select(F.col("_t").alias("table"), F.col("_a").alias("axis"), "chunks")))
    scored = scored.join(short.withColumnRenamed("uid", "q"), "q", "left_anti").unionByName(visited(everywhere))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return answers(scored).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
