"""Near duplicates of embeddings by an epsilon grid order join.

Vectors are brought to unit length, where a cosine of at least `cosine` means a distance of at most eps. They are projected on the
LEAD leading principal dimensions, filed in grid cells of side eps there, and sorted by cell, dimension after dimension. The sequence
is cut into blocks of BLOCK vectors and these into groups of consecutive blocks, the largest intervals. Two intervals whose boxes in the
leading dimensions lie more than eps apart have no links and are never brought together. So groups are paired first; a pair of groups is one
task, to which each block that lies near the other group is sent once, whatever the number of blocks it meets there; pairs of blocks,
then of halves of them, are left out by their boxes in the same way, down to LEAF vectors, which are compared by one matrix product in
double precision. The join is exact. A group holds GROUP_BYTES of vectors at most (one block at least), and fewer where tasks would lie idle.

Equal vectors are one entry with a count, so a third of the table may be one vector. A pair of groups returns a count of links and
one root for each vector, never the pairs, so a dense cluster makes no more rows than it has vectors for each pair of groups.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing; shorter vectors count as padded
with zeros; a row's own other occurrences count as other vectors; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import components as graph
from . import common
from .neighbours import matrix, unit, usable

LEAD, BLOCK, LEAF = 4, 4096, 256
#: Bytes of the vectors of a group of blocks, two of which a task holds, and the pairs of groups wanted for each core.
GROUP_BYTES, PAIRS_PER_CORE = 16 << 20, 2


def principal(entries: DataFrame, width: int) -> np.ndarray:
    """The LEAD leading principal dimensions of the unit vectors (width x LEAD), from sums that tasks make of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                x = unit(matrix(batch.column("vector").slice(start, 4096), width))
                n, total, outer = n + len(x), total + x.sum(0), outer + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary()), pa.array([outer.tobytes()], pa.binary())], names=["n", "total", "outer"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        sums = [sum(np.frombuffer(x) for x in frame[k]).tobytes() for k in ("total", "outer")]
        return pd.DataFrame({"n": [frame["n"].sum()], "total": sums[:1], "outer": sums[1:]})

    parts = entries.select("vector").mapInArrow(common.tidy(run), "n long, total binary, outer binary")
    # in two steps, so that no task adds up more than about the root of the number of tasks
    parts = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("g").applyInPandas(lambda f: add(f), "n long, total binary, outer binary")
    found = add(parts.toPandas())  # 32 rows
    n = max(1, int(found["n"][0]))
    mean, outer = np.frombuffer(found["total"][0]) / n, np.frombuffer(found["outer"][0]).reshape(width, width) / n
    return np.linalg.eigh(outer - np.outer(mean, mean))[1][:, ::-1][:, :LEAD]


def joined(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, eps: float, cosine: float, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """Begin in a, begin in b and the hits of every pair of leaves not provably apart. p, q: places in the leading dimensions. same: a is
    b, and only pairs with the first before the second are told."""
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        if same and m <= i:
            continue  # below the diagonal
        low = np.maximum(p[i:j].min(0) - q[k:m].max(0), q[k:m].min(0) - p[i:j].max(0))
        low = np.maximum(low, 0)
        if (low * low).sum() > eps * eps:
            continue
        if j - i <= LEAF and m - k <= LEAF:
            near = a[i:j] @ b[k:m].T
            hits = near >= cosine
            # where rounding could tell, the cosine is taken pair by pair
            for y, x in np.argwhere(np.abs(near - cosine) < 1e-12):
                hits[y, x] = float(np.dot(a[i + y], b[k + x])) >= cosine
            if same and k < j and i < m:
                hits &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
            if hits.any():
                yield i, k, hits
        elif j - i >= m - k:
            stack += [(i, (i + j) // 2, k, m), ((i + j) // 2, j, k, m)]
        else:
            stack += [(i, j, k, (k + m) // 2), (i, j, (k + m) // 2, m)]


def roots(n: int, edges: list[np.ndarray]) -> np.ndarray:
    """The least node each of n nodes is joined with by edges (arrays of two rows)."""
    root = np.arange(n)
    if not edges:
        return root
    u, v = np.concatenate(edges, 1)
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, least), np.minimum.at(new, v, least)
        np.minimum.at(new, root[u], least), np.minimum.at(new, root[v], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compared(left: dict, right: dict, same: bool, axes: np.ndarray, eps: float, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The links of each vector of two blocks, and a forest of (vector, root) that brings together what is linked. The vectors of right are
    numbered after those of left, unless the blocks are the same."""
    a, b = unit(left["x"]), unit(right["x"])
    links = [np.zeros(len(a), "i8"), np.zeros(len(b), "i8")]
    shift, edges = 0 if same else len(a), []
    for i, k, hits in joined(a, b, a @ axes, b @ axes, eps + 1e-9, cosine, same):
        r, c = hits.shape
        links[0][i : i + r] += hits @ right["m"][k : k + c]
        links[1][k : k + c] += left["m"][i : i + r] @ hits
        y, x = np.nonzero(hits)
        if len(y) > r + c:  # a forest of the leaf does for the rest
            forest = roots(r + c, [np.stack([y, x + r])])
            node = np.flatnonzero(forest != np.arange(r + c))
            ends = np.stack([node, forest[node]])
            edges.append(np.where(ends < r, ends + i, ends - r + k + shift))
        else:
            edges.append(np.stack([y + i, x + k + shift]))
    total = links[0] + links[1] if same else np.concatenate(links)
    root = roots(len(total), edges)
    node = np.flatnonzero(root != np.arange(len(root)))
    return total, np.stack([node, root[node]])


def gap(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> float:
    """The squared distance of two boxes."""
    part = np.maximum(np.maximum(low - high2, low2 - high), 0)
    return float((part * part).sum())


def near_duplicates(table: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    all_rows = table.select(F.col(vec_id).alias("vec_id"), F.when(usable(vector), F.col(vector)).alias("_v"))
    entries = all_rows.where("_v is not null").groupBy(F.col("_v").alias("vector")).agg(F.count("*").alias("m"), F.min("vec_id").alias("least"))
    entries = common.stored(entries.withColumn("uid", F.monotonically_increasing_id()), "entries")
    width = max(1, entries.agg(F.max(F.size("vector"))).first()[0] or 1)
    eps = float(np.sqrt(2 - 2 * cosine))
    axes = principal(entries, width)
    kind = "f4" if "float" in dict(entries.dtypes)["vector"] else "f8"

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                x = matrix(batch.column("vector"), width)
                grid = np.floor(unit(x) @ axes / eps).astype("i4")
                yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("m"), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), *[pa.array(grid[:, k]) for k in range(grid.shape[1])]], names=["uid", "m", "x", *[f"c{k}" for k in range(grid.shape[1])]])

    lead = [f"c{k}" for k in range(axes.shape[1])]
    placed = entries.select("uid", "m", "vector").mapInArrow(common.tidy(cells), "uid long, m long, x binary, " + ", ".join(f"{c} int" for c in lead))
    # the sequence: sorted by cell; a hash parts what lies in one cell, so that a full cell is spread over tasks too
    placed = placed.withColumn("h", F.xxhash64("uid"))
    ordered = placed.repartitionByRange(*lead, "h").sortWithinPartitions(*lead, "h").withColumn("_at", F.monotonically_increasing_id())
    ordered = common.stored(ordered.drop("h"), "sequence").withColumn("_p", F.shiftright("_at", 33))
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = sizes.select(F.col("_p").alias("_q"), (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_first"))  # a row a partition
    ranked = ordered.join(starts, F.col("_p") == F.col("_q"))
    ranked = ranked.withColumn("block", F.floor((F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))) / BLOCK))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_at")
        x = unit(np.stack([np.frombuffer(v, kind) for v in frame["x"]]).astype("f8")) @ axes
        row = {"block": frame["block"].iloc[0], "low": x.min(0).tolist(), "high": x.max(0).tolist(), "uid": frame["uid"].to_numpy().tobytes(), "m": frame["m"].to_numpy().tobytes(), "x": b"".join(frame["x"])}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    blocks = ranked.select("block", "_at", "uid", "m", "x").groupBy("block").applyInPandas(pack, "block long, low array<double>, high array<double>, uid binary, m binary, x binary")
    blocks = common.stored(blocks, "blocks")
    n, tasks = blocks.count(), PAIRS_PER_CORE * table.sparkSession.sparkContext.defaultParallelism
    size = max(1, min(GROUP_BYTES // (BLOCK * width * np.dtype(kind).itemsize), n // int(np.ceil(np.sqrt(2 * tasks)))))
    blocks = blocks.withColumn("own", F.floor(F.col("block") / size))
    corner = lambda f, box: F.array(*[f(F.get(box, F.lit(k))) for k in range(len(lead))])
    groups = common.stored(blocks.groupBy("own").agg(corner(F.min, "low").alias("low"), corner(F.max, "high").alias("high")), "groups")
    cell = lambda c, k: F.floor(F.get(c, F.lit(0)) / eps) + k
    one = groups.select(F.col("own").alias("g"), "low", "high", F.explode(F.sequence(cell("low", -1), cell("high", 1))).alias("cell"))
    two = groups.select(F.col("own").alias("h"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(F.sequence(cell("low", 0), cell("high", 0))).alias("cell"))
    apart = F.aggregate(F.zip_with(F.zip_with("low", "high2", lambda x, y: x - y), F.zip_with("low2", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, d: s + d * d)
    close = apart <= (eps + 1e-9) ** 2
    pairs = one.join(two, "cell").where((F.col("g") <= F.col("h")) & close).select("g", "h").distinct()
    # each block once for every pair of groups that it is needed in: places first, which are small, then what the blocks hold
    sides = pairs.select("g", "h", F.col("g").alias("own"), F.col("h").alias("other")).unionByName(pairs.where("g < h").select("g", "h", F.col("h").alias("own"), F.col("g").alias("other")))
    other = groups.select(F.col("own").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    sent = blocks.select("own", "block", "low", "high").join(sides, "own").join(other, "other").where(close).select("g", "h", "block")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("block").combine_chunks()
        g, h = group.column("g")[0].as_py(), group.column("h")[0].as_py()
        box = [np.array(group.column(c).to_pylist()) for c in ("low", "high")]
        own = group.column("own").to_numpy()
        uids, times, vectors = [[np.frombuffer(v.as_buffer(), t) for v in group.column(c)] for c, t in (("uid", "i8"), ("m", "i8"), ("x", kind))]
        first = np.cumsum([0, *map(len, uids)])
        held = lambda i: {"m": times[i], "x": vectors[i].reshape(-1, width).astype("f8")}
        links, edges = np.zeros(first[-1], "i8"), []
        for i in np.flatnonzero(own == g):
            left = held(i)
            for j in np.flatnonzero(own == h):
                if i <= j and gap(box[0][i], box[1][i], box[0][j], box[1][j]) <= (eps + 1e-9) ** 2:
                    total, forest = compared(left, left if i == j else held(j), i == j, axes, eps, cosine)
                    at = np.arange(first[i], first[i + 1]) if i == j else np.concatenate([np.arange(first[i], first[i + 1]), np.arange(first[j], first[j + 1])])
                    links[at] += total
                    edges.append(at[forest])
        root, told, uid = roots(len(links), edges), links > 0, np.concatenate(uids)
        out = pa.table({"uid": uid[told], "links": links[told], "root": uid[root][told]})
        common.give_back()
        return out

    met = sent.join(blocks, "block").groupBy("g", "h").applyInArrow(compare, "uid long, links long, root long")
    met = common.stored(met, "met")
    links = met.groupBy("uid").agg(F.sum("links").alias("links"))
    part_of = graph.components(met.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    known = entries.select("uid", "vector", "m", "least").join(links, "uid", "left").join(part_of.withColumnRenamed("node", "uid"), "uid", "left")
    known = common.stored(known.withColumn("component", F.coalesce("component", "uid")), "known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("vector", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = all_rows.join(known, F.col("_v") == F.col("vector"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
