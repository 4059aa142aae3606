"""Mixing sources to target weights by hash-threshold histograms.

Every row has a fixed 60-bit hash of its id (rows that share it: of the text, and of rows that share both: of the place). A source whose budget is r whole passes and a rest takes every row r times, and
those below a hash threshold once more. The threshold comes from histograms: tokens are summed by source and hash bucket, the
bucket in which the budget falls is found, and only that bucket is divided again, until a single hash value is left. Nothing
is sorted, and a smaller budget's rows are always among a larger one's.

Budgets: sources in order of their name's code points, null last, weigh 1, 2, 3, 1, ...; together they share `share` times all
tokens; no source gets more than `most` times its own tokens, and what it can't take goes to the others by weight.

Defined cases: a null text has no tokens and is taken 0; a null source is a source of its own, the last; rows with the same id
are told apart by text and then by place, so a source made of one repeated id comes as near to its target as any; a source without tokens has budget 0; an empty table gives an empty result. Other
columns, whatever their names, play no part. A hot source costs nothing: sums are combined before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

HASH_BITS, LEVEL_BITS = 60, 12
#: What orders the rows of a source: hashes of the id, of the text and of the place.
KEYS = ("h", "g", "r")
#: Rows of a table with a row per source that may be broadcast (of some 100 bytes each).
SMALL_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def hash60(column: Column) -> Column:
    """The first 15 hexadecimal digits of md5, a number from 0 to 2**60 - 1."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def budgets(sources: DataFrame, share: float = 1.0, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sources (source, source_size: a row each) with target. The windows run over one row per source, not over rows of text."""
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    at = sources.withColumn("weight", weight)
    # in order of the level at which a source is full: the level if it and all after it were not full
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    at = at.withColumn("full_at", (most * F.col("source_size")).cast("double") / F.col("weight").cast("double"))
    total = F.sum("source_size").over(everything).cast("double") * share
    at = at.withColumn("before", F.coalesce(F.sum(most * F.col("source_size")).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double"))
    at = at.withColumn("rest", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).cast("double")).withColumn("total", total)
    at = at.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"]
    target = F.least((most * F.col("source_size")).cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight").cast("double"))
    return at.select("source", "source_size", target.alias("target"))


def small(table: DataFrame) -> DataFrame:
    """table, marked for a broadcast if it has no more rows than SMALL_ROWS; a larger one is joined as Spark sees fit."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def fall(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows: source, size, key. wanted: source, rest (how many tokens to take). Returns source, rest, the key's value (prefix) where rest falls,
    and the tokens below it, the tokens and the rows (n) at it. Each level reads only the rows in the bucket where the budget falls."""
    at = wanted.select("source", F.col("rest"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = rows.join(small(at.select(F.col("source").alias("_s"), "prefix")), rows["source"].eqNullSafe(F.col("_s")) & (F.shiftright(rows[key], shift + LEVEL_BITS) == F.col("prefix")))
        sums = inside.groupBy("source", F.shiftright(key, shift).alias("bucket")).agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
        sums = sums.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")))
        found = sums.join(small(at.select(F.col("source").alias("_s"), "rest", "below")), F.col("source").eqNullSafe(F.col("_s")))
        # the first bucket whose end passes the budget; where the budget passes all, the last one
        past = F.col("below") + F.col("upto") > F.col("rest")
        bucket = F.struct("bucket", "upto", "tokens", "n")
        found = found.groupBy("source").agg(F.min_by(bucket, F.when(past, F.col("bucket"))).alias("hit"), F.max_by(bucket, "bucket").alias("last"), F.first("rest").alias("rest"), F.first("below").alias("below"))
        found = found.withColumn("hit", F.coalesce("hit", "last"))
        at = common.stored(found.select("source", "rest", F.col("hit.bucket").alias("prefix"), (F.col("below") + F.col("hit.upto") - F.col("hit.tokens")).alias("below"), F.col("hit.tokens").alias("tokens"), F.col("hit.n").alias("n")), "threshold")
    return at


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row per source with the threshold of each of KEYS (t_h, ...): the rows whose keys come before them, in order, come nearest to rest."""
    out, left = None, wanted.select("source", "rest")
    edges: list[str] = []
    for key in KEYS:
        at = fall(rows, left, key)
        if edges:
            at = at.join(small(left.select(F.col("source").alias("_s"), *edges)), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        nearer = F.col("below") + (F.col("below") + F.col("tokens")) <= 2 * F.col("rest")
        # what shares the key's value is parted by the next key
        last = F.lit(key == KEYS[-1]) | (F.col("n") <= 1)
        rest = [F.lit(0).cast("long").alias(f"t_{k}") for k in KEYS[len(edges) + 1 :]]
        settled = at.where(last).select("source", *edges, (F.col("prefix") + nearer.cast("long")).alias(f"t_{key}"), *rest)
        out = settled if out is None else out.unionByName(settled)
        left = common.stored(at.where(~last).select("source", *edges, F.col("prefix").alias(f"t_{key}"), (F.col("rest") - F.col("below")).alias("rest")), "shared")
        edges.append(f"t_{key}")
        if left.isEmpty():
            break
        mark = small(left.select(F.col("source").alias("_s"), f"t_{key}"))
        rows = rows.join(mark, rows["source"].eqNullSafe(F.col("_s")) & (rows[key] == F.col(f"t_{key}"))).drop("_s", f"t_{key}")
    return out


def keyed(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """The KEYS of each row: hashes of the id, the text and the row's place."""
    place = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - HASH_BITS)
    return [hash60(F.col(f"`{doc_id}`")), hash60(F.col(f"`{text}`")), place]


def planned(docs: DataFrame, share: float, most: int, weights: tuple[int, ...], doc_id: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, source, size and KEYS) and a row per source: _p (the source), source_size, target, passes and thresholds."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    keys = [k.alias(n) for k, n in zip(keyed(docs, doc_id, text), KEYS, strict=True)]
    rows = common.stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), *keys), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = budgets(sources, share, most, weights)
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most).cast("double"), F.floor(F.col("target") / F.col("source_size")))).otherwise(0.0).cast("long")
    plan = plan.withColumn("passes", passes).withColumn("rest", F.col("target") - (F.col("passes") * F.col("source_size")).cast("double"))
    plan = common.stored(plan, "budgets")
    cut = thresholds(rows, plan)
    plan = plan.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    return rows, common.stored(plan.select(F.col("source").alias("_p"), "source_size", "target", "passes", *[f"t_{k}" for k in KEYS]), "budgets")


def taken(keys: list[Column], plan, most: int) -> Column:
    """How often a row with these keys is taken; plan(name) is a column of its source's plan."""
    before = F.lit(False)
    for key, name in reversed(list(zip(keys, KEYS, strict=True))):
        before = (key < plan(f"t_{name}")) | ((key == plan(f"t_{name}")) & before)
    return F.least(F.lit(most).cast("long"), plan("passes") + before.cast("long"))


def mix(docs: DataFrame, share: float = 1.0, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies (how often the mix takes the row), taken = copies * size."""
    rows, plan = planned(docs, share, most, weights, doc_id, text, source)
    out = rows.join(small(plan), F.col("source").eqNullSafe(F.col("_p"))).withColumn("copies", taken([F.col(k) for k in KEYS], F.col, most))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, share: float = 1.0, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them. Texts don't move where there are no more than SMALL_ROWS sources."""
    _, plan = planned(docs, share, most, weights, doc_id, text, source)
    own = [F.col(f"`{c}`") for c in docs.columns]
    # the plan travels as one column with a name of its own
    row, times, place = common.free(docs.columns, "_row"), common.free(docs.columns, "_times"), common.free(docs.columns, "_place")
    *keys, by_place = keyed(docs, doc_id, text)
    out = docs.withColumn(place, by_place).join(small(plan.select(F.struct("*").alias(row))), F.col(f"`{source}`").eqNullSafe(F.col(row)["_p"]))
    out = out.withColumn(times, taken([*keys, F.col(place)], lambda name: F.col(row)[name], most).cast("int")).where(F.col(times) > 0)
    return out.select(*own, F.explode(F.sequence(F.lit(1), F.col(times))).alias(row)).select(*own)
