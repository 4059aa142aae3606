"""N-gram Jaccard join by vertical partitioning.

All n-grams get one global order, rare ones first: a count sketch over the whole corpus gives each its (rounded) frequency, ties
go by hash. Two sets that are similar enough share one of their first few n-grams, so those alone are matched to find candidates;
what the places of a shared n-gram rule out is dropped. The order is cut into FRAGMENTS ranges of equal mass, every set is cut
with it, the overlap of a pair is counted fragment by fragment, each by itself, and summed per pair.

Sets that are equal are one node from the start. Of the nodes that share an n-gram only the leader (the one with the fewest rarer
n-grams, as an original among its edited copies) is paired with the others at first; pairs are then sought only between nodes that
these links have not brought together. So no group of near copies is expanded into all pairs, and no link between components is
lost: every pair left out has both ends in one component already.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; a text of fewer words than n
is one n-gram; rows repeated or with equal sets share a component; a component's id is its least doc_id (nulls apart); an empty
table gives an empty result; other columns, whatever their names, play no part. n-grams are 58-bit hashes with their frequency
level, sets 64-bit digests; two that collide count as equal.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import components as graph
from . import common

#: Counters of the frequency sketch. A task holds 2**bits of 1 byte (they stop at 255), the driver and every worker the logarithms of
#: their sums (1 byte each). The order is for speed only: results are the same with any sketch. Where many more n-grams
#: than counters make all counters alike, more bits tell common n-grams from rare ones again.
SKETCH_BITS = 24
CHUNKS = 64
#: Ranges the global order is cut into, and how many of the rarest are counted first.
FRAGMENTS, EARLY = 8, 2
LEVEL_SHIFT = np.uint64(58)
#: Nodes that share an n-gram of more than 2**HOT_LEVEL occurrences are dealt over several tasks, about so many to each.
HOT_LEVEL = 10
#: Bits of the filter that tells which texts take part in pairs; it is broadcast (2**bits / 8 bytes). Where it fills up, more texts
#: than needed are cut, and the join drops them.
FILTER_BITS = 25
#: Rows of a table of leaders (of some 50 bytes each) that may be broadcast.
SMALL_ROWS = 100_000
#: Sets whose prefixes a task remembers to have sent.
KNOWN_SETS = 500_000


def shingles(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    vocabulary, index, counts = common.words(pc.ascii_lower(pc.fill_null(texts, "")))
    word = common.mix(common.hash64(vocabulary))[index] if len(index) else np.empty(0, "u8")
    ends = np.cumsum(counts)
    starts, total = ends - counts, word.copy()
    short = {}
    for k in range(1, size):
        rows = np.flatnonzero(counts == k)
        short |= dict(zip(rows.tolist(), common.mix(total[starts[rows]] + np.uint64(k)), strict=True))
        total = total[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[k:] if len(total) > 1 else total[:0]
    total = common.mix(total)
    for row, (start, n) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
        if n >= size:
            yield np.unique(total[start : start + n - size + 1])
        else:
            yield np.array([short[row]] if n else [], "u8")


def digest(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def ordered(values: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """n-grams as numbers in the global order."""
    level = levels[values & np.uint64(len(levels) - 1)].astype("u8")
    return np.sort((level << LEVEL_SHIFT) | (values >> np.uint64(6)))


def survey(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document (doc_id, n, sid) and, with chunk and counts, the frequency sketch of each task."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, "u1")
        mask = np.uint64(len(sketch) - 1)
        names, id_type = ["doc_id", "n", "sid", "chunk", "counts"], None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for part in common.blocks(batch, "text"):
                sets = list(shingles(part.column("text"), size))
                at, times = np.unique(np.concatenate(sets) & mask, return_counts=True)
                sketch[at] = np.minimum(sketch[at] + times, 255)
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, pa.array(map(digest, sets), pa.int64()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=names)
        if id_type is not None:
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(sketch, CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, id_type), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.int64()), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return docs.mapInArrow(common.tidy(run), f"doc_id {kind}, n long, sid long, chunk int, counts binary")


def levels_of(sketches: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The rounded logarithm of every counter, and the n-grams (as numbers in the global order) at which fragments begin."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // CHUNKS, "u4")
        for raw in frame["counts"]:
            total += np.frombuffer(zlib.decompress(raw), "u1")
        level = np.ceil(np.log2(np.maximum(total, 1), dtype="f4")).astype("u1")
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "levels": [level.tobytes()], "mass": [np.bincount(level, total, minlength=64).tolist()]})

    levels, mass = np.zeros(1 << SKETCH_BITS, "u1"), np.zeros(64)
    for r in sketches.groupBy("chunk").applyInPandas(add, "chunk int, levels binary, mass array<double>").collect():  # 2**SKETCH_BITS bytes
        at = r["chunk"] * (len(levels) // CHUNKS)
        levels[at : at + len(levels) // CHUNKS] = np.frombuffer(r["levels"], "u1")
        mass += np.array(r["mass"])
    weight, mass = mass, np.cumsum(mass)
    cuts = mass[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS
    level = np.minimum(np.searchsorted(mass, cuts, side="right"), 63)
    below = mass[level] - weight[level]
    part = (cuts - below) / np.maximum(mass[level] - below, 1)
    pivots = (level.astype("u8") << LEVEL_SHIFT) + (np.clip(part, 0, 1 - 1e-9) * 2.0**58).astype("u8")
    return levels, pivots


def needed(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of two sets of these sizes that makes a link."""
    return F.ceil(percent * (a + b) / (100 + percent) - 1e-9)


def possible(x: str, y: str, percent: int) -> Column:
    """Whether sizes, and the places of a shared n-gram, leave room for a link. x, y: prefixes of the columns n, at and prior of the two nodes.
    A linked pair of these sizes shares one of the n-grams that stand no later than what each set can do without. What comes before
    a shared n-gram can only match what comes before it in the other, and of that only the prior n-grams, which other nodes have
    in their prefixes too."""
    n, m, at, to = F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}at"), F.col(f"{y}at")
    least, most = needed(n, m, percent), F.least(F.col(f"{x}prior"), F.col(f"{y}prior")) + F.least(n - at, m - to)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (at + least <= n) & (to + least <= m) & (most >= least)


def id_bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS))


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bit set for each of ids (id), made in Spark; 2**FILTER_BITS bits whatever the number of ids."""
    words = ids.select(id_bit("id").alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), "u8")
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view("u8")
    return table


def passed(table: np.ndarray, bits: pa.Array) -> np.ndarray:
    h = bits.to_numpy().astype("u8")
    return (table[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def overlaps(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, levels, pivots: np.ndarray, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b, n, m) those that are links. Only the texts of nodes in pairs are cut into fragments."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    table = docs.sparkSession.sparkContext.broadcast(id_filter(nodes.join(wanted, "sid", "left_semi").select(F.col("rep").alias("id"))))
    texts = docs.withColumn("_h", id_bit("doc_id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passed(table.value, batch.column("_h"))))
            for part in common.blocks(batch, "text"):
                sid, fragment, grams = [], [], []
                for values in shingles(part.column("text"), size):
                    if len(values):
                        key, order = digest(values), ordered(values, levels.value)
                        for f, x in enumerate(np.split(order, np.searchsorted(order, pivots))):
                            if len(x):
                                sid.append(key), fragment.append(f), grams.append(x.view("i8"))
                sizes = np.append(0, np.cumsum([len(g) for g in grams])).astype("i4")
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(grams) if grams else np.empty(0, "i8")))
                yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(fragment, pa.int32()), lists], names=["sid", "fragment", "grams"])

    cuts = texts.mapInArrow(common.tidy(cut), "sid long, fragment int, grams array<long>")
    cuts = common.stored(cuts, "fragments")
    sizes = cuts.groupBy("sid", "fragment").agg(F.max(F.size("grams")).alias("size")).groupBy("sid").agg(F.map_from_entries(F.collect_list(F.struct("fragment", "size"))).alias("sizes"))

    def counted(some: DataFrame, fragments: DataFrame) -> DataFrame:
        """some (a, b, ...) with overlap: the sum of what the fragments have in common."""
        fragments = fragments.hint("merge")  # the same plan at every size
        left = some.select("a", "b").join(fragments.select(F.col("sid").alias("a"), "fragment", F.col("grams").alias("x")), "a")
        both = left.join(fragments.select(F.col("sid").alias("b"), "fragment", F.col("grams").alias("y")), ["b", "fragment"])
        # a set that several rows have was cut several times: its fragment counts once
        partial = both.select("a", "b", "fragment", F.size(F.array_intersect("x", "y")).alias("part")).groupBy("a", "b", "fragment").agg(F.max("part").alias("part"))
        return some.join(partial.groupBy("a", "b").agg(F.sum("part").alias("overlap")), ["a", "b"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))

    # the rarest n-grams first: pairs that have too few in common there, whatever the other fragments hold, go no further
    early = list(range(EARLY))
    rest = lambda c: F.aggregate(F.sequence(F.lit(EARLY), F.lit(FRAGMENTS - 1)), F.lit(0), lambda s, f: s + F.least(F.coalesce(F.try_element_at(F.col("sizes"), f), F.lit(0)), F.coalesce(F.try_element_at(F.col(c), f), F.lit(0))))
    first = counted(pairs, cuts.where(F.col("fragment").isin(early)))
    first = first.join(sizes.withColumnRenamed("sid", "a"), "a").join(sizes.toDF("b", "sizes2"), "b").withColumn("most", F.col("overlap") + rest("sizes2"))
    first = common.stored(first.where(F.col("most") >= needed(F.col("n"), F.col("m"), percent)).select("a", "b", "n", "m", F.col("overlap").alias("before")), "pairs")
    last = counted(first, cuts.where(~F.col("fragment").isin(early)).join(first.select(F.col("a").alias("sid")).union(first.select("b")).distinct(), "sid", "left_semi"))
    overlap = F.col("overlap") + F.col("before")
    links = common.stored(last.where(100 * overlap >= percent * (F.col("n") + F.col("m") - overlap)).select("a", "b"), "links")
    common.discard(cuts, first)
    table.unpersist()
    return links


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document; documents link when 100 * overlap >= percent * union."""
    return grouped(docs, size, percent, doc_id, text).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def grouped(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n, sid (the set's digest), and of sets that aren't empty component (a digest) and component_id, of every document."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    context = docs.sparkSession.sparkContext
    seen = common.stored(survey(docs, size), "survey")
    rows = seen.where("chunk is null").select("doc_id", "n", "sid")
    table, pivots = levels_of(seen.where("chunk is not null").select("chunk", "counts"))
    levels = context.broadcast(table)  # 2**SKETCH_BITS bytes
    nodes = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.empty(0, "i8")
        for batch in batches:
            for part in common.blocks(batch, "text"):
                grams, sids, sizes, places, salts = [], [], [], [], []
                sets = [values for values in shingles(part.column("text"), size) if len(values)]
                keys = np.array([digest(values) for values in sets], "i8")
                _, first = np.unique(keys, return_index=True)
                fresh = first[~np.isin(keys[first], known)]
                known = np.concatenate([known if len(known) < KNOWN_SETS else known[:0], keys[fresh]])
                for key, values in ((int(keys[k]), sets[k]) for k in fresh):
                    first = len(values) + (-percent * len(values)) // 100 + 1
                    grams.append(ordered(values, levels.value)[:first])
                    parts = np.uint64(1) << np.maximum(grams[-1] >> LEVEL_SHIFT, np.uint64(HOT_LEVEL)) - np.uint64(HOT_LEVEL)
                    salts.append(np.where(parts > 1, 1 + (np.uint64(key & 0x7FFFFFFFFFFFFFFF) & (parts - np.uint64(1))).astype("i8"), 0))
                    sids.append(np.full(first, key)), sizes.append(np.full(first, len(values))), places.append(np.arange(first))
                if grams:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype("u8").view("i8") if k == 0 else np.concatenate(x), t) for k, (x, t) in enumerate(((grams, pa.int64()), (sids, pa.int64()), (sizes, pa.int32()), (places, pa.int32()), (salts, pa.int32())))], names=["gram", "sid", "n", "at", "salt"])

    # dealt by n-gram once: what follows looks at each n-gram's nodes inside the tasks. A set that several tasks have met counts once.
    dealt = docs.mapInArrow(common.tidy(prefixes), "gram long, sid long, n int, at int, salt int").repartition("gram", "salt").dropDuplicates(["gram", "salt", "sid"])
    # n-grams of one node lead nowhere; of a part of a frequent one's nodes that isn't known
    nodes_of = Window.partitionBy("gram", "salt")
    several = (F.col("salt") > 0) | (F.min("sid").over(nodes_of) < F.max("sid").over(nodes_of))
    postings = dealt.withColumn("several", several).where("several").drop("several")
    prior = F.row_number().over(Window.partitionBy("sid").orderBy("at")) - 1
    postings = common.stored(postings.withColumn("prior", prior), "postings")
    # the leader of an n-gram has the fewest rarer ones before it; those of frequent n-grams are found part by part and joined
    place = ("at", "n", "sid", "prior")
    beside = lambda rows: rows.select(*place, *[F.col(f"lead.{c}").alias(f"l{c}") for c in place])
    least = F.min(F.struct(*place))
    leads = common.stored(postings.where("salt > 0").groupBy("gram", "salt").agg(least.alias("lead")).groupBy("gram").agg(F.min("lead").alias("lead")), "leads")
    leads = F.broadcast(leads) if leads.count() <= SMALL_ROWS else leads
    led = beside(postings.where("salt = 0").withColumn("lead", least.over(nodes_of))).unionByName(beside(postings.where("salt > 0").join(leads, "gram")))
    a, b = F.col("sid"), F.col("lsid")
    led, smaller = led.where((a != b) & possible("", "l", percent)), a < b
    led = led.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(smaller, F.col("n")).otherwise(F.col("ln")).alias("n"), F.when(smaller, F.col("ln")).otherwise(F.col("n")).alias("m")).distinct()
    led = common.stored(led, "pairs")
    links = overlaps(led, docs, nodes, levels, pivots, size, percent)

    # what is left: nodes of different components that share an n-gram
    part_of = graph.components(links).select(F.col("node").alias("sid"), "component")
    joined = common.stored(postings.join(part_of.hint("merge"), "sid", "left").withColumn("component", F.coalesce("component", "sid")), "parts")
    mixed = common.stored(joined.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("gram"), "mixed")
    at = common.stored(joined.join(mixed.hint("merge"), "gram", "left_semi"), "mixed")
    common.discard(postings, joined)
    to = at.select("gram", *[F.col(c).alias(f"y{c}") for c in ("sid", "n", "at", "prior", "component")])
    rest = at.join(to, "gram").where((F.col("component") != F.col("ycomponent")) & (F.col("sid") < F.col("ysid")) & possible("", "y", percent))
    rest = rest.select(F.col("sid").alias("a"), F.col("ysid").alias("b"), "n", F.col("yn").alias("m"), F.col("at").alias("i"), F.col("yat").alias("j"))
    # all shared n-grams of the prefixes are counted, so what follows the last of them bounds the overlap
    rest = rest.groupBy("a", "b", "n", "m").agg(F.count("*").alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
    rest = rest.where(F.col("c") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) - 1 >= needed(F.col("n"), F.col("m"), percent))
    rest = common.stored(rest.select("a", "b", "n", "m").join(led.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    common.discard(at, mixed, led)
    links = links.unionByName(overlaps(rest, docs, nodes, levels, pivots, size, percent))

    levels.unpersist()

    part_of = graph.components(links).select(F.col("node").alias("sid"), "component")
    named = common.stored(nodes.join(part_of, "sid", "left").withColumn("component", F.coalesce("component", "sid")), "named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select(F.col("sid").alias("_sid"), "component", "component_id")
    return rows.join(named, (F.col("sid") == F.col("_sid")) & (F.col("n") > 0), "left").select("doc_id", "n", "sid", "component", "component_id")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near duplicates: of those whose id names the group, one (of equal rows or sets). Rows that share an
    id are told apart by their sets. A row without an id stays, and so does one without words."""
    found = grouped(docs, size, percent, doc_id, text)
    key, stays, bit, mark = (common.free(docs.columns, n) for n in ("_key", "_stays", "_bit", "_sid"))
    sets = found.where("n > 0").groupBy("doc_id", "sid").agg(F.first("component").alias("component"), F.first("component_id").alias("component_id"), F.count("*").alias("times"))
    sets = common.stored(sets, "sets")
    chosen = sets.where("doc_id = component_id").groupBy(F.col("component").alias("_c")).agg(F.min("sid").alias("_s"))
    sets = sets.join(chosen, F.col("component") == F.col("_c"), "left")
    sets = sets.select(F.col("doc_id").alias(key), F.col("sid").alias(mark), (F.col("doc_id").isNull() | F.coalesce((F.col("doc_id") == F.col("component_id")) & (F.col("sid") == F.col("_s")), F.lit(False))).alias(stays), "times")
    # only ids of which a row goes need a look; texts of all others stay where they are
    odd = common.stored(sets.where(F.col(key).isNotNull() & (~F.col(stays) | (F.col("times") > 1))).select(key, mark, stays), "odd")
    table = docs.sparkSession.sparkContext.broadcast(id_filter(odd.select(F.col(key).alias("id"))))
    fields = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)

    def sifted(hit: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.filter(pa.array(passed(table.value, batch.column(bit)) == hit))
                if not hit:
                    yield pa.RecordBatch.from_arrays(rows.columns[:-1], names=rows.schema.names[:-1])
                    continue
                for part in common.blocks(rows, text):
                    sid = pa.array([digest(values) for values in shingles(part.column(text), size)], pa.int64())
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], sid], names=[*part.schema.names[:-1], mark])

        return docs.withColumn(bit, id_bit(doc_id)).mapInArrow(common.tidy(run), f"{fields}, `{mark}` long" if hit else fields)

    own = [F.col(f"`{c}`") for c in docs.columns]
    named = odd.toDF(f"{key}2", f"{mark}2", stays)
    looked = sifted(True).join(named, (F.col(f"`{doc_id}`") == F.col(f"{key}2")) & (F.col(mark) == F.col(f"{mark}2")), "left")
    single = looked.where(F.col(stays).isNull()).select(*own)
    several = looked.where(F.col(stays)).dropDuplicates([doc_id, mark]).select(*own)
    return sifted(False).unionByName(single).unionByName(several)
