"""Language-model scoring by an interpolated modified Kneser-Ney n-gram model of order 2 or 3.

Spark counts words and n-grams of the training texts; the counts are kept in the shared folder as sorted arrays, in shards, a file a shard:

  vocab-s: hashes of words, ascending, and their counts; the shard is the hash's first bits, so a word's number is its place in the
    sequence of shards
  follow-s: by word: how many distinct words it follows (the count of the lowest order)
  table3-s, table2-s: contexts (numbers of the words before, 2**32 * first + second), ascending, where each one's entries end, and the entries:
    words, ascending, and counts (a byte each, larger ones apart). Contexts of more than LONG entries have their sums beside them.
  hot3-s, hot2-s: the sums of contexts that are dealt over several shards

Of the highest order the counts are those of the text, below it how many distinct words come before. Workers map these files into memory
and find entries by bisection, so what a worker needs of a large model is paged in and can be dropped again.

n-grams of order 3 are dealt to shards by their middle word, so that both their context and what is left without their first word lie in
one shard; those of order 2 by their first word. A word that has more than its share of the corpus is dealt over several shards by the
word beside it (and, between two such words, by the third). The number of shards grows with the corpus: a shard holds what about SHARD_BYTES
of text give, and a task holds a shard, or a block of text and FLUSH n-grams.

A word's probability is (c - D(c)) / C + G * lower, D depending on whether c is 1, 2 or more; the lowest order is the same on the number of
distinct words before it, with 1 / (V + 1) below, which is all an unknown word gets. Counts have 64 bits.

Defined cases: a null text is empty: one end; words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; repeated rows count and are scored
each; without training texts every word has probability 1; an empty table gives an empty result; other columns play no part. Words are
64-bit hashes; two that collide count as one. A corpus of 2**32 - 1 distinct words or more is refused.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARD_BYTES, FLUSH, LONG = 16 << 20, 2_500_000, 64
#: Files a worker holds mapped at a time.
OPEN_FILES = 8192
END = np.uint64(0xFFFFFFFFFFFFFFFF)
HALF = np.uint64(32)
HOT_SHARE = 8  # a word with more than 1 / (HOT_SHARE * shards) of all tokens is dealt over several shards
VOCAB, TABLE, HOT = ("u8", "i8"), ("i8", "i8", "i8", "i8", "i8", "i8", "i8", "u8", "u4", "u4", "u1"), ("u8", "i8", "i8", "i8", "i8")
BLOB = "shard int, size long, ctx binary, word binary, count binary"
MET = f"kind string, {BLOB}, stats binary, n long, n1 long, n2 long, n3 long, n4 long"


def put(base: str, name: str, arrays: list[np.ndarray]) -> None:
    """Write arrays (the widest numbers first) to the shared folder under a final name in one move, so that a task run twice does no harm."""
    files, root = pafs.FileSystem.from_uri(base)
    files.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(np.array([len(a) for a in arrays], "u8").tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).view("u1").data if len(a) else b"")
    files.move(part, f"{root}/{name}")


@dataclass
class Model:
    """Where the arrays are, and the few numbers that aren't in them. Arrays are mapped on first use."""

    base: str
    bits: int
    order: int = 3
    starts: np.ndarray = None  # the first word number of each shard
    tokens: int = 0
    types: int = 0
    texts: int = 0
    entries: dict = field(default_factory=dict)  # by order: how many distinct n-grams
    off: dict = field(default_factory=dict)  # by order: the discounts of counts of 1, 2 and more
    low_rest: float = 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_open"}

    def arrays(self, name: str, shard: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
        opened = self.__dict__.setdefault("_open", {})
        if (name, shard) not in opened:
            if len(opened) >= OPEN_FILES:
                opened.clear()
            files, root = pafs.FileSystem.from_uri(self.base)
            path, copy = f"{root}/{name}-{shard}", None
            if not isinstance(files, pafs.LocalFileSystem):  # a store that can't be mapped: a copy that goes with the worker
                handle, copy = tempfile.mkstemp()
                os.close(handle)
                pafs.copy_files(path, copy, source_filesystem=files, destination_filesystem=pafs.LocalFileSystem())
                path = copy
            raw = np.memmap(path, "u1", "r").view(np.ndarray)
            if copy:
                os.unlink(copy)
            at, out = 8 * len(kinds), []
            for n, kind in zip(raw[:at].view("u8").tolist(), kinds, strict=True):
                size = n * np.dtype(kind).itemsize
                out.append(raw[at : at + size].view(kind))
                at += size
            opened[name, shard] = out
        return opened[name, shard]

    def shard_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype("i8")

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers (-1: unknown), counts, and counts of the lowest order (0 before they are known)."""
        number, count, follow = np.full(len(hashes), -1), np.zeros(len(hashes), "i8"), np.zeros(len(hashes), "i8")
        for shard, rows in by_shard(self.shard_of(hashes)):
            keys, counts = self.arrays("vocab", shard, VOCAB)
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, hashes[rows]), len(keys) - 1)
            known = keys[at] == hashes[rows]
            rows, at = rows[known], at[known]
            number[rows], count[rows] = at + self.starts[shard], counts[at]
            if self.entries:
                follow[rows] = self.arrays("follow", shard, ("i8",))[0][at]
        return number, count, follow

    def occurrences(self, numbers: np.ndarray) -> np.ndarray:
        """How often words occur; what stands before a first word counts as often as there are texts."""
        out = np.full(len(numbers), self.texts)
        inside = np.flatnonzero(numbers < self.types)
        for shard, rows in by_shard(np.searchsorted(self.starts, numbers[inside], side="right") - 1):
            out[inside[rows]] = self.arrays("vocab", shard, VOCAB)[1][numbers[inside[rows]] - self.starts[shard]]
        return out

    def parts(self, count: np.ndarray) -> np.ndarray:
        """Over how many shards a word that occurs so often is dealt."""
        return (1 + count * HOT_SHARE * (1 << self.bits) // max(1, self.tokens)).astype("u8")

    def dealt(self, level: int, ctx: np.ndarray, word: np.ndarray, count: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The shard of each n-gram, and whether its context has several. count: how often the words of the context occur."""
        last = self.parts(count[-1])
        if level == 2:
            return self.shard_of(common.mix(ctx + ((common.mix(word.astype("u8")) % last) << np.uint64(33)))), last > 1
        both = np.minimum(self.parts(count[0]), last)
        middle = (ctx & np.uint64(0xFFFFFFFF)) + ((common.mix(ctx >> HALF) % last) << np.uint64(33))
        return self.shard_of(common.mix(common.mix(middle) + common.mix(word.astype("u8") + np.uint64(1)) % both)), both > 1

    def home(self, ctx: np.ndarray) -> np.ndarray:
        return self.shard_of(common.mix(ctx ^ np.uint64(0x9E3779B97F4A7C15)))


def context_counts(model: Model, level: int, ctx: np.ndarray) -> list[np.ndarray]:
    """How often each of the words of contexts (equal ones beside each other) occurs."""
    if not len(ctx):
        return [np.empty(0, "i8")] * (level - 1)
    fresh = np.append(True, ctx[1:] != ctx[:-1])
    own, back = ctx[fresh], np.cumsum(fresh) - 1
    return [model.occurrences(w.astype("i8"))[back] for w in ([own] if level == 2 else [own >> HALF, own & np.uint64(0xFFFFFFFF)])]


def by_shard(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(shards):
        return
    if shards.max() < 1 << 16:
        shards = shards.astype("u2")  # which sorts faster
    order = np.argsort(shards, kind="stable")
    shards = shards.astype("i8")
    edge = np.flatnonzero(np.diff(shards[order], prepend=-1))
    for start, stop in zip(edge, [*edge[1:], len(order)], strict=True):
        yield int(shards[order[start]]), order[start:stop]


def summed(ctx: np.ndarray, word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and the sums of their counts."""
    order = np.argsort(ctx)
    ctx, word, count = ctx[order], word[order], count[order]
    if not len(ctx):
        return ctx, word, count
    if word.any():  # by the place of the context and the word in one number
        order = np.argsort((np.cumsum(np.append(False, ctx[1:] != ctx[:-1])).astype("u8") << HALF) | word)
        ctx, word, count = ctx[order], word[order], count[order]
    edge = np.flatnonzero(np.append(True, (ctx[1:] != ctx[:-1]) | (word[1:] != word[:-1])))
    return ctx[edge], word[edge], np.add.reduceat(count, edge, dtype="i8")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, with the end as the last; the word index of every token, an end after each text; tokens a text."""
    vocabulary, index, counts = common.words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = common.hash64(vocabulary)
    hashes[hashes == END] = 0
    return np.append(hashes, END), np.insert(index.astype("i8"), np.cumsum(counts), len(hashes)), counts + 1


def before(x: np.ndarray, lengths: np.ndarray, back: int, start: int) -> np.ndarray:
    """What stands so many places before each token of its text; start before the first ones."""
    out = np.concatenate([np.full(min(back, len(x)), start), x[: max(0, len(x) - back)]])
    ends = np.cumsum(lengths)
    place = np.arange(len(x)) - np.repeat(ends - lengths, lengths)
    out[place < back] = start
    return out


def contexts(model: Model, x: np.ndarray, lengths: np.ndarray) -> dict[int, np.ndarray]:
    """By order, the context of every token; -1 where it holds an unknown word."""
    one = before(x, lengths, 1, model.types)
    out = {2: one}
    if model.order == 3:
        two = before(x, lengths, 2, model.types)
        out[3] = np.where((one < 0) | (two < 0), np.uint64(0), (two.astype("u8") << HALF) | one.astype("u8"))
        out[3] = np.where((one < 0) | (two < 0), END, out[3])
    out[2] = np.where(one < 0, END, one.astype("u8"))
    return out


def packed(x: np.ndarray) -> bytes:
    """Numbers in few bytes: their lowest bytes, then the next ones, and so on as far as any are set, compressed."""
    used = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return zlib.compress(np.ascontiguousarray(x.view("u1").reshape(-1, x.itemsize).T[:used]).data, 1)


def unpacked(raw: bytes, kind: str, n: int) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), "u1")
    if n:
        part = np.frombuffer(zlib.decompress(raw), "u1").reshape(-1, n)
        out[:, : len(part)] = part.T
    return out.reshape(-1).view(kind)


def blobs(shards: np.ndarray, ctx: np.ndarray, word: np.ndarray, count: np.ndarray) -> dict[str, list]:
    """A row for each shard: its n-grams (ascending) and their counts."""
    out = {"shard": [], "size": [], "ctx": [], "word": [], "count": []}
    for shard, rows in by_shard(shards):
        for name, value in (("shard", shard), ("size", len(rows)), ("ctx", packed(np.diff(ctx[rows], prepend=np.uint64(0)))), ("word", packed(word[rows].astype("u4"))), ("count", packed(count[rows].astype("i8")))):
            out[name].append(value)
    return out


def batch(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int32()), pa.array(rows["size"], pa.int64()), *[pa.array(rows[k], pa.binary()) for k in ("ctx", "word", "count")]], names=["shard", "size", "ctx", "word", "count"])


def merged(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    frame = frame[frame["ctx"].notna()]
    take = lambda name, kind: [unpacked(raw, kind, int(n)) for raw, n in zip(frame[name], frame["size"], strict=True)]
    parts = [[np.cumsum(x, dtype="u8") for x in take("ctx", "u8")], take("word", "u4"), take("count", "i8")]
    return summed(*[np.concatenate([*p, np.empty(0, k)]) for p, k in zip(parts, ("u8", "u4", "i8"), strict=True)])


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many entries occur 1, 2, 3 and 4 times; plain halves where these are too few."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    return tuple(float(np.clip(d, 0.01, top)) for d, top in ((1 - 2 * y * n2 / n1, 1), (2 - 3 * y * n3 / n2, 2), (3 - 4 * y * n4 / n3, 3)))


def taken_off(count: np.ndarray, d: tuple) -> np.ndarray:
    return np.where(count == 1, d[0], np.where(count == 2, d[1], np.where(count > 2, d[2], 0.0)))


def sums(count: np.ndarray, edge: np.ndarray) -> list[np.ndarray]:
    """By run that begins at edge: the sum of counts, and how many are 1, 2 and more."""
    return [np.add.reduceat(x.astype("i8"), edge) if len(edge) else np.empty(0, "i8") for x in (count, count == 1, count == 2, count > 2)]


def gathered(blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], shards_of) -> Iterator[pa.RecordBatch]:
    """n-grams and counts of blocks, summed and sent on by shard whenever FLUSH of them have come together."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        grams = summed(*[np.concatenate(x) for x in zip(*held, strict=True)])
        held.clear()
        return batch(blobs(shards_of(*grams[:2]), *grams))

    for part in blocks:
        held.append(part)
        n += len(part[0])
        if n >= FLUSH:
            yield out()
            n = 0
    if held:
        yield out()


def settle(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark removes the shuffle files of the steps that are done."""
    gc.collect()
    spark._jvm.System.gc()


def train(docs: DataFrame, order: int = 3) -> Model:
    """docs: text. Counts words, then n-grams, and leaves the sorted arrays in the shared folder."""
    if order not in (2, 3):
        raise ValueError(f"order is {order}; 2 and 3 are supported")
    spark = docs.sparkSession
    size, texts = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = max(16, 1 << ((size or 0) // SHARD_BYTES).bit_length())
    model = Model(common.shared_dir(spark, "lm"), shards.bit_length() - 1, order, texts=texts)
    # every shard has its files, empty ones too
    with_all = lambda parts: parts.unionByName(spark.range(shards).select(F.col("id").cast("int").alias("shard")), allowMissingColumns=True).groupBy("shard")

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for whole in batches:
            for part in common.blocks(whole, "text"):
                yield tokens(part.column("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((hashes, np.zeros(len(hashes), "u4"), np.bincount(index, minlength=len(hashes))) for hashes, index, _ in parted(batches))
        yield from gathered(found, lambda ctx, _: model.shard_of(ctx))

    def keep_words(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        key, _, count = merged(frame)
        key, count = key[count > 0], count[count > 0]
        put(model.base, f"vocab-{shard}", [key, count.astype("i8")])
        return pd.DataFrame({"shard": [shard], "types": [len(key)], "tokens": [int(count.sum())]})

    sizes = with_all(docs.mapInArrow(common.tidy(count_words), BLOB)).applyInPandas(keep_words, "shard int, types long, tokens long").orderBy("shard").collect()  # a row a shard
    settle(spark)
    model.starts = np.cumsum([0, *(r["types"] for r in sizes)])
    model.tokens, model.types = sum(r["tokens"] for r in sizes), int(model.starts[-1])
    if model.types >= (1 << 32) - 1:
        raise ValueError(f"{model.types} distinct words; fewer than 2**32 - 1 are supported")

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grams():
            for hashes, index, lengths in parted(batches):
                x = model.numbers(hashes)[0][index]
                ctx = contexts(model, x, lengths)[order]
                yield ctx, x.astype("u4"), np.ones(len(x), "i8")

        yield from gathered(grams(), lambda ctx, word: model.dealt(order, ctx, word, context_counts(model, order, ctx))[0])

    def keep_grams(level: int):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            shard = int(frame["shard"].iloc[0])
            ctx, word, count = merged(frame)
            edge = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(ctx) else np.empty(0, "i8")
            ends, known = np.append(edge[1:], len(ctx)) if len(edge) else edge, sums(count, edge)
            several = model.dealt(level, ctx[edge], word[edge], context_counts(model, level, ctx[edge]))[1]
            long, over = np.flatnonzero((ends - edge > LONG) & ~several), np.flatnonzero(count > 254)
            put(model.base, f"table{level}-{shard}", [over, count[over], long, *[x[long] for x in known], ctx[edge], ends.astype("u4"), word.astype("u4"), np.minimum(count, 255).astype("u1")])
            times = np.bincount(np.minimum(count, 5), minlength=6)
            rows = [{"kind": "fact", "n": len(ctx)} | {f"n{k}": int(times[k]) for k in (1, 2, 3, 4)}]
            hot = np.flatnonzero(several)
            for home, at in by_shard(model.home(ctx[edge][hot])):
                rows.append({"kind": "hot", "shard": home, "ctx": ctx[edge][hot[at]].tobytes(), "stats": np.stack([x[hot[at]] for x in known]).tobytes()})
            if level == 3:  # distinct words before each pair
                pair, seen = np.unique(((ctx & np.uint64(0xFFFFFFFF)) << HALF) | word.astype("u8"), return_counts=True)
                first, second = pair >> HALF, (pair & np.uint64(0xFFFFFFFF)).astype("u4")
                down = blobs(model.dealt(2, first, second, context_counts(model, 2, first))[0], first, second, seen)
            else:  # distinct words before each word
                second, seen = np.unique(word, return_counts=True)
                down = blobs(np.searchsorted(model.starts, second.astype("i8"), side="right") - 1, second.astype("u8"), np.zeros(len(second), "u4"), seen)
            rows += [{"kind": "down"} | dict(zip(down, values, strict=True)) for values in zip(*down.values(), strict=True)]
            common.give_back()
            return pd.DataFrame(rows, columns=["kind", "shard", "size", "ctx", "word", "count", "stats", "n", "n1", "n2", "n3", "n4"]).astype({"shard": "Int32", **dict.fromkeys(("size", "n", "n1", "n2", "n3", "n4"), "Int64")})

        return run

    def keep_hot(level: int):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            shard = int(frame["shard"].iloc[0])
            frame = frame[frame["ctx"].notna()]
            ctx = np.concatenate([np.empty(0, "u8"), *[np.frombuffer(r, "u8") for r in frame["ctx"]]])
            stats = np.concatenate([np.empty((4, 0), "i8"), *[np.frombuffer(r, "i8").reshape(4, -1) for r in frame["stats"]]], 1)
            own, back = np.unique(ctx, return_inverse=True)
            total = np.zeros((4, len(own)), "i8")
            for k in range(4):
                np.add.at(total[k], back, stats[k])
            put(model.base, f"hot{level}-{shard}", [own, *total])
            return pd.DataFrame({"shard": [shard]})

        return run

    def keep_follows(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        key, _, count = merged(frame)
        follow = np.zeros(int(model.starts[shard + 1] - model.starts[shard]), "i8")
        follow[key.astype("i8") - model.starts[shard]] = count
        put(model.base, f"follow-{shard}", [follow])
        return pd.DataFrame([np.bincount(np.minimum(follow, 5), minlength=6).tolist()], columns=[f"n{k}" for k in range(6)])

    entries, left = {}, docs.mapInArrow(common.tidy(count_grams), BLOB)
    met = None
    for level in range(order, 1, -1):
        done, met = met, common.stored(with_all(left).applyInPandas(keep_grams(level), MET), f"lm-{level}")
        if done is not None:
            common.discard(done)
        settle(spark)
        facts = met.where("kind = 'fact'").agg(*[F.sum(c).alias(c) for c in ("n", "n1", "n2", "n3", "n4")]).first()
        entries[level], model.off[level] = facts["n"], discounts(np.array(facts[1:]))
        with_all(met.where("kind = 'hot'").select("shard", "ctx", "stats")).applyInPandas(keep_hot(level), "shard int").count()
        left = met.where("kind = 'down'").select("shard", "size", "ctx", "word", "count")
    low = with_all(left).applyInPandas(keep_follows, ", ".join(f"n{k} long" for k in range(6))).agg(*[F.sum(f"n{k}") for k in range(6)]).first()
    common.discard(met)
    settle(spark)
    model.entries, model.off[1] = entries, discounts(np.array(low[1:5]))
    many = model.types - low[0] - low[1] - low[2]
    model.low_rest = (model.off[1][0] * low[1] + model.off[1][1] * low[2] + model.off[1][2] * many) / max(1, entries[2])
    return model


def counts_at(table: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """The counts of entries of a table."""
    over_at, over, small = table[0], table[1], table[10]
    out = small[at].astype("i8")
    big = np.flatnonzero(out == 255)
    if len(big):
        out[big] = over[np.searchsorted(over_at, at[big])]
    return out


def short_sums(table: list[np.ndarray], begin: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The sums of counts of runs (one entry at least) that begin there, and how many of them are 1, 2 and more."""
    first = np.cumsum(n) - n
    at = np.arange(first[-1] + n[-1]) + np.repeat(begin - first, n)
    small = table[10][at]
    total = np.add.reduceat(small, first, dtype="i8")
    big = np.flatnonzero(small == 255)
    if len(big):
        np.add.at(total, np.searchsorted(first, big, side="right") - 1, counts_at(table, at[big]) - 255)
    ones, twos = (np.add.reduceat(small == k, first, dtype="i8") for k in (1, 2))
    return [total, ones, twos, n - ones - twos]


def bisected(words: np.ndarray, begin: np.ndarray, stop: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The place of the first entry of each run that is not below the word, for all runs at once."""
    out, rows = begin.copy(), np.flatnonzero(begin < stop)
    lo, hi, want = begin[rows], stop[rows], word[rows]
    while len(rows):
        mid = (lo + hi) >> 1
        less = words[mid] < want
        np.copyto(lo, mid + 1, where=less)
        np.copyto(hi, mid, where=~less)
        open_ = lo < hi
        if not open_.all():
            done = ~open_
            out[rows[done]] = lo[done]
            rows, lo, hi, want = rows[open_], lo[open_], hi[open_], want[open_]
    return out


def looked_up(table: list[np.ndarray], ctx: np.ndarray, word: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The count of each n-gram, the sum of its context's counts and of the discounts d (of counts of 0, 1, 2 and more) on them: zeros for unknown
    ones. n-grams come in ascending order."""
    _, _, long, *long_sums, keys, ends, words, _ = table
    times = np.zeros(len(ctx), "i8")
    if not len(keys):
        return times, times, np.zeros(len(ctx))
    fresh = np.append(True, ctx[1:] != ctx[:-1])
    own, back = ctx[fresh], np.cumsum(fresh) - 1
    run = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    known = keys[run] == own
    stop = np.where(known, ends[run], 0).astype("i8")
    begin = np.where(known & (run > 0), ends[np.maximum(run, 1) - 1], 0).astype("i8")
    n, total, off = stop - begin, np.zeros(len(own), "i8"), np.zeros(len(own))
    single, short = np.flatnonzero(n == 1), np.flatnonzero((n > 1) & (n <= LONG))
    if len(single):
        total[single] = counts_at(table, begin[single])
        off[single] = d[np.minimum(total[single], 3)]
    if len(short):
        total[short], *by = short_sums(table, begin[short], n[short])
        off[short] = by[0] * d[1] + by[1] * d[2] + by[2] * d[3]
    if len(long):
        place = np.minimum(np.searchsorted(long, run), len(long) - 1)
        rows = np.flatnonzero(known & (n > LONG) & (long[place] == run))
        total[rows], *by = (x[place[rows]] for x in long_sums)
        off[rows] = by[0] * d[1] + by[1] * d[2] + by[2] * d[3]
    end = stop[back]
    at = bisected(words, begin[back], end, word.astype("u4"))
    found = np.flatnonzero(at < end)
    found = found[words[at[found]] == word[found]]
    times[found] = counts_at(table, at[found])
    return times, total[back], off[back]


def interpolated(model: Model, level: int, ctx: np.ndarray, word: np.ndarray, count: list[np.ndarray], lower: np.ndarray) -> np.ndarray:
    """Probabilities of this order. ctx: END where it holds an unknown word; word: -1 for an unknown one; lower: those of the order below."""
    out, known = lower.copy(), np.flatnonzero(ctx != END)
    if not len(known):
        return out
    # each n-gram once, in ascending order, which is kind to memory; an unknown word gets the number after all words, which no entry has
    c, w = ctx[known], np.where(word[known] < 0, model.types, word[known]).astype("u8")
    order = np.argsort(c)
    c, w = c[order], w[order]
    again = np.argsort((np.cumsum(np.append(False, c[1:] != c[:-1])).astype("u8") << HALF) | w)
    order, w = order[again], w[again]
    fresh = np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1]))
    known, back = known[order], np.cumsum(fresh) - 1
    c, w, one = c[fresh], w[fresh], known[fresh]
    shards, several = model.dealt(level, c, w, [x[one] for x in count])
    d, times, total, off = np.array((0.0, *model.off[level])), np.empty(len(c), "i8"), np.empty(len(c), "i8"), np.empty(len(c))
    for shard, rows in by_shard(shards):
        times[rows], total[rows], off[rows] = looked_up(model.arrays(f"table{level}", shard, TABLE), c[rows], w[rows], d)
    hot = np.flatnonzero(several)
    for shard, rows in by_shard(model.home(c[hot])):
        keys, whole, *by = model.arrays(f"hot{level}", shard, HOT)
        rows = hot[rows]
        total[rows] = 0
        if len(keys):
            at = np.minimum(np.searchsorted(keys, c[rows]), len(keys) - 1)
            good = keys[at] == c[rows]
            rows, at = rows[good], at[good]
            total[rows], off[rows] = whole[at], by[0][at] * d[1] + by[1][at] * d[2] + by[2][at] * d[3]
    # where the context is unknown, all comes from below
    rest = np.where(total > 0, off / np.maximum(total, 1), 1.0)
    value = np.maximum(times - d[np.minimum(times, 3)], 0) / np.maximum(total, 1)
    out[known] = value[back] + rest[back] * lower[known]
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text and anything else. Adds n_tokens, n_known, train_tokens, base_score and score (log10 probabilities)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in common.blocks(whole, "text"):
                hashes, index, lengths = tokens(part.column("text"))
                number, count, follow = model.numbers(hashes)
                base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
                seen = model.entries.get(2, 0)
                p = (np.maximum(follow - taken_off(follow, model.off.get(1, (0.5,) * 3)), 0) / max(1, seen) + (model.low_rest if seen else 1.0) / (model.types + 1))[index]
                row = np.repeat(np.arange(len(lengths)), lengths)
                x, often = number[index], count[index]
                if seen:
                    ctx = contexts(model, x, lengths)
                    counts = [before(often, lengths, back, model.texts) for back in (2, 1)]
                    for level in range(2, model.order + 1):
                        p = interpolated(model, level, ctx[level], x, counts[-(level - 1) :], p)
                total = lambda v: np.bincount(row, v, minlength=len(lengths))  # noqa: E731, B023
                new = [pa.array(lengths), pa.array(total(often > 0).astype("i8")), pa.array(np.full(len(lengths), model.tokens)), pa.array(total(base[index])), pa.array(total(np.log10(p)))]
                names = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *new], names=[*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    fields = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes if c != "text")
    return docs.mapInArrow(common.tidy(run), f"{fields}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def learn_and_score(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """Scores of all docs by a model of those that learn is true for."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learned"), F.col(text).alias("text"))
    return score(rows, train(rows.where("learned").select("text"), order))
