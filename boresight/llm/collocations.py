"""Collocations from count tries.

A phrase that occurs often enough has only words and neighbouring pairs that do. A first pass counts hashes of words and pairs and sets two bits
of a map for each that is frequent; collisions only let more through. A second pass builds, for each shard of the words, a trie of the phrases
of at most `longest` words whose words and pairs are all in the map, with a count at each node. Tries are kept by level: a node has its parent's
place and its word, in order of the words, and a trie is so sorted. A shard writes its trie in prefix ranges, by the hash of a phrase's first PREFIX
words, each with its own dictionary and the ancestors its phrases need. Ranges of FAN_IN shards at a time are merged, every round cutting
its ranges finer, until one trie is left of each range; so no task gets more than FAN_IN parts, whatever the number of shards.

Nodes that are frequent become rows. What stands before a cut is found by walking up the trie to the node of the first words, what stands after it by
following suffix links to the node of the remaining words: joins of the frequent phrases, as each is a node itself.

Defined cases: a null or empty text has no words; a null language is `und`; repeated rows count each; phrases of equal score and count go by their bytes; an
empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Words of a shard, and hashes that a task gathers before it gives them out.
SHARD_WORDS, HASHES = 1_500_000, 2_000_000
#: Words of a phrase that decide its range, ranges that each round cuts a range into (a power of two), and shards merged at a time.
PREFIX, RANGE_BITS, FAN_IN = 3, 8, 256
#: Bits of the map for each frequent word or pair, bits of a part of the map, and parts at most (128 MB together).
BITS, PART_BITS, PARTS = 16, 20, 1024
UNKNOWN = "und"
# What parts pieces, and what parts words.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"

KIND = np.zeros(256, "u1")
KIND[list(BLANKS)], KIND[list(BREAKS)] = 1, 2
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words in lower case (ASCII), and by occurrence its word, its text, and how many words of its piece begin there."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    starts_at = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", "u1")[starts_at[0] : starts_at[-1]]
    bounds = starts_at - starts_at[0]
    kind = KIND[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    border = bounds[:-1][bounds[:-1] < len(data)]
    first[border] = inside[border]  # a word ends with its text
    begin = np.flatnonzero(first)
    if not len(begin):
        return pa.array([], pa.binary()), *(np.empty(0, "i8") for _ in range(3))
    kept = np.append(0, np.cumsum(inside))
    ends = kept[np.append(begin[1:], len(data))]
    raw = np.append(0, ends).astype("i4")
    coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(raw.tobytes()), pa.py_buffer(LOWER[data[inside]].tobytes())]).dictionary_encode()
    text = np.searchsorted(bounds, begin, side="right") - 1
    breaks = np.cumsum(kind == 2)[begin]
    new = np.append(True, (np.diff(breaks) > 0) | (np.diff(text) > 0))
    number = np.cumsum(new) - 1
    last = np.append(np.flatnonzero(new)[1:], len(begin))
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype("i8"), text, last[number] - np.arange(len(begin))


def languages(langs: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = pc.fill_null(langs, UNKNOWN).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype("i8")


def hashes(vocabulary: pa.Array, word: np.ndarray, names: list[str], lang: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each occurrence the hash of its word in its language, and of it and the next word (for the last one of a piece, of nothing)."""
    with np.errstate(over="ignore"):
        each = common.hash64(vocabulary)[word]
        one = common.mix(each ^ common.mix(common.hash64(pa.array(names, pa.string())))[lang])
        two = common.mix(one * np.uint64(0x9E3779B97F4A7C15) + np.append(each[1:], np.uint64(0)))
    return one, np.where(left > 1, two, one)


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, "i8")
    sums = np.diff(np.append(at, len(keys))) if counts is None else np.add.reduceat(counts[order], at) if len(at) else np.empty(0, "i8")
    return keys[at], sums.astype("i8")


def read(batch: pa.RecordBatch):
    """By block: words as of words(), the languages' names, and the language of each occurrence."""
    for part in common.blocks(batch, "text"):
        vocabulary, word, text, left = words(part.column("text"))
        names, lang = languages(part.column("lang"))
        yield vocabulary, word, left, names, lang[text]


def frequent_keys(rows: DataFrame, least: int) -> DataFrame:
    """key: the hashes of words and of pairs that occur so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def given() -> pa.RecordBatch:
            keys, n = counted(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(keys.view("i8")), pa.array(n)], names=["key", "n"])

        for batch in batches:
            for vocabulary, word, left, names, lang in read(batch):
                one, two = hashes(vocabulary, word, names, lang, left)
                held += [one, two[left > 1]]
                size += len(one) + len(held[-1])
                if size >= HASHES:
                    yield given()
                    held, size = [], 0
        if size:
            yield given()

    return rows.mapInArrow(common.tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")


class Map:
    """Two bits for each key, in parts; an absent key passes by chance alone."""

    def __init__(self, parts: int, bits: dict[int, bytes]):
        empty = bytes(1 << PART_BITS - 3)
        self.bits = np.frombuffer(b"".join(bits.get(k, empty) for k in range(parts)), "u1")
        self.parts = parts

    @staticmethod
    def places(keys: np.ndarray) -> Iterator[np.ndarray]:
        """The two bits of a key within its part."""
        for shift in (12, 12 + PART_BITS):
            yield (keys >> np.uint64(shift)).astype("i8") & (1 << PART_BITS) - 1

    def has(self, keys: np.ndarray) -> np.ndarray:
        base, found = (keys & np.uint64(self.parts - 1)).astype("i8") << PART_BITS, np.ones(len(keys), bool)
        for place in self.places(keys):
            place = base + place
            found &= (self.bits[place >> 3] >> (place & 7).astype("u1") & 1).astype(bool)
        return found


def mapped(keys: DataFrame) -> Map:
    """The map of stored keys. Its parts, PARTS at most, are made by tasks and come to the driver."""
    parts = min(PARTS, 1 << max(0, (keys.count() * BITS - 1) >> PART_BITS).bit_length())

    def run(table: pa.Table) -> pa.Table:
        own = table.column("key").combine_chunks().to_numpy(zero_copy_only=False).view("u8")
        bits = np.zeros(1 << PART_BITS, bool)
        for place in Map.places(own):
            bits[place] = True
        return pa.table({"part": pa.array([int(own[0]) & parts - 1], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    made = keys.groupBy(F.col("key").bitwiseAND(parts - 1).cast("int").alias("part")).applyInArrow(run, "part int, bits binary")
    return Map(parts, {r["part"]: bytes(r["bits"]) for r in made.collect()})


class Trie:
    """names: languages; roots: words of each; vocabulary: words in order of their bytes; and for each level the parent's place, the word and the count of its
    nodes, sorted. The first level's parents are the languages."""

    def __init__(self, names: list[str], roots: np.ndarray, vocabulary: pa.Array, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.names, self.roots, self.vocabulary, self.levels = names, roots, vocabulary, levels

    def hashes(self) -> list[np.ndarray]:
        """For each level the hashes that say in which range a node lies: of its first PREFIX words and its language."""
        with np.errstate(over="ignore"):
            own, above, out = common.hash64(self.vocabulary), common.mix(common.hash64(pa.array(self.names, pa.string()))), []
            for depth, (parent, word, _) in enumerate(self.levels):
                above = above[parent] if depth >= PREFIX else common.mix(above[parent] * np.uint64(0x9E3779B97F4A7C15) + own[word])
                out.append(above)
        return out

    def ranges(self, bits: int, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, bytes]]:
        """Ranges begin to end (None: all) of the trie by the first bits of the hashes. A range's nodes bring their ancestors, whose counts are 0 where they
        lie in another one."""
        found = [(h >> np.uint64(64 - bits)).astype("i8") for h in self.hashes()]
        kept: list[tuple[np.ndarray, np.ndarray]] = []  # of each level, from the last: range << 32 | node, in order, and count
        need = np.empty(0, "i8")
        for depth in reversed(range(len(self.levels))):
            parent, _, count = self.levels[depth]
            own = found[depth] << 32 | np.arange(len(parent))
            keys = np.union1d(own, need) if len(need) else np.sort(own, kind="stable")
            node, at = keys & 0xFFFFFFFF, keys >> 32
            kept.append((keys, np.where(found[depth][node] == at, count[node], 0)))
            need = np.unique(at << 32 | parent[node])
        kept.reverse()
        roots = np.union1d(need, np.arange(len(self.names)))  # the first range has the languages' words
        asked = np.arange(begin, (1 << bits if end is None else end) + 1)
        cuts = [np.searchsorted(keys, asked << 32) for keys in (roots, *[k for k, _ in kept])]
        for j, r in enumerate(asked[:-1].tolist()):
            if cuts[0][j] == cuts[0][j + 1]:
                continue
            langs = above = roots[cuts[0][j] : cuts[0][j + 1]] & 0xFFFFFFFF
            levels = []
            for (parent, word, _), (keys, count), cut in zip(self.levels, kept, cuts[1:]):
                own = slice(cut[j], cut[j + 1])
                node = keys[own] & 0xFFFFFFFF
                if not len(node):
                    break
                levels.append((np.searchsorted(above, parent[node]), word[node], count[own]))
                above = node
            used = np.unique(np.concatenate([*[w for _, w, _ in levels], np.empty(0, "i8")])).astype("i8")
            levels = [(p, np.searchsorted(used, w), c) for p, w, c in levels]
            yield r, Trie([self.names[k] for k in langs], self.roots[langs] if r == 0 else np.zeros(len(langs), "i8"), self.vocabulary.take(pa.array(used)), levels).written()

    def written(self) -> bytes:
        small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        levels = [(small(np.diff(p, prepend=0)), small(w), small(c)) for p, w, c in self.levels]
        raw = pickle.dumps((self.names, self.roots, self.vocabulary.to_pylist(), levels), protocol=5)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)

    @staticmethod
    def read(blob: bytes) -> Trie:
        names, roots, vocabulary, levels = pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True))
        return Trie(names, roots, pa.array(vocabulary, pa.binary()), [(np.cumsum(p, dtype="i8"), w.astype("i8"), c.astype("i8")) for p, w, c in levels])

    def rows(self, least: int) -> pa.Table:
        """The frequent nodes: lang, size (words; 0 for a language itself), phrase and a (how often)."""
        names, keep = pa.array(self.names, pa.string()), self.roots > 0
        out = [(names.filter(pa.array(keep)), 0, pa.array([""] * int(keep.sum()), pa.string()), self.roots[keep])]
        asked: list[np.ndarray] = []  # from the last level: frequent nodes and the way to them
        for depth in reversed(range(len(self.levels))):
            own = self.levels[depth][2] >= least
            if asked:
                own[self.levels[depth + 1][0][asked[-1]]] = True
            asked.append(own)
        lang, text, every = np.arange(len(self.names)), None, self.vocabulary.cast(pa.string())
        place = lang
        for depth, (parent, word, count) in enumerate(self.levels):
            own = np.flatnonzero(asked[-1 - depth])
            above = place[parent[own]]
            place = np.empty(len(parent), "i8")
            place[own] = np.arange(len(own))
            lang, last = lang[above], every.take(pa.array(word[own]))
            text = last if text is None else pc.binary_join_element_wise(text.take(pa.array(above)), last, " ")
            keep = count[own] >= least
            out.append((names.take(pa.array(lang[keep])), depth + 1, text.filter(pa.array(keep)), count[own][keep]))
        sizes = [pa.array(np.full(len(o[0]), o[1], "i4")) for o in out]
        return pa.table({"lang": pa.concat_arrays([o[0] for o in out]), "size": pa.concat_arrays(sizes), "phrase": pa.concat_arrays([o[2] for o in out]), "a": pa.array(np.concatenate([o[3] for o in out]))})


def levelled(parent: np.ndarray, word: np.ndarray, count: np.ndarray | None) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """A level of nodes, equal ones made one, and for each of those given its place in the level."""
    keys = parent << 32 | word
    order = np.argsort(keys, kind="stable")  # merges runs that are sorted already
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.empty(0, bool)
    at = np.flatnonzero(new)
    place = np.empty(len(keys), "i8")
    place[order] = np.cumsum(new) - 1
    sums = np.diff(np.append(at, len(keys))) if count is None else np.add.reduceat(count[order], at) if len(at) else np.empty(0, "i8")
    return (keys[at] >> 32, keys[at] & 0xFFFFFFFF, sums.astype("i8")), place


def merged(tries: list[Trie]) -> Trie:
    """One trie of several: their dictionaries are merged, which keeps each trie's order, and then level by level their sorted nodes."""
    names = sorted({n for t in tries for n in t.names})
    number = {n: k for k, n in enumerate(names)}
    langs = [np.array([number[n] for n in t.names], "i8") for t in tries]
    roots = np.zeros(len(names), "i8")
    for t, own in zip(tries, langs):
        np.add.at(roots, own, t.roots)
    coded = pa.concat_arrays([pa.array([], pa.binary()), *[t.vocabulary for t in tries]]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy(zero_copy_only=False)
    rank = np.empty(len(order), "i8")
    rank[order] = np.arange(len(order))
    flat, ends = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(order) else np.empty(0, "i8"), np.append(0, np.cumsum([len(t.vocabulary) for t in tries]))
    mine, above, levels = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])], langs, []
    for depth in range(max((len(t.levels) for t in tries), default=0)):
        own = [(above[k][t.levels[depth][0]], mine[k][t.levels[depth][1]], t.levels[depth][2]) if depth < len(t.levels) else (np.empty(0, "i8"),) * 3 for k, t in enumerate(tries)]
        level, place = levelled(*(np.concatenate([o[j] for o in own]) for j in range(3)))
        levels.append(level)
        cuts = np.append(0, np.cumsum([len(o[0]) for o in own]))
        above = [place[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    return Trie(names, roots, coded.dictionary.take(pa.array(order)), levels)


class Shard:
    """The words of a shard that may be part of a phrase: gathered by block, then made a trie."""

    def __init__(self, longest: int):
        self.longest, self.number, self.names, self.parts, self.roots, self.size = longest, {}, {}, [], {}, 0

    def add(self, vocabulary: pa.Array, word: np.ndarray, left: np.ndarray, names: list[str], lang: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """one, two: whether the word is frequent, and whether it and the next one are."""
        for k, n in enumerate(np.bincount(lang, minlength=len(names)).tolist()):
            self.roots[names[k]] = self.roots.get(names[k], 0) + n
        reach = one.astype("i8")  # words from here on that may be one phrase
        for _ in range(self.longest - 1):
            reach = np.where(one & two, 1 + np.append(reach[1:], 0), one)
        reach = np.minimum(reach, np.minimum(left, self.longest))
        asked = np.zeros(len(vocabulary), bool)
        asked[word[one]] = True
        renamed = np.full(len(vocabulary), -1, "i8")
        renamed[asked] = [self.number.setdefault(w, len(self.number)) for w in vocabulary.filter(pa.array(asked)).to_pylist()]
        langs = np.array([self.names.setdefault(n, len(self.names)) for n in names], "i8")
        # a word that is not frequent is in no phrase: only its place is left out
        self.parts.append((renamed[word].astype("i4"), reach.astype("i1"), langs[lang].astype("i4")))
        self.size += len(word)

    def trie(self) -> Trie:
        word, reach, lang = (np.concatenate([p[k] for p in self.parts]).astype("i8") for k in range(3))
        vocabulary = pa.array(list(self.number), pa.binary())
        order = pc.sort_indices(vocabulary).to_numpy(zero_copy_only=False)
        rank = np.empty(len(order), "i8")
        rank[order] = np.arange(len(order))
        named = sorted(self.names)
        lang = np.array([named.index(n) for n in self.names], "i8")[lang]
        at, levels = np.flatnonzero(reach > 0), []
        above = lang[at]
        for depth in range(self.longest):
            more = reach[at] > depth
            at, above = at[more], above[more]
            if not len(at):
                break
            level, above = levelled(above, rank[word[at + depth]], None)
            levels.append(level)
        return Trie(named, np.array([self.roots[n] for n in named], "i8"), vocabulary.take(pa.array(order)), levels)


def shard_tries(rows: DataFrame, shared: Broadcast, longest: int, bits: int) -> DataFrame:
    """run (a shard's number), range and trie; shared: the map of frequent words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, known = TaskContext.get().partitionId() << 24, Shard(longest), shared.value

        def given(number: int) -> Iterator[pa.RecordBatch]:
            for r, blob in shard.trie().ranges(bits):
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([r]), pa.array([blob], pa.binary())], names=["run", "range", "trie"])

        for batch in batches:
            for vocabulary, word, left, names, lang in read(batch):
                if not len(word):
                    continue
                one, two = hashes(vocabulary, word, names, lang, left)
                shard.add(vocabulary, word, left, names, lang, known.has(one), known.has(two) & (left > 1))
                if shard.size >= SHARD_WORDS:
                    yield from given(number)
                    number, shard = number + 1, Shard(longest)
        if shard.size:
            yield from given(number)

    return rows.mapInArrow(common.tidy(run), "run long, range long, trie binary")


def merging(bits: int, finer: int):
    """The merge of one range of some shards into finer ranges."""

    def run(table: pa.Table) -> pa.Table:
        shard, own = table.column("run")[0].as_py(), table.column("range")[0].as_py()
        cut = list(merged([Trie.read(b.as_py()) for b in table.column("trie")]).ranges(bits, own << finer, own + 1 << finer))
        return pa.table({"run": pa.array([shard] * len(cut), pa.int64()), "range": pa.array([r for r, _ in cut], pa.int64()), "trie": pa.array([b for _, b in cut], pa.binary())})

    return run


def phrases(docs: DataFrame, longest: int = 5, least: int = 100, text: str = "text", lang: str = "lang", fan_in: int = FAN_IN, range_bits: int = RANGE_BITS) -> DataFrame:
    """lang, size, phrase and a (occurrences) of all phrases of 1 to longest words that occur least times or more; size 0: all words of the
    language."""
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    keys = common.stored(frequent_keys(rows, least), "keys")
    shared, bits = docs.sparkSession.sparkContext.broadcast(mapped(keys)), range_bits
    tries = common.stored(shard_tries(rows, shared, longest, bits), "tries", compression="none")  # they are compressed
    common.discard(keys)
    shared.destroy()
    while True:
        runs = tries.select("run").distinct().count()
        groups = -(-runs // fan_in)
        dealt = tries.select(F.pmod(F.xxhash64("run"), F.lit(max(1, groups))).alias("run"), "range", "trie")
        if groups <= 1:
            last = lambda table: merged([Trie.read(b.as_py()) for b in table.column("trie")]).rows(least)
            found = common.stored(dealt.groupBy("range").applyInArrow(last, "lang string, size int, phrase string, a long"), "phrases")
            common.discard(tries)
            return found
        bits += range_bits
        before, tries = tries, common.stored(dealt.groupBy("run", "range").applyInArrow(merging(bits, range_bits), "run long, range long, trie binary"), "tries", compression="none")
        common.discard(before)


def scored(found: DataFrame, percent: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the phrases of two words or more that no longer one of percent of its occurrences holds. l, r: occurrences of what the cut of the
    lowest score, the first of equals, leaves on either side; n: words of the language; score: floor(1000 a n / (l r)), exactly."""
    space, size = F.lit(" "), F.col("size")
    total = found.where(size == 0).select("lang", F.col("a").alias("n"))
    nodes = found.where(size > 0).select("lang", "phrase", "a")
    candidates = found.where(size > 1)
    parts = F.split("phrase", space)
    join = lambda words: F.array_join(words, " ")
    cuts = candidates.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("first", join(F.slice(parts, F.lit(1), F.col("k")))).withColumn("rest", join(F.slice(parts, F.col("k") + 1, size - F.col("k"))))
    left = nodes.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = nodes.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(total, "lang")
    score = F.expr("(cast(1000 * cast(a as decimal(16,0)) as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    # a longer phrase one word at a time: those between have no fewer occurrences, so they hold it too
    longer = candidates.where(size > 2)
    within = longer.select("lang", join(F.slice(parts, F.lit(1), size - 1)).alias("phrase"), F.col("a").alias("m")).unionByName(longer.select("lang", join(F.slice(parts, F.lit(2), size - 1)).alias("phrase"), F.col("a").alias("m")))
    within = within.groupBy("lang", "phrase").agg(F.max("m").alias("m"))
    kept = lowest.join(within, ["lang", "phrase"], "left").where(F.col("m").isNull() | (F.col("m") * 100 < F.col("a") * percent))
    return kept.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def best(found: DataFrame, most: int = 2000) -> DataFrame:
    """The first phrases of each language, with rank."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
