"""Alignment of two tokenizers' tokens of one text.

A worker cuts the texts of a block of documents into stretches, tokenises each distinct stretch twice, and gives ids and byte offsets at which tokens end,
the stretches laid one after another; all that follows is functions of arrays. Offsets at which tokens of both end (intersect1d) cut the tokens into
groups. Each offset at which a token of either side ends (union1d) closes exactly one link, the pair of tokens that hold the byte before it; both are
found by searchsorted in the ends. A document's groups and links are those of its stretches. Between the steps a block has its distinct pairs once,
and its links are places among them.

Stretches are cut where the first tokenizer's own pattern always cuts too, before spaces and marks; and no piece of the second one has a space behind
another character or a mark behind a letter, which is checked. So neither has a token across.

How often each pair of ids is linked in the whole corpus is summed over the blocks' counts. The most frequent pairs, PAIRS_SENT of them at most, travel to
all tasks as sorted arrays; the others are joined with the documents that have them, so no bound on the pairs is assumed.

Defined cases: a text that is null or empty, or that either tokenizer does not give back byte for byte, has no tokens, groups or links; repeated
rows are aligned each and all count; an empty table gives an empty result; other columns, whatever their names, are kept or left
out as asked and play no part.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .packing import gather

#: Bytes of text in a block of documents (one document at least), which is one row with its distinct stretches.
BLOCK_BYTES = 2 << 20
#: Stretches whose tokens a worker remembers, the longest of them in characters, and tokens of a side from which on all are forgotten.
CACHE_STRETCHES, CACHE_LENGTH, CACHE_TOKENS = 200_000, 64, 1_000_000
#: Pairs of ids that are broadcast at most: 24 bytes each.
PAIRS_SENT = 500_000
#: Stored blocks have a row group each: Spark's reader decodes up to 4096 rows of a row group at once, which are the whole file where a row is a block.
BY_BLOCK = {"parquet.block.row.count.limit": "1"}
SIDES, MADE = ("a", "b"), ("n_a", "n_b", "stretches")
LISTS, LINKED = ("a_ids", "a_ends", "b_ids", "b_ends", "ends", "uses"), ("pairs", "pair_uses", "link_at", "link_ends")


class ByteLevel:
    """The first tokenizer: byte-level BPE from a JSON file. Special tokens' strings are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that stand for themselves; the others follow from 256 on
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        entries = self.own.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.bytes[k] = bytes(shown[c] for c in entry) if all(c in shown for c in entry) else entry.encode()

    def encode(self, stretches: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch_fast(stretches, add_special_tokens=False)]


class Pieces:
    """The second tokenizer: a SentencePiece model that adds a space before a text; it gets each stretch without its own. A stretch that begins with a mark gets a letter
    before it, whose token is left out. No piece may hold what stretches are cut between."""

    LETTER = "x"

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        own = self.own
        if any(re.search(rf"[^▁]▁|[0-9A-Za-zÀ-ɏ][{common.MARKS}]", own.id_to_piece(k)) for k in range(own.get_piece_size()) if not (own.is_byte(k) or own.is_control(k))):
            raise ValueError("pieces that hold a space behind another character, or a mark behind a letter, are not provided for")
        self.bytes = [bytes([int(own.id_to_piece(k)[3:-1], 16)]) if own.is_byte(k) else own.id_to_piece(k).replace("▁", " ").encode() for k in range(own.get_piece_size())]

    def encode(self, stretches: list[str]) -> list[list[int]]:
        got = self.own.encode([s[1:] if s[0] == " " else self.LETTER + s for s in stretches], num_threads=1)
        return [ids if s[0] == " " else ids[1:] for ids, s in zip(got, stretches)]


class Side:
    """What one tokenizer gave for the stretches that a worker remembers: ids one after another, and their number by stretch."""

    def __init__(self, tokenizer):
        self.tokenizer, self.length = tokenizer, np.array([len(b) for b in tokenizer.bytes], "i8")
        self.forget()

    def forget(self) -> None:
        self.ids, self.sizes = np.empty(0, "i8"), np.empty(0, "i8")

    def add(self, stretches: list[str], same: np.ndarray) -> None:
        table, ids, sizes = self.tokenizer.bytes, [self.ids], [self.sizes]
        for start in range(0, len(stretches), 4096):
            part = stretches[start : start + 4096]
            got = self.tokenizer.encode(part)
            same[start : start + 4096] &= [b"".join([table[i] for i in x]) == stretch.encode() for x, stretch in zip(got, part)]
            ids.append(np.fromiter((i for x in got for i in x), "i8"))
            sizes.append(np.fromiter(map(len, got), "i8", len(got)))
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)


class Known(dict):
    """Stretch -> its place among those both sides have tokenised."""

    def __init__(self, a_path: str, b_path: str):
        super().__init__()
        self.sides, self.same = (Side(ByteLevel(a_path)), Side(Pieces(b_path))), np.empty(0, bool)

    def tokenised(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """For distinct stretches: which come back byte for byte from both, their place in what is given, and (ids, sizes) of both sides by place."""
        missing = [s for s in stretches if s not in self]
        # long stretches are in the lists, though not in the dictionary
        if len(self.same) + len(missing) > CACHE_STRETCHES or max(len(side.ids) for side in self.sides) > CACHE_TOKENS:
            self.clear()
            self.same = np.empty(0, bool)
            for side in self.sides:
                side.forget()
            missing = stretches
        self.update(zip(missing, range(len(self.same), len(self.same) + len(missing))))
        same = np.ones(len(missing), bool)
        for side in self.sides:
            side.add(missing, same)
        self.same = np.concatenate([self.same, same])
        at = np.fromiter(map(self.__getitem__, stretches), "i8", len(stretches))
        found = self.same[at], at, [(side.ids, side.sizes) for side in self.sides]
        for s in missing:
            if len(s) > CACHE_LENGTH:  # its tokens stay until all are forgotten, its text does not
                del self[s]
        return found


@cache
def known(a_path: str, b_path: str) -> Known:
    return Known(a_path, b_path)


def block(a_path: str, b_path: str, texts: pa.Array) -> tuple[list[pa.Array], list[pa.Array]]:
    """MADE of each text, and LISTS of the block."""
    tables = known(a_path, b_path)
    texts = pc.fill_null(texts, "")
    distinct, place, counts = common.stretches(pc.if_else(pc.greater(pc.binary_length(texts), 0), pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)), texts))
    same, at, sides = tables.tokenised(distinct.to_pylist())
    owner = np.repeat(np.arange(len(texts)), counts)
    good = np.ones(len(texts), bool)
    good[owner[~same[place]]] = False
    keep = good[owner]
    owner, place = owner[keep], place[keep]
    uses = np.bincount(place, minlength=len(distinct))
    used = uses > 0  # a stretch of texts without tokens alone is left out
    lists, sizes = {"uses": uses[used]}, []
    for (ids, numbers), side, name in zip(sides, tables.sides, SIDES):
        ids, number = gather(ids, numbers, at[used])
        ends = np.cumsum(side.length[ids])
        lists |= {f"{name}_ids": ids, f"{name}_ends": ends, "ends": ends[np.cumsum(number) - 1]}
        sizes.append(number)
    place = (np.cumsum(used) - 1)[place]
    totals = [np.bincount(owner, number[place], len(texts)).astype("i8") for number in sizes]
    return [*map(pa.array, totals), listed(place, np.bincount(owner, minlength=len(texts)))], [listed(lists[c], np.array([len(lists[c])])) for c in LISTS]


def listed(values: np.ndarray | pa.Array, sizes: np.ndarray) -> pa.ListArray:
    values = values if isinstance(values, pa.Array) else pa.array(values.astype("i4"))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype("i4")), values)


def fields_of(docs: DataFrame, text: str, keep: list[str] | None) -> tuple[DataFrame, list[str], str, str]:
    """The rows to tokenise, the columns kept of them, the text's column, and the fields of MADE and of those kept as DDL."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in MADE]
    place = common.free(kept, "_text")
    rows = docs.select(*[f"`{c}`" for c in kept], docs[f"`{text}`"].alias(place))
    return rows, kept, place, ", ".join([*[f"`{c}`: {k}" for c, k in rows.dtypes[:-1]], "n_a: long, n_b: long, stretches: array<int>"])


def tokenised(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, kept: list[str], place: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.blocks(batch, place, BLOCK_BYTES):
            numbers, lists = block(a_path, b_path, part.column(place))
            whole = pa.StructArray.from_arrays([*[part.column(c) for c in kept], *numbers], names=[*kept, *MADE])
            yield pa.RecordBatch.from_arrays([listed(whole, np.array([len(whole)])), *lists], names=["docs", *LISTS])


def tokenise(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row for each block of documents: docs, the columns keep (None: all) of each with n_a and n_b, its numbers of tokens, and stretches, places in the
    block's list of distinct stretches (in place of any columns so called); and for those, laid one after another, ids and byte offsets of ends of the tokens of
    either side, the byte offsets of the stretches' own ends, and their numbers of uses."""
    rows, kept, place, fields = fields_of(docs, text, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tokenised(batches, a_path, b_path, kept, place)

    return rows.mapInArrow(common.tidy(run), f"docs array<struct<{fields}>>, " + ", ".join(f"{c} array<int>" for c in LISTS))


def numbers(column: pa.Array, row: int) -> np.ndarray:
    """The numbers of a row of a column of lists."""
    return column[row].values.to_numpy(zero_copy_only=False)


class Spans:
    """The groups and links of a block's stretches: of each group the places past its last tokens on either side, of each link its pair of ids (the first side's in the
    upper 32 bits), and the numbers of groups and of links up to the end of each stretch."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.a_ids, a_ends, self.b_ids, b_ends, ends = (numbers(batch.column(c), row) for c in LISTS[:-1])
        cuts, closed = np.intersect1d(a_ends, b_ends), np.union1d(a_ends, b_ends)
        self.a_to, self.b_to = np.searchsorted(a_ends, cuts, "right"), np.searchsorted(b_ends, cuts, "right")
        self.links = self.a_ids[np.searchsorted(a_ends, closed)].astype("i8") << 32 | self.b_ids[np.searchsorted(b_ends, closed)]
        self.group_ends, self.link_ends = np.searchsorted(cuts, ends, "right"), np.searchsorted(closed, ends, "right")

    def written(self) -> list[str]:
        """The groups of each stretch as a1,a2|b1;a3|b2,b3."""
        sizes = np.column_stack([np.diff(self.a_to, prepend=0), np.diff(self.b_to, prepend=0)]).ravel()  # of a group's first side, then its second
        side = np.repeat(np.arange(len(sizes)) % 2, sizes)
        ids = np.empty(len(side), "i8")
        ids[side == 0], ids[side == 1] = self.a_ids, self.b_ids
        mark = np.zeros(len(side), "i8")  # 1: the last of its group on the first side, 2: of the group
        mark[np.cumsum(sizes) - 1] = np.arange(len(sizes)) % 2 + 1
        shown = [f"{i}{',|;'[m]}" for i, m in zip(ids.tolist(), mark.tolist())]
        to = (self.a_to + self.b_to)[self.group_ends - 1].tolist()
        return ["".join(shown[i:k])[:-1] for i, k in zip([0, *to], to)]


def spread(ends: np.ndarray, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of what the stretches named consist of, one after another, and how many each has; ends: up to the end of each stretch."""
    return gather(np.arange(ends[-1] if len(ends) else 0), np.diff(ends, prepend=0), stretches)


def by_document(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of the values of each document; sizes: how many it has."""
    return np.diff(np.append(0, np.cumsum(values))[np.append(0, np.cumsum(sizes))])


def aligned(blocks: DataFrame) -> DataFrame:
    """The documents of blocks, a row each: their columns with groups, an array<struct<a: array<int>, b: array<int>>> of ids, and links, an array<long> of pairs of
    ids (in place of any so called)."""
    own = {f.name: f.dataType.simpleString() for f in blocks.schema["docs"].dataType.elementType.fields if f.name not in ("stretches", "groups", "links")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                docs, spans = batch.column("docs")[row].values, Spans(batch, row)
                sides = [listed(ids, np.diff(to, prepend=0)) for ids, to in ((spans.a_ids, spans.a_to), (spans.b_ids, spans.b_to))]
                groups = pa.StructArray.from_arrays(sides, names=list(SIDES))
                stretches = docs.field("stretches")
                sizes, flat = pc.list_value_length(stretches).to_numpy(zero_copy_only=False), stretches.flatten().to_numpy(zero_copy_only=False)
                out = [docs.field(c) for c in own]
                for values, ends in ((groups, spans.group_ends), (pa.array(spans.links), spans.link_ends)):
                    at, each = spread(ends, flat)
                    out.append(listed(values.take(pa.array(at)), by_document(each, sizes)))
                yield pa.RecordBatch.from_arrays(out, names=[*own, "groups", "links"])

    return blocks.mapInArrow(common.tidy(run), ", ".join([*[f"`{c}` {k}" for c, k in own.items()], "groups array<struct<a: array<int>, b: array<int>>>, links array<long>"]))


def digests(batches: Iterator[pa.RecordBatch], digest: Callable[[str], str], name: str, own: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            docs, spans = batch.column("docs")[row].values, Spans(batch, row)
            written, groups = spans.written(), np.diff(spans.group_ends, prepend=0)
            stretches = docs.field("stretches")
            sizes, flat = pc.list_value_length(stretches).to_numpy(zero_copy_only=False), stretches.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            told = pa.array((digest(";".join(map(written.__getitem__, flat[e - n : e].tolist()))) if n else None for e, n in zip(ends.tolist(), sizes.tolist())), pa.string())
            pairs, at = np.unique(spans.links, return_inverse=True)
            uses = np.bincount(at, np.repeat(numbers(batch.column("uses"), row), np.diff(spans.link_ends, prepend=0)), len(pairs))
            whole = pa.StructArray.from_arrays([*[docs.field(c) for c in own], pa.array(by_document(groups[flat], sizes)), told], names=[*own, "n_groups", name])
            lists = [listed(v, np.array([len(v)])) for v in (pa.array(pairs), pa.array(uses.astype("i8")), at, spans.link_ends)]
            yield pa.RecordBatch.from_arrays([listed(whole, np.array([len(whole)])), *lists], names=["docs", *LINKED])


def digested(blocks: DataFrame, digest: Callable[[str], str], name: str = "digest") -> DataFrame:
    """blocks whose docs also have n_groups and name (in place of any so called): digest of the groups as text (a1,a2|b1;a3|b2,b3), null without groups. Beside docs there
    are the block's distinct pairs of linked ids, the uses of each, link_at, the place among them of each link, and link_ends, the number of links up to the end of each
    stretch."""
    fields = [f for f in blocks.schema["docs"].dataType.elementType.fields if f.name not in ("n_groups", name)]
    own, shown = [f.name for f in fields], ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields)
    return blocks.mapInArrow(common.tidy(lambda batches: digests(batches, digest, name, own)), digested_schema(shown, name))


def digested_schema(fields: str, name: str) -> str:
    return f"docs array<struct<{fields}, n_groups: long, `{name}`: string>>, pairs array<long>, pair_uses array<long>, link_at array<int>, link_ends array<int>"


def tokenise_digested(docs: DataFrame, a_path: str, b_path: str, digest: Callable[[str], str], name: str = "digest", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """digested(tokenise(docs)), both by the same workers."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_groups", name)]
    rows, kept, place, fields = fields_of(docs, text, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return digests(tokenised(batches, a_path, b_path, kept, place), digest, name, [*kept, *MADE])

    return rows.mapInArrow(common.tidy(run), digested_schema(fields, name))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n (links that hold it) and best (whether no other pair of its second id has more) over all blocks."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "pair_uses")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.pair_uses").alias("m"))
    counts = each.groupBy("pair").agg(F.sum("m").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))
    return counts.withColumn("best", (F.col("n") == highest).cast("long"))


def frequent(pairs: DataFrame, most: int = PAIRS_SENT) -> DataFrame:
    """The pairs of at least such a power of two of links that they are most or fewer."""
    sizes = {r["k"]: r["m"] for r in pairs.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("m")).collect()}  # 63 rows at most
    held, least = 0, 63
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > most:
            break
        least = k
    return pairs.where(F.floor(F.log2("n")) >= least)


def looked_up(table: tuple[np.ndarray, np.ndarray, np.ndarray], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n and best of each pair, 0 where the sorted table has it not, and whether it has."""
    known, n, best = table
    if not len(known):
        return np.zeros(len(pairs), "i8"), np.zeros(len(pairs), "i8"), np.zeros(len(pairs), bool)
    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
    hit = known[at] == pairs
    return n[at] * hit, best[at] * hit, hit


def with_links(blocks: DataFrame, most: int = PAIRS_SENT) -> DataFrame:
    """The documents of digested blocks, a row each, with n_links, n_best (links whose pair is linked most of those of its second id, corpus-wide) and
    count_sum (over the links, how often their pair is linked corpus-wide), in place of any so called, and without stretches."""
    made = ("n_links", "n_best", "count_sum")
    own = {f.name: f.dataType.simpleString() for f in blocks.schema["docs"].dataType.elementType.fields if f.name not in ("stretches", *made)}
    blocks = common.stored(blocks.withColumn("block", F.monotonically_increasing_id()), "aligned", **BY_BLOCK)
    pairs = common.stored(pair_counts(blocks), "pairs")
    sent = frequent(pairs, most)
    listed_pairs = sent.orderBy("pair").toArrow()  # most of them
    table = blocks.sparkSession.sparkContext.broadcast(tuple(listed_pairs.column(c).to_numpy() for c in ("pair", "n", "best")))
    own_ddl = ", ".join(f"`{c}` {k}" for c, k in own.items())
    block_id, place = common.free(list(own), "_block"), common.free(list(own), "_place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                docs, at, ends = batch.column("docs")[row].values, numbers(batch.column("link_at"), row), numbers(batch.column("link_ends"), row)
                n, best, _ = looked_up(table.value, numbers(batch.column("pairs"), row))
                stretches = docs.field("stretches")
                sizes, flat = pc.list_value_length(stretches).to_numpy(zero_copy_only=False), stretches.flatten().to_numpy(zero_copy_only=False)
                sums = [by_document(by_document(v[at], np.diff(ends, prepend=0))[flat], sizes) for v in (best, n)]
                links = pc.subtract(pc.add(docs.field("n_a"), docs.field("n_b")), docs.field("n_groups"))
                where = [pa.array(np.full(len(docs), batch.column("block")[row].as_py(), "i8")), pa.array(np.arange(len(docs)))]
                yield pa.RecordBatch.from_arrays([*[docs.field(c) for c in own], links, *map(pa.array, sums), *where], names=[*own, *made, block_id, place])

    out = blocks.mapInArrow(common.tidy(run), f"{own_ddl}, " + ", ".join(f"`{c}` long" for c in (*made, block_id, place)))
    names = [F.col(f"`{c}`") for c in (*own, "n_links")]
    rare = pairs.join(sent.select("pair"), "pair", "left_anti")
    if rare.isEmpty():
        return out.select(*names, *made[1:])
    more = rare_sums(blocks, rare, table)
    out = out.join(more, (out[f"`{block_id}`"] == more["_rare_block"]) & (out[f"`{place}`"] == more["_rare_doc"]), "left")
    return out.select(*names, *[(F.col(c) + F.coalesce(F.col(f"_rare_{c}"), F.lit(0))).alias(c) for c in made[1:]])


def rare_sums(blocks: DataFrame, rare: DataFrame, table) -> DataFrame:
    """_rare_block, _rare_doc (its place there), _rare_n_best and _rare_count_sum over the links of pairs that were not sent: only those are dealt out, each once for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                pairs, at, ends = (numbers(batch.column(c), row) for c in ("pairs", "link_at", "link_ends"))
                lost = ~looked_up(table.value, pairs)[2][at]  # by link
                kept = np.append(0, np.cumsum(lost))
                stretches = batch.column("docs")[row].values.field("stretches")
                sizes, flat = pc.list_value_length(stretches).to_numpy(zero_copy_only=False), stretches.flatten().to_numpy(zero_copy_only=False)
                where, each = spread(kept[ends], flat)
                owner = np.repeat(np.repeat(np.arange(len(sizes)), sizes), each)
                keys, m = np.unique(owner * len(pairs) + at[lost][where], return_counts=True)
                block_id = np.full(len(keys), batch.column("block")[row].as_py(), "i8")
                yield pa.RecordBatch.from_arrays([*map(pa.array, (block_id, keys // max(len(pairs), 1), pairs[keys % max(len(pairs), 1)], m.astype("i8")))], names=["block", "doc", "pair", "m"])

    held = blocks.mapInArrow(common.tidy(run), "block long, doc long, pair long, m long").join(rare, "pair")
    found = held.groupBy(F.col("block").alias("_rare_block"), F.col("doc").alias("_rare_doc"))
    return found.agg(F.sum(F.col("m") * F.col("best")).alias("_rare_n_best"), F.sum(F.col("m") * F.col("n")).alias("_rare_count_sum"))
