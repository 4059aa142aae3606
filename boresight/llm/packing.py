"""Packing token sequences by sums of squares.

Documents become token ids plus an end id; what is longer than a sequence is cut into pieces of the full length. A piece then
goes where the sum over residual gaps of (open sequences with that gap) squared becomes smallest: into an open sequence, the
tightest gap on ties, or a new one. Pieces are dealt at random to groups of GROUP_PIECES and each group is packed by itself,
longest piece first; what lies in sequences left open by more than REPACK_GAP is packed again, in ever fewer groups, until one
group or nothing is left. No group is larger than GROUP_PIECES in the mean, so a task's memory is bounded at any size.

Defined cases: a null text is empty and gives one piece holding the end id only; repeated rows are packed each; ties are
settled by order within the group; an empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GROUP_PIECES = 4000
REPACK_GAP = 1 / 64
#: Words whose ids a worker remembers.
CACHE_WORDS = 300_000
#: A word whose outer ASCII punctuation can be encoded apart: the tokenizer itself parts it from a Latin letter or a digit. An
#: apostrophe may begin a contraction, and "<|" a special token; such words are encoded whole.
PUNCTUATION = r"""[!"#$%&()*+,\-./:;=?@\[\\\]^_`{|}~]*"""
LETTER = r"a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}"
CORE = f"[{LETTER}0-9]"
PARTS = rf"^(?P<head>{PUNCTUATION})(?P<core>{CORE}(?:[^<']*{CORE})?)(?P<tail>{PUNCTUATION})$"


LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Known:
    """Words a worker has encoded, as arrays: the words, their ids one after another, and the number of each word."""

    words = pa.array([], pa.string())
    ids, sizes = np.empty(0, "<u4"), np.empty(0, "i8")


@cache
def known(path: str) -> Known:
    return Known()


def encoded(path: str, missing: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words in another order, their ids one after another, and the number of each word."""
    encoder, ids, sizes = tokenizer(path), [], []
    plain = pc.match_substring_regex(missing, f"^[{LETTER}]+$")
    letters, others = missing.filter(plain), missing.filter(pc.invert(plain))
    for start in range(0, len(letters), 4096):  # a word of letters is one unit of the tokenizer, so many can be encoded as one text
        part = letters.slice(start, 4096).to_pylist()
        got = encoder.encode(" ".join(part), add_special_tokens=False)
        ids.append(np.array(got.ids, "<u4")), sizes.append(np.bincount(got.word_ids, minlength=len(part)))
    for start in range(0, len(others), 4096):
        got = [e.ids for e in encoder.encode_batch_fast(others.slice(start, 4096).to_pylist(), add_special_tokens=False)]
        ids += [np.array(x, "<u4") for x in got]
        sizes.append(np.fromiter(map(len, got), "i8", len(got)))
    return pa.concat_arrays([letters, others]), np.concatenate([*ids, np.empty(0, "<u4")]), np.concatenate([*sizes, np.empty(0, "i8")])


def word_ids(path: str, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after another, and the number of each word."""
    have = known(path)
    at = pc.index_in(vocabulary, value_set=have.words)
    if at.null_count:
        if len(have.words) + at.null_count > CACHE_WORDS:  # begin anew with these
            have.words, have.ids, have.sizes = encoded(path, vocabulary)
        else:
            words, ids, sizes = encoded(path, vocabulary.filter(pc.is_null(at)))
            have.words, have.ids, have.sizes = pa.concat_arrays([have.words, words]), np.concatenate([have.ids, ids]), np.concatenate([have.sizes, sizes])
        at = pc.index_in(vocabulary, value_set=have.words)
    return gather(have.ids, have.sizes, at.to_numpy(zero_copy_only=False))


def gather(ids: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries that index names, one after another, and the number of each."""
    begin, length = np.cumsum(sizes) - sizes, sizes[index]
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length - begin[index], length)
    return ids[at], length


def partly_lower(text: str) -> str:
    """ASCII capitals lowered but in words with "<|"."""
    return re.sub(r"[^ \t-\r]+", lambda m: m[0] if "<|" in m[0] else m[0].translate(LOWER), text)


def encode(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each text with the end id after it, one after another, and the number of each text.

    The tokenizer drops white space and no token spans it, so each distinct word is encoded once a block. It lowers words itself, but
    after it has looked for special tokens by case, so words that may hold one are left as they are.
    """
    texts = pc.fill_null(texts, "")
    lower = pc.ascii_lower(texts)
    special = pc.match_substring(texts, "<|")
    if pc.any(special).as_py():
        lower = pc.if_else(special, pa.array(map(partly_lower, texts.to_pylist()), texts.type), lower)
    vocabulary, index, counts = common.words(lower)
    parts = pc.extract_regex(vocabulary, pattern=PARTS)
    head, core, tail = (pc.fill_null(pc.struct_field(parts, k), "") for k in ("head", "core", "tail"))
    core = pc.if_else(pc.is_null(parts), vocabulary, core)
    coded = pa.concat_arrays([head, core, tail]).dictionary_encode()
    ids, sizes = word_ids(path, coded.dictionary)
    ids, sizes = gather(ids, sizes, coded.indices.to_numpy(zero_copy_only=False).reshape(3, -1).T.ravel())
    sizes = sizes.reshape(-1, 3).sum(1)
    ids, sizes = np.append(ids, np.uint32(end_id)), np.append(sizes, 1)
    index = np.insert(index.astype("i8"), np.cumsum(counts), len(sizes) - 1)
    stream, length = gather(ids, sizes, index)
    row = np.repeat(np.arange(len(texts)), counts + 1)
    return stream, np.bincount(row, length, len(texts)).astype("i8")


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.blocks(batch, "text"):
                stream, sizes = encode(tokenizer_path, part.column("text"), end_id)
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(capacity, sizes[row] - piece * capacity)
                raw = np.append(0, np.cumsum(length) * 4).astype("i4")
                ids = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(raw.tobytes()), pa.py_buffer(stream.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece.astype("i4")), pa.array(piece * capacity), pa.array(length), ids], names=["doc_id", "piece", "start", "length", "ids"])

    return rows.mapInArrow(common.tidy(run), f"doc_id {rows.dtypes[0][1]}, piece int, start long, length long, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each piece, placed in the order given."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, "i8")
    out, made = np.empty(len(lengths), "i8"), 0
    for k, size in enumerate(lengths.tolist()):
        gap = 0
        if size < capacity:
            # growth of the sum of squares if a sequence of gap g = size .. capacity - 1 takes the piece
            took = count[size:capacity]
            growth = 2 * (count[: capacity - size] - took) + 2
            growth[0] = 1 - 2 * took[0]
            growth[took == 0] = 1 << 40
            best = int(growth.argmin())
            if growth[best] <= 2 * count[capacity - size] + 1:
                gap = size + best
        if gap:
            where = open_at[gap].pop()
            count[gap] -= 1
        else:
            where, gap, made = made, capacity, made + 1
        if gap > size:
            open_at[gap - size].append(where)
            count[gap - size] += 1
        out[k] = where
    return out


def pack(parts: DataFrame, capacity: int = 4096, length: str = "length") -> DataFrame:
    """parts with sequence_id and offset (in place of any so called); parts is kept in the shared folder meanwhile. Give it no more
    columns than needed."""
    parts = parts.drop("sequence_id", "offset")
    own = parts.dtypes
    fields = ", ".join(f"`{c}` {k}" for c, k in own)
    key, group, gap = (common.free(parts.columns, n) for n in ("_key", "_group", "_gap"))

    def place(level: int):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values([length, key], ascending=[False, True], ignore_index=True)
            size = frame[length].to_numpy()
            where = sum_of_squares(size, capacity)
            order = np.argsort(where, kind="stable")
            ends = np.cumsum(size[order])
            first = np.searchsorted(where[order], where[order])
            offset = np.empty(len(size), "i8")
            offset[order] = ends - size[order] - (ends[first] - size[order][first])
            fill = np.bincount(where, size)
            sequence = (level << 56) + (int(frame[group].iloc[0]) << 28) + where
            return frame.drop(columns=[group]).assign(**{"sequence_id": sequence, "offset": offset, gap: (capacity - fill[where]).astype("i4")})

        return run

    left, done, level, before = parts.withColumn(key, F.xxhash64(F.monotonically_increasing_id())), None, 0, None
    left = common.stored(left, "pieces")
    while True:
        n = left.count()
        groups = max(1, -(-n // GROUP_PIECES))
        # the key is hashed again at each level, else groups of one level would stay together
        dealt = left.withColumn(group, F.pmod(F.xxhash64(key, F.lit(level)), F.lit(groups)))
        packed = dealt.groupBy(group).applyInPandas(place(level), f"{fields}, `{key}` long, sequence_id long, offset long, `{gap}` int")
        if groups == 1 or (before is not None and n > 0.9 * before):
            return (packed if done is None else done.unionByName(packed)).drop(key, gap)
        packed = common.stored(packed, "packed")
        closed = packed.where(F.col(gap) <= int(capacity * REPACK_GAP))
        done = closed if done is None else done.unionByName(closed)
        left, level, before = packed.where(F.col(gap) > int(capacity * REPACK_GAP)).select(*[f"`{c}`" for c, _ in own], key), level + 1, n


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each whole sequence, from packed pieces that still carry their ids."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("offset")
        return pd.DataFrame({"sequence_id": frame["sequence_id"].iloc[:1], "ids": [b"".join(frame["ids"])]})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(join, "sequence_id long, ids binary")
