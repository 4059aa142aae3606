"""Byte-level BPE by backtracking from longest matches.

Merging by ranks is replaced by a search that gives the same tokens: two tokens may stand side by side if undoing their merges, the later
one first, never meets a point in time at which BPE would have merged across the border. A sequence is BPE's own if all its
neighbours may stand so. An automaton over the bytes (as Latin-1 characters) finds the longest token at every place; the search takes it, or
the next shorter token that starts alike, and goes back one token where none fits. Places from which there is no way on are
marked, so that each is tried once, and what is known of neighbours is remembered: the time is linear in the bytes.

A text is first cut by a pattern, and each match is encoded by itself; each distinct stretch between safe cuts is encoded once a block. A match that is itself a token is that token, as in the library whose
results this reproduces. That library's regular expressions know another version of Unicode than Python's; letters and numbers on which
they differ are found by asking it once a worker, and texts that hold one are cut by a pattern which spells the classes out.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded each; an empty table gives an empty
result; other columns, whatever their names, are kept or left out as asked and play no part. Null ids, or ids that hold a null or an
id outside the vocabulary, decode to null.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common
from .packing import gather

#: What a worker remembers: matches of the pattern with their ids, none longer than this; and pairs of neighbours.
CACHE_MATCHES, CACHE_LENGTH, CACHE_PAIRS = 400_000, 64, 1_000_000
NEVER = 1 << 60


class Vocabulary:
    """The tables of a vocabulary: ranks (bytes -> id; a lower id merges first), the bytes of each id, the longest shorter token that starts a
    token (-1: none), the two tokens a token is merged from (None: none), and the automaton."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, k in ranks.items():
            self.tokens[k] = token
        self.sizes = [len(t) for t in self.tokens]
        self.shorter, self.parts = [-1] * len(self.tokens), [None] * len(self.tokens)
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, k in sorted(ranks.items(), key=lambda x: x[1]):
            self.shorter[k] = next((r for n in range(len(token) - 1, 0, -1) if (r := ranks.get(token[:n])) is not None), -1)
        for token, k in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1 or self.merged_from(token, k):
                self.automaton.add_word(token.decode("latin-1"), (k, len(token) - 1))
            elif merged(ranks, token) == [k]:
                raise ValueError(f"the token {token!r} is merged from tokens of higher rank; this search needs ranks in the order of the merges")
        if len(self.automaton):
            self.automaton.make_automaton()

    def merged_from(self, token: bytes, k: int) -> bool:
        """Find the two earlier tokens that merge to a token; without any, the token can only be a whole match."""
        left = self.shorter[k]
        while left >= 0:
            right = self.ranks.get(token[self.sizes[left] :])
            if left < k and right is not None and right < k and self.compatible(left, right, k):
                self.parts[k] = (left, right)
                return True
            left = self.shorter[left]
        return False

    def compatible(self, a: int, b: int, limit: int = NEVER) -> bool:
        """Whether no merge of a rank below limit crosses the border between two neighbours, at any time."""
        ranks, tokens, parts = self.ranks, self.tokens, self.parts
        while True:
            across = ranks.get(tokens[a] + tokens[b])
            if across is not None and across < limit:
                return False
            if parts[b] is not None and (parts[a] is None or b >= a):  # of equal merges the right one is the later
                limit, b = b + 1, parts[b][0]
            elif parts[a] is not None:
                limit, a = a, parts[a][1]
            else:
                return True

    def encode(self, match: bytes) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(match)
        if whole is not None:
            return (whole,)
        longest = [-1] * len(match)
        for end, (k, before) in self.automaton.iter(match.decode("latin-1")):  # ends ascend, so the longest match of a place comes last
            longest[end - before] = k
        if -1 in longest:
            raise ValueError(f"the vocabulary has no token for a byte of {match[:40]!r}")
        sizes, shorter, pairs, last = self.sizes, self.shorter, self.pairs, len(match)
        passable, found, at, token, left = bytearray(b"\1") * (last + 1), [], 0, longest[0], -1
        while True:
            end = at + sizes[token]
            fits = passable[end]
            if fits and left >= 0:
                fits = pairs.get(left << 32 | token)
                if fits is None:
                    if len(pairs) >= CACHE_PAIRS:
                        pairs.clear()
                    fits = pairs[left << 32 | token] = self.compatible(left, token)
            if fits:
                found.append(token)
                if end == last:
                    return tuple(found)
                at, left, token = end, token, longest[end]
                continue
            token = shorter[token]
            while token < 0:  # no way on from here: go back, and try a shorter token there
                passable[at] = 0
                token = found.pop()
                at -= sizes[token]
                left, token = found[-1] if found else -1, shorter[token]


def merged(ranks: dict[bytes, int], match: bytes) -> list[int]:
    """Plain merging, the pair of lowest rank first: square in the bytes. For the few tokens that no two earlier ones give."""
    parts = [match[k : k + 1] for k in range(len(match))]
    while True:
        best = min(((ranks.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1)), default=(NEVER, 0))
        if best[0] == NEVER:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


class Matches(dict):
    """Match of the pattern -> ids, encoded when it first comes; bounded."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, match: str) -> tuple[int, ...]:
        ids = self.vocabulary.encode(match.encode())
        if len(match) <= CACHE_LENGTH:
            if len(self) >= CACHE_MATCHES:
                self.clear()
            self[match] = ids
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of a token in base 64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


class Cutter:
    """The matches of a pattern in a text, as the library's regular expressions find them. The pattern's classes may be \\p{L}, \\p{N} and \\s."""

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        self.found = regex.compile(pattern)
        every, single = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000)))), {bytes([k]): k for k in range(256)}
        classes = {}
        for name in (r"\p{L}", r"\p{N}"):
            theirs = tiktoken.Encoding("own", pat_str=name, mergeable_ranks=single, special_tokens={})
            classes[name] = set(theirs.decode_bytes(theirs.encode_ordinary(every)).decode()), set(regex.findall(name, every))
        letters, numbers = (theirs for theirs, _ in classes.values())
        # a character on which the two differ is looked at as another one of the class it has there
        strange = set().union(*(theirs ^ ours for theirs, ours in classes.values()))
        self.stand_in = {ord(c): "\u4e00" if c in letters else "\u0660" if c in numbers else "\u00a7" for c in strange}
        self.strange = frozenset(strange)

    def matches(self, text: str) -> list[str]:
        if not text.isascii() and not self.strange.isdisjoint(text):
            return [text[m.start() : m.end()] for m in self.found.finditer(text.translate(self.stand_in))]
        return self.found.findall(text)


@cache
def cutter(pattern: str) -> Cutter:
    return Cutter(pattern)


@cache
def matches(ranks_path: str) -> Matches:
    return Matches(vocabulary(ranks_path))


def encoded(known: Matches, cut: Cutter, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of stretches, one after another, and the number of each. Stretches that begin with a space before another character and end without white
    space are cut into matches as one text, as no match goes across where two of them meet."""
    plain = np.fromiter((s[0] == " " and not s[1:2].isspace() and not s[-1].isspace() for s in stretches), bool, len(stretches))
    together = [s for s, p in zip(stretches, plain) if p]
    found = cut.matches("".join(together))
    ends, borders = np.cumsum(np.fromiter(map(len, found), "i8", len(found))), np.cumsum(np.fromiter(map(len, together), "i8", len(together)))
    if len(together) and (not len(ends) or ends[-1] != borders[-1]):  # a pattern that leaves characters out
        plain[:], together, found, ends, borders = False, [], [], np.empty(0, "i8"), np.empty(0, "i8")
    got = [known[m] for m in found]
    upto = np.append(0, np.cumsum(np.fromiter(map(len, got), "i8", len(got))))[np.append(0, np.searchsorted(ends, borders, side="right"))]
    others = [tuple(chain.from_iterable(map(known.__getitem__, cut.matches(s)))) for s, p in zip(stretches, plain) if not p]
    sizes = np.empty(len(stretches), "i8")
    sizes[plain], sizes[~plain] = np.diff(upto), np.fromiter(map(len, others), "i8", len(others))
    order = np.empty(len(stretches), "i8")  # where each stretch stands when those together come first
    order[plain], order[~plain] = np.arange(len(together)), len(together) + np.arange(len(others))
    standing = np.empty(len(stretches), "i8")
    standing[order] = sizes
    flat = np.fromiter(chain.from_iterable(chain(got, others)), "i4", int(sizes.sum()))
    return gather(flat, standing, order)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (None: all) with the ids of each text, an array of int, in a column out (in place of any so called)."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != out]
    place = common.free(kept, "_text")
    rows = docs.select(*[f"`{c}`" for c in kept], docs[f"`{text}`"].alias(place))
    fields = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cut = matches(ranks_path), cutter(pattern)
        for batch in batches:
            for part in common.blocks(batch, place):
                distinct, index, counts = common.stretches(part.column(place))
                ids, sizes = gather(*encoded(known, cut, distinct.to_pylist()), index)
                ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], lists], names=[*kept, out])

    return rows.mapInArrow(common.tidy(run), ", ".join(filter(None, [fields, f"`{out}` array<int>"])))


@cache
def token_bytes(path: str) -> pa.Array:
    tokens = vocabulary(path).tokens
    return pa.array(tokens, pa.large_binary())


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of each array of ids in a binary column out (in place of any so called)."""
    kept = [c for c in df.columns if c != out]
    place = common.free(kept, "_ids")
    rows = df.select(*[f"`{c}`" for c in kept], df[f"`{ids}`"].cast("array<int>").alias(place))
    fields = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes[:-1])

    def joined(lists: pa.Array) -> pa.Array:
        tokens, flat = token_bytes(ranks_path), lists.flatten()
        good = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))), False)
        safe = pc.if_else(good, flat, 0)
        texts = tokens.take(safe)
        good = pc.and_(good, pc.greater(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)  # an id between two tokens' ids has no bytes
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(sizes))
        bytes_at = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)))[ends]
        bad = np.append(0, np.cumsum(~good))[ends]
        whole = b"" if not len(texts) else memoryview(texts.buffers()[2])
        out = [None if null or bad[k + 1] > bad[k] else bytes(whole[bytes_at[k] : bytes_at[k + 1]]) for k, null in enumerate(pc.is_null(lists).to_pylist())]
        return pa.array(out, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], joined(batch.column(place))], names=[*kept, out])

    return rows.mapInArrow(common.tidy(run), ", ".join(filter(None, [fields, f"`{out}` binary"])))
