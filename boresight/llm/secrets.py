"""Secret scans with column functions only.

Three patterns give the base spans. Beside them, candidate strings (runs of token characters with a digit in them) go through a
window that slides one character at a time: the counts of the characters in it are updated by the one that enters and the one
that leaves, and with them sum(c log2 c), so that each step's Shannon entropy costs no recount. Every character class has its
own window and threshold; what all windows over the threshold cover is a span, unless the allow-list knows the candidate as
harmless or a base span already covers it.

Scans come in two kinds. The whole one looks at all runs of token characters, letters alone included, and the allow-list takes out
what its matches cover and no more: the stretches between them go through the windows, each by its own class. The narrow one follows
the SQL registered for op3_secrets: candidates need a digit, and a match anywhere takes out the whole candidate.

Spans are (kind, start, end) in code points, end exclusive, by start, then in the order of KINDS.

Defined cases: null text: no spans; empty text: none; repeated rows are scanned each; two kinds may find the same place and both
stay; an empty table gives an empty result; other columns, whatever their names, play no part in what is found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import bound

# The base patterns with the least length of the whole match or of the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

# Class -> (alphabet, window, bits a character).
CLASSES = {
    "entropy_hex": ("0123456789abcdef", 20, 3.0),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 20, 3.8),
}
TOKEN = "[A-Za-z0-9+/=_-]"
CANDIDATE = rf"(?<!{TOKEN})(?={TOKEN}*[0-9]){TOKEN}{{20,}}"

# Candidates that are no secrets: ids, numbers, placeholders, alphabets, dates and paths. Loops are over characters alone: one over a group
# recurses in Java, and long tokens would exhaust the stack.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"^[0-9_/=+-]+$", r"(?i)example|sample|dummy|placeholder|change_?me|redacted|your_|xxxx|0{8}|deadbeef",
    r"(?i)abcdefghij|klmnopqrst|0123456789|1234567890|qwertyuiop", r"^(?!.*[-_/]{2})[a-z][a-z/_-]*[0-9]{1,4}$", r"//|^/[A-Za-z]+/",
)

# Fixed values of the whole scan: a candidate, and what in it is harmless: all of it, the directories it begins with, or some words.
RUN = rf"(?<!{TOKEN}){TOKEN}{{20,}}"
LEAST = 20
HARMLESS = "|".join((
    ALLOWED[0], ALLOWED[1], ALLOWED[4], r"^(?!.*[-_/]{2})(?=.*[-_/])[a-z][a-z/_-]*[a-z]$", r"^/{1,2}[A-Za-z][A-Za-z/]*/",
    r"(?i:example|sample|dummy|placeholder|change_?me|redacted|your_|x{4,}|0{8,}|deadbeef|abcdefghij|klmnopqrst|0123456789|1234567890|qwertyuiop)",
))

SPAN = "array<struct<start:int,rank:int,end:int,shift:int>>"
TOKENS = "array<struct<start:int,token:string,shift:int>>"
GAPS = "array<struct<from:int,to:int>>"
FIRST_DENSE = KINDS.index("entropy_hex")
#: Matches walked over in one go; what a walk gathers is copied at each step, so longer ones are cut into walks of this length.
STRETCH = 64


def chained(items: Column, kind: str, zero: Column, total, combine, emit) -> Column:
    """What emit(state, item) gives for each item, joined into one array of type kind. The state begins with zero and becomes total(state, item);
    combine(state, state) joins the states of two stretches. Linear in the items but for one number in STRETCH of them."""

    def stretch(state: Column, part: Column) -> Column:
        begin = F.struct(state.alias("at"), F.array().cast(kind).alias("out"))
        step = lambda acc, x: F.struct(total(acc["at"], x).alias("at"), F.concat(acc["out"], emit(acc["at"], x)).alias("out"))
        return F.aggregate(part, begin, step, lambda acc: acc["out"])

    def whole(parts: Column) -> Column:
        after = F.transform(parts, lambda part: F.aggregate(part, zero, total))
        step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        before = F.aggregate(after, F.struct(zero.alias("at"), F.array_repeat(zero, 0).alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(before, parts, stretch))

    parts = lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(xs) - 1) / STRETCH).cast("int"))), lambda g: F.slice(xs, g * STRETCH + 1, STRETCH))
    return bound(bound(items, parts), whole)


def pieces(text: Column, pattern: str, *groups: tuple[int, str]) -> Column:
    """The text cut at the matches of pattern: gap before each match, the match ("hit"), and parts of it; after the last one a gap alone."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), *[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(name) for k, name in groups])


def passed(at: Column, x: Column) -> Column:
    """The place after a piece: code points, and by how many more bytes."""
    both = F.concat(x["gap"], F.coalesce(x["hit"], F.lit("")))
    return F.struct((at["at"] + F.length(both)).alias("at"), (at["shift"] + F.octet_length(both) - F.length(both)).alias("shift"))


def further(a: Column, b: Column) -> Column:
    return F.struct((a["at"] + b["at"]).alias("at"), (a["shift"] + b["shift"]).alias("shift"))


def start() -> Column:
    return F.struct(F.lit(0).alias("at"), F.lit(0).alias("shift"))


def located(text: Column, pattern: str, kind: str, value: int | None = None) -> Column:
    """The matches of pattern as spans. The text is cut at the matches; lengths of what lies before give the places."""
    none, rank = F.array().cast(SPAN), KINDS.index(kind)

    def emit(at: Column, x: Column) -> Column:
        begin = at["at"] + F.length(x["gap"])
        good = x["hit"].isNotNull() & ((F.length(x["value"]) >= value) if value else F.lit(True))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + F.length(x["hit"])).alias("end"), (at["shift"] + F.octet_length(x["gap"]) - F.length(x["gap"])).alias("shift"))
        return F.when(good, F.array(span)).otherwise(none)

    found = chained(pieces(text, pattern, *([(2, "value")] if value else [])), SPAN, start(), passed, further, emit)
    return F.when(text.rlike(pattern), found).otherwise(none)


def hot_windows(token: Column, alphabet: str, window: int, bits: float) -> Column:
    """struct(first, last): from where the first window over the threshold starts to where the last one ends; first -1 without one."""
    codes = F.transform(F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(alphabet), c))
    weight = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 2)])
    w = lambda c: F.get(weight, c)

    def step(acc: Column, i: Column) -> Column:
        enter = F.get(acc["codes"], i) - 1
        leave = F.when(i >= window, F.get(acc["codes"], i - window) - 1).otherwise(-1)
        more, less = F.get(acc["counts"], enter), F.get(acc["counts"], F.greatest(leave, F.lit(0)))
        total = acc["total"] + F.when(enter == leave, 0.0).otherwise(w(more + 1) - w(more) + F.when(leave >= 0, w(less - 1) - w(less)).otherwise(0.0))
        counts = F.transform(acc["counts"], lambda c, k: c + (k == enter).cast("int") - (k == leave).cast("int"))
        hot = (i >= window - 1) & (math.log2(window) - total / window >= bits - 1e-9)
        first = F.when(hot & (acc["first"] < 0), i - window + 1).otherwise(acc["first"])
        return F.struct(acc["codes"].alias("codes"), counts.alias("counts"), total.alias("total"), first.alias("first"), F.when(hot, i + 1).otherwise(acc["last"]).alias("last"))

    begin = F.struct(codes.alias("codes"), F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(F.sequence(F.lit(0), F.length(token) - 1), begin, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def cut_up(text: Column, pattern: str, part: str, least: int = 1) -> Column:
    """The matches of pattern ("hit") or what lies between them ("gap") with their places, those of least characters or more."""
    none = F.array().cast(TOKENS)

    def emit(at: Column, x: Column) -> Column:
        gap = F.length(x["gap"])
        begin, shift = (at["at"] + gap, at["shift"] + F.octet_length(x["gap"]) - gap) if part == "hit" else (at["at"], at["shift"])
        piece = F.struct(begin.alias("start"), x[part].alias("token"), shift.alias("shift"))
        return F.when(F.length(x[part]) >= least, F.array(piece)).otherwise(none)

    return chained(pieces(text, pattern), TOKENS, start(), passed, further, emit)


def stretches(text: Column) -> Column:
    """What the whole scan puts through the windows."""

    def free_of(t: Column) -> Column:
        return F.transform(cut_up(t["token"], HARMLESS, "gap", LEAST), lambda g: F.struct((t["start"] + g["start"]).alias("start"), g["token"].alias("token"), t["shift"].alias("shift")))

    return F.when(text.rlike(RUN), F.flatten(F.transform(cut_up(text, RUN, "hit"), free_of))).otherwise(F.array().cast(TOKENS))


def candidates(text: Column) -> Column:
    """What the narrow scan puts through the windows."""

    def harmful(t: Column) -> Column:
        harmless = F.lit(False)
        for pattern in ALLOWED:
            harmless |= t["token"].rlike(pattern)
        return ~harmless

    return F.when(text.rlike(CANDIDATE), F.filter(cut_up(text, CANDIDATE, "hit"), harmful)).otherwise(F.array().cast(TOKENS))


def dense(tokens: Column) -> Column:
    """The entropy spans of tokens."""

    def span(t: Column) -> Column:
        is_hex = t["token"].rlike("^[0-9a-fA-F]+$")
        hexes, mixed = hot_windows(F.lower(t["token"]), *CLASSES["entropy_hex"]), hot_windows(t["token"], *CLASSES["entropy_base64"])
        hot = F.when(is_hex, hexes).otherwise(mixed)
        rank = F.when(is_hex, KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_base64"))
        return F.transform(F.array(hot), lambda h: F.struct((t["start"] + h["first"]).alias("start"), F.when(h["first"] >= 0, rank).otherwise(-1).alias("rank"), (t["start"] + h["last"]).alias("end"), t["shift"].alias("shift")))

    return F.filter(F.flatten(F.transform(tokens, span)), lambda s: s["rank"] >= 0)


def scan(docs: DataFrame, text: str = "text", base: str = "_base", spans: str = "_spans", narrow: bool = False) -> DataFrame:
    """docs with its base spans and all spans, each array<struct<start, rank, end, shift>> in order; rank is the place in KINDS, shift by
    how much more bytes than code points lie before the span."""
    whole = F.coalesce(F.col(text), F.lit(""))
    own = [f"`{c}`" for c in docs.columns]
    b, e = common.free(docs.columns, "_b"), common.free(docs.columns, "_e")
    found = docs.select("*", F.concat(located(whole, ASSIGN, "assign", ASSIGN_VALUE), located(whole, ACCESS, "access"), located(whole, HEX, "hex")).alias(b), dense((candidates if narrow else stretches)(whole)).alias(e))
    found = found.select(*own, F.array_sort(b).alias(base), e)

    # in order of the starts, base spans first: what the furthest end so far reaches is covered. This order is the result's too
    def reach(at: Column, s: Column) -> Column:
        return F.when(s["rank"] < FIRST_DENSE, F.greatest(at, s["end"])).otherwise(at)

    def emit(at: Column, s: Column) -> Column:
        return F.when((s["rank"] < FIRST_DENSE) | (at < s["end"]), F.array(s)).otherwise(F.array().cast(SPAN))

    every = chained(F.array_sort(F.concat(F.col(base), e)), SPAN, F.lit(0), reach, F.greatest, emit)
    return found.select(*own, base, F.when(F.size(e) > 0, every).otherwise(F.col(base)).alias(spans))


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with what the spans cover replaced by mark; overlapping spans give one mark. Nothing else changes."""
    base, spans = common.free(docs.columns, "_base"), common.free(docs.columns, "_spans")
    first, last = (lambda s: s["start"] + s["shift"]), (lambda s: s["end"] + s["shift"])  # in bytes; spans are ASCII throughout

    def emit(at: Column, s: Column) -> Column:
        gap = F.struct(at.alias("from"), first(s).alias("to"))
        return F.when(first(s) >= at, F.array(gap)).otherwise(F.array().cast(GAPS))

    def clean(raw: Column) -> Column:
        gaps = chained(F.col(spans), GAPS, F.lit(0), lambda at, s: F.greatest(at, last(s)), F.greatest, emit)
        marked = F.transform(gaps, lambda g: F.concat(raw.substr(g["from"] + 1, g["to"] - g["from"]).cast("string"), F.lit(mark)))
        end = F.aggregate(spans, F.lit(0), lambda at, s: F.greatest(at, last(s)))
        return F.concat(F.array_join(marked, ""), raw.substr(end + 1, F.octet_length(raw)).cast("string"))

    marked = scan(docs, text, base, spans)
    return marked.select(*[F.when(F.size(spans) > 0, bound(F.col(f"`{text}`").cast("binary"), clean)).otherwise(F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
