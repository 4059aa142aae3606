"""Quality by a factorisation machine.

A document is a sparse vector: its words hashed to 2**WORD_BITS places (square root of the word's share of the text), and statistics
of its structure and size, and numbers from metadata columns where these are named. The machine scores bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; the pairs are summed in linear
time as half of (sum v x)**2 - sum (v x)**2 in each of RANK dimensions.

Defined cases: a null text is empty; an empty text has statistics but no words and gets the score these give; repeated rows are
scored each; an empty table gives an empty result; without labels of both kinds everything scores the share of label 1 (a half
without any). A null or non-finite number in a metadata column is a feature of its own. Labels, language, source and id are never looked at when scoring. Text is processed whole, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The fit uses a bounded sample of the labelled rows: so many of label 0 and of label 1 at most, of so many bytes together.
SAMPLE_PER_LABEL = (3000, 4000)
SAMPLE_BYTES = 48_000_000
WORD_BITS, RANK = 15, 6
STRIP = " \t.,;:!?\"'()[]{}|*#$%&<>-_=+/\\`~^@"
STATISTICS = ("bytes", "words", "word length", "capitals", "digits", "marks", "sentence ends", "lines", "other bytes", "distinct words", "top word", "echoes", "distinct lines", "line length", "ends of words")
WORDS = 1 << WORD_BITS


@dataclass
class Model:
    bias: float
    linear: np.ndarray  # by feature: words, then statistics and metadata
    factors: np.ndarray  # feature x RANK
    mean: np.ndarray
    scale: np.ndarray
    metadata: tuple[str, ...] = ()


def numbers(columns: list[pa.ChunkedArray | pa.Array]) -> np.ndarray:
    """Two features of each metadata column: the logarithm of its size with its sign, and whether there is none."""
    out = []
    for column in columns:
        x = pc.fill_null(column.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
        good = np.isfinite(x)
        x = np.where(good, x, 0.0)
        out += [np.sign(x) * np.log1p(np.abs(x)), ~good]
    return np.stack(out, 1).astype(float)


def byte_classes() -> np.ndarray:
    """A row per class of bytes: capitals, digits, marks, sentence ends, line ends, bytes beyond ASCII."""
    code = np.arange(256)
    text = [chr(c) for c in code]
    return np.array([[c.isascii() and c.isupper() for c in text], [c in "0123456789" for c in text], [c.isascii() and c.isprintable() and not c.isalnum() and c not in " .,?" for c in text], [c in ".?!" for c in text], [c == "\n" for c in text], code > 127])


CLASSES = byte_classes()


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of every word feature; the statistics, a row per text."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    raw = pa.concat_arrays([texts])
    ends = np.frombuffer(raw.buffers()[1], "i4", n + 1) if n else np.zeros(1, "i4")
    data = np.frombuffer(raw.buffers()[2], "u1")[ends[0] : ends[-1]] if n and raw.buffers()[2] else np.empty(0, "u1")
    size = np.diff(ends).astype(float)
    row_of_byte = np.repeat(np.arange(n), np.diff(ends))
    counts = np.bincount(row_of_byte * 256 + data, minlength=256 * n).reshape(n, 256) @ CLASSES.T.astype("i8")

    vocabulary, index, words = common.words(texts)
    bare = pc.utf8_lower(pc.utf8_trim(vocabulary, characters=STRIP))
    place = (common.mix(common.hash64(bare)) >> np.uint64(64 - WORD_BITS)).astype("i8")
    marked = pc.not_equal(pc.utf8_rtrim(vocabulary, characters=STRIP), vocabulary).to_numpy(zero_copy_only=False).astype(float)
    length = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(float)
    row = np.repeat(np.arange(n), words)
    pair, times = np.unique(row * WORDS + place[index], return_counts=True)
    at, feature = pair // WORDS, pair % WORDS
    total = np.maximum(words, 1)
    top = np.zeros(n)
    np.maximum.at(top, at, times)
    echo = np.bincount(row[1:], (index[1:] == index[:-1]) & (row[1:] == row[:-1]), minlength=n) if len(index) else np.zeros(n)

    lists = pc.split_pattern(texts, "\n")
    lines = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    line = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype("i8")
    line_row = np.repeat(np.arange(n), lines)
    distinct = np.bincount(np.unique(line_row * (line.max() + 1 if len(line) else 1) + line) // (line.max() + 1 if len(line) else 1), minlength=n)[:n]

    per = np.maximum(size, 1)
    statistics = np.stack(
        [np.log1p(size), np.log1p(words), np.bincount(row, length[index], minlength=n) / total, *(counts[:, :4].T / per), counts[:, 4] / per * 100, counts[:, 5] / per, np.bincount(at, minlength=n) / total, top / total, echo / total, distinct / np.maximum(lines, 1), np.log1p(size / np.maximum(lines, 1)), np.bincount(row, marked[index], minlength=n) / total], 1
    )
    return at, feature, np.sqrt(times / total[at]), statistics


def scores(model: Model, at: np.ndarray, feature: np.ndarray, value: np.ndarray, statistics: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits, and the factor sums (a row per text)."""
    n = len(statistics)
    x = np.clip((statistics - model.mean) / model.scale, -3, 3)
    w, v = model.linear[WORDS:], model.factors[WORDS:]
    linear = model.bias + x @ w + np.bincount(at, model.linear[feature] * value, minlength=n)
    sums, squares = x @ v, (x * x) @ (v * v)
    for f in range(RANK):
        part = model.factors[feature, f] * value
        sums[:, f] += np.bincount(at, part, minlength=n)
        squares[:, f] += np.bincount(at, part * part, minlength=n)
    return linear + 0.5 * (sums * sums - squares).sum(1), sums


def fit_arrays(texts: pa.Array, labels: np.ndarray, metadata: np.ndarray | None = None, odds: float = 0.0, steps: int = 120, rate: float = 0.03, decay: float = 1e-4) -> Model:
    """Full-batch Adam on the logistic loss. odds: the log of how much likelier label 1 is in the sample than in the table, taken off the bias."""
    parts, rows = [], 0
    for block in common.blocks(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        at, feature, value, statistics = vectors(block.column("text"))
        parts.append((at + rows, feature, value, statistics))
        rows += len(statistics)
    at, feature, value, statistics = (np.concatenate(x) for x in zip(*parts, strict=True))
    if metadata is not None:
        statistics = np.concatenate([statistics, metadata], 1)
    mean, scale = statistics.mean(0), statistics.std(0) + 1e-6
    n, d = len(labels), WORDS + statistics.shape[1]
    start = np.random.default_rng(7)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    model = Model(float(np.log(share / (1 - share))), np.zeros(d), start.normal(0, 0.05, (d, RANK)), mean, scale)
    x = np.clip((statistics - mean) / scale, -3, 3)
    # a word in fewer than 3 documents of the sample says nothing
    usual = np.bincount(feature, minlength=WORDS) >= 3
    model.factors[:WORDS][~usual] = 0
    keep = usual[feature]
    at, feature, value = at[keep], feature[keep], value[keep]
    flat = np.concatenate([[model.bias], model.linear, model.factors.ravel()])
    m, s = np.zeros_like(flat), np.zeros_like(flat)
    for t in range(1, steps + 1):
        model.bias, model.linear, model.factors = flat[0], flat[1 : 1 + d], flat[1 + d :].reshape(d, RANK)
        z, sums = scores(model, at, feature, value, statistics)
        g = (1 / (1 + np.exp(-z)) - labels) / n
        linear = np.concatenate([np.bincount(feature, g[at] * value, minlength=WORDS), x.T @ g])
        factors = np.zeros((d, RANK))
        gv = g[at] * value
        own = np.concatenate([np.bincount(feature, gv * value, minlength=WORDS), (x * x).T @ g])
        for f in range(RANK):
            factors[:WORDS, f] = np.bincount(feature, gv * sums[at, f], minlength=WORDS)
        factors[WORDS:] = x.T @ (g[:, None] * sums)
        factors -= own[:, None] * model.factors
        grad = np.concatenate([[g.sum()], linear + decay * model.linear, (factors + decay * model.factors).ravel()])
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        flat = flat - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    model.bias, model.linear, model.factors = float(flat[0] - odds), flat[1 : 1 + d], flat[1 + d :].reshape(d, RANK)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ()) -> Model:
    """Fit to a sample (common.labelled_sample) of the labelled documents outside the held-out fold. metadata: columns of numbers to learn
    from beside the text."""
    sample, share = common.labelled_sample(docs, labels, label, doc_id, text, SAMPLE_PER_LABEL, SAMPLE_BYTES, metadata)
    y = sample.column("_y").to_numpy().astype(float)
    if not len(y) or len(share) < 2:
        ones = 0.5 if not share else float(min(max(next(iter(share)), 0.001), 0.999))
        none = np.zeros(WORDS + len(STATISTICS) + 2 * len(metadata))
        return Model(float(np.log(ones / (1 - ones))), none, np.zeros((len(none), RANK)), np.zeros(len(none) - WORDS), np.ones(len(none) - WORDS), metadata)
    more = numbers([sample.column(f"_m{k}") for k in range(len(metadata))]) if metadata else None
    model = fit_arrays(sample.column("_t").combine_chunks(), y, more, float(np.log(share[1] / share[0])))
    model.metadata = metadata
    del sample
    common.give_back()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted (in place of any so called)."""
    if clash := {"score", "predicted"} & set(model.metadata):
        raise ValueError(f"metadata columns can't be called {sorted(clash)}: the result's columns are")
    docs = docs.drop("score", "predicted")
    state = docs.sparkSession.sparkContext.broadcast(model)  # 8 * 2**WORD_BITS * (1 + RANK) bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.blocks(batch, text):
                at, feature, value, statistics = vectors(part.column(text))
                if state.value.metadata:
                    statistics = np.concatenate([statistics, numbers([part.column(c) for c in state.value.metadata])], 1)
                p = 1 / (1 + np.exp(-scores(state.value, at, feature, value, statistics)[0]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype("i4"))], names=[*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(common.tidy(run), ", ".join(f"`{c}` {k}" for c, k in docs.dtypes) + ", score double, predicted int")
