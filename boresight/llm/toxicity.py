"""Toxicity by multiple-instance learning.

A document is a bag of sentences. With s the sum of the weights of a sentence's distinct words, the sentence scores
p = 1 - (1 + exp(bias)) / (1 + exp(bias + s)): a logistic score from which what a sentence without evidence would have is
taken off, so that long documents don't become toxic by length. Weights are at least 0 (a word can accuse, none can excuse)
and an L1 penalty keeps them few. The bag scores 1 - (1 - leak) prod(1 - p), the noisy-or with leak sigmoid(bias). Only documents carry labels, so the weights are fitted to the bag scores; the sentences that
carry the blame then come out by themselves, and `locate` returns them.

Words weigh by themselves and by their first letters, which carries over to inflected and joined forms.

Defined cases: a null text is empty; an empty text scores the leak; ties between sentences are all returned; rows repeated in the
input are scored each; an empty table gives an empty result; without labels of both kinds everything scores 0. Columns other
than the named ones play no part, whatever their names. Text is processed whole, BLOCK_BYTES at a time per worker.
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

#: The fit uses a bounded sample of the labelled rows: so many clean and toxic documents at most, of so many bytes together.
SAMPLE_PER_LABEL = (2000, 2000)
SAMPLE_BYTES = 32_000_000
#: A sentence of more words than this is cut into several instances.
INSTANCE_WORDS = 48
PREFIXES = (4, 5, 7)
MARK = "\x1e"
STRIP = " \t.,;:!?\"'()[]{}|*#$%&<>-_=+/\\`~^@"


@dataclass
class Model:
    """Sorted feature hashes and their weights; unseen features weigh nothing."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float


def instances(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, the word index of each occurrence, the instance of each occurrence, the text of each instance."""
    marked = pc.replace_substring_regex(pc.fill_null(texts, ""), r"[.!?\n\r]+", f" {MARK} ")
    vocabulary, index, counts = common.words(pc.utf8_lower(marked))
    mark = pc.index(vocabulary, MARK).as_py()
    row = np.repeat(np.arange(len(texts)), counts)
    if not len(index):
        return vocabulary, index, np.empty(0, "i8"), np.empty(0, "i8")
    is_mark = index == mark
    edge = np.ones(len(index), bool)
    edge[1:] = (row[1:] != row[:-1]) | is_mark[:-1]
    begins = np.flatnonzero(edge)
    inside = np.arange(len(index)) - begins[np.cumsum(edge) - 1]
    edge |= inside % INSTANCE_WORDS == 0
    keep = ~is_mark
    instance = (np.cumsum(edge) - 1)[keep]
    _, first, instance = np.unique(instance, return_index=True, return_inverse=True)
    return vocabulary, index[keep], instance, row[keep][first]


def features(vocabulary: pa.Array) -> np.ndarray:
    """A row per word: the hashes of its features."""
    bare = pc.utf8_trim(vocabulary, characters=STRIP)
    columns = [common.hash64(bare)]
    for n in PREFIXES:
        start = pc.utf8_slice_codeunits(bare, 0, n)
        columns.append(common.mix(common.hash64(start) + np.uint64(n)))
    return np.stack(columns, 1)


def fit_arrays(texts: pa.Array, labels: np.ndarray, steps: int = 160, rate: float = 0.1, penalty: float = 2e-5) -> Model:
    """Full-batch Adam on the likelihood of the document labels under the noisy-or."""
    parts, n_bags, n_inst, n_words = [], 0, 0, 0
    for block in common.blocks(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
        vocabulary, word, inst, bag = instances(block.column("text"))
        once = np.unique(inst.astype("i8") * max(1, len(vocabulary)) + word)
        inst, word = once // max(1, len(vocabulary)), once % max(1, len(vocabulary))
        parts.append((features(vocabulary) if len(vocabulary) else np.empty((0, 1 + len(PREFIXES)), "u8"), (word + n_words).astype("i4"), (inst + n_inst).astype("i4"), (bag + n_bags).astype("i4")))
        n_bags, n_inst, n_words = n_bags + block.num_rows, n_inst + len(bag), n_words + len(vocabulary)
    hashes, word, inst, bag = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    # words of several blocks become one, known by their own hash
    _, first, same = np.unique(hashes[:, 0], return_index=True, return_inverse=True)
    hashes, word = hashes[first], same.astype("i4")[word]
    # features of one or two documents say nothing about others
    pairs = np.unique(bag[inst].astype("i8") * max(1, len(hashes)) + word) % max(1, len(hashes))
    keys, code = np.unique(hashes, return_inverse=True)
    code = code.reshape(hashes.shape)
    seen = np.bincount(code[pairs].ravel(), minlength=len(keys))
    del pairs
    used = seen >= 3
    place = np.where(used, np.cumsum(used) - 1, used.sum())
    keys, code = keys[used], place.astype("i4")[code]
    w, bias = np.full(len(keys) + 1, 0.01), -6.0
    w[-1] = 0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    y = labels.astype(float)
    if not len(keys) or y.min() == y.max():
        return Model(np.empty(0, "u8"), np.empty(0), -40.0)
    n = len(y)
    for t in range(1, steps + 1):
        z = bias + np.bincount(inst, w[code].sum(1)[word], minlength=len(bag))
        leak = 1 / (1 + np.exp(-bias))
        total = np.bincount(bag, np.logaddexp(0, z) - np.logaddexp(0, bias), minlength=n) + np.logaddexp(0, bias)
        p_bag = -np.expm1(-total)
        # d loss / d total of a bag: 1 for a clean one, -(1-P)/P for a marked one
        pull = np.where(y == 1, -(1 - p_bag) / np.maximum(p_bag, 1e-12), 1.0)
        g_inst = pull[bag] / (1 + np.exp(-z)) / n
        g_word = np.bincount(word, g_inst[inst], minlength=len(code))
        g = np.bincount(code.ravel(), np.repeat(g_word, code.shape[1]), minlength=len(w)) + penalty
        g[-1] = 0
        g = np.append(g, g_inst.sum() + leak * (pull.sum() - pull[bag].sum()) / n)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w = np.maximum(w - step[:-1], 0)
        bias -= step[-1]
    few = w[:-1] > 0.02
    return Model(keys[few], w[:-1][few], float(bias))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit to a sample (common.labelled_sample) of the labelled documents outside the held-out fold."""
    sample, _ = common.labelled_sample(docs, labels, label, doc_id, text, SAMPLE_PER_LABEL, SAMPLE_BYTES)
    y = sample.column("_y").to_numpy()
    if not len(y):
        return Model(np.empty(0, "u8"), np.empty(0), -40.0)
    texts = sample.column("_t").combine_chunks()
    del sample
    model = fit_arrays(texts, y)
    del texts
    common.give_back()
    return model


def score_texts(model: Model, texts: pa.Array) -> tuple[np.ndarray, tuple]:
    """The noisy-or of each text, and (instance logits, instance's text, occurrence's word, occurrence's instance, vocabulary)."""
    vocabulary, word, inst, bag = instances(texts)
    z = np.full(len(bag), model.bias)
    if len(word) and len(model.keys):
        h = features(vocabulary)
        at = np.minimum(np.searchsorted(model.keys, h), len(model.keys) - 1)
        value = np.where(model.keys[at] == h, model.weights[at], 0.0).sum(1)
        told = value[word] > 0
        once = np.unique(inst[told].astype("i8") * len(value) + word[told])
        z += np.bincount(once // len(value), value[once % len(value)], minlength=len(bag))
    total = np.bincount(bag, np.logaddexp(0, z) - np.logaddexp(0, model.bias), minlength=len(texts)) + np.logaddexp(0, model.bias)
    return -np.expm1(-total), (z, bag, word, inst, vocabulary)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float | None = None) -> DataFrame:
    """docs with columns score and predicted (in place of any so called); with a threshold, only the rows below it and docs' own columns."""
    if threshold is None:
        docs = docs.drop("score", "predicted")
    own = docs.columns
    state = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    extra = pa.schema([]) if threshold is not None else pa.schema([("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.blocks(batch, text):
                p, _ = score_texts(state.value, part.column(text))
                if threshold is not None:
                    yield part.filter(pa.array(p < threshold))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= 0.5).astype("i4"))], names=[*part.schema.names, *extra.names])

    fields = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    return docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(common.tidy(run), fields if threshold is not None else f"{fields}, score double, predicted int")


def locate(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The offending sentences: doc_id, sentence (ordinal among the document's instances), p, words (lower case)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    state = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.blocks(batch, "text"):
                _, (z, bag, word, inst, vocabulary) = score_texts(state.value, part.column("text"))
                p = -np.expm1(np.logaddexp(0, state.value.bias) - np.logaddexp(0, z))
                hits = np.flatnonzero(p >= threshold)
                first = np.searchsorted(bag, bag)
                said = []
                for k in hits:
                    lo, hi = np.searchsorted(inst, [k, k + 1])
                    said.append(" ".join(vocabulary.take(pa.array(word[lo:hi])).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(bag[hits])), pa.array((hits - first[hits]).astype("i4")), pa.array(p[hits]), pa.array(said, pa.string())], names=["doc_id", "sentence", "p", "words"])

    return rows.mapInArrow(common.tidy(run), f"doc_id {rows.dtypes[0][1]}, sentence int, p double, words string")
