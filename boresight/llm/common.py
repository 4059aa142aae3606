"""What the training-data operators share: the shared folder, word splitting, hashing."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, shared_dir, stored  # noqa: F401

#: Text handled at a time inside a Python worker, so that memory does not depend on the batch Spark sends.
BLOCK_BYTES = 2 << 20


#: Marks that stretches() cuts off from a letter or digit before them.
MARKS = ",.;:!?"
MARK, ALNUM = np.zeros(256, bool), np.zeros(256, bool)
MARK[list(MARKS.encode())] = True
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def held_out(doc_id: str, remainder: int, fold: int = 5) -> Column:
    """crc32(doc_id as text) mod fold = remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % fold == remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, per_label: tuple[int, int], most_bytes: int, more: tuple[str, ...] = ()) -> tuple[pa.Table, dict[int, float]]:
    """_t (the text, null: empty), _y and the columns more of a sample of the labelled documents outside the held-out fold, and the share of
    each label's ids that it was drawn from.

    Of each label the first per_label[label] ids by hash are drawn, of documents that share an id the least. Texts are whole; in the order
    of the hash, a text that would bring the sample over most_bytes is left out. So what comes to the driver is bounded.
    """
    marks = labels.where(F.col(label).isin(0, 1) & ~held_out(doc_id, 0)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    marks = stored(marks.withColumn("_h", F.xxhash64("_id")), "labels")
    counts = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    drawn = [marks.where(F.col("_y") == y).orderBy("_h", "_id").limit(n) for y, n in enumerate(per_label)]
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.struct(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"), *[F.col(f"`{c}`").cast("double").alias(f"_m{k}") for k, c in enumerate(more)]).alias("_r"))
    chosen = rows.join(F.broadcast(drawn[0].unionByName(drawn[1])), "_id").groupBy("_id", "_y", "_h").agg(F.min("_r").alias("_r"))  # sum(per_label) rows at most
    chosen = stored(chosen.withColumn("_b", F.octet_length("_r._t")), "sample")
    ids, total = [], 0
    for r in sorted(chosen.select("_h", "_id", "_b").collect(), key=lambda r: (r["_h"], r["_id"])):
        if total + r["_b"] <= most_bytes:
            total += r["_b"]
            ids.append((r["_id"],))
    if not ids:
        return chosen.select("_r.*", "_y").limit(0).toArrow(), {}
    keep = docs.sparkSession.createDataFrame(ids, chosen.select("_id").schema)
    sample = chosen.join(F.broadcast(keep), "_id").orderBy("_h", "_id").select("_r.*", "_y").toArrow()
    return sample, {y: min(1.0, per_label[y] / n) for y, n in counts.items()}


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES):
    """Slices of a batch of about most bytes of text (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("i8")
    start, ends = 0, np.cumsum(lengths)
    while start < len(lengths):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def free(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it, inside functions of arrays too."""
    return F.transform(F.array(value), use)[0]


def give_back() -> None:
    """Return what memory this process no longer needs: workers and the driver live on beside Spark's own heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def rest(spark: SparkSession) -> None:
    """Let the executors collect garbage, so that what a stage has grown their heaps by goes back before the next one: a heap does not shrink
    otherwise, and Python workers live beside it. As many small tasks as there are cores; an executor that gets none merely stays as it is."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def tidy(run):
    """run, which gives back memory when a task is done."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words [^\\x20\\x09-\\x0D]+, the word index of every occurrence, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(texts)
    row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    row = row[real.to_numpy(zero_copy_only=False)]
    coded = flat.filter(real).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.bincount(row, minlength=len(texts))


def stretches(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct stretches of the texts, the stretch of every occurrence, and the number in each text; together they are the texts.

    A stretch ends before a space between two characters that are visible ASCII or of U+00C0 to U+07FF. No version of Unicode has white space there, so
    byte-level tokenizers, whose patterns take a space only before a word or in a run of white space, always cut there too. It also ends
    between an ASCII letter or digit or a letter of U+00C0 to U+024F and one of MARKS, as these patterns do.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    places = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
    data, bounds = np.frombuffer(texts.buffers()[2] or b"", "u1")[places[0] : places[-1]], places - places[0]
    border = np.zeros(len(data) + 1, bool)
    border[bounds] = True
    space = np.flatnonzero(data[1:-1] == 32) + 1
    space = space[~border[space] & ~border[space + 1]]
    before, lead, after = data[space - 1], data[np.maximum(space - 2, 0)], data[space + 1]
    visible = lambda x: (x > 32) & (x < 127)
    two = lambda x: (x >= 0xC3) & (x < 0xE0)
    good = (visible(before) | (before >= 0x80) & (before < 0xC0) & two(lead)) & (visible(after) | two(after))
    mark = np.flatnonzero(MARK[data[1:]]) + 1
    mark = mark[~border[mark]]
    before, lead = data[mark - 1], data[np.maximum(mark - 2, 0)]
    latin = (before >= 0x80) & (before < 0xC0) & (lead >= 0xC3) & (lead < 0xCA) & ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7)))  # no signs of times and division
    starts = np.sort(np.concatenate([space[good], mark[ALNUM[before] | latin], bounds[:-1][bounds[:-1] < bounds[1:]]]), kind="stable")  # no place is in both
    ends = np.append(starts, len(data)).astype("i8")
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
    return coded.dictionary.cast(pa.large_string()), coded.indices.to_numpy(zero_copy_only=False).astype("i8"), np.diff(np.searchsorted(starts, bounds))


def hash64(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    return pd.util.hash_array(strings.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(strings) else np.empty(0, "u8")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
