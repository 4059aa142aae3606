"""Documents to training sequences: toxic documents go, one of each group of near duplicates stays, secrets are blotted out, sources
are mixed to their weights, and what remains is packed.

Defined cases, of every stage: a null text counts as empty and its document stays (toxicity scores it as without evidence, near duplicates link it with nothing, secrets
finds none, mixing takes it with size 0, packing gives it one piece of the end id); rows that share an id, or repeat, are rows of their own, of which near duplicates keep one for each
different set of words; columns beside those of documents, whatever their names, are kept up to the packing; an empty table gives empty tables throughout.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boresight.llm import common, jaccard, mixing, packing, secrets, toxicity


def rested(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """stage, begun when the executors have given back what the stage before left on their heaps."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.rest(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@rested
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or is below a half, by a model fitted to the labels."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, threshold=0.5)


@rested
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word Jaccard similarity 0.8 or more."""
    return jaccard.keep_one(docs, size=5, percent=80)


@rested
def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; what a secret span covers becomes a mark, and n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.select(*[F.length("text").cast(kind).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c, kind in clean.dtypes])


@rested
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


@rested
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    import public_tokenizers

    parts = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("secrets", blot_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL can express neither the fitted scores of the first stage nor the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
