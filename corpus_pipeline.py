"""A training corpus in five stages, from ``documents`` to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import decontam, langid, minhash, mixing, sharding
from wordloom.llm.queries import held_out, table
from wordloom.storage import materialize

#: Least share of its main language that a document needs to stay.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts, texts without letters, mixtures without a main language."""
    model = langid.train(docs.filter(~held_out()))
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    judged = langid.identify(docs, model, extra={"__kept": kept}, keep_text=True)
    main = F.array_max(F.map_values("shares"))  # the mixture's alone: a short text of one language isn't one of many
    return (judged.filter((F.col("lang_pred") != "und") & (main >= LEAST_SHARE))
            .select(*[F.col("__text" if c == "text" else f"__kept.`{c}`").alias(c) for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least doc_id of each class of near-duplicates."""
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it; those it doesn't take go."""
    return mixing.repeat_rows(docs, mixing.mix(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document left."""
    return sharding.shard(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("mix_sources", mix_sources), ("shard", shard)]

#: Language ID learns a model and near-duplicates join classes by signatures: SQL can't express run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
