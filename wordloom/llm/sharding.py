"""Sharding by weighted rendezvous hashing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.storage import materialize, running_total

#: 52 bits of a hash become a number in (0, 1).
HASH_SPAN = float(1 << 52)


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on the key and the shard's number alone."""
    digest = F.md5(F.concat(key, F.lit(f"#{shard}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(HASH_SPAN)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard whose weighted draw is best: least -ln(u)/weight, so shares follow the weights.

    With one more shard, a key either keeps its shard or moves to the new one. Equal draws,
    if they ever meet, go to the lower shard. Shards of weight 0 get nothing.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a positive weight")
    scores = [F.struct((-F.ln(draw(key, i)) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard"))
              for i, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*scores))["shard"]


def stable_key(column: Column) -> Column:
    """The key as text; all null keys form one key of their own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("~"))


def shard(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
          weights: list[float] | None = None) -> DataFrame:
    """Deal rows to shards: ``key, size, text_crc32, law, shard, slot, grown_shard``.

    ``law`` is ``key``: the key and the shards decide. ``grown_shard`` is the shard with one
    more shard of the last one's weight. ``slot`` numbers a shard's rows from 0 without gaps,
    in the order of the key's hash, key, checksum and size; it is built from counts of ranges
    of that order, so no task holds a shard, nor all rows of a repeated key. A null text has size 1 and checksum 0;
    rows with equal keys share a shard, and equal rows take neighbouring slots in any order.
    An empty table gives an empty result. Other columns are neither read nor returned.
    """
    weights = [1.0] * 8 if weights is None else weights
    ready = docs.select(
        F.col(key).alias(key), stable_key(F.col(key)).alias("__key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = materialize(
        ready.withColumn("__hash", F.md5(F.col("__key").cast("binary")))
        .withColumn("shard", rendezvous(F.col("__key"), weights))
        .withColumn("grown_shard", rendezvous(F.col("__key"), [*weights, weights[-1]])), "placed")
    order = [F.col("__hash"), F.col("__key"), F.col("text_crc32"), F.col("size")]
    return (running_total(placed, ["shard"], order, F.lit(1).cast("long"), "slot")
            .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    F.col("slot").cast("long").alias("slot"), "grown_shard"))
