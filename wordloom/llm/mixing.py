"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wordloom.storage import join_small, materialize, running_total, sortable

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_rank(key: Column, seed: int) -> Column:
    """Hash of the key that orders rows pseudo-randomly; a null key hashes as the empty string."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def stable_source(source: Column) -> Column:
    """The source as a text that isn't null and sorts like it, null last."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def water_fill(sources: DataFrame, size: str, weight: str, total: Column, max_epochs: int) -> DataFrame:
    """Add ``target``: shares of ``total`` by weight, clamped at ``max_epochs`` times the size.

    Clamping every source above its cap and resharing the excess by weight until none is
    above ends in one state: with sources sorted by cap/weight, a first run of them is
    clamped and the others share the rest by weight. A source is clamped exactly if its
    cap is no more than its share of what the sources sorted before it leave, so a prefix
    sum finds the state without iterating. ``sources`` has one row per source; sizes are
    integers, so all sums are exact. If all are clamped, the total isn't reached. One task sees the row of every source.
    """
    cap, w = F.col("__cap"), F.col(weight)
    rising = Window.orderBy(cap.cast("double") / w, F.col("__key"))
    whole = Window.partitionBy()
    return (
        sources.withColumn("__cap", F.col(size) * F.lit(max_epochs))
        .withColumn("__total", total)
        .withColumn("__before", F.coalesce(
            F.sum(cap).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__rest", F.sum(w).over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__full", cap.cast("double") * F.col("__rest")
                    <= (F.col("__total") - F.col("__before")) * w)
        .withColumn("__level", (F.col("__total") - F.sum(F.when(F.col("__full"), cap).otherwise(0)).over(whole))
                    / F.nullif(F.sum(F.when(F.col("__full"), 0).otherwise(w)).over(whole), F.lit(0)))
        .withColumn("target", F.when(F.col("__full"), cap.cast("double"))
                    .otherwise(F.col("__level") * w))
        .drop("__cap", "__total", "__before", "__rest", "__full", "__level")
    )


def mix(docs: DataFrame, *, size: Column | None = None, source: str = "source", key: str = "doc_id",
        weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2,
        seed: int = 17) -> DataFrame:
    """How often the mix takes each row: ``key, source, size, source_size, target, copies, taken``.

    Sources sorted by code point, null last, get ``weights`` in turn. They share ``share``
    times the total size by :func:`water_fill`. A source's rows are all taken
    floor(target/size) times; rows in seeded hash order are taken once more until the
    running size, measured at each row's middle, reaches the rest. So a source's taken
    size misses its target by half a row at most, and a row is taken ``max_epochs`` times at most.

    Null keys hash as empty strings and null texts have size 0. Ties in the hash go by size,
    so equal rows are interchangeable and reruns agree. Empty sources have target 0; an
    empty table gives an empty result. Other columns of ``docs`` aren't read, whatever their names.
    """
    counted = materialize(
        docs.select(
            F.col(key).alias(key), F.col(source).cast("string").alias("source"),
            (word_count(F.col("text")) if size is None else size).cast("long").alias("size"),
            seeded_rank(F.col(key), seed).alias("__rank"))
        .withColumn("__key", stable_source(F.col("source"))), "mix-sizes")
    per_source = counted.groupBy("__key").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy("__key")) - 1
    ranked = per_source.withColumn("__w", F.element_at(
        F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")))
    everything = F.sum("source_size").over(Window.partitionBy())
    targets = materialize(
        water_fill(ranked, "source_size", "__w", F.lit(float(share)) * everything, max_epochs)
        .withColumn("__whole", F.when(F.col("source_size") > 0,
                                      F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("__part", F.col("target") - F.col("__whole") * F.col("source_size"))
        .drop("__w"), "mix-targets")
    running = running_total(counted, ["__key"], [F.col("__rank"), F.col("size")], F.col("size"), "__before")
    again = (2 * F.col("__before") + F.col("size") <= 2 * F.col("__part")) & (F.col("__part") > 0)
    return (
        join_small(running, targets, ["__key"])
        .withColumn("copies", (F.col("__whole") + again.cast("int")).cast("int"))
        .select(key, "source", "size", "source_size", "target", "copies",
                (F.col("size") * F.col("copies")).alias("taken"))
    )


def repeat_rows(docs: DataFrame, taken: DataFrame, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """Rows of ``docs`` as often as ``taken`` (by :func:`mix` with that seed) says, with the columns of ``docs``.

    In each source the rows taken once more are the first ones in order of hash and size, so the last
    of them tells all others: texts needn't be joined with one row for each document. Rows that share
    the last one's key and size are alike to the mix; only where not all of them are taken
    once more are they told apart, by a running number over a hash of the text and their other columns.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(seeded_rank(F.col(key), seed).alias("rank"), F.col("size"))
    placed = taken.select(stable_source(F.col("source")).alias("__s"), order.alias("at"), "copies")
    ends = (placed.groupBy("__s", "copies").agg(F.max("at").alias("last")).groupBy("__s")
            .agg(F.min("copies").alias("__low"), F.max("copies").alias("__high"), F.max_by("last", "copies").alias("__last")))
    ends = materialize(ends, "mix-ends")
    tied = (join_small(placed, ends, ["__s"]).filter("at = __last")
            .groupBy("__s").agg(F.count_if(F.col("copies") == F.col("__high")).alias("__more"), F.count(F.lit(1)).alias("__alike")))
    ends = materialize(ends.join(tied, "__s"), "mix-ends")
    marked = docs.select(F.struct(*columns).alias("__row"), stable_source(F.col("source").cast("string")).alias("__s"),
                         F.struct(seeded_rank(F.col(key), seed).alias("rank"), word_count(F.col("text")).alias("size")).alias("__at"))
    marked = join_small(marked, ends, ["__s"])
    torn = (F.col("__at") == F.col("__last")) & (F.col("__more") < F.col("__alike"))
    times = F.when(F.col("__at") <= F.col("__last"), F.col("__high")).otherwise(F.col("__low"))
    back = [F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    out = (marked.filter(~torn).withColumn("__times", times).filter("__times > 0")
           .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*back))
    if ends.filter("__more < __alike").isEmpty():
        return out
    some = marked.filter(torn).select(*back, "__s", "__low", "__high", "__more")
    some = materialize(some.withColumn("__hash", F.md5(F.coalesce("text", F.lit("")).cast("binary"))), "mix-torn")
    some = running_total(some, ["__s"], [F.col("__hash"), *sortable(docs)], F.lit(1).cast("long"), "__place")
    some = (some.withColumn("__times", F.when(F.col("__place") < F.col("__more"), F.col("__high")).otherwise(F.col("__low")))
            .filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*columns))
    return out.unionByName(some)
