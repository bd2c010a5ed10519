"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks. DataFrame functions only.

Words are maximal runs of 0-9, a-z and characters from U+0080 in the lower-cased text; shingles
are five words, and a text or item of one to four words is one shingle. An item with n shingles is compared with windows of n shingles of each text
(the whole text where that is shorter). The weighted similarity counts a shingle as often as
it occurs: common / (window + item - common).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.storage import join_small, materialize

SHINGLE = 5
THRESHOLD = 0.8
SEPARATOR = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
#: Marks (12 bytes each) that are broadcast at a time; more are searched for in blocks of so many.
MARKS = 1_000_000
#: Fingerprints of windows at the threshold, without repeated shingles, differ in 9.7 of 64 bits on average, with deviation 2.9.
RADIUS = 23
#: One block more than the radius: fingerprints within it agree on a whole block at least.
BLOCKS = RADIUS + 1
WIDTHS = [64 // BLOCKS + (i < 64 % BLOCKS) for i in range(BLOCKS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = [_signed(((1 << w) - 1) << sum(WIDTHS[:i])) for i, w in enumerate(WIDTHS)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column) -> Column:
    """64-bit hashes of the shingles in order; one of all words where there are under five, none where there is no word."""
    words = F.array_remove(F.split(F.lower(text), SEPARATOR), "")

    def runs(w: Column) -> Column:
        last = F.size(w) - SHINGLE
        return F.when(last >= 0, F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))).when(
            F.size(w) > 0, F.array(F.xxhash64(w, F.size(w))))

    return F.coalesce(let(F.transform(words, lambda w: F.xxhash64(w)), runs), F.array().cast("array<long>"))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of a multiset: each bit is the majority of that bit, an exact half counting as 0.

    Bit k and bit k + 32 are counted together in the halves of one long, for up to 2**31 shingles.
    """
    lanes = F.lit((1 << 32) | 1)

    def count(k: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + F.shiftrightunsigned(h, k).bitwiseAND(lanes))

    counts = [count(k) for k in range(32)]

    def majority(c: Column) -> Column:
        n = F.size(hashes)
        bits = F.lit(0).cast("long")
        for k in range(32):
            low = F.get(c, F.lit(k)).bitwiseAND(F.lit((1 << 32) - 1)) * 2 > n
            high = F.shiftrightunsigned(F.get(c, F.lit(k)), 32) * 2 > n
            bits = bits.bitwiseOR(F.when(low, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
            bits = bits.bitwiseOR(F.when(high, F.lit(_signed(1 << k + 32))).otherwise(F.lit(0)).cast("long"))
        return bits

    return let(F.array(*counts), majority)


def block_values(fingerprint: Column) -> Column:
    return F.array(*[fingerprint.bitwiseAND(F.lit(m)) for m in MASKS])


def common_weight(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    shared = F.array_intersect(a, b)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda xs, h: F.size(F.filter(xs, lambda x: x == h))
    return F.when(plain, F.size(shared)).otherwise(
        F.aggregate(shared, F.lit(0), lambda s, h: s + F.least(times(a, h), times(b, h))))


def least_common(window: Column, item: Column, threshold: float) -> Column:
    """The least common weight with which a window reaches the threshold."""
    return F.ceil((window + item) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9)).cast("int")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
                 item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id, hash, item_id, similarity, start, distance``: the best window of each item in each text.

    1. A shingle of some item that occurs in a text marks its place. A window reaches the
       threshold only if enough of its places are marked, so only windows with enough marks
       (of items of its size), beginning at a mark or ending the text, are kept. That loses
       nothing: moving a window's start on to its next mark never lowers its common weight.
    2. Each kept window meets the items of which it holds one of the rarest shingles: of each item,
       so many of its rarest as leave a rest that can't reach the threshold. That loses nothing
       either, and a passage that many items share brings no pairs.
    3. Pairs whose 64-bit SimHashes agree on one of 24 blocks and lie within 23 bits go on (a pair within
       the radius agrees on a block). So do all pairs in which a shingle repeats or the window is
       shorter than the item: there the weights, not the number of shingles, decide, and no radius is safe.
    4. Exact weighted-shingle similarity decides.

    A text is known by key and ``hash`` (128 bits of it); rows that repeat both are one. ``start``
    is the least start of the windows with the greatest similarity, in words from 0. Texts and items
    without words are neither found nor searched for; an item of one to four words is found only in
    texts that consist of the same words. Items that share an id count as one. Other columns of both
    tables are ignored.
    """
    items = benchmark.select(F.col(item_key).alias("item_id"), shingle_hashes(F.col(item_text)).alias("item"))
    items = materialize(items.filter(F.size("item") > 0).distinct().select(
        "*", F.size("item").alias("n"), simhash(F.col("item")).alias("item_print"), repeats("item").alias("item_loose"),
        F.monotonically_increasing_id().alias("no")), "items")
    marks = materialize(items.select("n", F.explode("item").alias("h")).distinct(), "marks")
    named = docs.select(F.struct(F.col(key).alias("id")).alias("id"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("hash"),
                        F.col(text).alias("text"))
    windows = materialize(_windows(named, marks, threshold), "windows")
    sliced = (join_small(named, windows, ["id", "hash"])
              .withColumn("hs", shingle_hashes(F.col("text"))).drop("text")
              .withColumn("size", F.explode("sizes")).withColumn("start", F.explode("size.starts"))
              .select("id", "hash", F.col("size.n").alias("n"), "start",
                      F.slice("hs", F.col("start") + 1, F.col("size.n")).alias("window")).distinct())
    loose = repeats("window") | (F.size("window") < F.col("n"))
    sliced = materialize(sliced.select("*", simhash(F.col("window")).alias("print"), loose.alias("loose"),
                                       F.monotonically_increasing_id().alias("w")), "prints")
    pairs = materialize(candidates(sliced, items, threshold), "pairs")
    differ = F.col("print").bitwiseXOR(F.col("item_print"))
    near = F.exists(block_values(differ), lambda v: v == 0) & (F.bit_count(differ) <= RADIUS)
    common = F.col("common")
    good = (join_small(pairs.join(sliced.drop("n"), "w"), items, ["no"])
            .filter(near | F.col("loose") | F.col("item_loose"))
            .withColumn("distance", F.bit_count(differ))
            .withColumn("common", common_weight(F.col("window"), F.col("item")))
            .withColumn("similarity", common / (F.size("window") + F.col("n") - common))
            .filter(common >= least_common(F.size("window"), F.col("n"), threshold)))
    return (good.groupBy("id", "hash", "item_id")
            .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), (-F.col("distance")).alias("near"))).alias("best"))
            .select(F.col("id.id").alias("id"), "hash", "item_id", "best.similarity", (-F.col("best.back")).alias("start"),
                    (-F.col("best.near")).alias("distance")))


def repeats(column: str) -> Column:
    return F.size(F.array_distinct(column)) < F.size(column)


def _windows(named: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """``id, hash, sizes``: the starts of the windows with enough marks, by window size."""
    places = (named.withColumn("hs", shingle_hashes(F.col("text")))
              .select("id", "hash", F.size("hs").alias("m"), F.posexplode("hs").alias("pos", "h")))
    blocks = max(1, -(-marks.count() // MARKS))
    block = F.pmod(F.xxhash64("h"), F.lit(blocks))
    # The marks are a query set: in blocks of a bounded size, each broadcast, they meet all places.
    met = [places.join(F.broadcast(marks.filter(block == b)), "h") for b in range(blocks)]
    marked = (reduce(DataFrame.unionByName, met).groupBy("id", "hash", "m", "n")
              .agg(F.array_sort(F.collect_set("pos")).alias("at")))
    window = F.least("m", "n")
    need = least_common(window, F.col("n"), threshold)
    marked = marked.withColumn("need", need).filter(F.size("at") >= F.col("need"))
    enough = F.filter(F.sequence(F.lit(0), F.size("at") - F.col("need")),
                      lambda j: F.get("at", j + F.col("need") - 1) - F.get("at", j) < F.col("n"))
    starts = F.array_distinct(F.transform(enough, lambda j: F.least(F.get("at", j), F.col("m") - window)))
    return (marked.withColumn("starts", starts).filter(F.size("starts") > 0)
            .groupBy("id", "hash").agg(F.collect_list(F.struct("n", "starts")).alias("sizes")))


def candidates(sliced: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """``w, no``: windows and the items of their size of which each holds one of the rarest shingles."""
    held = items.select("no", "n", F.explode("item").alias("h")).groupBy("no", "n", "h").agg(F.count(F.lit(1)).alias("c"))
    common = held.groupBy("n", "h").agg(F.count(F.lit(1)).alias("holders"))
    rarest = Window.partitionBy("no").orderBy("holders", "h").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("c").over(rarest), F.lit(0))
    least = F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9))
    index = materialize(held.join(common, ["n", "h"]).withColumn("before", before)
                        .filter(F.col("n") - F.col("before") >= least).select("n", "h", "no"), "index")
    inside = sliced.select("w", "n", F.explode(F.array_distinct("window")).alias("h"))
    return join_small(inside, index, ["n", "h"]).select("w", "no").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
                      **options) -> DataFrame:
    """``docs`` without the rows in which :func:`contaminated` finds an item; all columns are kept."""
    bad = contaminated(docs, benchmark, key=key, text=text, **options)
    bad = materialize(bad.select(F.struct("id").alias("__id"), F.col("hash").alias("__hash")).distinct(), "leaks")
    marked = docs.withColumns({"__id": F.struct(F.col(key).alias("id")),
                               "__hash": F.unhex(F.md5(F.col(text).cast("binary")))})
    return (join_small(marked, bad, ["__id", "__hash"], "left_anti")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
