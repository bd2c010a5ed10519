"""URL rules by a sort-merge range join. DataFrame functions only.

A rule (host, path) becomes the interval of canonical keys that start with its own key:
host labels reversed, a zero byte, the path. A url becomes one point for each host that
contains its own (itself and its parents), so a rule for subdomains is a plain prefix too.
Points and interval ends are range-sorted together. A sweep over the sorted rows keeps the
stack of open rules: the running count of opened less closed intervals is the stack's depth,
and the rule opened last at that depth is its top. Counts and tops are carried between the
range partitions through a table with one row per partition and depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wordloom.storage import join_small, materialize

#: Rows of a range partition, about; their number follows the counted input.
ROWS_PER_RANGE = 200_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def range_key(host: Column, path: Column) -> Column:
    """Canonical sort key as bytes: reversed host labels, a zero byte, the path."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("\0"), path).cast("binary")


def parent_hosts(host: Column) -> Column:
    """The host and all that it is a subdomain of."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def sweep(points: DataFrame, intervals: DataFrame, carry: list[str], payload: list[str]) -> DataFrame:
    """Points with the innermost interval that holds each: ``carry`` and struct ``top`` (null: none).

    points: ``k`` binary and ``carry``. intervals: ``k`` binary prefixes, distinct, and ``payload``.
    """
    top = F.struct(*payload)
    nothing = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in carry]
    shape = intervals.select(top.alias("top")).schema["top"].dataType
    none = F.lit(None).cast(shape).alias("top")
    opened = intervals.select("k", F.lit(1).alias("step"), top.alias("top"), *nothing)
    closed = intervals.select(F.concat("k", F.lit(b"\xff")).alias("k"), F.lit(-1).alias("step"), none, *nothing)
    events = points.select("k", F.lit(0).alias("step"), none, *carry).unionByName(opened).unionByName(closed)
    # At one key, closings come first, then openings, then points.
    rank = F.when(F.col("step") == -1, 0).when(F.col("step") == 1, 1).otherwise(2)
    events = materialize(events.withColumn("rank", rank).withColumn("tie", F.xxhash64(*carry)), "events")
    ranges = max(1, -(-events.count() // ROWS_PER_RANGE),
                 int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(events.repartitionByRange(ranges, "k", "rank", "tie")
                        .withColumn("part", F.spark_partition_id()), "sweep")
    order = [F.col("k"), F.col("rank"), F.col("tie")]
    upto = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    depths = (dealt.groupBy("part").agg(F.sum("step").alias("net"))
              .select("part", F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("start")))
    deep = (join_small(dealt, materialize(depths, "depths"), ["part"])
            .withColumn("depth", F.col("start") + F.sum("step").over(upto)))
    level = Window.partitionBy("part", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = deep.withColumn("inside", F.last("top", ignorenulls=True).over(level))
    # What each depth had open when a partition ended, carried to the later ones.
    last = (deep.filter("step = 1").groupBy("part", "depth")
            .agg(F.max_by("top", F.struct("k", "rank", "tie")).alias("top")))
    states = materialize(_states(last, ranges - 1), "states")  # a row for each partition and depth at most
    return (join_small(seen.filter("step = 0"), states, ["part", "depth"], "left")
            .select(*carry, F.when(F.col("depth") > 0, F.coalesce("inside", "carried")).alias("top")))


def _states(last: DataFrame, final: int) -> DataFrame:
    """For each later partition and depth, the rule that an earlier partition opened last at that depth."""
    until = F.coalesce(F.lead("part").over(Window.partitionBy("depth").orderBy("part")), F.lit(final))
    return (last.withColumn("until", until)
            .filter("until > part")
            .select("depth", F.col("top").alias("carried"),
                    F.explode(F.sequence(F.col("part") + 1, F.col("until"))).alias("part")))


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url",
          default: str = "allow") -> DataFrame:
    """The longest rule that fits each url: ``key, host, path, rule, verdict``.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the
    url's path starts with the rule's path. The longest host and path together wins, then
    the longest host; of equal rules, the greatest verdict (``block`` before ``allow``) holds.
    Without a rule the verdict is ``default`` and the rule null. A null url, or one without
    ``://``, has empty host and path, which only a rule for the empty host fits. Rows that
    share key, host and path are counted, judged once and repeated; a null key is a key like
    any other. Empty tables of pages or rules work. Other columns of ``pages`` are ignored.
    """
    wanted = (pages.select(F.col(key).alias("__id"), host_of(F.col(url)).alias("host"),
                           path_of(F.col(url)).alias("path"))
              .groupBy("__id", "host", "path").agg(F.count(F.lit(1)).alias("n")))
    points = (wanted.withColumn("__host", F.explode(parent_hosts(F.col("host"))))
              .select(range_key(F.col("__host"), F.col("path")).alias("k"), "__id", "host", "path", "n"))
    intervals = (rules.select(F.coalesce("host", F.lit("")).alias("h"), F.coalesce("path", F.lit("")).alias("p"),
                              "verdict")
                 .groupBy("h", "p").agg(F.max("verdict").alias("verdict"))
                 .select(range_key(F.col("h"), F.col("p")).alias("k"), F.concat("h", "p").alias("rule"),
                         "verdict", F.length("h").alias("host_length")))
    found = sweep(points, intervals, ["__id", "host", "path", "n"], ["rule", "verdict", "host_length"])
    longest = F.when(F.col("top").isNotNull(), F.struct(F.length("top.rule"), F.col("top.host_length")))
    return (
        found.groupBy("__id", "host", "path").agg(F.max_by("top", longest).alias("top"), F.max("n").alias("n"))
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .select(F.col("__id").alias(key), "host", "path", F.col("top.rule").alias("rule"),
                F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
    )
