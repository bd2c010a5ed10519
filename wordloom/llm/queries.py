"""The ten registered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import (decontam, langid, licenses, minhash, mixing, mpegts, quality, sharding, urlfilter, warc)

#: The rules of op5: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id"):
    """Rows that nothing may be learned from: crc32 of the key as text leaves 2 divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2).drop("copies", "source")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~held_out()))
    return langid.identify(docs, model, extra={"held_out": held_out()}).drop("shares")


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), weights=[1.0] * 8)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: every 64th is its directory's LICENSE, every 8th that of its folder."""
    n = F.col("doc_id")
    folder = F.concat_ws("/", "source", F.concat(F.lit("p"), F.floor(n / 64)),
                         F.when(n % 64 != 0, F.concat(F.lit("m"), F.floor(n / 8))))
    name = F.when(n % 8 == 0, F.concat(F.lit("LICENSE."), n)).otherwise(F.concat(F.lit("f"), n, F.lit(".txt")))
    files = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", folder, name))
    return licenses.scan(files, keep=["doc_id"])


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.features(mpegts.store(table(spark, sf_dir, "documents")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "similarity", "start")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~held_out()))
    return quality.score(docs, model, extra={"held_out": held_out()})


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.archive(table(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_language_id, op3_shard, op4_near_duplicates, op5_url_rules, op6_license_scan,
    op7_transport_streams, op8_decontaminate, op9_quality, op10_warc)}
