"""Stages of a job: which one a change of parameters invalidates, and their stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.params import KNOBS, STAGE_OF, STAGES, Params


def invalidated(pairs: DataFrame) -> Column:
    """The earliest stage to run again, null if only planning changed. ``pairs`` has structs ``old`` and ``new``."""
    at = [F.when(~F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")), STAGES.index(STAGE_OF[k])) for k in KNOBS if k in STAGE_OF]
    return F.get(F.array(*[F.lit(s) for s in STAGES]), F.array_min(F.array(*at)))


def invalidated_from(old: Params, new: Params) -> str | None:
    changed = [STAGES.index(s) for k, s in STAGE_OF.items() if getattr(old, k) != getattr(new, k)]
    return STAGES[min(changed)] if changed else None


def stages_left(done: Column, stale: Column) -> Column:
    """Of the stages done, those before the stale one."""
    order = F.array(*[F.lit(s) for s in STAGES])
    return F.filter(done, lambda s: stale.isNull() | (F.array_position(order, s) < F.array_position(order, stale)))


def save_stage(df: DataFrame, root: str, stage: str) -> None:
    """A stage's table, partitioned by job: jobs that ran again are replaced, the others stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(f"{root}/{stage}"))


def load_stage(spark: SparkSession, root: str, stage: str, schema: str) -> DataFrame:
    """A stored stage, empty if it was never stored."""
    path = f"{root}/{stage}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
