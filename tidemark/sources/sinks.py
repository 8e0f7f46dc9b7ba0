"""Writers: snapshots by date, model tables, upserts, and intermediate results in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Unset, a temporary one where all tasks run on this machine, as
    in tests; on a cluster, whose executors would not see it, an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage and survives lost executors.

    Results read these files, so they stay; all of one application lie in one folder of its id, to be removed after it.
    """
    path = f"{shared_dir(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(rdd: RDD) -> RDD:
    """`checkpointed` for few large records."""
    sc = rdd.context
    path = f"{shared_dir(SparkSession.getActiveSession())}/{sc.applicationId}/step-{uuid.uuid4().hex}"
    rdd.saveAsPickleFile(path, 1)
    return sc.pickleFile(path)


def write_snapshot(df: DataFrame, path: str, as_of: str) -> None:
    """One partition per snapshot date; writing a date again replaces that date only."""
    df.withColumn("vintage", F.lit(as_of).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("vintage").parquet(path)


def seed_terms(curated: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: derived rows fill what curation has not set; curated rows are never overwritten."""
    fresh = derived.join(curated.select(*keys), keys, "left_anti").withColumn("source", F.lit("derived"))
    return curated.withColumn("source", F.lit("curated")).unionByName(fresh)
