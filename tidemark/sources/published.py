"""Tables published in versions: a new version is written whole, then one pointer moves.

A table is a folder with `versions/<name>` and the file `current`, which names the version that readers get. The pointer is
replaced by one rename, so a reader sees the old or the new version, a run that fails leaves the old one, and a reader that
pins a version keeps it. Works in any store that Spark's file systems reach.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _store(spark: SparkSession, path: str):
    """(file context, a function that makes paths) of the store that path lies in."""
    fs = spark._jvm.org.apache.hadoop.fs
    return fs.FileContext.getFileContext(fs.Path(path).toUri(), spark._jsc.hadoopConfiguration()), fs.Path


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that readers get, None before the first."""
    store, at = _store(spark, path)
    if not store.util().exists(at(f"{path}/current")):
        return None
    return spark.read.text(f"{path}/current").first()[0]


def point_to(spark: SparkSession, path: str, version: str) -> None:
    """Makes version, which must be there, the current one; also back to an older one."""
    store, at = _store(spark, path)
    if not store.util().exists(at(f"{path}/versions/{version}/_SUCCESS")):
        raise FileNotFoundError(f"{path} has no whole version {version}")
    jvm = spark._jvm
    fresh = at(f"{path}/.current-{uuid.uuid4().hex}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    out = store.create(fresh, flags, spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0))
    out.write(bytearray(version.encode()))
    out.close()
    kinds = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    store.rename(fresh, at(f"{path}/current"), kinds)


def publish(df: DataFrame, path: str, version: str | None = None) -> str:
    """Writes df as a new version and makes it the current one; gives its name. df may read the table itself."""
    version = version or uuid.uuid4().hex
    df.write.mode("error").parquet(f"{path}/versions/{version}")
    point_to(df.sparkSession, path, version)
    return version


def read_published(spark: SparkSession, path: str, version: str | None = None, schema: StructType | None = None) -> DataFrame:
    """The table at its current version, or at a pinned one. The version is fixed here, not when rows are read."""
    version = version or current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/versions/{version}")


def upsert_derived(derived: DataFrame, path: str, keys: list[str], overwrite: bool = False) -> str:
    """Publishes the table at path with derived rows put in: new keys enter, derived ones are refreshed, curated ones stay as they are
    unless overwrite. The table has keys, `source` and other columns; derived has the same without source, each key once."""
    spark = derived.sparkSession
    old = read_published(spark, path)
    fresh = derived.withColumn("source", F.lit("derived")).select(old.columns)
    held = old if overwrite else old.where(F.col("source") != "derived")
    if overwrite:
        return publish(old.join(fresh, keys, "left_anti").unionByName(fresh), path)
    stale = old.where(F.col("source") == "derived").join(fresh, keys, "left_anti")
    return publish(held.unionByName(stale).unionByName(fresh.join(held, keys, "left_anti")), path)
