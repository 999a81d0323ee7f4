"""Parquet tables that change in one step.

A table is a folder with ``data`` and ``manifest``. A change first writes its files to a new
folder under ``data``, where no reader looks, and then appends one file to ``manifest`` that
lists the folders (by partition, if there is one) of the new version. That file appears by one
rename at the end of its job, so a reader sees the old version or the new one, and a change
that fails half-way leaves the old one. Files of old versions stay until they are deleted from
outside, which no reader of the latest version notices. A table has one writer at a time.
"""
from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidegauge.session import persist_plan

MANIFEST = "version long, folder string, part string, partition string, table string"


def _manifest(spark: SparkSession, path):
    """Rows of the latest version and its number; None and 0 for a table that is not there yet."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifest")
        version = rows.agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, 0
    return rows.where(F.col("version") == version), version


def _part(partition):
    return F.col(partition).cast("string")


def _in_parts(df, parts, partition):
    """Rows of the partitions that ``parts`` (column part) lists; null is a partition like others."""
    return df.join(parts.select(F.col("part").alias("_part")), _part(partition).eqNullSafe(F.col("_part")), "left_semi")


def read_table(spark: SparkSession, path) -> DataFrame:
    """The latest version. Folders are read one beside the other; each upsert since the last
    replacement adds one at most."""
    rows, _ = _manifest(spark, path)
    if rows is None:
        raise ValueError(f"no table at {path}")
    kept = rows.select("folder", "partition", "table").distinct().collect()
    schema, partition = T.StructType.fromJson(json.loads(kept[0]["table"])), kept[0]["partition"]
    frames = []
    for folder in sorted({r["folder"] for r in kept if r["folder"]}):
        df = spark.read.schema(schema).parquet(f"{path}/data/{folder}")
        frames.append(_in_parts(df, rows.where(F.col("folder") == folder), partition) if partition else df)
    found = reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)
    return found.select(*schema.names)


def stage(df: DataFrame, path, partition=None) -> str:
    """Write ``df`` where no reader looks; the name of its folder."""
    folder = uuid.uuid4().hex
    writer = df.write.partitionBy(partition) if partition else df.write
    writer.parquet(f"{path}/data/{folder}")
    return folder


def publish(rows: DataFrame, path, version, schema, partition=None):
    """Make ``rows`` (folder, part) the given version of the table, by one file."""
    spark, names = rows.sparkSession, ("folder", "part")
    rows = rows.select(*names)
    if rows.limit(1).count() == 0:                             # a table without rows has no folder
        rows = spark.createDataFrame([(None, None)], "folder string, part string")
    rows.withColumns({"version": F.lit(version), "partition": F.lit(partition), "table": F.lit(schema.json())}) \
        .coalesce(1).write.mode("append").json(f"{path}/manifest")


def replace_table(df: DataFrame, path, partition=None):
    """All rows anew, split by ``partition`` if given (in which an empty text counts as null)."""
    spark = df.sparkSession
    _, version = _manifest(spark, path)
    folder = stage(df, path, partition)
    if partition:
        parts = spark.read.schema(df.schema).parquet(f"{path}/data/{folder}").select(_part(partition).alias("part")).distinct() if df.limit(1).count() \
            else spark.createDataFrame([], "part string")
    else:
        parts = spark.createDataFrame([(None,)], "part string")
    publish(parts.withColumn("folder", F.lit(folder)), path, version + 1, df.schema, partition)


def upsert_table(path, source: DataFrame, keys):
    """Upsert into a partitioned table, rewriting only the partitions that ``source`` touches.

    Columns of ``source`` but the keys and the partition are updated; it has one row per key. A
    null in a key or the partition matches nothing, so such rows are added.
    The touched partitions are joined, never collected, and the old files stay as they are, so
    a lost executor can always read them again.
    """
    from tidegauge.sources.sinks import upsert
    spark = source.sparkSession
    rows, version = _manifest(spark, path)
    head = rows.select("partition", "table").first()
    partition, schema = head["partition"], T.StructType.fromJson(json.loads(head["table"]))
    touched = persist_plan(source.select(_part(partition).alias("part")).distinct())
    target = _in_parts(read_table(spark, path), touched, partition)
    folder = stage(upsert(target, source, [*keys, partition]).select(*schema.names), path, partition)
    untouched = rows.where("folder is not null").join(touched.select(F.col("part").alias("_part")), F.col("part").eqNullSafe(F.col("_part")), "left_anti")
    publish(untouched.select("folder", "part").unionByName(touched.select(F.lit(folder).alias("folder"), "part")), path, version + 1, schema, partition)
