"""Reading of source trees and of stored tables, and change lists from snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.functions.classify import is_ignored, is_scanned, language
from siftwork.runtime import exists

VECTOR_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("file_path", T.StringType()), T.StructField("function_name", T.StringType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType())]
    + [T.StructField("code_type", T.StringType()), T.StructField("language", T.StringType()), T.StructField("complexity", T.FloatType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("hash", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType())]
)


def read_tree(spark: SparkSession, folder: str, only_scanned: bool = True) -> DataFrame:
    """Files below a folder: ``path`` (relative, ``./a/b``), ``content``, ``size``, ``last_modified``, ``hash``, ``language``.

    Files that a scan leaves out are dropped by their path before they are read. Bytes that aren't UTF-8 become
    replacement characters. A file of any size is read whole by one task.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/")
    path = F.concat(F.lit("."), F.regexp_replace("path", r"^(?:file:/*)?.*?" + _quoted(root.removeprefix("file://")), ""))
    rel = raw.select(path.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))
    kept = rel.where(is_scanned(F.col("path")) if only_scanned else ~is_ignored(F.col("path")))
    return kept.select("path", F.decode("content", "UTF-8").alias("content"), "size", "last_modified", F.sha2("content", 256).alias("hash"), language(F.col("path")).alias("language"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else f"\\{c}" for c in text)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A stored table of a known schema; an empty one if there is nothing at ``path``."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.format(fmt).schema(schema).load(path)


def read_batches(spark: SparkSession, folder: str, schema: T.StructType = VECTOR_SCHEMA) -> DataFrame:
    """All ``batch_*.json`` files of a folder, in parallel; missing numbers don't matter."""
    return spark.read.schema(schema).json(f"{folder.rstrip('/')}/batch_*.json")


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path``, ``change`` (added, modified, deleted) between two snapshots of ``path, hash``."""
    b = before.select("path", F.col("hash").alias("was"), F.lit(True).alias("there"))
    a = after.select("path", F.col("hash").alias("now"), F.lit(True).alias("here"))
    change = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def line_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path``, ``lines_added``, ``lines_removed`` between two snapshots of ``path, content``, lines compared as a multiset."""
    side = lambda df, n: df.where("content IS NOT NULL").select("path", F.explode(F.split("content", "\r?\n")).alias("line"), F.lit(n).alias("n"))
    net = side(before, -1).unionAll(side(after, 1)).groupBy("path", "line").agg(F.sum("n").alias("n")).where("n <> 0")
    return net.groupBy("path").agg(F.sum(F.greatest("n", F.lit(0))).alias("lines_added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("lines_removed"))
