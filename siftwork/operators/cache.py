"""An analysis table keyed by path and content hash, and a cache of responses: upserts, anti-joins, statistics, eviction.

Every change gives a new table from an old one; nothing is updated in place. What a change writes, it
writes as a new version of the table, so a failed write leaves the old one whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.runtime import exists


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` in place of the rows with its keys; other rows stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def stale(table: DataFrame, current: DataFrame, key: str, hash_col: str) -> DataFrame:
    """Rows of ``table`` whose key is gone from ``current`` (``deleted``) or has another hash there (``changed``); letter case doesn't count."""
    now = current.select(key, F.lower(hash_col).alias("__now"), F.lit(True).alias("__there"))
    joined = table.join(now, key, "left")
    reason = F.when(F.col("__there").isNull(), "deleted").when(~F.lower(hash_col).eqNullSafe(F.col("__now")), "changed")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").drop("__now", "__there")


def to_analyse(current: DataFrame, table: DataFrame, key: str, hash_col: str) -> DataFrame:
    """Rows of ``current`` that the table doesn't hold with the same hash, with ``change_type`` Created or Modified."""
    held = table.select(key, F.lower(hash_col).alias("__held"), F.lit(True).alias("__there"))
    joined = current.join(held, key, "left").where(F.col("__there").isNull() | ~F.lower(hash_col).eqNullSafe(F.col("__held")))
    return joined.withColumn("change_type", F.when(F.col("__there").isNull(), "Created").otherwise("Modified")).drop("__held", "__there")


def table_stats(table: DataFrame, size: Column, when: Column) -> DataFrame:
    """Rows, total size (0 if unknown), first and last time."""
    return table.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_size"), F.min(when).alias("oldest"), F.max(when).alias("newest"))


def evict(table: DataFrame, most: int, hits: str, order: list[str]) -> DataFrame:
    """The ``most`` rows of most hits; ties by ``order``, later values stay."""
    return table.orderBy(F.desc(hits), *[F.desc(c) for c in order]).limit(most)


def prompt_hash(prompt: Column, model: Column, config: Column) -> Column:
    return F.sha2(F.concat(prompt, model, config), 256)


def lookup(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each request with its response and whether it was a hit."""
    return requests.join(table.select(key, "response"), key, "left").withColumn("hit", F.col("response").isNotNull())


def hit_rate(looked_up: DataFrame) -> DataFrame:
    n = F.count("*")
    return looked_up.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.when(n == 0, 0.0).otherwise(F.count_if("hit") / n).alias("hit_rate"))


def first_and_rest(table: DataFrame, column: str, most: int = 10) -> DataFrame:
    """``n``, ``line``: the first ``most`` values in order, and how many more there are. One row of counts and ``most`` rows are all that is sorted."""
    named = table.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("line"))
    first = named.orderBy("line").limit(most).withColumn("n", F.row_number().over(Window.orderBy("line")).cast("long"))
    more = named.agg(F.count("*").alias("all")).where(F.col("all") > most).select(F.format_string("... and %d more", F.col("all") - most).alias("line"), F.lit(most + 1).cast("long").alias("n"))
    return first.unionByName(more).select("n", "line")


def of_model(table: DataFrame, model: str) -> DataFrame:
    """The responses of one model."""
    return table.where(F.col("model_type") == model)


def pre_warm(table: DataFrame, responses: DataFrame, config: str = "default") -> DataFrame:
    """A response cache (``prompt_hash, response, model_type, hit_count``) with ``responses`` (``prompt, response, model_type``) put in; of several for one hash the greatest response."""
    new = responses.select(prompt_hash(F.col("prompt"), F.col("model_type"), F.lit(config)).alias("prompt_hash"), "response", "model_type")
    new = new.groupBy("prompt_hash").agg(F.max(F.struct("response", "model_type")).alias("r")).select("prompt_hash", "r.response", "r.model_type", F.lit(0).cast("long").alias("hit_count"))
    return upsert(table.select("prompt_hash", "response", "model_type", "hit_count"), new, "prompt_hash")


class VersionedTable:
    """A table below ``folder`` in numbered versions; the newest complete one holds."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and exists(self.spark, f"{self.folder}/{n}/_SUCCESS"))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest (or given) version; None if there is none."""
        known = self.versions()
        if not known:
            return None
        return self.spark.read.parquet(f"{self.folder}/v{known[-1] if version is None else version}")

    def write(self, df: DataFrame) -> int:
        n = (self.versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/v{n}")
        return n

    def upsert(self, new: DataFrame, key: str) -> int:
        old = self.read()
        return self.write(new if old is None else upsert(old, new, key))

    def delete(self, keys: DataFrame, key: str) -> int:
        old = self.read()
        return 0 if old is None else self.write(without(old, keys, key))

    def clear(self, confirm: bool = False) -> bool:
        """Write an empty version; the old ones stay as backup. Without ``confirm`` nothing happens."""
        old = self.read()
        if not confirm or old is None:
            return False
        self.write(old.limit(0))
        return True

    def prune(self, keep: int = 1) -> list[int]:
        """Delete all but the newest versions; gives those deleted."""
        fs, _ = self._fs()
        gone = self.versions()[: -max(keep, 1)]
        for n in gone:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v{n}"), True)
        return gone
