"""Writing of vector tables and reports: batches, exports, named backups."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.runtime import exists

#: The columns of a CSV export.
CSV_COLUMNS = ("id", "file_path", "function_name", "code_type", "language", "complexity", "line_start", "line_end")


def write_batches(df: DataFrame, folder: str, rows: int = 1000) -> None:
    """The table as JSON files of at most ``rows`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).json(folder)


def export(df: DataFrame, path: str, fmt: str, codec: str = "snappy") -> None:
    """The table as json (all columns), csv (the flat columns, with a header) or parquet."""
    if fmt == "csv":
        df.select(*CSV_COLUMNS).write.mode("overwrite").option("header", "true").csv(path)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").option("compression", codec).parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


class Backups:
    """Named copies of a table below ``folder/backups``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.base = spark, f"{folder.rstrip('/')}/backups"

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def create(self, df: DataFrame, name: str, at: float | None = None) -> dict:
        """Write the copy, then its info; a copy without info isn't listed."""
        if not name or "/" in name:
            raise ValueError("a backup's name is one path segment")
        df.write.mode("overwrite").parquet(f"{self.base}/{name}/data")
        info = {"name": name, "created_at": time.time() if at is None else at, "rows": self.spark.read.parquet(f"{self.base}/{name}/data").count()}
        self.spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.base}/{name}/info")
        return info

    def list(self) -> list[dict]:
        """Infos of the backups, newest first."""
        if not exists(self.spark, self.base):
            return []
        fs, jpath = self._fs(self.base)
        found = [s.getPath().getName() for s in fs.listStatus(jpath)]
        infos = [json.loads(self.spark.read.text(f"{self.base}/{n}/info").first()[0]) for n in found if exists(self.spark, f"{self.base}/{n}/info/_SUCCESS")]
        return sorted(infos, key=lambda i: (-i["created_at"], i["name"]))

    def restore(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}/data")

    def cleanup(self, keep_days: float, now: float | None = None) -> list[str]:
        """Delete backups older than so many days; gives their names. Nothing outside the backups is touched."""
        limit = (time.time() if now is None else now) - keep_days * 86400
        gone = [i["name"] for i in self.list() if i["created_at"] < limit]
        for name in gone:
            fs, jpath = self._fs(f"{self.base}/{name}")
            fs.delete(jpath, True)
        return gone


def is_fresh(sources: DataFrame, indexed_at) -> DataFrame:
    """One row: whether no source (``last_modified``) is newer than the index."""
    return sources.agg((~F.coalesce(F.max("last_modified") > F.lit(indexed_at), F.lit(False))).alias("fresh"))


#: Rows of a report at most, unless more are asked for.
REPORT_ROWS = 10_000


def _few(df: DataFrame, most: int) -> list:
    """The rows of a report; an error, and not a part of them, if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows: write it with export(), or give a greater limit")
    return rows


def report_json(df: DataFrame, most: int = REPORT_ROWS) -> str:
    """A report of at most ``most`` rows as indented JSON."""
    return json.dumps([json.loads(r[0]) for r in _few(df.select(F.to_json(F.struct(*df.columns))), most)], indent=2, ensure_ascii=False)


def report_text(title: str, df: DataFrame, markdown: bool = False, most: int = REPORT_ROWS) -> str:
    """A report of at most ``most`` rows as plain or Markdown text."""
    rows = [r.asDict() for r in _few(df, most)]
    if markdown:
        head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        return "\n".join([*head, *("| " + " | ".join("" if v is None else str(v) for v in r.values()) + " |" for r in rows)]) + "\n"
    return "\n".join([title, "=" * len(title), *(", ".join(f"{k}: {v}" for k, v in r.items()) for r in rows)]) + "\n"
