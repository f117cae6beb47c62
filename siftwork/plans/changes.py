"""Queries over the change log of scanned files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators.changes import ChangeRun, file_log, latest, recorded_states
from siftwork.runtime import new_folder, table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The files of the next run: it begins with what earlier runs recorded, plans its batch, applies and commits it; these are the batch's rows.

    The folder is the question's own, as the tables hold all that earlier runs left: asked twice, it gives the same rows.
    """
    run = ChangeRun(spark, new_folder(spark, "changes"))
    run.adopt(recorded_states(table(spark, folder, "cache_entry"), table(spark, folder, "analysis_runs")))
    batch = run.run(file_log(table(spark, folder, "file_metadata")))
    return run.read_plan(batch).select(F.col("key").alias("path"))


def p3_states(spark: SparkSession, folder: str) -> DataFrame:
    """The latest state of every file with its offset."""
    return latest(file_log(table(spark, folder, "file_metadata"))).select(F.col("key").alias("path"), F.col("offset").alias("revision"), F.col("state").alias("hash"))


QUERIES = {"p3_found": p3_found, "p3_states": p3_states}

_NORMAL = "'.' || list_aggregate(list_transform(list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda s: s <> '' AND s <> '.'), lambda s: '/' || s), 'string_agg', '')"
ORACLES = {
    "p3_found": f"""
        WITH now AS (
            SELECT {_NORMAL} AS path, arg_max(lower(hash), revision) AS hash FROM file_metadata WHERE hash IS NOT NULL AND revision IS NOT NULL AND path IS NOT NULL GROUP BY 1
        ), done AS (
            SELECT {_NORMAL} AS path, max(struct_pack(t := last_analyzed, h := lower(file_hash))).h AS hash
            FROM cache_entry WHERE run_id IN (SELECT run_id FROM analysis_runs WHERE status = 'succeeded') AND path IS NOT NULL GROUP BY 1
        )
        SELECT now.path FROM now LEFT JOIN done ON now.path = done.path WHERE done.path IS NULL OR now.hash IS DISTINCT FROM done.hash
    """,
    "p3_states": f"SELECT path, revision::BIGINT AS revision, hash FROM (SELECT {_NORMAL} AS path, max(revision) AS revision, arg_max(lower(hash), revision) AS hash FROM file_metadata WHERE hash IS NOT NULL AND revision IS NOT NULL AND path IS NOT NULL GROUP BY 1)",
}
