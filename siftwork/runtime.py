"""Session settings and tables kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_owned: dict[str, str] = {}
_kept: dict[str, SparkSession] = {}


def build_session(app: str = "siftwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; ``conf`` overrides any setting."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset one is made here, but only for a session within this machine: executors elsewhere would write to their own disks."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _owned:
        folder = tempfile.mkdtemp(prefix="siftwork-")
        atexit.register(shutil.rmtree, folder, True)
        _owned[app] = "file://" + folder
    return _owned[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one. It goes away with the session."""
    path = f"{shared_dir(spark)}/siftwork/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of a session, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    into = tempfile.mkdtemp(prefix="siftwork-zip-")
    atexit.register(shutil.rmtree, into, True)
    shutil.copytree(here, f"{into}/src/siftwork", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{into}/siftwork", "zip", f"{into}/src"))
    _shipped.add(app)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session is gone; the cluster cleans its shared folder itself
        pass


def keep(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    It cuts the lineage: a lost executor costs a second read of the table, never a second
    computation, and the rows stay the same however often they are read. The table goes away
    with the session.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    _kept[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def discard(kept: DataFrame) -> None:
    """Delete the files of a kept table that nothing reads any more. Other tables stay as they are."""
    for path in {f.rpartition("/")[0] for f in kept.inputFiles()}:
        for known in [k for k in _kept if k.split(":", 1)[-1].lstrip("/") == path.split(":", 1)[-1].lstrip("/")]:
            _remove(_kept.pop(known), known)


def spread(df: DataFrame) -> DataFrame:
    """A small input over all cores, for work that costs much more for each row than a shuffle of it.

    An input of at least as many partitions as cores, so every large one, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
