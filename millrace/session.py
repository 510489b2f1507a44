"""Session defaults and the shared folder in which intermediate tables are written."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Defaults for a session that this library builds itself. A session that is handed in keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", app: str = "millrace", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one is set where none is named, in local mode alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        path = f"file://{local}"
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path


#: Spark removes the shuffle files of a query once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files; else these stay until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str, lean: bool = False) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    It cuts the lineage so that a lost executor costs no recomputation of Python
    stages, and lets several consumers share one run of an expensive stage.
    ``lean`` takes less disk: the table is packed closer, and the shuffle files that made it go at once.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    if lean:
        with shuffles_dropped(spark):
            df.write.option("compression", "zstd").parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: list[tuple[str, str]] = []


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when the application ends, or by ``clear_staged``."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    place, files = _files(spark, path)
    files.deleteOnExit(place)
    _STAGED.append((spark.sparkContext.applicationId, path))
    return path


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clear_staged(spark: SparkSession) -> int:
    """Deletes the intermediate tables of this application so far; for long sessions, once their results are written."""
    own = [path for app, path in _STAGED if app == spark.sparkContext.applicationId]
    for path in own:
        place, files = _files(spark, path)
        files.delete(place, True)
    _STAGED[:] = [(app, path) for app, path in _STAGED if path not in own]
    return len(own)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files are too few to fill them; large tables are left as they are."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="millrace-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "millrace_package.zip")
        with zipfile.ZipFile(path, "w") as out:
            for base, _, files in os.walk(package):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(base, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(package)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    return spark
