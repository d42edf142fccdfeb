"""Session helpers: the shared folder, written tables and worker imports."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Scratch paths that still exist, in the order of their creation.
_paths: list[str] = []
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, from spark.checkpoint.dir.

    Where the setting is absent (tests, local mode) a temporary folder is made
    and set as checkpoint folder. A cluster without the setting is an error:
    a machine-local folder would lose data silently there.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        base = getattr(sc, "_weftgraph_dir", None)
        if base is None:
            folder = tempfile.mkdtemp(prefix="weftgraph-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            base = f"file://{folder}"
            sc._weftgraph_dir = base
            sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the application ends."""
    if not _paths:
        atexit.register(_remove_all, spark)
    path = f"{shared_dir(spark)}/weftgraph-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _paths.append(path)
    return path


def _remove_all(spark: SparkSession) -> None:
    for path in list(_paths):
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system; it works after the session was stopped, while its JVM lives."""
    jvm = spark.sparkContext._jvm
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
    except Exception:  # the JVM is gone; the folder's owner cleans up
        pass
    if path in _paths:
        _paths.remove(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftgraph_path = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of statements that are done: it does so once the driver's garbage is collected, in a large heap perhaps never during a query."""
    gc.collect()  # Python's handles of frames
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the table that `materialise` wrote for df."""
    remove(df.sparkSession, df._weftgraph_path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Scratch tables that are made inside go at the end, but those of the frames added to the list that is given."""
    before, kept = set(_paths), []
    try:
        yield kept
    finally:
        stay = {k._weftgraph_path for k in kept}
        for path in [p for p in _paths if p not in before and p not in stay]:
            remove(spark, path)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started from.

    Workers of a local master share the driver's path; executors of a cluster
    get the package as a zip, whatever folders the driver itself sees.
    """
    sc = spark.sparkContext
    roots = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    here = sc.master.startswith("local") and not sc.master.startswith("local-cluster") and os.path.realpath(_ROOT) in [*roots, os.path.realpath(os.getcwd())]
    if here or getattr(sc, "_weftgraph_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="weftgraph-ship-"), "weftgraph.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(_ROOT, "weftgraph")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, _ROOT))
    sc.addPyFile(target)
    atexit.register(shutil.rmtree, os.path.dirname(target), ignore_errors=True)
    sc._weftgraph_shipped = True
