"""Tables in the shared folder, by which operators cut their lineage and hand on what several steps read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def store_of(path: str):
    """(file system, path in it, what stands before that) of a local or shared path, or of a store that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, path[: -len(inner)] if path.endswith(inner) else ""


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where none is set: a folder of our own, gone at exit, if Spark runs on one machine; on a cluster an error."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="catchwater-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        own = f"file://{path}"
        spark.sparkContext.setCheckpointDir(own)
    return own


def home(spark: SparkSession) -> str:
    """The part of the shared folder that is this application's."""
    return f"{shared_dir(spark)}/catchwater/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{home(spark)}/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: a lost executor never costs more than one reread."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written unless it is a written table as it is."""
    return df if hasattr(df, "_written_to") else written(df, name)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._written_to.rpartition("/")[0])


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has in the shared folder; for callers that are done with its results."""
    remove(spark, home(spark))
