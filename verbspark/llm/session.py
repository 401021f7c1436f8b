"""What the operators need from the Spark session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[str | None] = ContextVar("_scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the setting is absent and all executors are threads of this
    process, as in tests, a folder of this machine is taken; elsewhere its
    absence is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return folder


def step_path(spark: SparkSession) -> str:
    """A place of its own for a table in the shared folder."""
    return f"{_steps(spark)}/{uuid.uuid4().hex}"


def _steps(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{_scope.get() or f'steps-{spark.sparkContext.applicationId}'}"


def delete_steps(spark: SparkSession) -> None:
    """Deletes all step tables of this application, once the results that read them have been written."""
    delete(spark, _steps(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, computed once and written as a table in the shared folder.

    Unlike a checkpoint a written table has the size that it has, so that plans
    over many such steps keep true estimates.
    """
    spark = df.sparkSession
    path = step_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*steps: DataFrame) -> None:
    """Deletes tables that checkpointed() wrote, once nothing reads them any more."""
    for df in steps:
        path = getattr(df, "_written", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables that checkpointed() wrote inside; results must have been written by then."""
    name = f"steps-{uuid.uuid4().hex}"
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)
        delete(spark, f"{shared_folder(spark)}/{name}")


#: Rows of text that go to a Python worker at once, at most.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the buffers between executors and their Python workers small: rows may hold long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver did.

    Elsewhere the package is installed, or sent with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
