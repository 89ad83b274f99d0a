"""Session defaults and the written tables that cut the lineage of multi-step jobs."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def get_session(name: str = "tidemark", **settings: str) -> SparkSession:
    """Build or reuse a session with the defaults the library assumes."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach; chosen here only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return folder


_areas: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """Where intermediate tables of this application, or of the open :func:`scratch_area`, go."""
    if _areas:
        return _areas[-1]
    return f"{shared_folder(spark)}/tidemark-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the scratch folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    That cuts the lineage, survives the loss of an executor, and gives the
    planner the true size: a plan over a checkpointed RDD keeps multiplied-up
    estimates, which grow without bound when a loop joins its own output.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch_area(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside are deleted on leaving; write or collect the result before."""
    _areas.append(scratch_path(spark, "area"))
    try:
        yield _areas[-1]
    finally:
        _delete(spark, _areas.pop())


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application wrote; results that read it are gone too."""
    _delete(spark, f"{shared_folder(spark)}/tidemark-{spark.sparkContext.applicationId}")
