"""Tables between the steps of an iteration."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def workers_know(spark: SparkSession) -> None:
    """Python workers started from now on find this package where the driver found it, if that folder is there."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share.

    A cluster names it in spark.checkpoint.dir. Only where that is unset, as in
    local tests, a folder of this machine is set, which goes when Python ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        global _own
        if _own is None:
            _own = tempfile.mkdtemp(prefix="driftlens-")
            atexit.register(shutil.rmtree, _own, ignore_errors=True)
        root = f"file://{_own}"
    return f"{root.rstrip('/')}/driftlens-{uuid.uuid4().hex}"


_own: str | None = None


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """df, written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whether Spark deletes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run within go when each query ends, not when the driver next collects garbage.

    For steps that end in written tables, which nothing reads by an earlier shuffle.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
