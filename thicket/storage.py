"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``. Where it is unset, one of our
    own if all of Spark is this process; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="thicket-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver exits."""
    path = f"{shared_dir(spark)}/thicket/{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage as ``checkpoint()`` does, keeps columns prunable, and a
    lost executor loses none of it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._thicket_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for ``df``, which nothing reads any more."""
    drop_path(df.sparkSession, df._thicket_path)


def forget_all(spark: SparkSession) -> None:
    """Deletes every step of a session, once its results have been used. The
    driver's exit does the same."""
    for own, path in [x for x in _made if x[0] is spark]:
        drop_path(own, path)
        _made.remove((own, path))


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return
