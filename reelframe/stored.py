"""Tables in the folder that a cluster's machines share: they cut a plan's lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_written: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines share.

    Where that is unset, a local session gets a folder of its own; a cluster has to name one.
    """
    global _own_dir
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="reelframe-")
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to; sweep() deletes what it holds."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)
    _written.discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t._written_to)


def sweep(spark: SparkSession) -> None:
    """Delete all that this process has written to the shared folder and not discarded; results still to be read go too."""
    for path in sorted(_written):
        _delete(spark, path)
