"""Tables written in the cluster's shared folder, to cut lineage and to hand results from one job to the next.

The folder is ``spark.checkpoint.dir`` as the session has it; only where that is unset and the master is local
(tests, a notebook) a local folder is taken. Everything goes through Spark's own readers and writers, so any Hadoop file system will do, and a
lost executor costs the tasks that it ran, never a table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="lumisieve-"))
    return f"{named.rstrip('/')}/lumisieve-{app}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder, read back with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables that ``written`` gave, once all that reads them is written itself."""
    for t in tables:
        _delete(t.sparkSession, t.scratch_path)


def clear(spark: SparkSession) -> None:
    """Remove what this application has written. Results that still read it must have been saved before."""
    _delete(spark, shared_folder(spark))


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
