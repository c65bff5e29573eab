"""Session defaults and tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Temporary folders of local sessions without the setting.
_local: dict[int, str] = {}


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("nearmesh")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local master, where all share one disk, gets a temporary folder if the
    setting is missing; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or _local.get(id(spark.sparkContext))
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="nearmesh-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = _local[id(spark.sparkContext)] = "file://" + folder
    return path.rstrip("/")


def step_dir(spark: SparkSession) -> str:
    """The folder of this application's step tables, within the shared one."""
    return f"{shared_dir(spark)}/nearmesh-{spark.sparkContext.applicationId}"


def clear_steps(spark: SparkSession) -> None:
    """Delete the step tables of this application; results that still read them are lost."""
    jvm, path = spark.sparkContext._jvm, step_dir(spark)
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str = "step", compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{step_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as (id, vec)."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
