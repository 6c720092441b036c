"""Session settings shared by the entry points, the bench and the tests."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "pitline", memory: str = "8g") -> SparkSession:
    """A local session for tests and benches. On a cluster the submitter builds the session."""
    n = str(cores)
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", n if n.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a
    folder of its own, because executors on other machines could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder and reading it back."""
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df))


def write_scratch(df: DataFrame) -> str:
    """Write ``df`` as Parquet under a fresh name in the shared folder; return the path."""
    path = scratch_path(df.sparkSession)
    df.write.mode("errorifexists").parquet(path)
    return path


def scratch_path(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), f"pitline-{uuid.uuid4().hex}")
