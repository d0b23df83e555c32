"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tracelens", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on: UTC, AQE and Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: the cluster's, or a new local one when none is named."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tracelens-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows once as a table in shared storage and go on from there.

    Cuts the plan for results that are read several times or iterated over, and survives
    the loss of executors. Nothing reads the shuffle files of the write again, so they are removed when it ends.
    """
    path = new_stage(df.sparkSession)
    conf = df.sparkSession.conf
    # asked with a default, an unset entry reads as that default and never as Spark's own
    own = conf.get(CLEANUP) if conf.isModifiable(CLEANUP) else None
    if own is not None:
        conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if own is not None:
            conf.set(CLEANUP, own)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Removes a query's shuffle files at its end, where this version of Spark can.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STAGES: list[str] = []


def new_stage(spark: SparkSession) -> str:
    """A new name in shared storage, which ``release`` deletes."""
    _STAGES.append(f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}")
    return _STAGES[-1]


def release(spark: SparkSession) -> int:
    """Delete the stages that ``materialize`` has written so far; results that still read them must be stored before."""
    done = 0
    while _STAGES:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_STAGES.pop())
        done += bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))
    return done
