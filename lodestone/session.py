"""Session and table helpers shared by every module."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC times; conf keys use ``__`` for dots."""
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
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a temporary one in local mode, and an error on a cluster."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if not path and not held.isDefined():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        path = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    if not held.isDefined():
        context.setCheckpointDir(path)
    return path or held.get()


def pinned(df: DataFrame) -> DataFrame:
    """df computed once and checkpointed below the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a table that is sent to every task.
BROADCAST_ROWS = 200_000


def sent(df: DataFrame) -> DataFrame:
    """df as a side of a join: sent to every task where it has few rows. It is counted first, so it should be stored."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
