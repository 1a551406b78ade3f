"""Shared scratch space, and small helpers over rows of documents.

Executors can be lost, so intermediate tables are written below
``spark.checkpoint.dir``, which the whole cluster shares, and read back; a lost
task is then recomputed from files rather than from a long lineage.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Stands for a null doc_id wherever documents are ordered or joined.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a temporary one in local mode, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestone-"))
        return context._jsc.sc().getCheckpointDir().get()
    return path


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex[:12]}"


#: Paths written within each open ``scratch``, the innermost last.
_MADE: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``settled`` writes within go at the end, but for those that outlive it."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            discard(spark, path)


def settled(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Writes df once below the shared folder and reads it back: no later stage recomputes it.

    outlives: the table stays when the innermost ``scratch`` ends.
    """
    depth = 2 if outlives else 1
    back, path = written(df, name)
    if len(_MADE) >= depth:
        _MADE[-depth].append(path)
    return back


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as written below the shared folder, and its path, which is the caller's to discard."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system layer."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of steps that are over: its cleaner acts once their plans are garbage, which large heaps may leave for long."""
    gc.collect()
    spark._jvm.System.gc()


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Identity of a document row: its id (null: NULL_ID) and a hash of its text.

    Rows that agree in both are one document in every decision; each of the
    repeated rows still comes back in the result.
    """
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("_doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"),
    ]


def own(docs: DataFrame) -> list[Column]:
    """docs' columns as its own, whatever their names and whatever it is joined with."""
    return [docs[f"`{c}`"] for c in docs.columns]


def unused(names: list[str], stem: str) -> str:
    """A column name that none of names is, upper or lower case."""
    taken = {n.lower() for n in names}
    while stem.lower() in taken:
        stem += "_"
    return stem


def mapped(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any names, dots included: run sees them as c0, c1, ... and names its own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def tuned(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches bounded for rows that hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark
