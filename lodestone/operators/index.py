"""Tables derived from a source once and kept below the shared folder: an index is read, not made anew, until its source changes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import sparse
from lodestone.session import shared_dir


def fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of the files below a path."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found, out = system.listFiles(hadoop, True), []
    while found.hasNext():
        f = found.next()
        out.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(out)).encode()).hexdigest()[:20]


def kept(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build()'s table for the present state of the files at source. A table without its marker, of a run that died, is written again."""
    path = f"{shared_dir(spark).rstrip('/')}/lodestone-index/{name}-{fingerprint(spark, source)}"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def postings(spark: SparkSession, source: str, key: str, text: str = "text") -> DataFrame:
    """Stored (key, term, weight) of a Parquet table, in order of terms, so that a search reads the row groups of its own terms."""

    def build() -> DataFrame:
        rows = sparse.weights(spark.read.parquet(source), key, text)
        return rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "term").sortWithinPartitions("term", key)

    return kept(spark, f"postings-{key}", source, build)
