"""Job 1: documents as they land become chunks; what was taken is never taken again.

    python -m jobs.ingest jobs/ingest.json --documents /data/documents --output /data/chunks --checkpoint /data/chunks-checkpoint

Takes the Parquet files that have come since the last run (a file stream with a
checkpoint, ended once all of them are taken). Of a document that comes again only
another text counts: each identifier's version, the digest of its text, is kept as
streaming state. Texts are cleaned, cut into sentences and packed into chunks.

Every micro-batch writes its own partitions, ``batch`` and ``lang``, by dynamic
overwrite, so a batch that is run again after a failure replaces what it had
written. ``documents`` below the output names each version with its batch, and
``chunks`` holds the chunks; ``current`` reads the newest version of each document.
Rows without an identifier are left out and logged.
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import settings
from lodestone.functions import text as T
from lodestone.operators import packing
from lodestone.streaming import ingest as streams

log = logging.getLogger("jobs.ingest")

DEFAULTS = {"documents": None, "output": None, "checkpoint": None, "files_a_batch": 1000}
SCHEMA = "doc_id long, text string, lang string, source string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cut(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, chunk_index, chunk_total, chunk_id, tokens, content) of cleaned texts packed by sentences."""
    parts = packing.sentence_groups(T.sentences(T.clean_text(F.col("text"))))
    rows = docs.select("doc_id", "lang", "source", parts.alias("p"))
    # outer, and empty texts dropped after: a filter on the parts' number would pack every text a second time
    each = rows.select("doc_id", "lang", "source", F.size("p").alias("chunk_total"), F.posexplode_outer("p").alias("_i", "content")).where("_i IS NOT NULL")
    return each.select(
        "doc_id", "lang", "source", (F.col("_i") + 1).alias("chunk_index"), "chunk_total",
        T.chunk_id(F.lit(None).cast("string"), F.lit("txt"), F.coalesce("source", F.lit("")), F.col("content")).alias("chunk_id"),
        T.tokens(F.col("content")).alias("tokens"), "content",
    )


def _write(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run(spark: SparkSession, config: dict) -> dict[str, int]:
    """One run over whatever is new; counts of rows taken, documents written, and chunks written."""
    output, counts = config["output"].rstrip("/"), {"rows": 0, "documents": 0, "chunks": 0}
    stream = streams.landing(spark, config["documents"], SCHEMA, config["files_a_batch"])
    named = stream.withColumns({"arrived": F.col("_metadata.file_modification_time").cast("string"), "file": F.col("_metadata.file_path"), "version": F.sha2(F.coalesce("text", F.lit("")), 256)})
    changed = streams.changed(named.where("doc_id IS NOT NULL"), "doc_id", "version", ("arrived", "file"))

    def store(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            held = batch.withColumn("batch", F.lit(number))
            _write(held.select("doc_id", "source", "version", "batch", "lang"), f"{output}/documents", "batch", "lang")
            _write(cut(batch).withColumn("batch", F.lit(number)), f"{output}/chunks", "batch", "lang")
            new = batch.count()
        finally:
            batch.unpersist()
        chunks = _table(spark, output, "chunks", number)
        counts["documents"] += new
        counts["chunks"] += chunks
        log.info("batch %d: wrote %d documents and %d chunks to %s", number, new, chunks, output)

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = changed.writeStream.foreachBatch(store).option("checkpointLocation", config["checkpoint"]).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    counts["rows"] = sum(p.numInputRows for p in query.recentProgress)
    log.info("read %d new rows of %s", counts["rows"], config["documents"])
    return counts


def _table(spark: SparkSession, output: str, name: str, batch: int) -> int:
    """Rows of one batch; 0 where nothing has been written yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{output}/{name}/batch={batch}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return 0
    return spark.read.parquet(f"{output}/{name}/batch={batch}").count()


def current(spark: SparkSession, output: str) -> DataFrame:
    """Chunks of the newest version of every document."""
    types = "doc_id long, source string, version string, batch int, lang string"
    newest = spark.read.schema(types).parquet(f"{output}/documents").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    chunks = "doc_id long, source string, chunk_index int, chunk_total int, chunk_id string, tokens long, content string, batch int, lang string"
    held = spark.read.schema(chunks).parquet(f"{output}/chunks").join(newest, ["doc_id", "batch"], "left_semi")
    return held.select("doc_id", "lang", "source", "chunk_index", "chunk_total", "chunk_id", "tokens", "content")


def main(argv: list[str] | None = None) -> None:
    from lodestone.session import build_session

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config, master = settings.from_command_line(__doc__.splitlines()[0], DEFAULTS, argv)
    spark = build_session("ingest", master)
    try:
        run(spark, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
