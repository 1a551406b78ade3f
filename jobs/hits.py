"""Job 2: every question searched on behalf of every caller; the sheet of hits that an evaluation or a review starts from.

    python -m jobs.hits jobs/hits.json --tables /data/sf1 --output /data/hits

Reads documents, their vectors, and the questions; each caller's hits come from
hybrid search over what that caller may see, and carry the source to cite and the
first sentence. The sheet is partitioned by caller and written by dynamic
overwrite: a rerun gives the same rows, and a run for some callers leaves those of
the others alone.
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import settings
from lodestone.functions import text as T
from lodestone.operators import retrieve
from lodestone.plans import inputs
from lodestone.session import pinned, sent

log = logging.getLogger("jobs.hits")

DEFAULTS = {"tables": None, "output": None, "shared": "", "callers": ["u7", "u12", "u33"], "hits": 10}
SCHEMA = "query_id long, doc_id long, rank int, score double, found_in string, source string, citation string, snippet string, caller string"


def sheet(spark: SparkSession, tables: str, caller: str, hits: int) -> DataFrame:
    """(query_id, doc_id, rank, score, found_in, source, citation, snippet) of a caller, whose address is caller@x."""
    queries, chunks = inputs.queries(spark, tables), inputs.chunks(spark, tables)
    found = pinned(retrieve.search(queries, chunks, "hybrid", hits, retrieve.visible(caller, f"{caller}@x"), texts=inputs.documents(spark, tables)))
    # the texts of the winners only are cleaned, each once
    texts = inputs.documents(spark, tables).select("doc_id", "source", "text").join(sent(found.select("doc_id").distinct()), "doc_id", "left_semi")
    first = F.get(T.sentences(T.clean_text(F.col("text"))), F.lit(0))
    payload = texts.select("doc_id", "source", F.concat(F.lit("[Source: "), F.coalesce("source", F.lit("unknown")), F.lit("]")).alias("citation"), F.coalesce(first, F.lit("")).alias("snippet"))
    return found.join(payload, "doc_id").select("query_id", "doc_id", "rank", "score", "found_in", "source", "citation", "snippet")


def run(spark: SparkSession, config: dict) -> dict[str, int]:
    """Writes the sheet of each caller; hits by caller."""
    counts = {}
    for caller in config["callers"]:
        rows = sheet(spark, config["tables"], caller, config["hits"]).withColumn("caller", F.lit(caller))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("caller").parquet(config["output"])
        counts[caller] = written(spark, config["output"]).where(F.col("caller") == caller).count()
        log.info("read the tables of %s for %s, wrote %d hits to %s", config["tables"], caller, counts[caller], config["output"])
    return counts


def written(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(output)


def main(argv: list[str] | None = None) -> None:
    from lodestone.session import build_session

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config, master = settings.from_command_line(__doc__.splitlines()[0], DEFAULTS, argv)
    spark = build_session("hits", master, **({"spark__checkpoint__dir": config["shared"]} if config["shared"] else {}))
    try:
        run(spark, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
