"""Sinks: keyed chunk tables, evaluation logs, JSON side outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.chunks import refusal
from lodestone.operators.dml import upsert


def split_storable(chunks: DataFrame, **names) -> tuple[DataFrame, DataFrame]:
    """(chunks that can be stored, the others with their reason); names as for refusal."""
    rows = chunks.withColumn("reason", refusal(**names))
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def upsert_table(spark: SparkSession, chunks: DataFrame, path: str, keys: list[str], parts: int = 64, newest: list[Column] | None = None) -> DataFrame:
    """Puts rows into a keyed table; the new row replaces the old one, and of several of a batch the one that ``newest`` puts first stays, else the greatest row.

    The table is cut into ``parts`` by a hash of its keys. A change writes a new version of
    the parts that it touches and leaves the others where they lie; readers take each
    part's newest complete version, so they never see half of a change.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    order = newest or [F.desc(F.struct(*[c for c in chunks.columns if c not in keys] or keys))]
    new = upsert(chunks.limit(0), chunks, keys, order).withColumn("_part", part)
    touched = [r["_part"] for r in new.select("_part").distinct().collect()]  # parts at most
    places = _parts(spark, path)
    version = max((v for v, _ in places.values()), default=-1) + 1
    held = [places[p][1] for p in touched if p in places]
    if held:
        old = spark.read.schema(chunks.schema).parquet(*held)
        new = old.join(new.select(*keys), keys, "left_anti").select(*chunks.columns).withColumn("_part", part).unionByName(new)
    if touched:
        new.repartition(len(touched), "_part").write.mode("errorifexists").partitionBy("_part").parquet(f"{path}/version={version:06d}")
    return read_table(spark, path, chunks.schema) if touched or places else chunks.limit(0)


def _parts(spark: SparkSession, path: str) -> dict[int, tuple[int, str]]:
    """part -> (version, folder) of its newest complete version."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    hadoop = Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, tuple[int, str]] = {}
    if not system.exists(hadoop):
        return out
    for s in system.listStatus(hadoop):
        name = s.getPath().getName()
        if name.startswith("version=") and system.exists(Path(s.getPath(), "_SUCCESS")):
            version = int(name.split("=")[1])
            for p in system.listStatus(s.getPath()):
                if p.getPath().getName().startswith("_part="):
                    number = int(p.getPath().getName().split("=")[1])
                    if version > out.get(number, (-1, ""))[0]:
                        out[number] = (version, p.getPath().toString())
    return out


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The newest version of every part; None where there is no table."""
    places = [folder for _, folder in _parts(spark, path).values()]
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*places) if places else None


def drop_table(spark: SparkSession, path: str) -> bool:
    """Deletes a table with all its versions; whether there was one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def table_info(spark: SparkSession, path: str) -> dict[str, int]:
    """Versions, parts, and rows of a table."""
    places = _parts(spark, path)
    held = read_table(spark, path)
    return {"versions": len({v for v, _ in places.values()}), "parts": len(places), "rows": held.count() if held is not None else 0}


def append_log(rows: DataFrame, path: str) -> None:
    """Evaluation rows, appended as CSV."""
    rows.write.mode("append").option("header", "true").csv(path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, reference) of a text file, one a line, or of a CSV."""
    if path.lower().endswith(".csv"):
        df = spark.read.option("header", "true").csv(path)
        return df.select("question", (F.col("reference") if "reference" in df.columns else F.lit(None).cast("string")).alias("reference"))
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("question"), F.lit(None).cast("string").alias("reference"))
