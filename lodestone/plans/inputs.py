"""The driver's tables seen as the engine's: documents with owners, permissions, queries, turns, chunks.

Columns that the tables lack are derived from their keys, the same way here and
in the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

USERS = 10


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with uploaded_by, owner_email, allowed_users, is_public, document_id."""
    d = table(spark, sf_dir, "documents")
    user = lambda n: F.concat(F.lit("u"), F.pmod("doc_id", F.lit(n)).cast("string"))
    mail = F.when(F.pmod("doc_id", F.lit(45)) == 5, "").when(F.pmod("doc_id", F.lit(5)) != 0, F.concat(user(50), F.lit("@x")))
    return d.select(
        "doc_id",
        "text",
        "lang",
        "source",
        "n_chars",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id"),
        user(50).alias("uploaded_by"),
        mail.alias("owner_email"),
        F.array(mail, F.concat(user(11), F.lit("@x"))).alias("allowed_users"),
        (F.pmod("doc_id", F.lit(7)) == 0).alias("is_public"),
    )


DOCUMENTS_SQL = """docs AS (SELECT *, 'doc_' || doc_id AS document_id, 'u' || (doc_id % 50) AS uploaded_by,
  CASE WHEN doc_id % 45 = 5 THEN '' WHEN doc_id % 5 <> 0 THEN 'u' || (doc_id % 50) || '@x' END AS owner_email,
  ['u' || (doc_id % 50) || '@x', 'u' || (doc_id % 11) || '@x'] AS allowed_both,
  'u' || (doc_id % 11) || '@x' AS other_user, doc_id % 7 = 0 AS is_public FROM documents)"""


def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, user_id, permission_level, expires_at): a third of the pairs; every fourth document's expire."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(USERS - 1))).alias("u"))
    d = d.where(F.pmod(F.col("doc_id") + F.col("u"), F.lit(3)) == 0)
    expires = F.when(F.pmod("doc_id", F.lit(4)) == 0, F.to_timestamp(F.lit("2024-06-01 00:00:00")) + F.make_dt_interval(days=F.pmod("doc_id", F.lit(60)).cast("int")))
    level = F.when(F.pmod("doc_id", F.lit(2)) == 0, "read").otherwise("write")
    return d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id"), F.concat(F.lit("u"), F.col("u").cast("string")).alias("user_id"), level.alias("permission_level"), expires.alias("expires_at"))


PERMISSIONS_SQL = """perms AS (SELECT 'doc_' || doc_id AS document_id, 'u' || u AS user_id,
  CASE WHEN doc_id % 2 = 0 THEN 'read' ELSE 'write' END AS permission_level,
  CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2024-06-01 00:00:00' + to_days((doc_id % 60)::INT) END AS expires_at
  FROM documents, range(10) AS r(u) WHERE (doc_id + u) % 3 = 0)"""
NOW = "2024-07-01 00:00:00"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as queries, with the vector of their number."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return b.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the vector of their number, where there is one."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return documents(spark, sf_dir).join(e, "doc_id", "left")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
