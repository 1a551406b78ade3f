"""Questions over tables: profiles, routing, and read-only SQL in place of generated programs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.guard import NotAQuery, check

#: Least score of a vector route; fixes tried.
ROUTE_LEAST, FIXES = 0.45, 2


def profile(df: DataFrame, name: str) -> DataFrame:
    """(table_name, column_name, data_type, rows, nulls, distinct_values) of each column, in one pass."""
    cols = [c for c, _ in df.dtypes]
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.struct(F.lit(c).alias("c"), F.lit(t).alias("t"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias("z")) for c, t in df.dtypes]).alias("a"),
    )
    assert cols
    out = row.select(F.explode("a").alias("x"))
    return out.select(F.lit(name).alias("table_name"), F.col("x.c").alias("column_name"), F.col("x.t").alias("data_type"), F.col("x.n").alias("n_rows"), F.col("x.z").alias("n_nulls"))


def describe(df: DataFrame, name: str) -> str:
    """What a router reads of a table."""
    return f"Table {name}. COLUMNS: " + ", ".join(f"{c} ({t})" for c, t in df.dtypes)


def mentioned(question: Column, names: list[str]) -> Column:
    """The first table named in the question, else null; the only table where there is one."""
    if len(names) == 1:
        return F.lit(names[0])
    low = F.lower(question)
    return F.coalesce(*[F.when(F.instr(low, name.lower()) > 0, F.lit(name)) for name in sorted(names, key=lambda n: (-len(n), n))], F.lit(None).cast("string"))


def table_index(profiles: DataFrame, held: DataFrame | None = None, embed=None, force: bool = False) -> DataFrame:
    """(table_name, summary, digest, vector, status) of tables (table_name, summary, digest).

    A table whose digest the index holds keeps its vector and is skipped; new and changed ones are embedded.
    """
    from lodestone.functions import providers
    from lodestone.operators.dml import status

    if held is None:
        held = profiles.limit(0).withColumn("vector", F.lit(None).cast("array<float>"))
    rows = status(profiles, held, "table_name", "digest", force)
    fresh = providers.embedded(rows.where("status <> 'skipped'"), "summary", embed or providers.hashed_embedding)
    kept = rows.where("status = 'skipped'").join(held.select("table_name", "vector"), "table_name")
    return kept.select("table_name", "summary", "digest", "vector", "status").unionByName(fresh.select("table_name", "summary", "digest", "vector", "status"))


def routed(questions: DataFrame, index: DataFrame, least: float = ROUTE_LEAST, query: str = "query_id", key: str = "table_id") -> DataFrame:
    """(query, routed_to, score) of questions (query, vector): the nearest table, or null where even that scores below ``least``."""
    from lodestone.operators import dense

    best = dense.search(questions, index, 1, query, key)
    return best.select(query, F.when(F.col("score") >= least, F.col(key)).alias("routed_to"), "score")


def guarded(spark: SparkSession, statement: str, allowed: set[str], most_rows: int | None = None) -> DataFrame:
    """One query over allowed temporary views; anything else is refused before it runs. most_rows caps what a person is shown."""
    df = spark.sql(check(spark, statement, allowed))
    return df.limit(most_rows) if most_rows else df


def ask(spark: SparkSession, question: str, write: Callable[[str, str | None], str], allowed: set[str], fixes: int = FIXES) -> tuple[DataFrame, str]:
    """Writes SQL for a question, runs it guarded, and hands an analysis error back to the writer, ``fixes`` times at most."""
    from pyspark.errors import AnalysisException, ParseException

    error = None
    for _ in range(fixes + 1):
        statement = write(question, error)
        try:
            return guarded(spark, statement, allowed), statement
        except (AnalysisException, ParseException, NotAQuery) as e:
            error = str(e)
    raise NotAQuery(f"no query after {fixes} fixes: {error}")


def templates(question: str, error: str | None = None) -> str:
    """A stand-in writer for a few kinds of question: total, average, share, top."""
    q = question.lower()
    m = re.search(r"(total|average) (\w+) (?:of|in) (\w+) by (\w+)", q)
    if m:
        f = "sum" if m[1] == "total" else "avg"
        return f"SELECT {m[4]}, round({f}({m[2]}), 2) AS value FROM {m[3]} GROUP BY {m[4]}"
    m = re.search(r"share of (\w+) where (\w+) is (\w+)", q)
    if m:
        return f"SELECT round(100.0 * count_if({m[2]} = '{m[3]}') / count(*), 2) AS value FROM {m[1]}"
    m = re.search(r"top (\d+) (\w+) by (\w+)", q)
    if m:
        return f"SELECT * FROM {m[2]} ORDER BY {m[3]} DESC LIMIT {m[1]}"
    raise NotAQuery("no template for this question")
