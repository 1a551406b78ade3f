"""From retrieved rows to an answer: reranking, grading, budget, prompt, citations, judging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.operators import sparse
from lodestone.session import sent

# -- fixed values ------------------------------------------------------------
TOP = 5
WEAK_BELOW, WEAK_SHARE, ATTEMPTS = 3, 0.5, 2
NEXT_MODE = {"hybrid": "dense", "dense": "sparse", "sparse": "hybrid"}
NO_ANSWER = "i don't have enough information in the provided context"
CITATION = r"(?i)\[Source:\s*([^,\]]+)(?:,\s*page\s+(\d+))?\]"
# ----------------------------------------------------------------------------


def coverage(pairs: DataFrame, queries: DataFrame, docs: DataFrame, query: str = "query_id", key: str = "doc_id", text: str = "text", postings: DataFrame | None = None, chars: int | None = None) -> DataFrame:
    """(query, key, coverage): the share of a query's different terms that the document holds.

    postings: stored term weights of the documents, whose texts are not read then. chars: a
    reranker's limit on what it reads of a text; none unless one is given.
    """
    q = sparse.terms(queries, query, "text").select(query, "term").withColumn("_all", F.count(F.lit(1)).over(W.partitionBy(query)))
    wanted = pairs.select(query, key)
    if postings is not None and chars is None:
        # terms of the questions only
        d = postings.join(q.select("term").distinct(), "term", "left_semi").select(key, "term")
    else:
        held = docs.join(sent(pairs.select(key).distinct()), key, "left_semi").select(key, F.substring(text, 1, chars).alias(text) if chars else F.col(text))
        d = sparse.terms(held, key, text).select(key, "term")
    met = wanted.join(q, query).join(d.withColumn("_hit", F.lit(1)), [key, "term"], "left")
    return met.groupBy(query, key).agg(F.round(F.sum(F.coalesce("_hit", F.lit(0))) / F.max("_all"), 6).alias("coverage"))


def rerank(hits: DataFrame, scored: DataFrame, n: int = TOP, query: str = "query_id", key: str = "doc_id", score: str = "coverage") -> DataFrame:
    """The n best by the new score; a missing one counts as 0; ties keep the order of retrieval. retrieval_score stays."""
    both = hits.withColumnRenamed("score", "retrieval_score").withColumnRenamed("rank", "retrieval_rank").join(scored, [query, key], "left")
    both = both.withColumn("score", F.coalesce(score, F.lit(0.0)))
    order = W.partitionBy(query).orderBy(F.desc("score"), "retrieval_rank")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def relevance(coverage_: Column) -> Column:
    """A stand-in judge's 1..5 of a coverage share; null for none."""
    return F.when(coverage_.isNotNull(), (F.least(F.floor(coverage_ * 5), F.lit(4)) + 1).cast("int"))


def weak(graded: DataFrame, attempt: int, query: str = "query_id", grade: str = "grade") -> DataFrame:
    """(query, weak_share, retry): whether over WEAK_SHARE of the rows are graded below WEAK_BELOW and an attempt is left."""
    share = F.avg(F.when(F.col(grade) < WEAK_BELOW, 1.0).otherwise(0.0))
    return graded.groupBy(query).agg(F.round(share, 6).alias("weak_share")).withColumn("retry", (F.col("weak_share") > WEAK_SHARE) & F.lit(attempt < ATTEMPTS))


def header(number: Column, source: Column, page: Column, section: Column) -> Column:
    """Heading of a chunk in the prompt."""
    part = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label), c.cast("string")))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.concat_ws(" | ", source, part("page ", page), part("section ", section)))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer from the context only and cite as [Source: name, page n]."))


def no_answer(answer: Column) -> Column:
    return F.lower(answer).contains(NO_ANSWER)


def citations(answers: DataFrame, key: str = "query_id", answer: str = "answer") -> DataFrame:
    """(key, cited_source, cited_page) of each citation in an answer."""
    found = F.arrays_zip(F.regexp_extract_all(answer, F.lit(CITATION), 1).alias("s"), F.regexp_extract_all(answer, F.lit(CITATION), 2).alias("p"))
    rows = answers.select(key, F.explode(found).alias("c"))
    return rows.select(key, strip(F.col("c.s")).alias("cited_source"), F.nullif(F.col("c.p"), F.lit("")).cast("int").alias("cited_page")).distinct()


def cited(chunks: DataFrame, cites: DataFrame, key: str = "query_id") -> DataFrame:
    """The chunks that an answer cites, each once: source equal in any case, and the page equal or not given."""
    low = cites.withColumn("_s", F.lower("cited_source")).select(F.col(key).alias("_k"), "_s", "cited_page")
    same = (F.col(key) == F.col("_k")) & (F.lower("source") == F.col("_s")) & (F.col("cited_page").isNull() | (F.col("cited_page") == F.col("page")))
    return chunks.join(low, same, "left_semi")


def extract(chunks: DataFrame, query: str = "query_id") -> DataFrame:
    """A stand-in generator: the first sentence of the best chunk with its citation."""
    best = chunks.where("rank = 1")
    sentence = F.element_at(F.split("content", r"(?<=[.!?])\s+"), 1)
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(", page "), F.col("page").cast("string"))).otherwise("")
    return best.select(query, F.concat(sentence, F.lit(" [Source: "), "source", page, F.lit("]")).alias("answer"))


def judge_average(*scores: Column) -> Column:
    """Mean of the scores that there are, to 2 places."""
    there = F.array_compact(F.array(*[s.cast("double") for s in scores]))
    total = F.aggregate(there, F.lit(0.0), lambda a, x: a + x)
    return F.round(F.when(F.size(there) > 0, total / F.size(there)), 2)


def session_summary(rows: DataFrame, by: list[str], metrics: list[str], alert: float = 3.0) -> DataFrame:
    """Mean of each metric over the rows that have it, and whether it is below the alert threshold."""
    agg = [F.count(F.lit(1)).alias("rows")]
    agg += [F.round(F.avg(m), 2).alias(f"avg_{m}") for m in metrics]
    out = rows.groupBy(*by).agg(*agg)
    return out.withColumns({f"low_{m}": F.coalesce(F.col(f"avg_{m}") < alert, F.lit(False)) for m in metrics})


def length_stats(hits: DataFrame, docs: DataFrame, query: str = "query_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query, candidates, mean_chars, most_chars) of the texts that are sent to a reranker."""
    size = hits.join(docs.select(key, F.length(F.coalesce(text, F.lit(""))).alias("_n")), key)
    return size.groupBy(query).agg(F.count(F.lit(1)).alias("candidates"), F.round(F.avg("_n"), 2).alias("mean_chars"), F.max("_n").cast("long").alias("most_chars"))


def direct(question: str, history: str = "", generate=None) -> str:
    """An answer without retrieval: the question after its history, to a generator; the stand-in says that it can't."""
    text = f"{history}\n\n{question}".strip()
    return generate(text) if generate is not None else "I can answer questions about the documents that you have added."


def judged(answers: DataFrame, judges: dict[str, Column]) -> DataFrame:
    """answers with each judge's score and their average; a judge that fails gives null and doesn't count."""
    rows = answers.withColumns(judges)
    return rows.withColumn("average", judge_average(*[F.col(j) for j in judges]))
