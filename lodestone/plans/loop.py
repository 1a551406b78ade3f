"""The corrective retrieval loop over a batch of queries.

Round 0 is hybrid, then dense, then sparse: queries whose hits are graded weak
go round again, at most three rounds, and every query keeps its last round.
The dense and the sparse lists, of which every mode is a view, are searched once for all queries and
checkpointed, and so are the grades of all that they hold; a round only fuses and ranks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import answer, retrieve
from lodestone.session import pinned


def corrective_search(queries: DataFrame, chunks: DataFrame, predicate: Column | None = None, n: int = answer.TOP, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, grade, rank, attempt, mode): each query's reranked hits of the round that it ended in."""
    lists = {name: pinned(rows) for name, rows in retrieve.ranked(queries, chunks, "hybrid", predicate, texts=texts).items()}
    pairs = reduce(DataFrame.union, [rows.select("query_id", "doc_id") for rows in lists.values()]).distinct()
    covered = pinned(answer.coverage(pairs, queries, chunks if texts is None else texts))
    open_, done, mode = queries.select("query_id"), [], "hybrid"
    for attempt in range(answer.ATTEMPTS + 1):
        held = {name: rows.join(open_, "query_id", "left_semi") for name, rows in lists.items() if mode in ("hybrid", name)}
        ranked = answer.rerank(retrieve.fuse(held, 20), covered, n)
        graded = pinned(ranked.select("query_id", "doc_id", "score", answer.relevance(F.col("score")).alias("grade"), "rank", F.lit(attempt).alias("attempt"), F.lit(mode).alias("mode")))
        weak = answer.weak(graded, attempt).where("retry").select("query_id")
        if attempt == answer.ATTEMPTS or weak.isEmpty():
            done.append(graded)
            break
        done.append(graded.join(weak, "query_id", "left_anti"))
        open_, mode = weak, answer.NEXT_MODE[mode]
    return reduce(DataFrame.unionByName, done)
