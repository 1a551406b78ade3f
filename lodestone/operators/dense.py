"""Exact dense search: blocks of queries against every row, k best kept on the way.

A block of query vectors goes to every task and meets the rows' vectors as one
matrix product a batch; each task keeps its k best for each query, so what is
shuffled is tasks x queries x k rows and never a product of the two tables.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import sparse

#: Queries a pass; their vectors are sent to every task.
BLOCK = 4096
#: Rows that meet TILE queries at once: what a task holds beside its k best is of this size, whatever the tables'.
SLICE, TILE = 1024, 256


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def search(queries: DataFrame, rows: DataFrame, k: int = 20, query: str = "query_id", key: str = "doc_id", vector: str = "vector") -> DataFrame:
    """(query, key, score, rank): k nearest rows by cosine, rounded to 6 places; ties by key.

    Null vectors take no part; zero vectors score 0.
    """
    wanted = queries.select(F.col(query).cast("long").alias("q"), F.col(vector).alias("v")).where("v IS NOT NULL AND q IS NOT NULL")
    held = rows.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).where("v IS NOT NULL")
    blocks = max(1, -(-wanted.count() // BLOCK))
    parts = []
    for block in range(blocks):
        some = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        table = some.toArrow().combine_chunks()
        ids = table.column("q").to_numpy()
        vectors = _unit(_matrix(table.column("v").combine_chunks())) if len(ids) else np.zeros((0, 0))

        def run(batches, ids=ids, vectors=vectors):
            best_k, best_s = sparse.nothing_yet(len(ids), k)
            for part in (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)):
                rows, keys = _unit(_matrix(part.column(1))).T, part.column(0).to_numpy()
                for at in range(0, len(ids), TILE):
                    some = slice(at, at + TILE)
                    s = vectors[some] @ rows
                    np.round(s, 6, out=s)
                    s += 0.0
                    sparse.keep_best(best_k[some], best_s[some], keys, s)
            q, c = np.nonzero(best_s > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_k[q, c]), pa.array(best_s[q, c])], [query, key, "score"])

        parts.append(held.mapInArrow(run, f"{query} long, {key} long, score double"))
    return sparse.top(reduce(DataFrame.union, parts), k, query, key)
