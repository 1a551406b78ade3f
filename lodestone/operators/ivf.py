"""Dense search by an inverted file: rows listed by their nearest centroid, a question meets the lists nearest to it.

Centroids come from a bounded sample; every row is assigned to its list and stored in
order of lists, so that a search reads the row groups of the lists that are probed. A
question's vectors lie in every task, as in the exact search: nothing but the k best
is shuffled, and a list that holds a third of all rows is read by many tasks. Scores are
exact. How many lists are probed follows from a trial of recall against the exact
search, and the recall found comes with the result; ``dense.search`` stays the exact way.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import dense, index, sparse

#: Rows from which centroids are made, rounds of their making, and most lists.
SAMPLE, ROUNDS, LISTS = 20_000, 8, 4096
#: Recall to reach, and questions of the trial.
RECALL, TRIAL = 0.95, 256


def centroids(rows: DataFrame, lists: int | None = None, key: str = "doc_id", vector: str = "vector") -> np.ndarray:
    """Unit centroids of a sample of rows, those of least hash; lists: about the root of the number of rows where none is given."""
    held = rows.where(F.col(vector).isNotNull())
    total = held.count()
    lists = lists or int(min(LISTS, max(1, round(total**0.5))))
    # the sample is cut by hash before it is sorted
    share = min(1.0, 2 * SAMPLE / max(total, 1))
    rank = F.xxhash64(key, F.lit(7))
    some = held.where(rank <= min(2**63 - 1, int((2 * share - 1) * 2**63))).orderBy(rank, key).limit(SAMPLE).select(vector).toArrow().combine_chunks()
    v = dense._unit(dense._matrix(some.column(0).combine_chunks())) if some.num_rows else np.zeros((0, 0))
    if not len(v):
        return np.zeros((0, 0))
    rng = np.random.default_rng(len(v))
    c = v[rng.choice(len(v), min(lists, len(v)), replace=False)]
    for _ in range(ROUNDS):
        at = (v @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, v)
        full = np.bincount(at, minlength=len(c)) > 0
        c = np.where(full[:, None], dense._unit(sums), c)
    return c


def listed(rows: DataFrame, c: np.ndarray, key: str = "doc_id", vector: str = "vector") -> DataFrame:
    """(key, vector, list) of every row that has a vector."""
    kind = rows.schema[vector].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, dense.SLICE):
                part = batch.slice(at, dense.SLICE)
                near = (dense._unit(dense._matrix(part.column(1))) @ c.T).argmax(axis=1) if len(c) else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32))], [key, vector, "list"])

    return rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), vector).mapInArrow(run, f"{key} long, {vector} {kind}, list int")


def stored(spark: SparkSession, source: str, key: str, vector: str, rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(rows by list, centroids) of a Parquet table's vectors, made once and read until the source changes."""

    def number() -> DataFrame:
        c = centroids(rows, key=key, vector=vector)
        return spark.createDataFrame([(i, x) for i, x in enumerate(c.tolist())], "list int, centroid array<double>")

    held = index.kept(spark, f"ivf-centroids-{key}", source, number).orderBy("list").toArrow().combine_chunks()
    c = dense._matrix(held.column("centroid").combine_chunks()) if held.num_rows else np.zeros((0, 0))

    def build() -> DataFrame:
        # by range of list and key: a large list lies in several files
        return listed(rows, c, key, vector).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "list", key).sortWithinPartitions("list", key)

    return index.kept(spark, f"ivf-lists-{key}", source, build), c


def _probed(vectors: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """(questions, lists): whether a question meets a list."""
    near = np.argsort(-(vectors @ c.T), axis=1, kind="stable")[:, :probes]
    out = np.zeros((len(vectors), len(c)), bool)
    np.put_along_axis(out, near, True, axis=1)
    return out


def search(queries: DataFrame, lists: DataFrame, c: np.ndarray, k: int, probes: int, query: str = "query_id", key: str = "doc_id", vector: str = "vector") -> DataFrame:
    """(query, key, score, rank): k best by cosine of the rows in each question's ``probes`` nearest lists; ties by key."""
    wanted = queries.select(F.col(query).cast("long").alias("q"), F.col(vector).alias("v")).where("v IS NOT NULL AND q IS NOT NULL")
    blocks = max(1, -(-wanted.count() // dense.BLOCK))
    parts = []
    for block in range(blocks):
        some = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        table = some.toArrow().combine_chunks()
        ids = table.column("q").to_numpy()
        if not len(ids) or not len(c):
            continue
        vectors = dense._unit(dense._matrix(table.column("v").combine_chunks()))
        meets = _probed(vectors, c, probes)

        def run(batches, ids=ids, vectors=vectors, meets=meets):
            best_k, best_s = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for part in (batch.slice(at, dense.SLICE) for batch in batches for at in range(0, batch.num_rows, dense.SLICE)):
                at = part.column(2).to_numpy()
                who = np.flatnonzero(meets[:, np.unique(at)].any(axis=1))
                if not len(who):
                    continue
                s = np.round(vectors[who] @ dense._unit(dense._matrix(part.column(1))).T, 6) + 0.0
                s[~meets[np.ix_(who, at)]] = -np.inf
                keys = np.broadcast_to(part.column(0).to_numpy(), s.shape)
                both_k, both_s = np.full((len(ids), best_k.shape[1] + s.shape[1]), -1, np.int64), np.full((len(ids), best_s.shape[1] + s.shape[1]), -np.inf)
                both_k[:, : best_k.shape[1]], both_s[:, : best_s.shape[1]] = best_k, best_s
                both_k[who, best_k.shape[1] :], both_s[who, best_s.shape[1] :] = keys, s
                order = np.lexsort((both_k, -both_s), axis=1)[:, :k]
                best_k, best_s = np.take_along_axis(both_k, order, 1), np.take_along_axis(both_s, order, 1)
            row, col = np.nonzero(np.isfinite(best_s))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best_k[row, col]), pa.array(best_s[row, col])], [query, key, "score"])

        used = np.flatnonzero(meets.any(axis=0)).tolist()
        rows = lists.where(F.col("list").isin(used)) if len(used) < len(c) else lists
        parts.append(rows.select(key, vector, "list").mapInArrow(run, f"{query} long, {key} long, score double"))
    if not parts:
        return queries.sparkSession.createDataFrame([], f"{query} long, {key} long, score double, rank int")
    return sparse.top(reduce(DataFrame.union, parts), k, query, key)


def probes_for(queries: DataFrame, lists: DataFrame, c: np.ndarray, k: int, recall: float = RECALL, trial: int = TRIAL, query: str = "query_id", key: str = "doc_id", vector: str = "vector") -> tuple[int, float]:
    """(probes, recall): the fewest lists a question whose rows hold that share of the exact k best, over a trial of questions of least hash."""
    some = queries.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(query), query).limit(trial).select(F.col(query).cast("long").alias(query), vector)
    table = some.toArrow().combine_chunks()
    if not table.num_rows or not len(c):
        return max(1, len(c)), 1.0
    order = np.argsort(-(dense._unit(dense._matrix(table.column(1).combine_chunks())) @ c.T), axis=1, kind="stable")
    place = dict(zip(table.column(0).to_pylist(), np.argsort(order, axis=1)))  # question -> place of each list
    best = dense.search(some, lists, k, query, key, vector)
    hits = best.join(lists.select(key, "list"), key).select(query, "list").collect()  # trial x k rows
    places = np.sort([place[r[query]][r["list"]] for r in hits])
    at = max(0, int(np.ceil(recall * len(places))) - 1)
    probes = int(places[at]) + 1
    return probes, round(float((places < probes).mean()), 6)
