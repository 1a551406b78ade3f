"""The inverted file against brute force, the scan against postings, and searches of stored postings that score allowed rows only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import answer, dense, ivf, retrieve, sparse
from lodestone.plans import inputs, retrieval_queries
from lodestone.session import table
from tests.conftest import SF


def vectors(spark, n, seed, groups=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, 16))
    v = centre[np.minimum(rng.integers(0, groups * 2, n), groups - 1)] + 0.4 * rng.normal(size=(n, 16))  # half lie in one group
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "doc_id long, vector array<double>")


def sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, set()).add((r.doc_id, r.score))
    return out


def test_every_row_is_listed_and_all_probes_are_exact(spark):
    rows = vectors(spark, 900, 1).unionByName(spark.createDataFrame([(5000, None), (5001, [0.0] * 16)], "doc_id long, vector array<double>"))
    c = ivf.centroids(rows)
    lists = ivf.listed(rows, c)
    assert lists.count() == 901 and lists.select("list").distinct().count() > 5
    q = rows.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    assert sets(ivf.search(q, lists, c, 10, len(c))) == sets(dense.search(q, rows, 10))


def test_recall_is_what_was_measured(spark):
    rows = vectors(spark, 2000, 2)
    c = ivf.centroids(rows)
    lists = ivf.listed(rows, c).persist()
    q = rows.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    probes, recall = ivf.probes_for(q, lists, c, 10, recall=0.9)
    assert probes < len(c) and recall >= 0.9
    got, want = sets(ivf.search(q, lists, c, 10, probes)), sets(dense.search(q, rows, 10))
    hit = sum(len(got[i] & w) for i, w in want.items()) / sum(map(len, want.values()))
    assert hit == pytest.approx(recall, abs=1e-6)
    # fewer lists hold fewer of them
    one = sets(ivf.search(q, lists, c, 10, 1))
    assert sum(len(one[i] & w) for i, w in want.items()) < hit * sum(map(len, want.values()))
    lists.unpersist()


def test_query_against_brute_force(spark):
    got = retrieval_queries.dense_ivf(spark, SF).collect()
    want = sets(retrieval_queries.dense_topk(spark, SF))
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add((r.doc_id, r.score))
    assert set(found) == set(want)
    hit = sum(len(found[i] & w) for i, w in want.items()) / sum(map(len, want.values()))
    assert hit >= 0.9 and got[0].recall >= 0.9 and got[0].probes >= 1


def test_empty_tables(spark):
    rows = vectors(spark, 3, 3)
    c = ivf.centroids(rows.limit(0))
    lists = ivf.listed(rows.limit(0), c)
    q = rows.withColumnRenamed("doc_id", "query_id")
    assert ivf.probes_for(q, lists, c, 5) == (1, 1.0)
    assert ivf.search(q, lists, c, 5, 1).count() == 0
    c = ivf.centroids(rows)
    assert ivf.search(q.limit(0), ivf.listed(rows, c), c, 5, 1).count() == 0


def test_hidden_rows_are_not_scored(spark):
    """Below the sums of the scores stands the join with what may be seen."""
    postings = retrieval_queries._postings(spark, SF)
    docs = inputs.documents(spark, SF)
    q = table(spark, SF, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    seen = docs.where(retrieve.visible("u7", "u7@x"))
    plan = sparse.search(q, seen, 5, postings=postings)._jdf.queryExecution().optimizedPlan().toString()
    joins, sums = plan.index("LeftSemi"), plan.index("sum((_qw")
    assert sums < joins
    got = {(r.query_id, r.doc_id, r.score) for r in sparse.search(q, seen, 5, postings=postings).collect()}
    assert got == {(r.query_id, r.doc_id, r.score) for r in sparse.search(q, seen, 5).collect()}
    whole = lambda d: {(r.query_id, r.doc_id, r.score) for r in sparse.search(q, d, 5, postings=postings).collect()}
    assert whole(None) == whole(docs)


def test_coverage_from_postings_is_that_from_texts(spark):
    q = table(spark, SF, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, SF, "documents")
    hits = sparse.search(q, docs, 5)
    rows = lambda **how: sorted((r.query_id, r.doc_id, r.coverage) for r in answer.coverage(hits, q, docs, **how).collect())
    assert rows() == rows(postings=retrieval_queries._postings(spark, SF))
    short = rows(chars=200)
    assert len(short) == len(rows()) and sum(c for *_, c in short) < sum(c for *_, c in rows())


def test_scan_is_the_join_by_term(spark, monkeypatch):
    """Blocks, batches and tasks of a few rows give what postings that meet by term give; no posting is shuffled."""
    monkeypatch.setattr(sparse, "BLOCK", 7)
    monkeypatch.setattr(sparse, "ROWS", 5)
    q = table(spark, SF, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    q = q.unionByName(spark.createDataFrame([(-1, None), (-2, "the a"), (-3, "nowherefound")], "query_id long, text string"))
    docs = table(spark, SF, "documents").unionByName(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", None, None, None)], table(spark, SF, "documents").schema))
    rows = lambda df: sorted((r.query_id, r.doc_id, r.score, r.rank) for r in df.collect())
    got = sparse.search(q, docs.repartition(3), 5)
    assert rows(got) == rows(sparse.search(q, docs, 5, postings=sparse.weights(docs)))
    assert got.columns == ["query_id", "doc_id", "score", "rank"] and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sparse.search(q, docs.limit(0), 5).count() == 0 and sparse.search(q.limit(0), docs, 5).count() == 0


def test_dense_tiles_keep_ties_by_key(spark, monkeypatch):
    """Many rows of one score, over several tiles and batches; a tile's scores are all that grows with a batch."""
    monkeypatch.setattr(dense, "TILE", 3)
    monkeypatch.setattr(dense, "SLICE", 4)
    rows = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(40, 0, -1)], "doc_id long, vector array<double>").repartition(3)
    q = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(10)], "query_id long, vector array<double>")
    got = {}
    for r in dense.search(q, rows, 6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    for i in range(10):
        assert sorted(got[i]) == [(n + 1, 2 * n + (1 if i % 2 else 2), 1.0) for n in range(6)]
    assert dense.search(q, rows.limit(4), 6).count() == 40
