"""Operator 11: against a plain k-means over Python integers, and its bounds against full scans."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import centroids


def plain(rows, dims, clusters, rounds, scale=1024):
    """[(vec_id, cluster, distance)] and the final centroids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) <= centroids.LIMIT // scale for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cs = [v for _, v in sorted(kept, key=key)[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(cs)), key=lambda j: (far(v, cs[j]), j))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        for j in range(len(cs)):
            own = [v for (_, v), a in zip(kept, of) if a == j]
            cs[j] = [sum(x) // len(own) for x in zip(*own)] if own else cs[j]
    return sorted(((i, a := near(v), far(v, cs[a])) for i, v in kept), key=repr), cs


def sample(n, dims, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return [(i, [float(x) for x in centres[i % 6] + spread * rng.normal(size=dims)]) for i in range(n)]


@pytest.mark.parametrize("clusters, rounds, spread", [(8, 10, 0.3), (3, 4, 1.0), (12, 6, 0.05), (1, 2, 0.3), (5, 0, 0.3)])
def test_same_as_plain(spark, clusters, rounds, spread):
    rows = sample(150, 5, clusters, spread)
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # copies
    rows += [(7, rows[7][1]), (None, rows[8][1]), (2000, None), (2001, [1.0]), (2002, []), (2003, [1.0, None, 0.0, 0.0, 0.0]), (2004, [math.nan] * 5), (2005, [math.inf, 0.0, 0.0, 0.0, 0.0]), (2006, [1e30] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumn("a", F.lit("clash")).withColumn("v", F.lit(1))
    got, cs, done, far = centroids.cluster(df, clusters, rounds, dims=5)
    want, plain_cs = plain(rows, 5, clusters, rounds)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert cs.tolist() == plain_cs
    assert far == {a: sum(d for _, b, d in want if b == a) for a in {a for _, a, _ in want}}
    assert len(done) == rounds + 1 and all(sum(x.values()) == len(want) for x in done)


def test_bounds_save_distances(spark):
    df = spark.createDataFrame(sample(3000, 16, 5), "vec_id long, embedding array<double>")
    _, _, done, _ = centroids.cluster(df, 10, 8, dims=16)
    assert done[0]["rescanned"] == 3000
    assert sum(x["certified"] for x in done[1:]) > 0.5 * 3000 * 8
    assert sum(x["rescanned"] for x in done[1:]) < 0.2 * 3000 * 8


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([0, 2, 1, 1, 1, 0, 2])]
    got, _, _, _ = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 2, 3, dims=2)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 2, 2, 3)[0]


def test_fewer_vectors_than_centroids_and_none(spark):
    df = spark.createDataFrame(sample(3, 64, 1), "vec_id long, embedding array<double>")
    assert sorted(r.distance for r in centroids.report(df).collect()) == [0, 0, 0]
    none = centroids.report(df.limit(0))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0
