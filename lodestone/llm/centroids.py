"""Operator 11: exact k-means over integer vectors with Drake's adaptive bounds.

Every vector carries its centroid, an upper bound of the distance to it, lower
bounds for its ``NEAR`` next nearest centroids, and one remainder bound for all
others. When centroids move, the bounds move with them; a vector whose upper
bound lies below all lower ones keeps its centroid without a distance being
taken. Else its own distance is taken, then those to the bounded centroids, and
only if the remainder bound cannot rule the others out, all of them. Distances
are exact integers, so the bounds save work and never decide a tie.

A round is one pass over the vectors, without a shuffle: each task writes its
vectors with their new bounds and, as its last rows, the sums of its clusters;
these few rows are added up and give the next centroids (k x components numbers
on the driver). Rounds are written below the shared folder, two at a time, so a
lost executor costs its tasks of one round.

Defined results: vectors of another length, with a null, non-finite or, beyond
``LIMIT``, too large a component (whose distances would not fit into a long) are
left out; repeated rows are vectors of their own; a null id's vector is clustered
too, and is a first centroid only where fewer ids are known than centroids asked
for; fewer vectors than centroids: one centroid a vector; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import store, vec

log = logging.getLogger(__name__)

DIMS, SCALE, CLUSTERS, ROUNDS, SALT = 64, 1024, 8, 10, "3"
#: Lower bounds kept one by one.
NEAR = 3
#: Largest size of an integer component: 64 squared differences fit into a long.
LIMIT = 1 << 26
#: Slack of a comparison of bounds, against rounding: absolute, and by size.
_SLACK, _SHARE = 1e-6, 1e-9
#: What a pass did with its vectors, by how far it had to go.
STEPS = ("certified", "own_distance", "reordered", "rescanned")

_ROWS = "vec_id long, v array<int>, a int, d long, u double, near array<int>, low array<double>, rest double, n long, sums array<long>"


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * component) of the vectors that are kept."""
    x = vectors[column]
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) > LIMIT // scale)
    kept = vectors.where((F.size(x) == dims) & ~F.exists(x, bad))
    return kept.select(vectors[id_column].cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v"))


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x (n, dims) to rows of c (n or 1, dims), exact."""
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


class Bounds:
    """State of a run of vectors: centroid, squared distance, and bounds."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.a = np.zeros(len(x), np.int32)
        self.d = np.zeros(len(x), np.int64)
        self.u = np.zeros(len(x))
        self.near = self.low = self.rest = None

    def scan(self, rows: np.ndarray, c: np.ndarray) -> None:
        """All distances of the given rows, and bounds made from them."""
        k, b = len(c), min(NEAR, len(c) - 1)
        d = np.stack([_squared(self.x[rows], c[j : j + 1]) for j in range(k)], axis=1)
        order = np.argsort(d, axis=1, kind="stable")  # ties: the smaller number first
        d = np.take_along_axis(d, order, axis=1)
        if self.near is None:
            self.near, self.low, self.rest = np.zeros((len(self.x), b), np.int32), np.zeros((len(self.x), b)), np.full(len(self.x), np.inf)
        self.a[rows], self.d[rows], self.u[rows] = order[:, 0], d[:, 0], np.sqrt(d[:, 0])
        self.near[rows], self.low[rows] = order[:, 1 : b + 1], np.sqrt(d[:, 1 : b + 1])
        if k > b + 1:
            self.rest[rows] = np.sqrt(d[:, b + 1])

    def follow(self, c: np.ndarray, drift: np.ndarray) -> list[int]:
        """Moves the bounds by the centroids' drift and mends what they cannot certify; counts by STEPS."""
        self.u += drift[self.a]
        self.low -= drift[self.near]
        self.rest -= drift.max()
        least = np.minimum(self.low.min(axis=1, initial=np.inf), self.rest)
        open_ = np.flatnonzero(~_below(self.u, least))
        done = [len(self.x) - len(open_)]
        self.d[open_] = _squared(self.x[open_], c[self.a[open_]])
        self.u[open_] = np.sqrt(self.d[open_])
        left = open_[~_below(self.u[open_], least[open_])]
        done.append(len(open_) - len(left))
        # the bounded centroids and the own one, exactly and in order
        ids = np.sort(np.concatenate([self.a[left, None], self.near[left]], axis=1), axis=1)
        d = np.stack([_squared(self.x[left], c[ids[:, j]]) for j in range(ids.shape[1])], axis=1) if len(left) else np.zeros((0, ids.shape[1]), np.int64)
        order = np.argsort(d, axis=1, kind="stable")
        ids, d = np.take_along_axis(ids, order, axis=1), np.take_along_axis(d, order, axis=1)
        sure = _below(np.sqrt(d[:, 0]), self.rest[left])
        rows = left[sure]
        self.a[rows], self.d[rows], self.u[rows] = ids[sure, 0], d[sure, 0], np.sqrt(d[sure, 0])
        self.near[rows], self.low[rows] = ids[sure, 1:], np.sqrt(d[sure, 1:])
        done.append(len(rows))
        rows = left[~sure]
        if len(rows):
            self.scan(rows, c)
        return [*done, len(rows)]


def _below(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Whether upper lies below lower by more than rounding can amount to."""
    finite = np.where(np.isfinite(lower), np.abs(lower), 0)
    return upper + _SLACK + _SHARE * (upper + finite) < lower


def _pass(rows: DataFrame, c: np.ndarray, drift: np.ndarray | None, last: bool) -> DataFrame:
    """One round's rows: vectors with their state, then the sums of each task's clusters (a -1: counts by STEPS)."""
    dims = c.shape[1]
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("a", pa.int32()), ("d", pa.int64()), ("u", pa.float64()), ("near", pa.list_(pa.int32())), ("low", pa.list_(pa.float64())), ("rest", pa.float64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        count, total, far, steps = np.zeros(len(c), np.int64), np.zeros((len(c), dims), np.int64), [0] * len(c), np.zeros(len(STEPS), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            wide = lambda name, dtype: batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(n, -1)
            s = Bounds(wide("v", np.int64))
            if drift is None:
                s.scan(np.arange(n), c)
                steps[-1] += n
            else:
                s.a, s.d, s.u, s.rest = (batch.column(x).to_numpy(zero_copy_only=False).copy() for x in ("a", "d", "u", "rest"))
                b = min(NEAR, len(c) - 1)
                s.near, s.low = wide("near", np.int32).reshape(n, b), wide("low", np.float64).reshape(n, b)
                steps += s.follow(c, drift)
            if last:
                s.d = _squared(s.x, c[s.a])
                for j in range(len(c)):
                    far[j] += sum(s.d[s.a == j].tolist())
            count += np.bincount(s.a, minlength=len(c))
            for j in np.unique(s.a):
                total[j] += s.x[s.a == j].sum(axis=0)
            none = lambda t: pa.nulls(n, t)
            b = np.full(n, s.near.shape[1])
            cols = [batch.column("vec_id"), batch.column("v"), pa.array(s.a), pa.array(s.d), pa.array(s.u), vec.lists(pa.array(s.near.ravel()), b), vec.lists(pa.array(s.low.ravel()), b), pa.array(s.rest), none(pa.int64()), none(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)
        held = np.flatnonzero(count).tolist()
        sums = [{"a": j, "n": int(count[j]), "sums": [far[j]] if last else total[j].tolist()} for j in held] + [{"a": -1, "n": int(count.sum()), "sums": steps.tolist()}]
        if held:
            yield pa.RecordBatch.from_pylist(sums, schema=schema)

    return rows.mapInArrow(vec.lean(run), _ROWS)


def _totals(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (count, sums) over all tasks."""
    each = rows.where("n IS NOT NULL").select("a", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("sums").alias("at", "x"))
    found: dict[int, tuple[int, dict[int, int]]] = {}
    for r in each.groupBy("a", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        found.setdefault(r.a, (int(r.n), {}))[1][r.at] = int(r.x)
    return {a: (n, [x[i] for i in range(len(x))]) for a, (n, x) in found.items()}


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, salt: str = SALT) -> np.ndarray:
    """The vectors of least sha256 of salt:id; equal ids by their components."""
    by = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    found = rows.orderBy(by.asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r.v for r in found], np.int64)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, np.ndarray, list[dict[str, int]], dict[int, int]]:
    """(rows of vec_id, a and d; final centroids; how far each pass had to go; squared distance summed by cluster)."""
    spark = vectors.sparkSession
    rows, old = store.written(integers(vectors, dims, scale, id_column, column), "vectors")
    c, drift, done = first_centroids(rows, clusters, salt), None, []
    if not len(c):
        store.discard(spark, old)
        return spark.createDataFrame([], "vec_id long, a int, d long"), c, done, {}
    for turn in range(rounds + 1):
        last = turn == rounds
        new, path = store.written(_pass(rows, c, drift, last), f"centroids-{turn}")
        store.discard(spark, old)
        totals = _totals(new)
        done.append(dict(zip(STEPS, totals.pop(-1)[1])))
        log.info("pass %d of %d: %s", turn, rounds, done[-1])
        if last:
            break
        moved = c.copy()
        for a, (n, x) in totals.items():
            moved[a] = [s // n for s in x]
        drift = np.sqrt(_squared(moved, c).astype(np.float64)) * (1 + 1e-12)
        rows, old, c = new.where("n IS NULL").drop("n", "sums"), path, moved
    return new.where("n IS NULL").select("vec_id", "a", "d"), c, done, {a: x[0] for a, (_, x) in totals.items()}


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    rows, c, _, far = cluster(vectors)
    digests = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    of = lambda values, t: F.get(F.array(*[F.lit(x).cast(t) for x in values]), F.col("a")) if values else F.lit(None).cast(t)
    return rows.select(
        "vec_id", F.col("a").alias("cluster"), F.col("d").alias("distance"),
        of([far.get(a, 0) for a in range(len(c))], "long").alias("cluster_inertia"), F.lit(sum(far.values())).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"),
    )


def _oracle() -> str:
    """DuckDB's twin: every round scans every centroid."""
    gap = "list_sum(list_transform(list_zip(k.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) > {LIMIT // SCALE})) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id), v) - 1 AS c, v FROM k ORDER BY 1 LIMIT {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT k.r, arg_min(c{i}.c, ({gap.format(i=i)}, c{i}.c)) AS a, min({gap.format(i=i)}) AS d FROM k, c{i} GROUP BY k.r)")
        if i < ROUNDS:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT a, list(x ORDER BY p) AS v FROM (
                  SELECT a, p, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT a, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i} JOIN k USING (r)) GROUP BY a, p) GROUP BY a) m ON m.a = c{i}.c)"""
            )
    return f"""WITH {", ".join(parts)}
SELECT k.vec_id, a::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN k USING (r) JOIN c{ROUNDS} ON c{ROUNDS}.c = a"""


ORACLE_SQL = _oracle()
