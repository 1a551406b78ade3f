"""Operator 3: SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within tau bits of one another are found over m partitions of the
64 bits. If thresholds t_1..t_m add up to tau - m + 1, then any such pair is
within t_i bits on some partition i (t_i = -1: partition i is not probed).

* Partitions are groups of correlated bits (one 64 x 64 matrix of bit counts,
  gathered from all fingerprints), so the others stay selective.
* m and the thresholds come from dynamic programming over estimated costs:
  candidates met plus probes sent. Estimates use the number of distinct
  fingerprints and each partition's collision mass; values that hold a large
  share of all fingerprints are known by name (at most HEAVY a partition), and
  a fingerprint that has one gets thresholds of its own, which steer round it.
* Each fingerprint sends the values within t_i of its own and meets the index
  rows of those values; the exact distance is checked in the join.

Copies are collapsed to distinct fingerprints first; a fingerprint has at most
43,744 others within 3 bits, so links don't grow with the square of a group.

Defined results: null and blank texts have fingerprint zero and link like any
other; a text of fewer words than a shingle is one shingle; repeated rows come
back once each; a null doc_id stands last among ids: a component of such rows
only has a null component_id; an empty table gives no rows; extra columns are
ignored. One text is held by one task.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import graph, packets, store, vec
from lodestone.llm.prefixes import COUNTER_BITS, Hot, counter, ranks, short

BITS = 64
SEED = 42
#: Values named for the thresholds of their own, at most, a partition.
HEAVY = 1000
_BLOCK = 4096


def _bits(values: np.ndarray) -> np.ndarray:
    """values as rows of 64 bits, bit 0 (the lowest) first."""
    return np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """SimHash of one UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start[:n].tolist(), end[k - 1 :].tolist())), np.uint64, n)
    total = np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        total += _bits(h[at : at + _BLOCK]).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long): the 64 bits as a signed number."""

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                values = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values)], ["doc_id", "fp"])

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(vec.lean(run), "doc_id long, fp long")


# -- the plan of the search ---------------------------------------------------


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, 64 x 64 counts of bits set together); one small row a task is gathered."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in vec.gathered(batches):
            values = batch.column(0).to_numpy(zero_copy_only=False)
            n += len(values)
            for at in range(0, len(values), 1 << 16):
                x = _bits(values[at : at + (1 << 16)]).astype(np.float32)
                total += x.T @ x
        flat = total.ravel().astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.append(flat, n))], ["k", "v"])

    rows = fps.select("fp").mapInArrow(vec.lean(run), "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        out[r["k"]] = r["v"]
    return int(out[-1]), out[:-1].reshape(BITS, BITS).astype(float)


def group_bits(n: int, counts: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of nearly equal width, filled greedily by correlation."""
    p = counts.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((counts / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for g in range(m):
        width = (BITS - sum(map(len, groups))) // (m - g)
        seed = max(left, key=lambda b: (corr[b, list(left)].sum(), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < width:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def ball(width: int, radius: int) -> int:
    """Values within radius of one value of so many bits."""
    out = term = 1
    for k in range(1, radius + 1):
        term = term * (width - k + 1) // k
        out += term
    return out if radius >= 0 else 0


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds >= -1 with the given sum and least cost, by dynamic programming.

    costs[i][t + 1] is the cost of threshold t on partition i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, picks) in best.items():
            for t, own in enumerate(cost, -1):
                if s + t not in step or c + own < step[s + t][0]:
                    step[s + t] = (c + own, [*picks, t])
        best = step
    return best[total]


#: Cost of a probe in candidates: a row sent through a shuffle against a comparison within the join.
PROBE_COST = 20.0


def _costs(width: int, n: int, mean: float, tau: int, own: float | None = None) -> list[float]:
    """Of thresholds -1..tau for one fingerprint: rows met plus probes sent.

    mean: rows that hold a random fingerprint's value; own: those of this one's.
    """
    out = [0.0]
    for t in range(tau + 1):
        probes = ball(width, t)
        met = (mean if own is None else own) + (probes - 1) * max(mean / 8, n / 2.0**width)
        out.append(probes * PROBE_COST + met if probes < 1e5 else float("inf"))
    return out


class Search:
    """How to probe: the groups, the usual thresholds, and those of heavy values."""

    def __init__(self, fps: DataFrame, tau: int) -> None:
        self.tau = tau
        n, counts = bit_counts(fps)
        self.n = n
        plans = []
        for m in range(1, tau + 3):
            groups = group_bits(n, counts, m)
            # mass of a value: what independent bits would give, from each bit's share
            p = counts.diagonal() / max(n, 1)
            same = p * p + (1 - p) * (1 - p)
            means = [max(1.0, n * float(np.prod(same[g]))) for g in groups]
            cost, picks = allocate([_costs(len(g), n, x, tau) for g, x in zip(groups, means)], tau - m + 1)
            plans.append((cost + m * PROBE_COST, m, groups, means, picks))
        _, self.m, self.groups, self.means, self.usual = min(plans, key=lambda x: (x[0], x[1]))

    def values(self, fps: np.ndarray) -> np.ndarray:
        """Value of each partition, bits packed to its low end: shape (n, m)."""
        bits = _bits(fps)
        packed = [np.packbits(np.pad(bits[:, g], ((0, 0), (0, BITS - len(g)))), axis=1, bitorder="little") for g in self.groups]
        return np.stack([np.ascontiguousarray(x).view("<u8")[:, 0] for x in packed], 1)

    def masks(self, i: int, radius: int) -> np.ndarray:
        """What to xor a value of partition i with, to get every value within radius."""
        width = len(self.groups[i])
        out = last = np.zeros(1, np.uint64)
        top = np.full(1, -1)
        for _ in range(radius):
            grown = [(m | np.uint64(1 << b), b) for m, t in zip(last.tolist(), top.tolist()) for b in range(t + 1, width)]
            last = np.array([int(g[0]) for g in grown], np.uint64)
            top = np.array([g[1] for g in grown])
            out = np.concatenate((out, last))
        return out

    def thresholds(self, own: dict[tuple[int, int], int], values: np.ndarray) -> np.ndarray:
        """(n, m) thresholds; rows with a heavy value get their own by dynamic programming."""
        out = np.tile(np.array(self.usual), (len(values), 1))
        heavy = np.zeros(values.shape, np.int64)
        for i in range(self.m):
            names = np.array(sorted(v for p, v in own if p == i), np.uint64)
            if len(names):
                at = np.minimum(np.searchsorted(names, values[:, i]), len(names) - 1)
                held = np.array([own[i, int(v)] for v in names.tolist()])
                heavy[:, i] = np.where(names[at] == values[:, i], held[at], 0)
        rows = np.flatnonzero(heavy.any(1))
        seen: dict[tuple, list[int]] = {}
        for r, key in zip(rows.tolist(), map(tuple, heavy[rows].tolist())):
            if key not in seen:
                costs = [_costs(len(g), self.n, x, self.tau, max(x, h)) for g, x, h in zip(self.groups, self.means, key)]
                seen[key] = allocate(costs, self.tau - self.m + 1)[1]
            out[r] = seen[key]
        return out


def _heavy(index: DataFrame, search: Search) -> dict[tuple[int, int], int]:
    """(partition, value) -> rows, of values that hold over 1/HEAVY of all fingerprints: at most HEAVY a partition."""
    least = max(200, search.n // HEAVY)
    rows = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).collect()
    return {(r["part"], r["value"] & (2**64 - 1)): r["n"] for r in rows}


def near_pairs(fps: DataFrame, tau: int = 3) -> DataFrame:
    """(a, b) with a < b: every pair of the distinct fingerprints fp within tau bits."""
    search = Search(fps, tau)

    def rows_of(batches, probe: bool, own=None):
        for batch in vec.gathered(batches):
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            values = search.values(fp)
            limits = search.thresholds(own, values) if probe else None
            for i in range(search.m):
                for t in sorted(set(limits[:, i].tolist())) if probe else [0]:
                    if t < 0:
                        continue
                    rows = np.flatnonzero(limits[:, i] == t) if probe else np.arange(len(fp))
                    flips = search.masks(i, t)
                    each = max(1, 200_000 // len(flips))
                    for at in range(0, len(rows), each):
                        some = rows[at : at + each]
                        sent = (values[some, i][:, None] ^ flips[None, :]).ravel()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(sent), i, np.int32)), pa.array(sent.view(np.int64)), pa.array(np.repeat(fp[some], len(flips)))], ["part", "value", "fp"]
                        )

    schema = "part int, value long, fp long"
    index = fps.select("fp").mapInArrow(lambda batches: rows_of(batches, False), schema)
    own = _heavy(index, search)
    probes = fps.select("fp").mapInArrow(lambda batches: rows_of(batches, True, own), schema)
    left, right = probes.alias("p"), index.alias("x")
    near = (F.col("p.part") == F.col("x.part")) & (F.col("p.value") == F.col("x.value"))
    within = (F.col("p.fp") != F.col("x.fp")) & (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("x.fp"))) <= tau)
    return left.join(right, near & within).select(F.least("p.fp", "x.fp").alias("a"), F.greatest("p.fp", "x.fp").alias("b")).distinct()


def group_near(docs: DataFrame, shingle: int = 3, tau: int = 3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, links): every document, its least reachable doc_id, and how many other fingerprints its own links to."""
    rows = store.settled(fingerprints(docs, shingle, id_column, text), "fingerprints")
    classes = store.settled(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    pairs = store.settled(near_pairs(classes, tau), "near")
    nodes = graph.components(pairs, "a", "b")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    of = classes.join(nodes, classes["fp"] == nodes["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(roots, "root").select("fp", "component_id").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    # written first: a join of two tables may split the rows of a fingerprint that is everywhere
    named = store.settled(named, "named-fingerprints")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "links")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id, links."""
    rows = group_near(docs)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


# -- near copies: fingerprints first, shingle sets decide ---------------------------

SHINGLE = 5
SIMILARITY = 0.8
#: Earlier rows of a shingle's list that each row is compared with before groups are known.
PROBES = 4
#: Bits of the table of texts to compare.
TABLE_BITS = 22


def _runs(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of so many words (ASCII case folded), rows ascending; a shorter text is one run."""
    body, offsets = vec.flat(column)
    starts, ends = vec.words(body, offsets)
    h = vec.hash_spans(body, starts, ends, folded=True)
    row = vec.rows_of(starts, offsets)
    count = np.bincount(row, minlength=len(column))
    runs = np.where(count, np.maximum(count - shingle + 1, 1), 0)
    at = np.repeat(np.cumsum(count) - count, runs) + vec.grouped_arange(runs)
    row = np.repeat(np.arange(len(column)), runs)
    out = np.zeros(len(at), np.uint64)
    for i in range(shingle):
        held = np.flatnonzero(count[row] > i)
        out[held] = vec.mix(out[held] + h[at[held] + i] * np.uint64(2 * i + 1))
    return out, row


def _ranks(docs: DataFrame, shingle: int, text: str) -> np.ndarray:
    """Place of each counter of shingles, rarest first."""

    def counters(batch):
        for part in vec.slices(batch, "text"):
            yield counter(short(_runs(part.column(0), shingle)[0]))

    return ranks(packets.totals(docs.select(docs[text].alias("text")), counters, COUNTER_BITS))


def _ordered_sets(column: pa.Array, shingle: int, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, sid, n): each row's different shingles, rarest first (without ranks: ascending), a hash of the set, and its size; 0 and 0 without words."""
    run, row = _runs(column, shingle)
    key = row.astype(np.uint64)
    if rank is not None:
        key = (key << np.uint64(COUNTER_BITS)) | rank[counter(short(run))]
    order = np.lexsort((run, key))
    run, row = run[order], row[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1])
    run, row = run[new], row[new]
    n = np.bincount(row, minlength=len(column))
    sid = np.zeros(len(column), np.uint64)
    if len(run):
        held = np.flatnonzero(n)
        sid[held] = vec.mix(np.add.reduceat(vec.mix(run), (np.cumsum(n) - n)[held]) + n[held].astype(np.uint64))
    return run, sid, n


def _texts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    doc, text_hash = store.doc_key(id_column, text)
    return docs.select(doc.alias("doc"), text_hash.alias("hash"), docs[text].alias("text"))


def _sets(docs: DataFrame, p: int, q: int, shingle: int, id_column: str, text: str) -> DataFrame:
    """(doc, hash, sid, n, prefix, fp): of every document its set of shingles, so many of the rarest that sets of Jaccard >= p/q share one, and its fingerprint."""
    rank = _ranks(docs, shingle, text)

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                found, sid, n = _ordered_sets(part.column(2), shingle, rank)
                sent = np.where(n, n - (n * p + q - 1) // q + 1, 0)
                at = np.repeat(np.cumsum(n) - n, sent) + vec.grouped_arange(sent)
                prefix = vec.lists(pa.array(short(found[at]).view(np.int32)), sent)
                texts = part.column(2).cast(pa.large_binary()).to_pylist()
                fp = np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64)
                cols = [part.column(0), part.column(1), pa.array(sid.view(np.int64)), pa.array(n.astype(np.int32)), prefix, pa.array(fp)]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "hash", "sid", "n", "prefix", "fp"])

    return _texts(docs, id_column, text).mapInArrow(vec.lean(run), "doc long, hash long, sid long, n int, prefix array<int>, fp long")


def _near_sets(rows: DataFrame, tau: int) -> DataFrame:
    """(a, b): sets to compare by their documents' fingerprints.

    The first set of each fingerprint meets those of two others within tau bits, the
    least and the nearest of the lesser ones; a fingerprint's other sets meet its first.
    So comparisons follow the number of sets, however large a group is.
    """
    held = store.settled(rows.select("sid", "fp").distinct(), "fingerprinted-sets")
    firsts = store.settled(held.groupBy("fp").agg(F.min("sid").alias("first")), "fingerprints")
    near = near_pairs(firsts, tau).groupBy("b").agg(F.min("a").alias("least"), F.min(F.struct(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("bits"), "a")).alias("nearest"))
    near = near.select("b", F.explode(F.array_distinct(F.array("least", "nearest.a"))).alias("a"))
    across = near.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    within = held.join(firsts, "fp").select(F.col("sid").alias("x"), F.col("first").alias("y"))
    return across.select("x", "y").union(within).where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Those pairs (a, b) that are not in one group already."""
    of_a = groups.select(F.col("node").alias("a"), F.col("component").alias("ga"))
    of_b = groups.select(F.col("node").alias("b"), F.col("component").alias("gb"))
    return pairs.join(of_a, "a", "left").join(of_b, "b", "left").where(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("a", "b")


def _sent(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, how many of each row) of a column of prefixes."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint32), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs_of(cols: list[np.ndarray], p: int, q: int, most: int):
    """(a, b, word) within the lists of cols (word, n, pos, sid): sets that may be similar.

    Within a word's list, by size, each row meets the earlier ones, up to ``most`` that
    pass the filters of length and position; a list where that leaves some out comes
    as (null, null, word).
    """
    order = np.lexsort((cols[3], cols[1], cols[0]))
    word, n, pos, sid = (c[order] for c in cols)
    n, pos, sid = n.astype(np.int64), pos.astype(np.int64), sid.view(np.int64)
    begin = np.concatenate(([True], word[1:] != word[:-1]))
    at_begin = np.maximum.accumulate(np.where(begin, np.arange(len(word)), 0))
    found = np.zeros(len(word), np.int64)
    live, lag, size, a_out, b_out, cut = np.flatnonzero(~begin), 1, 0, [], [], []
    while True:
        live = live[live - lag >= at_begin[live]]
        live = live[q * n[live - lag] >= p * n[live]]
        full = found[live] >= most
        cut.append(word[live[full]])
        live = live[~full]
        if len(live):
            a = live - lag
            need = (p * (n[a] + n[live]) + p + q - 1) // (p + q)
            b = live[np.minimum(n[a] - pos[a], n[live] - pos[live]) >= need]
            found[b] += 1
            a_out.append(np.minimum(sid[b - lag], sid[b]))
            b_out.append(np.maximum(sid[b - lag], sid[b]))
            size += len(b)
        if size and (size > 200_000 or not len(live)):
            both = np.unique(np.stack((np.concatenate(a_out), np.concatenate(b_out)), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64())], ["a", "b", "word"])
            size, a_out, b_out = 0, [], []
        if not len(live):
            break
        lag += 1
    words = np.unique(np.concatenate(cut))
    if len(words):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.nulls(len(words), pa.int64()), pa.array(words.astype(np.int64))], ["a", "b", "word"])


def _first_met(classes: DataFrame, p: int, q: int, hot: Hot, rows: int) -> DataFrame:
    """(a, b, word) of ``_pairs_of`` for all prefixes. A hot word's sets are dealt into lists, and the word comes as one that left some out."""
    buckets = packets.buckets_for(classes.sparkSession, rows)
    most = PROBES

    def blocks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                word, count = _sent(part.column(2))
                row, pos = np.repeat(np.arange(part.num_rows), count), vec.grouped_arange(count)
                sid, n = (part.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
                lists = hot.of(word)
                # the list's number makes two keys of one word differ; 0 where it has one list
                chosen = np.where(lists > 1, 1 + vec.mix(sid.view(np.uint64)) % lists.astype(np.uint64), 0)
                yield [(word.astype(np.uint64) << np.uint64(32)) | chosen.astype(np.uint64), n, pos.astype(np.int32), sid.view(np.uint64)]

    def send(batches):
        return packets.dealt(blocks(batches), buckets)

    def meet(batches):
        for cols in packets.opened(batches, ["<u8", "<i4", "<i4", "<u8"]):
            yield from _pairs_of(cols, p, q, most)
            words = cols[0][(cols[0] & np.uint64(0xFFFFFFFF)) != 0]
            if len(words):
                words = np.unique(words)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.nulls(len(words), pa.int64()), pa.array(words.view(np.int64))], ["a", "b", "word"])

    index = classes.select("sid", "n", "prefix").mapInArrow(vec.lean(send), packets.SCHEMA)
    return packets.shuffled(index).mapInArrow(vec.lean(meet), "a long, b long, word long").withColumn("word", F.shiftright("word", 32).cast("int")).distinct()


def _similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, p: int, q: int, shingle: int, id_column: str, text: str) -> DataFrame:
    """Those pairs (a, b) of sets whose Jaccard similarity is p/q at least."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = store.settled(classes.select("sid", "doc", "hash").join(wanted, "sid", "left_semi").select("sid", F.xxhash64("doc", "hash").alias("row")), "candidate-documents")
    # texts never move: a bit table, which only errs by letting more pass, turns most others away where they lie
    held = wanted.select(F.shiftrightunsigned("row", 64 - TABLE_BITS).alias("k")).distinct().toArrow().column(0).to_numpy()
    table = np.packbits(np.isin(np.arange(1 << TABLE_BITS), held))

    def sets(batches):
        bits = np.unpackbits(table).astype(bool)
        for batch in batches:
            row = batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - TABLE_BITS)
            some = batch.filter(pa.array(bits[row.astype(np.int64)]))
            for part in vec.slices(some, "text"):
                found, sid, n = _ordered_sets(part.column(0), shingle, None)
                yield pa.RecordBatch.from_arrays([pa.array(sid.view(np.int64)), vec.lists(pa.array(found.view(np.int64)), n), part.column(1)], ["sid", "s", "row"])

    texts = _texts(docs, id_column, text).select("text", F.xxhash64("doc", "hash").alias("row"))
    found = texts.mapInArrow(vec.lean(sets), "sid long, s array<long>, row long").join(wanted, ["sid", "row"], "left_semi").drop("row")
    shingles = store.settled(found.dropDuplicates(["sid"]), "candidate-shingles")
    both = pairs.join(shingles.select(F.col("sid").alias("a"), F.col("s").alias("sa")), "a").join(shingles.select(F.col("sid").alias("b"), F.col("s").alias("sb")), "b")
    met = both.withColumn("c", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return store.settled(met.where(q * F.col("c") >= p * (F.size("sa") + F.size("sb") - F.col("c"))).select("a", "b"), "similar-texts")


def _across_groups(index: DataFrame, words: DataFrame, roots: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b): under the given words, all sets of different groups that may be similar.

    In each word's list the rows outside its largest group meet all rows of other
    groups, in a join that may split a hot word; a list of one group has none to meet.
    """
    held = store.settled(index.join(words, "word", "left_semi").join(roots, "sid"), "open-lists")
    size = held.groupBy("word", "root").agg(F.count(F.lit(1)).alias("k"))
    largest = size.groupBy("word").agg(F.max(F.struct("k", "root")).alias("m"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("word", F.col("m.root").alias("m"))
    asked = held.join(largest, "word").where("root != m").drop("m").alias("x")
    y = held.alias("y")
    need = F.expr(f"({p}L * (x.n + y.n) + {p + q - 1}L) div {p + q}L")
    near = (
        (F.col("x.word") == F.col("y.word"))
        & (F.col("x.root") != F.col("y.root"))
        & (q * F.least("x.n", "y.n") >= p * F.greatest("x.n", "y.n"))
        & (F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= need)
    )
    return asked.join(y, near).select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_column: str = "doc_id", text: str = "text", tau: int = 3) -> DataFrame:
    """(doc, hash, least): every document but the first of its group; least is the least doc_id of the group. doc and hash as store.doc_key gives them.

    Texts of equal shingle sets are one class. Two classes are linked if their sets'
    Jaccard similarity is ``similarity`` at least; groups are the components of all
    links. Fingerprints within ``tau`` bits (``near_pairs``) give the first groups,
    each link checked by Jaccard. Similar sets whose fingerprints differ in more bits
    are found exactly: they share one of their rarest shingles (prefix filter). In long
    lists each set first meets PROBES others, then, in the lists that this left open,
    all those of other groups; only pairs that are in one group already are left out.
    """
    p, q = Fraction(str(similarity)).as_integer_ratio()
    with store.scratch(docs.sparkSession):
        rows = store.settled(_sets(docs, p, q, shingle, id_column, text), "shingle-sets")
        classes = store.settled(rows.groupBy("sid").agg(F.min(F.struct("doc", "hash", "n", "prefix")).alias("f")).select("sid", "f.*"), "set-classes")

        def counters(batch):
            yield counter(_sent(batch.column(0))[0])

        links = _similar(store.settled(_near_sets(rows, tau), "near-sets"), classes, docs, p, q, shingle, id_column, text)
        groups = graph.components(links, "a", "b")
        counts = packets.totals(classes.select("prefix"), counters, COUNTER_BITS)
        met = store.settled(_first_met(classes, p, q, Hot(counts), int(counts.sum())), "candidate-sets")
        others = store.settled(_apart(met.where("a IS NOT NULL").select("a", "b"), groups), "sets-apart")
        links = links.union(_similar(others, classes, docs, p, q, shingle, id_column, text))
        groups = graph.components(links, "a", "b")
        open_ = met.where("a IS NULL").select("word").distinct()
        if not open_.isEmpty():
            roots = store.settled(classes.select("sid").join(groups, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("component", "sid").alias("root")), "set-roots")
            index = classes.select("sid", "n", F.posexplode("prefix").alias("pos", "word"))
            rest = store.settled(_across_groups(index, open_, roots, p, q), "further-sets")
            links = links.union(_similar(rest, classes, docs, p, q, shingle, id_column, text))
            groups = graph.components(links, "a", "b")
        of = classes.select("sid", "doc", "hash").join(groups, F.col("sid") == F.col("node"), "left").select("sid", "doc", "hash", F.coalesce("component", "sid").alias("root"))
        of = store.settled(of, "grouped-sets")
        # written first: a join of two tables may split the rows of a text that is everywhere
        first = of.groupBy("root").agg(F.min(F.struct("doc", "hash")).alias("f"))
        named = store.settled(of.join(first, "root").select("sid", F.col("f.doc").alias("least"), F.col("f.hash").alias("least_hash")), "named-sets")
        gone = rows.select("doc", "hash", "sid").join(named, "sid").where("doc != least OR hash != least_hash")
        return store.settled(gone.select("doc", "hash", "least").distinct(), "near-copies", outlives=True)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of near copies: the one of least (doc_id, text hash).

    Rows that agree in doc_id and text are one document and stay or go together.
    """
    gone = near_copies(docs, similarity)
    doc, text_hash = store.doc_key()
    # by sorting at every size: what is broadcast would grow with the documents
    return docs.join(gone.hint("merge"), (doc == gone["doc"]) & (text_hash == gone["hash"]), "left_anti").select(*store.own(docs))
