"""Rows of fixed-width numpy columns, shuffled as packed blocks instead of one by one.

A task sorts its rows by bucket and sends one packet a bucket and flush, so the
JVM moves a few large binaries where it would sort and convert millions of small
rows. A bucket's packets meet in one task and are held by it: callers choose so
many buckets that one holds a bounded number of rows, and split keys that
alone would hold more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import vec

SCHEMA = "bucket int, body binary"
FLUSH_ROWS = 1 << 17
#: Rows that a bucket should hold, on average.
BUCKET_ROWS = 300_000
#: Counters in one packet of ``totals``.
_RANGE = 1 << 13


def _halves(c: np.ndarray) -> np.ndarray:
    """Signed numbers as their low halves and their high ones, so that the shuffle's codec sees the zeros of small numbers."""
    if c.dtype.kind != "i":
        return c
    return np.ascontiguousarray(c.view(f"<u{c.itemsize // 2}").reshape(-1, 2).T)


def _packet(held: list[list[np.ndarray]], buckets: int) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*held)]
    bucket = (vec.mix(cols[0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, cols = bucket[order], [c[order] for c in cols]
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    stop = np.append(start[1:], len(bucket))
    cols = [_halves(c) for c in cols]
    bodies = [b"".join(c[..., a:b].tobytes() for c in cols) for a, b in zip(start.tolist(), stop.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(bucket[start]), pa.array(bodies, pa.binary())], ["bucket", "body"])


def dealt(blocks: Iterable[list[np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packets of blocks of columns; rows of equal first columns get one bucket."""
    held, size = [], 0
    for block in blocks:
        if not len(block[0]):
            continue
        held.append(block)
        size += len(block[0])
        if size >= FLUSH_ROWS:
            yield _packet(held, buckets)
            held, size = [], 0
    if size:
        yield _packet(held, buckets)


def shuffled(packets: DataFrame) -> DataFrame:
    """Packets with those of a bucket one after the other."""
    parts = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packets.repartition(parts, "bucket").sortWithinPartitions("bucket")


def buckets_for(spark, rows: int) -> int:
    """Four a shuffle partition, so that they spread evenly, and more where rows are many."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def opened(batches: Iterable[pa.RecordBatch], types: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of one bucket after the other."""
    width = sum(np.dtype(t).itemsize for t in types)

    def columns(bodies):
        out = [[] for _ in types]
        for body in bodies:
            n, at = len(body) // width, 0
            for cells, t in zip(out, types):
                size = np.dtype(t).itemsize
                if np.dtype(t).kind == "i":
                    cells.append(np.ascontiguousarray(np.frombuffer(body, f"<u{size // 2}", 2 * n, at).reshape(2, n).T).view(t)[:, 0])
                else:
                    cells.append(np.frombuffer(body, t, n, at))
                at += n * size
        return [np.concatenate(c) for c in out]

    now, held = None, []
    for batch in batches:
        for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != now and held:
                yield columns(held)
                held = []
            now = bucket
            held.append(body)
    if held:
        yield columns(held)


def totals(rows: DataFrame, counters: Callable[[pa.RecordBatch], Iterable[np.ndarray]], bits: int) -> np.ndarray:
    """How often each of 2^bits counters is named by any row; that fixed number reaches the driver.

    A task keeps all counters and sends them in ranges; a range's sums meet in one task.
    """
    step = min(_RANGE, 1 << bits)

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for named in counters(batch):
                np.add.at(total, named, 1)
        ranges = total.reshape(-1, step)
        at = np.flatnonzero(ranges.any(1))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([r.tobytes() for r in ranges[at]], pa.binary())], ["bucket", "body"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(body, np.int64)
                sums[bucket] = sums[bucket] + part if bucket in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["bucket", "body"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = rows.mapInArrow(vec.lean(count), SCHEMA).repartition(parts, "bucket").mapInArrow(vec.lean(add), SCHEMA).toArrow()
    out = np.zeros((1 << bits) // step * step, np.int64).reshape(-1, step)
    for bucket, body in zip(summed.column(0).to_pylist(), summed.column(1).to_pylist()):
        out[bucket] = np.frombuffer(body, np.int64)
    return out.ravel()
