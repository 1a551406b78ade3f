"""Incremental loads and conversation memory as streams.

Batch twins: dml.unseen for the first, memory.to_compress and memory.active for
the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lodestone.operators.memory import COMPRESS_ABOVE, KEEP, with_tiers


def landing(spark: SparkSession, path: str, schema: StructType | str, files_a_batch: int = 1000) -> DataFrame:
    """Rows of Parquet files as they land in a folder; a single file, or a pattern, will do too."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = held.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(held) and not system.getFileStatus(held).isDirectory():
        # a file stream takes a file by a pattern only
        path = f"{path.rpartition('/')[0]}/{{{held.getName()}}}"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def unseen_into(stream: DataFrame, table: str, keys: list[str], checkpoint: str, version: str | None = None):
    """A query that appends the rows of each batch that a Parquet table lacks; replayed batches add nothing."""
    on = keys + ([version] if version else [])

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(table)
        rows = batch.dropDuplicates(on)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            rows = rows.join(spark.read.parquet(table).select(*on), on, "left_anti")
        rows.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class Versions(StatefulProcessor):
    """Hands on a key's newest row where its version is not the one held for the key."""

    def __init__(self, version: str, order: tuple[str, ...]) -> None:
        self.version, self.order = version, [*order, version]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("version", "version string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for part in rows:
            both = part if newest is None else pd.concat([newest, part])
            newest = both.sort_values(self.order, kind="stable", na_position="first").tail(1)
        version = newest[self.version].iloc[0]
        held = self.held.get() if self.held.exists() else None
        if held is None or held[0] != version:
            self.held.update((version,))
            yield newest

    def close(self) -> None:
        pass


def changed(stream: DataFrame, key: str, version: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose key is new, or comes with another version than it last had; of several rows of a micro-batch the last by ``order``, then version.

    A key's version is streaming state, so nothing that was written before is read
    again, and a version that comes back after another counts as a change. Needs the
    RocksDB state store. version is a string; a key's rows of one micro-batch meet in one task.
    """
    return stream.groupBy(key).transformWithStateInPandas(Versions(version, order), outputStructType=stream.schema, outputMode="Update", timeMode="None")


class TurnBuffer(StatefulProcessor):
    """Keeps a session's turns; past ``above`` all but the last ``keep`` are handed on for compression, each once."""

    def __init__(self, above: int = COMPRESS_ABOVE, keep: int = KEEP) -> None:
        self.above, self.keep = above, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, role string, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.turns.get()) if self.turns.exists() else []
        for part in rows:
            held += list(part[["turn", "role", "content"]].itertuples(index=False, name=None))
        held = sorted({(int(t), r, c) for t, r, c in held})
        out = []
        if len(held) > self.above:
            out, held = held[: -self.keep], held[-self.keep :]
        self.turns.put(held)
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["session_id", "turn", "role", "content"])

    def close(self) -> None:
        pass


class Tiers(StatefulProcessor):
    """Holds a session's turns until they expire, each by a timer of its own, and hands on those that have."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "turn long", "tier string, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for turn, tier, until in part.loc[part["until"].notna(), ["turn", "tier", "until"]].itertuples(index=False, name=None):
                self.turns.updateValue((int(turn),), (tier, int(until)))
                self.handle.registerTimer(int(until))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, gone = expiredTimerInfo.getExpiryTimeInMs(), []
        for (turn,), (tier, until) in list(self.turns.iterator()):
            if until <= now:
                gone.append((key[0], turn, tier, until))
                self.turns.removeKey((turn,))
        if gone:
            yield pd.DataFrame(sorted(gone), columns=["session_id", "turn", "tier", "until"])

    def close(self) -> None:
        pass


def purge_stream(turns: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(session_id, turn, tier, expires_at) of turns (session_id, turn, content, created_at) that expire as event time goes on.

    Only turns of tiers that expire are held, and each for as long as its tier says, so state
    does not grow with what is kept for good; that too moves event time on. Batch twin: memory.expired at the watermark. A
    turn that comes again after its expiry is late, and is not held anew.
    """
    rows = with_tiers(turns.withWatermark("created_at", late))
    held = rows.select("session_id", "turn", "tier", F.unix_millis("expires_at").alias("until"), "created_at")
    gone = held.groupBy("session_id").transformWithStateInPandas(Tiers(), outputStructType="session_id long, turn long, tier string, until long", outputMode="Append", timeMode="EventTime")
    return gone.select("session_id", "turn", "tier", F.timestamp_millis("until").alias("expires_at"))


def compression_stream(turns: DataFrame, above: int = COMPRESS_ABOVE, keep: int = KEEP) -> DataFrame:
    """Turns to compress, as sessions grow. Needs the RocksDB state store."""
    return turns.groupBy("session_id").transformWithStateInPandas(
        TurnBuffer(above, keep), outputStructType="session_id long, turn long, role string, content string", outputMode="Append", timeMode="None"
    )
