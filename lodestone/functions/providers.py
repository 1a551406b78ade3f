"""Stand-ins for model calls: deterministic, offline, and replaceable by name."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSION = 64
Embed = Callable[[list[str]], np.ndarray]


def hashed_embedding(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """Signed feature hashing of words, of unit length; an empty text is the zero vector."""
    out = np.zeros((len(texts), dimension), np.float32)
    held = [(text or "").lower().split() for text in texts]
    known: dict[str, int] = {}
    code = [known.get(w) or known.setdefault(w, zlib.crc32(w.encode())) for words in held for w in words]
    if code:
        h = np.array(code, np.int64)
        row = np.repeat(np.arange(len(texts)), [len(words) for words in held])
        np.add.at(out, (row, h % dimension), np.where((h >> 16) & 1, 1.0, -1.0).astype(np.float32))
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, n, out=out, where=n > 0)


def embedded(df: DataFrame, text: str, embed: Embed = hashed_embedding, name: str = "vector", batch: int = 32) -> DataFrame:
    """df with the vector of each text, in batches of at most ``batch`` texts a call."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [x or "" for x in part[text]]
            vectors = [embed(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            part[name] = list(np.concatenate(vectors)) if vectors else []
            yield part

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])
    return df.mapInPandas(run, schema)


def _near(texts: list[str], embed: Embed, batch: int) -> np.ndarray:
    """Similarity of each text and the next, to 6 places; zero vectors have similarity 0."""
    vectors = [embed(texts[i : i + batch]) for i in range(0, len(texts), batch)]
    v = np.concatenate(vectors).astype(np.float64) if vectors else np.zeros((0, 1))
    norm = np.sqrt((v * v).sum(1))
    dot, size = (v[1:] * v[:-1]).sum(1), norm[1:] * norm[:-1]
    return np.round(np.divide(dot, size, out=np.zeros_like(dot), where=size > 0), 6)


def segmented(df: DataFrame, parts: str, cut: float, embed: Embed = hashed_embedding, batch: int = 256) -> DataFrame:
    """df with each row's array of texts joined into runs: a new one begins where neighbours' similarity, to 6 places, lies below the cut.

    A row's texts are embedded and compared where they lie; nothing is shuffled. Zero vectors have similarity 0.
    """
    names = df.columns
    at = names.index(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 100):
                rows = whole.slice(first, 100)
                held = [x or [] for x in rows.column(at).to_pylist()]
                near = _near([t for x in held for t in x], embed, batch)
                out, base = [], 0
                for x in held:
                    runs: list[list[str]] = []
                    for i, text in enumerate(x):
                        if i == 0 or near[base + i - 1] < cut:
                            runs.append([])
                        runs[-1].append(text)
                    out.append([" ".join(r) for r in runs])
                    base += len(x)
                cols = list(rows.columns)
                cols[at] = pa.array(out, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return df.mapInArrow(run, df.schema)


def with_valleys(df: DataFrame, parts: str, name: str, factor: float, embed: Embed = hashed_embedding, batch: int = 256) -> DataFrame:
    """df with name: for each list of texts of a row's array<array<string>>, which of them begin behind a valley of their similarity curve.

    A valley lies below both its neighbours and below the curve's mean less ``factor`` times
    its standard deviation (of the population), to 6 places. All lists of a run of rows are
    embedded together where they lie; nothing is exploded or shuffled.
    """
    names = df.columns
    at = names.index(parts)

    def marks(n: int, near: np.ndarray) -> list[bool]:
        out = np.zeros(n, bool)
        if n > 3:
            low = np.round(near.mean() - factor * near.std(), 6)
            inner = near[1:-1]
            out[2:-1] = (inner < near[:-2]) & (inner < near[2:]) & (inner < low)
        return out.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 100):
                rows = whole.slice(first, 100)
                held = [x or [] for x in rows.column(at).to_pylist()]
                near = _near([t for x in held for texts in x for t in texts], embed, batch)
                out, base = [], 0
                for x in held:
                    each = []
                    for texts in x:
                        each.append(marks(len(texts), near[base : base + max(0, len(texts) - 1)]))
                        base += len(texts)
                    out.append(each)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.list_(pa.list_(pa.bool_())))], [*names, name])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.ArrayType(T.BooleanType())))]))


def healthy(embed: Embed = hashed_embedding) -> bool:
    """Whether an embedder gives vectors of one length, not zero, and orders related texts before unrelated ones."""
    a, b, c = embed(["annual sales report", "sales report of the year", "zebra crossing"])
    return len(a) == len(b) and bool(np.any(a)) and float(a @ b) > float(a @ c)


def with_retry(call: Callable, tries: int = 5, wait: float = 0.0) -> Callable:
    """call, tried again after errors, with a growing pause."""
    import time

    def tried(*args, **kwargs):
        for n in range(tries):
            try:
                return call(*args, **kwargs)
            except Exception:
                if n == tries - 1:
                    raise
                time.sleep(wait * (n + 1))

    return tried


def query_vector(text: str, embed: Embed = hashed_embedding, prefix: str = "") -> np.ndarray:
    """The vector of one question; an empty one is an error. prefix: what the model wants before questions."""
    if not text or not text.strip():
        raise ValueError("an empty question has no vector")
    return embed([prefix + text])[0]


def embedded_or_dropped(df: DataFrame, text: str, key: str, embed: Embed = hashed_embedding, batch: int = 32, tries: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows with their vector, keys of the batches that failed ``tries`` times). A row without a text is an error before any call."""
    if not df.where(F.trim(F.coalesce(text, F.lit(""))) == "").isEmpty():
        raise ValueError("a row has nothing to embed")
    call = with_retry(embed, tries)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for at in range(0, len(part), batch):
                some = list(part[text][at : at + batch])
                try:
                    out += [v.tolist() for v in call(some)]
                except Exception:
                    out += [None] * len(some)
            part["vector"] = out
            yield part

    from pyspark.sql import types as T

    rows = df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))
    return rows.where("vector IS NOT NULL"), rows.where("vector IS NULL").select(key)
