"""Operator 2: substring dedup over sliding spans of sentences.

A text is cut into sentences (after . ! ? … and white space, and at line feeds).
At each sentence a span starts that runs over the fewest consecutive sentences,
two at least, that hold ``least_words`` words, and another ends that is as short;
a sentence that alone holds ``alone_words`` is a span by itself. A longer run that
repeats is thus covered from its first sentence to its last by such spans, which
repeat with it. Where a span ends depends on its own words only, so a passage
gives the same spans wherever it stands. Spans are hashed (two times 64 bits over
the words, ASCII case folded, and their number), joined globally, and the
sentences that any non-first repeat covers are removed. The first occurrence is
the one of least (doc_id, text hash, sentence number).

Repeats inside one document count like those across documents. Runs of fewer than
``least_words`` words are no spans: they stay, however often they repeat.

Defined results: a null or blank text has no sentences and stays as it is; a
null doc_id counts as the least id; rows that agree in doc_id and text are one
document and lose the same sentences, rows that share a doc_id only are documents
of their own; ties can't occur, as a span's place is its document and sentence;
an empty table gives no rows; extra columns pass through
``remove_spans`` untouched. One text is held by one task; a span's occurrences
are never gathered in one place: minima are pre-aggregated and joined back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import store, vec

LEAST_WORDS = 20
ALONE_WORDS = 50
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True  # ! . ?


def sentence_starts(body: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each word begins a sentence: first of its text or line, or after a word that ends in . ! ? or …"""
    out = np.zeros(len(starts), bool)
    if not len(starts):
        return out
    last = ends - 1
    closes = _ENDS[body[last]]
    ellipsis = (body[last] == 0xA6) & (ends - starts >= 3)
    at = np.flatnonzero(ellipsis)
    closes[at] |= (body[last[at] - 1] == 0x80) & (body[last[at] - 2] == 0xE2)
    feeds = np.concatenate(([0], np.cumsum(body == 10)))
    row = vec.rows_of(starts, offsets)
    out[0] = True
    out[1:] = closes[:-1] | (feeds[starts[1:]] != feeds[ends[:-1]]) | (row[1:] != row[:-1])
    return out


class Sentences:
    """The sentences of a slice of texts: word ranges, rows, and byte spans."""

    def __init__(self, column: pa.Array) -> None:
        self.body, self.offsets = vec.flat(column)
        self.word_start, self.word_end = vec.words(self.body, self.offsets)
        self.first = np.flatnonzero(sentence_starts(self.body, self.offsets, self.word_start, self.word_end))
        self.stop = np.append(self.first[1:], len(self.word_start))
        self.row = vec.rows_of(self.word_start[self.first], self.offsets) if len(self.first) else np.zeros(0, np.int64)
        per_row = np.bincount(self.row, minlength=len(self.offsets) - 1) if len(self.row) else np.zeros(len(self.offsets) - 1, np.int64)
        self.number = vec.grouped_arange(per_row)
        self.row_stop = np.cumsum(per_row)

    def spans(self, least_words: int, alone_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first sentence, sentences, hash, second hash) of each span."""
        words = self.stop - self.first
        total = np.concatenate(([0], np.cumsum(words)))
        at = np.arange(len(words))
        # the shortest run that starts at each sentence, and the shortest that ends there
        count = np.searchsorted(total, total[:-1] + least_words, "left") - at
        count = np.where(words >= alone_words, 1, np.maximum(count, 2))
        back = at + 2 - np.searchsorted(total, total[1:] - least_words, "right")
        back = np.where(words >= alone_words, 1, np.maximum(back, 2))
        row_start = self.row_stop[self.row] - np.bincount(self.row, minlength=len(self.row_stop))[self.row]
        ahead, behind = at + count <= self.row_stop[self.row], at + 1 - back >= row_start
        both = np.unique(np.concatenate(((at[ahead] << 31) | count[ahead], ((at + 1 - back)[behind] << 31) | back[behind])))
        at, count = both >> 31, both & ((1 << 31) - 1)
        h = vec.hash_spans(self.body, self.word_start, self.word_end, folded=True)
        # a running polynomial over word hashes gives each span's in two look-ups
        power, inverse = vec._powers(vec._MULTIPLIER, len(h) + 1), vec._powers(vec._INVERSE, len(h) + 1)
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)))
        other = np.concatenate((np.zeros(1, np.uint64), np.cumsum(vec.mix(h), dtype=np.uint64)))
        a, b = self.first[at], self.stop[at + count - 1]
        value = (running[b] - running[a]) * inverse[a]
        return at, count, vec.mix(value + (b - a).astype(np.uint64)), vec.mix(other[b] - other[a])


def spans_of(docs: DataFrame, least_words: int = LEAST_WORDS, alone_words: int = ALONE_WORDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(h, g, doc, hash, at, count): two hashes, document, first sentence and sentences of every span."""

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                s = Sentences(part.column(2))
                if not len(s.first):
                    continue
                at, count, h, g = s.spans(least_words, alone_words)
                doc, text_hash = (part.column(i).to_numpy(zero_copy_only=False)[s.row[at]].astype(np.int64) for i in (0, 1))
                cols = [h.view(np.int64), g.view(np.int64), doc, text_hash, s.number[at].astype(np.int32), count.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "g", "doc", "hash", "at", "count"])

    rows = docs.select(*store.doc_key(id_column, text), docs[text].alias("text"))
    return rows.mapInArrow(vec.lean(run), "h long, g long, doc long, hash long, at int, count int")


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS, alone_words: int = ALONE_WORDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, hash, at, count, first_doc): every occurrence of a repeated span but its first."""
    spans = store.settled(spans_of(docs, least_words, alone_words, id_column, text), "spans")
    place = F.struct("doc", "hash", "at")
    # written first: a join of two tables may split the rows of a span that is everywhere
    firsts = spans.groupBy("h", "g").agg(F.min(place).alias("f"), F.max(place).alias("l")).where(F.col("f") != F.col("l")).select("h", "g", "f")
    firsts = store.settled(firsts, "first-spans")
    met = spans.join(firsts, ["h", "g"]).where(place != F.col("f"))
    return met.select("doc", "hash", "at", "count", F.col("f.doc").alias("first_doc"))


def covered(docs: DataFrame, least_words: int = LEAST_WORDS, alone_words: int = ALONE_WORDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, hash, sentences, first_docs): the numbers of the sentences that go, and documents that hold the first copies."""
    with store.scratch(docs.sparkSession):
        met = repeated_spans(docs, least_words, alone_words, id_column, text)
        numbers = met.groupBy("doc", "hash").agg(F.collect_set(F.struct("at", "count")).alias("s"), F.sort_array(F.collect_set("first_doc")).alias("first_docs"))
        each = F.flatten(F.transform("s", lambda x: F.sequence(x["at"], x["at"] + x["count"] - 1)))
        return store.settled(numbers.select("doc", "hash", F.sort_array(F.array_distinct(each)).alias("sentences"), "first_docs"), "covered", outlives=True)


def without(text: str, gone: list[int]) -> str:
    """text without the sentences of these numbers; of the white space around it one run stays."""
    s = Sentences(pa.array([text]))
    lost = np.zeros(len(s.first), bool)
    lost[gone] = True
    raw = text.encode()
    edge = np.append(s.word_start[s.first], len(raw))
    stops = s.word_end[s.stop - 1]
    out, any_before, gap = [raw[: edge[0]]], False, b""
    for i in range(len(s.first)):
        space = raw[stops[i - 1] : edge[i]] if i else b""
        # of the white space around what went, a line feed stays: it may be all that ends a sentence
        gap = gap if b"\n" in gap else space
        if not lost[i]:
            out.append((gap if any_before else b"") + raw[edge[i] : stops[i]])
            any_before, gap = True, b""
    if len(s.first):
        out.append(raw[stops[-1] :])
    return b"".join(out).decode()


def _applied(docs: DataFrame, gone: DataFrame, how: str) -> DataFrame:
    """docs with their text cut; how: inner for the changed documents only, left for all."""
    names = docs.columns
    doc, text_hash = store.doc_key()
    joined = docs.join(gone.hint("merge"), (doc == gone["doc"]) & (text_hash == gone["hash"]), how).select(*store.own(docs), gone["sentences"].alias(store.unused(names, "gone")))
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, lost in enumerate(batch.column(len(names)).to_pylist()):
                if lost:
                    texts[i] = without(texts[i], lost)
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return store.mapped(joined, vec.lean(run), docs.schema)


def remove_spans(docs: DataFrame, least_words: int = LEAST_WORDS, alone_words: int = ALONE_WORDS) -> DataFrame:
    """docs without the sentences that go; n_chars, where there is one, follows the text."""
    out = _applied(docs, covered(docs, least_words, alone_words), "left")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed, removed_sentences, first_docs of each document that loses sentences."""
    gone = covered(docs)
    return gone.select(
        F.when(F.col("doc") != store.NULL_ID, F.col("doc")).alias("doc_id"),
        F.size("sentences").cast("long").alias("n_removed"),
        F.col("sentences").alias("removed_sentences"),
        "first_docs",
    )
