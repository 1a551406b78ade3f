"""Operator 10: line dedup by an exact set-similarity join.

A line is the set of its words (ASCII case folded). Lines of equal sets are one
class, told apart by a 64-bit hash of the set; before a line goes as an equal one,
a 64-bit parity map of its words must agree too. Words are ordered by rarity,
counted over all lines into a fixed number of counters (any one order gives right
results; a rare-first order makes them cheap). A class sends the first words of
its set, so many that two sets of Jaccard >= threshold must share one:

* length filter: the smaller set has threshold times the larger's words;
* positional filter: what follows the shared words can still make up the overlap;
* bitmap filter: the sets' parity maps (64 bits, 128 for long sets) differ
  in no more bits than the words in which similar sets may differ;
* at last Jaccard itself, on the sets' 32-bit word hashes.

A set too small to be similar to another one (of fewer than 4 words at 0.8)
sends nothing: only an equal one removes it.

A line goes if an earlier line has the same set or one of Jaccard >= threshold,
whether or not that one stays. So a class needs only one earlier match: each
shared word offers PROBES earlier candidates, which settles large groups of
variants in linear size.

A word sent by more than LIST_ROWS classes is hot, by counts of all that is sent:
its classes are dealt at random into lists of about that length. Classes that
these leave unsettled, and those that have more candidates than PROBES, then meet
all they may be similar to: under each hot word together with a second word (two
similar sets share their first two common words, and these stand among the first
words of both, one further on), in a join that may split a hot key.

Earlier is by (doc_id, line number, text hash). Defined results: null and blank
texts have no lines; blank lines stay; a null doc_id counts as the least id; rows
that agree in doc_id and text are one document and lose the same lines, rows that
share a doc_id only are documents of their own; an empty table gives no rows;
extra columns pass through ``remove_lines`` untouched. One text is held by one task.
"""

from __future__ import annotations

import uuid
from contextlib import ExitStack, contextmanager
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import packets, store, vec
from lodestone.llm.prefixes import COUNTER_BITS, Hot, counter, ranks, short

THRESHOLD = "0.8"
PROBES = 4
#: Sets of more words have a parity map of 128 bits: 64 say little of them. The 64 are its halves' XOR.
WIDE_WORDS = 40
#: Words of open classes that every task may hold.
BROADCAST_WORDS = 500_000
#: Lines whose words are sorted at once; their number has 21 bits of the sort key.
_BLOCK_LINES = 1 << 21
_FRONT = "doc long, hash long, line int, sid long, n int, low long, high long"
#: word, n, pos, line, sid, doc, low, high
_INDEX = ["<u4", "<i4", "<i4", "<i4", "<u8", "<i8", "<u8", "<u8"]


class _Filters:
    """The filters for one threshold, in whole numbers."""

    def __init__(self, threshold: str) -> None:
        t = Fraction(threshold)
        self.p, self.q = t.numerator, t.denominator
        #: Fewer words than that, and only an equal set is similar.
        self.least = -(-self.p // (self.q - self.p)) if self.p < self.q else 1 << 31

    def overlap(self, a, b):
        """Least number of common words of similar sets."""
        return (self.p * (a + b) + self.p + self.q - 1) // (self.p + self.q)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Words that a set of n sends."""
        return np.where(n >= self.least, n - (n * self.p + self.q - 1) // self.q + 1, 0)

    def pass_(self, n, pos, maps, a, b):
        """Whether the sets at a and b, known to meet at positions pos, may be similar."""
        na, nb = n[a], n[b]
        need = self.overlap(na, nb)
        spare = na + nb - 2 * need
        folded, low, high = maps
        ok = (np.minimum(na - pos[a], nb - pos[b]) >= need) & (np.bitwise_count(folded[a] ^ folded[b]) <= spare)
        at = np.flatnonzero(ok)
        at = at[np.minimum(na[at], nb[at]) > WIDE_WORDS]
        if len(at):
            a, b = a[at], b[at]
            ok[at] = np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b]) <= spare[at]
        return ok


def _word_ranks(docs: DataFrame, text: str) -> np.ndarray:
    """Place of each counter of words, rarest first."""

    def counters(batch):
        for part in vec.slices(batch, "text"):
            body, offsets = vec.flat(part.column(0))
            yield counter(short(vec.mix(vec.hash_spans(body, *vec.words(body, offsets), folded=True))))

    return ranks(packets.totals(docs.select(docs[text].alias("text")), counters, COUNTER_BITS))


def line_sets(docs: DataFrame, threshold: str = THRESHOLD, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, hash, line, sid, n, low, high, head, tail) of every line with a word.

    head and tail are the set's 32-bit word hashes, rarest first; head holds those that
    the set sends and one more. Both are empty where only an equal set is similar.
    """
    rank = _word_ranks(docs, text)
    filters = _Filters(threshold)

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                out = _sets_of(part, rank, filters)
                if out is not None:
                    yield out

    rows = docs.select(*store.doc_key(id_column, text), docs[text].alias("text"))
    return rows.mapInArrow(vec.lean(run), f"{_FRONT}, head binary, tail binary")


def _ordered(line: np.ndarray, rank: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Places of the words, each line's once each and rarest first."""
    spare = 43 - COUNTER_BITS
    out = []
    for base in range(0, int(line[-1]) + 1 if len(line) else 0, _BLOCK_LINES):
        a, b = np.searchsorted(line, (base, base + _BLOCK_LINES))
        # one sort key: the line, the word's rank, and further bits of its hash
        key = (line[a:b] - base).astype(np.uint64) << np.uint64(43)
        key |= rank[counter(short(mixed[a:b]))].astype(np.uint64) << np.uint64(spare)
        key |= (mixed[a:b] >> np.uint64(64 - COUNTER_BITS - spare)) & np.uint64((1 << spare) - 1)
        order = np.argsort(key)
        key = key[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        out.append(a + order[first])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _sets_of(part: pa.RecordBatch, rank: np.ndarray, filters: _Filters) -> pa.RecordBatch | None:
    body, offsets = vec.flat(part.column(2))
    starts, ends = vec.words(body, offsets)
    mixed = vec.mix(vec.hash_spans(body, starts, ends, folded=True))
    line_start = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(body == 10) + 1)))
    line = np.searchsorted(line_start, starts, "right") - 1
    order = _ordered(line, rank, mixed)
    if not len(order):
        return None
    mixed, line = mixed[order], line[order]
    begin = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    n = np.diff(np.append(begin, len(line)))
    sid = vec.mix(np.add.reduceat(mixed, begin) + n.astype(np.uint64))
    bit = np.uint64(1) << (mixed & np.uint64(63))
    upper = np.repeat(n > WIDE_WORDS, n) & (mixed & np.uint64(64) != 0)
    low = np.bitwise_xor.reduceat(np.where(upper, np.uint64(0), bit), begin)
    high = np.bitwise_xor.reduceat(np.where(upper, bit, np.uint64(0)), begin)
    at = line_start[line[begin]]
    row = np.searchsorted(offsets[1:], at, "right")
    number = line[begin] - np.searchsorted(line_start, offsets[row], "left")
    sent = filters.prefix(n)
    head = np.where(sent > 0, np.minimum(sent + 1, n), 0)
    word, place = short(mixed), vec.grouped_arange(n)
    ahead = place < np.repeat(head, n)
    rest = np.repeat(sent > 0, n) & ~ahead
    cols = [
        *(pa.array(part.column(i).to_numpy(zero_copy_only=False)[row].astype(np.int64)) for i in (0, 1)),
        pa.array(number.astype(np.int32)),
        pa.array(sid.view(np.int64)),
        pa.array(n.astype(np.int32)),
        pa.array(low.view(np.int64)),
        pa.array(high.view(np.int64)),
        _packed(word[ahead], head),
        _packed(word[rest], np.where(sent > 0, n - head, 0)),
    ]
    return pa.RecordBatch.from_arrays(cols, ["doc", "hash", "line", "sid", "n", "low", "high", "head", "tail"])


def _packed(words: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of 32-bit words as a binary column."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(4 * counts, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words, "<u4"))])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all words, words per row) of a packed column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return np.frombuffer(body.tobytes(), "<u4"), np.diff(offsets) // 4


def _numbers(part: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [part.column(part.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]


def _sent(part: pa.RecordBatch, filters: _Filters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of all heads, where each row's begin, row, position and place of every word that is sent)."""
    words, held = _unpacked(part.column(part.schema.get_field_index("head")))
    begin = np.cumsum(held) - held
    (n,) = _numbers(part, "n")
    count = np.where(held > 0, filters.prefix(n.astype(np.int64)), 0)
    pos = vec.grouped_arange(count)
    row = np.repeat(np.arange(len(n)), count)
    return words, begin, row, pos, begin[row] + pos


def _index_blocks(batches, filters: _Filters, hot: Hot):
    """Columns _INDEX: a row for each word that a class sends. A hot word's classes get one of its lists each."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            words, _, row, pos, place = _sent(part, filters)
            sid, doc, line, n, low, high = _numbers(part, "sid", "doc", "line", "n", "low", "high")
            word, lists = words[place], hot.of(words[place])
            some = np.flatnonzero(lists > 1)
            if len(some):
                chosen = vec.mix(sid[row[some]].view(np.uint64)) % lists[some].astype(np.uint64)
                word[some] = short(vec.mix((word[some].astype(np.uint64) << np.uint64(32)) + chosen))
            yield [word, n[row], pos.astype(np.int32), line[row], sid[row].view(np.uint64), doc[row], low[row].view(np.uint64), high[row].view(np.uint64)]


def _met(cols: list[np.ndarray], filters: _Filters, most: int):
    """(a, b, more) within the lists of cols: earlier class a that b may be similar to, ``most`` for each b in a list."""
    order = np.argsort((cols[0].astype(np.uint64) << np.uint64(32)) | cols[1].astype(np.uint64))
    word, n, pos, number, sid, doc, low, high = (c[order] for c in cols)
    sid = sid.view(np.int64)
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    maps = (low ^ high, low, high)
    begin = np.concatenate(([True], word[1:] != word[:-1]))
    at_begin = np.maximum.accumulate(np.where(begin, np.arange(len(word)), 0))
    live = np.flatnonzero(~begin)
    found = np.zeros(len(word), np.int64)
    a_out, b_out, last = [], [], []
    size, lag = 0, 1
    while len(live):
        live = live[live - lag >= at_begin[live]]
        live = live[filters.q * n[live - lag] >= filters.p * n[live]]
        if not len(live):
            break
        two = live[filters.pass_(n, pos, maps, live - lag, live)]
        one = two - lag
        if len(two):
            swap = (doc[one] > doc[two]) | ((doc[one] == doc[two]) & ((number[one] > number[two]) | ((number[one] == number[two]) & (sid[one] > sid[two]))))
            a, b = np.where(swap, two, one), np.where(swap, one, two)
            good = (found[b] < most) & (sid[a] != sid[b])
            a, b = a[good], b[good]
            np.add.at(found, b, 1)
            a_out.append(sid[a])
            b_out.append(sid[b])
            last.append(found[b] >= most)
            size += len(a)
        lag += 1
        if size > 200_000:
            yield _pairs(a_out, b_out, last)
            a_out, b_out, last, size = [], [], [], 0
    if size:
        yield _pairs(a_out, b_out, last)


def _pairs(a, b, more):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, more)], ["a", "b", "more"])


def _candidates(classes: DataFrame, filters: _Filters, hot: Hot, rows: int) -> DataFrame:
    """(a, b, more): the first meetings, under every word or list of one."""
    spark = classes.sparkSession
    buckets = packets.buckets_for(spark, rows)
    most = PROBES

    def send(batches):
        return packets.dealt(_index_blocks(batches, filters, hot), buckets)

    def meet(batches):
        for cols in packets.opened(batches, _INDEX):
            yield from _met(cols, filters, most)

    index = classes.select("sid", "doc", "line", "n", "low", "high", "head").mapInArrow(vec.lean(send), packets.SCHEMA)
    met = packets.shuffled(index).mapInArrow(vec.lean(meet), "a long, b long, more boolean")
    return met.groupBy("a", "b").agg(F.max("more").alias("more"))


_KEYS = "key long, sid long, n int, pos int, doc long, line int, map long"


def _keys(classes: DataFrame, filters: _Filters, hot: Hot, words: np.ndarray | None) -> DataFrame:
    """_KEYS: a row for each word that a class sends; for a hot one, for each two of which the first is that one. words: no other first words."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                all_words, begin, row, pos, place = _sent(part, filters)
                word = all_words[place]
                if words is not None and len(word):
                    keep = words[np.minimum(np.searchsorted(words, word), len(words) - 1)] == word
                    row, pos, place, word = row[keep], pos[keep], place[keep], word[keep]
                if not len(word):
                    continue
                _, head = _unpacked(part.column(part.schema.get_field_index("head")))
                # a hot word meets each later word of the head, another one stands for itself
                is_hot = hot.of(word) > 1
                count = np.where(is_hot, head[row] - pos - 1, 1)
                step = vec.grouped_arange(count)
                of = np.repeat(np.arange(len(word)), count)
                second = np.where(is_hot[of], all_words[np.minimum(place[of] + 1 + step, len(all_words) - 1)], 0)
                key = np.where(is_hot[of], vec.mix((word[of].astype(np.uint64) << np.uint64(32)) + second.astype(np.uint64)), word[of].astype(np.uint64))
                # the second common word stands one further on
                at_pos = np.where(is_hot[of], pos[of] + step, pos[of])
                sid, doc, line, n, low, high = (c[row[of]] for c in _numbers(part, "sid", "doc", "line", "n", "low", "high"))
                cols = [key.view(np.int64), sid, n, at_pos.astype(np.int32), doc, line, low ^ high]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "sid", "n", "pos", "doc", "line", "map"])

    return classes.select("sid", "doc", "line", "n", "low", "high", "head").mapInArrow(vec.lean(run), _KEYS)


def _further(classes: DataFrame, asked: DataFrame, filters: _Filters, hot: Hot) -> DataFrame:
    """(a, b): for every class b of asked all earlier classes that it may be similar to."""
    own = store.settled(_keys(classes.join(asked, "sid", "left_semi"), filters, hot, None), "line-asked")
    p, q = filters.p, filters.q

    def firsts(batches):
        for batch in batches:
            words, _, _, _, place = _sent(batch, filters)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(words[place]).astype(np.int64))], ["word"])

    first = classes.join(asked, "sid", "left_semi").select("n", "head").mapInArrow(vec.lean(firsts), "word long").distinct()
    held = first.limit(BROADCAST_WORDS + 1).toArrow().column(0).to_numpy()
    # beyond that number every class sends its keys
    words = np.sort(held).astype(np.uint32) if len(held) <= BROADCAST_WORDS else None
    a, b = _keys(classes, filters, hot, words).alias("a"), own.alias("b")
    na, nb = F.col("a.n"), F.col("b.n")
    need = F.expr(f"({p}L * (a.n + b.n) + {p + q - 1}L) div {p + q}L")
    order = lambda x: F.struct(f"{x}.doc", f"{x}.line", f"{x}.sid")
    near = (
        (q * F.least(na, nb) >= p * F.greatest(na, nb))
        & (F.least(na - F.col("a.pos"), nb - F.col("b.pos")) >= need)
        & (F.bit_count(F.col("a.map").bitwiseXOR(F.col("b.map"))) <= na + nb - 2 * need)
        & (order("a") < order("b"))
    )
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & near).select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b")).distinct()
    return met.withColumn("more", F.lit(False))


def _with_hot(classes: DataFrame, filters: _Filters, hot: Hot) -> DataFrame:
    """(sid) of the classes that send a hot word."""

    def run(batches):
        for batch in batches:
            words, _, row, _, place = _sent(batch, filters)
            rows = np.unique(row[hot.of(words[place]) > 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows))], ["sid"])

    return classes.select("sid", "n", "head").mapInArrow(vec.lean(run), "sid long")


def _verified(pairs: DataFrame, classes: DataFrame, filters: _Filters) -> DataFrame:
    """(b, more, similar) of every pair."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = np.arange(part.num_rows, dtype=np.uint64) << np.uint64(32)
                words, size = [], np.zeros(part.num_rows, np.int64)
                for i in range(2, 6):
                    body, n = _unpacked(part.column(i))
                    words.append(np.repeat(rows, n) + body)
                    size += n
                # a word of both sets of a pair stands twice
                both = np.sort(np.concatenate(words))
                common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(rows))
                similar = common * (filters.p + filters.q) >= size * filters.p
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(similar)], ["b", "more", "similar"])

    left = classes.select(F.col("sid").alias("a"), F.col("head").alias("ha"), F.col("tail").alias("ta"))
    right = classes.select(F.col("sid").alias("b"), F.col("head").alias("hb"), F.col("tail").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("b", "more", "ha", "ta", "hb", "tb")
    return both.mapInArrow(vec.lean(run), "b long, more boolean, similar boolean")


def _gone(classes: DataFrame, filters: _Filters) -> DataFrame:
    """(sid) of the classes that are similar to an earlier one."""

    def counters(batch):
        words, _, _, _, place = _sent(batch, filters)
        yield counter(words[place])

    counts = packets.totals(classes.select("n", "head"), counters, COUNTER_BITS)
    hot = Hot(counts)
    first = _candidates(classes, filters, hot, int(counts.sum()))
    pairs = store.settled(_verified(first, classes, filters), "line-pairs")
    gone = pairs.where("similar").select(F.col("b").alias("sid")).distinct()
    asked = pairs.where("more").select(F.col("b").alias("sid"))
    if len(hot.at):
        asked = asked.union(_with_hot(classes, filters, hot))
    asked = store.settled(asked.distinct().join(gone, "sid", "left_anti"), "line-open")
    if not asked.isEmpty():
        rest = _verified(_further(classes, asked, filters, hot), classes, filters)
        gone = gone.union(rest.where("similar").select(F.col("b").alias("sid"))).distinct()
    return store.settled(gone, "line-gone")


def removed_lines(docs: DataFrame, threshold: str = THRESHOLD, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, hash, lines): of each document that loses lines, their numbers from 0, ascending; doc and hash as store.doc_key gives them."""
    spark = docs.sparkSession
    with store.scratch(spark):
        with ExitStack() as held:
            path = store.fresh(spark, "line-sets")
            sets = line_sets(docs, threshold, id_column, text)
            sets.write.option("compression", "snappy").parquet(path)
            sets = spark.read.schema(sets.schema).parquet(path)
            lines = store.settled(sets.select("doc", "hash", "line", "sid", "low"), "lines")
            classes = held.enter_context(_classes(sets))
            store.discard(spark, path)
            del sets
            store.release(spark)
            state = _state(classes, _Filters(threshold))
        is_first = (F.col("doc") == F.col("d")) & (F.col("line") == F.col("l")) & (F.col("hash") == F.col("h"))
        judged = lines.join(state, "sid").where((F.coalesce("g", F.lit(False)) | ~is_first) & (F.col("low") == F.col("m")))
        return store.settled(judged.groupBy("doc", "hash").agg(F.sort_array(F.collect_set("line")).alias("lines")), "line-removed", outlives=True)


@contextmanager
def _classes(sets: DataFrame):
    """The first line of every sid, as a table below the shared folder for as long as the context lasts.

    It is bucketed by sid, so that neither check of words moves it again, and made in
    two halves of all sids, so that the words of one half only are shuffled at a time.
    """
    spark = sets.sparkSession
    name, at = f"lodestone_lines_{uuid.uuid4().hex[:12]}", store.fresh(spark, "line-classes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        for half in range(2):
            first = F.min(F.struct("doc", "line", "hash", "n", "low", "high", "head", "tail")).alias("f")
            rows = sets.where(F.col("sid").bitwiseAND(1) == half).groupBy("sid").agg(first).select("sid", "f.*")
            rows.write.mode("append").option("compression", "snappy").option("path", at).bucketBy(parts, "sid").saveAsTable(name)
            del rows
            store.release(spark)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        store.discard(spark, at)


def _state(classes: DataFrame, filters: _Filters) -> DataFrame:
    """(sid, d, h, l, m, g) of every class: its first line's document, text and number, its parity map, and whether it is similar to an earlier one."""
    gone = _gone(classes, filters)
    state = classes.select("sid", F.col("doc").alias("d"), F.col("hash").alias("h"), F.col("line").alias("l"), F.col("low").alias("m"))
    # written first: a join of two tables may split the rows of a line that is everywhere
    return store.settled(state.join(gone.withColumn("g", F.lit(True)), "sid", "left"), "line-state")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed, removed_lines of each document that loses lines."""
    rows = removed_lines(docs)
    return rows.select(F.when(F.col("doc") != store.NULL_ID, F.col("doc")).alias("doc_id"), F.size("lines").cast("long").alias("n_removed"), F.col("lines").alias("removed_lines"))


def remove_lines(docs: DataFrame, threshold: str = THRESHOLD) -> DataFrame:
    """docs without the lines that go; n_chars, where there is one, follows the text."""
    rows = removed_lines(docs, threshold)
    names = docs.columns
    doc, hash_ = store.doc_key()
    # by sorting at every size: what is broadcast would grow with the documents
    joined = docs.join(rows.hint("merge"), (doc == rows["doc"]) & (hash_ == rows["hash"]), "left").select(*store.own(docs), rows["lines"].alias(store.unused(names, "gone")))
    at = names.index("text")

    def run(batches):
        for batch in batches:
            gone = batch.column(len(names)).to_pylist()
            texts = batch.column(at).to_pylist()
            for i, lines in enumerate(gone):
                if lines:
                    lost = set(lines)
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in lost)
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    out = store.mapped(joined, vec.lean(run), docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out
