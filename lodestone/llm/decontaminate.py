"""Operator 7: benchmark decontamination by CGK embedding, bit sampling, and exact edits.

Texts are sequences of words (ASCII case folded, punctuation at their ends
stripped). A random walk embeds a window: step j writes the word at the walk's
place and moves on if a random bit of (j, word) says so; sequences a few edits
apart thus meet again and agree in most coordinates. A key is a sample of
coordinates. Windows start at every word of a document, and at every word of an
item, and the item's keys are looked up for each. Walks are added until, of items
of each class of sizes, edited as far as ``similarity`` allows, the keys find
``recall``. Each meeting gives an item-sized window of the document, and the least
number of word edits between the item and any part of it is computed exactly.

Items shorter than SHORT words, and those of a class that MOST_WALKS walks leave
short of ``recall``, are met by their pieces instead, one more than the edits
allowed, so none is missed. The share found of its class comes with every match.

The benchmark is a query set: it is taken in blocks of about BLOCK_ITEMS items or
BLOCK_BYTES of text, and PASS_BLOCKS blocks meet all documents in one pass over
them; documents are never shuffled, and their words are hashed once a pass. Blocks
are broadcast as their items' words; a worker builds the tables of one block at a
time, and keeps the last block's for its next task.

Defined results: null and blank texts and items match nothing; a null id stays
null; repeated rows and repeated items each report; an empty table gives no
rows; extra columns pass through ``drop_contaminated``. A text is held by one
task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import store, vec

SIMILARITY = 0.8
RECALL = 0.97
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
#: Blocks that take turns in one pass over the documents; a worker holds the words of so many, 8 bytes each.
PASS_BLOCKS = 4
#: Bytes of rows and words that a task holds while the blocks of a pass take turns.
HELD_BYTES = 32 << 20
SHORT = 8
#: Least words of the classes of sizes for which recall is measured, after the first.
CLASSES = (10, 12, 16, 24, 40, 80)
#: Edited items of a class that are tried.
TRIALS = 300
STEPS = 10
#: Coordinates that are sampled together; all hold the first, so that only words of items start a walk.
SAMPLES = ((0, 3, 6, 9), (0, 2, 5, 8), (0, 4, 7, 9))
MOST_WALKS = 8
_GONE = np.uint64(0)
#: Added to window starts, which may lie before the first word, in packed pairs.
_SHIFT = 1 << 24
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words before each row and after the last)."""
    body, offsets = vec.flat(column)
    starts, ends = vec.words(body, offsets)
    row = vec.rows_of(starts, offsets)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    a, b = starts.copy(), ends.copy()
    for edge, step in ((b, -1), (a, 1)):
        live = np.arange(len(edge))
        while len(live):
            at = edge[live] - 1 if step < 0 else edge[live]
            live = live[(a[live] < b[live]) & _PUNCT[body[np.minimum(at, len(body) - 1)]]]
            edge[live] += step
            live = live[a[live] < b[live]]
    empty = a >= b
    a[empty], b[empty] = starts[empty], ends[empty]
    return vec.hash_spans(body, a, b, folded=True) | np.uint64(1), bounds


def allowed(n: int, similarity: float) -> int:
    """Word edits that leave n words so similar."""
    return int(n * (1 - similarity) + 1e-9)


def _seeds(walk: int) -> np.ndarray:
    return np.random.default_rng([7, walk]).integers(1, 2**63, 2 * STEPS + len(SAMPLES), dtype=np.uint64) | np.uint64(1)


def walk_keys(words: np.ndarray, at: np.ndarray, stop: np.ndarray, walk: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each sample: (keys of the walks that start at ``at``, whether the walk stayed before ``stop``)."""
    seeds = _seeds(walk)
    padded = np.append(words, _GONE)
    place = at.copy()
    seen = []
    wanted = {c for s in SAMPLES for c in s}
    for j in range(max(wanted) + 1):
        word = padded[np.where(place < stop, place, len(words))]
        seen.append(word if j in wanted else None)
        place = place + ((word * seeds[j]) >> np.uint64(63)).astype(np.int64)
    out = []
    for k, sample in enumerate(SAMPLES):
        key = np.full(len(at), seeds[2 * STEPS + k], np.uint64)
        inside = np.ones(len(at), bool)
        for c in sample:
            key = vec.mix(key + seen[c] * seeds[STEPS + c])
            inside &= seen[c] != _GONE
        out.append((key, inside))
    return out


class _Table:
    """Keys -> (item, offset) entries, behind a bit table that turns most others away."""

    def __init__(self, keys: np.ndarray, item: np.ndarray, offset: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.offset = keys[order], item[order], offset[order]
        self.shift = np.uint64(64 - min(24, max(16, int(len(keys)).bit_length() + 6)))
        self.held = np.zeros(1 << int(64 - self.shift), bool)
        self.held[(self.keys >> self.shift).astype(np.int64)] = True

    def meet(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a key, entry) of every meeting."""
        at = np.flatnonzero(self.held[(keys >> self.shift).astype(np.int64)])
        low, high = np.searchsorted(self.keys, keys[at], "left"), np.searchsorted(self.keys, keys[at], "right")
        count = high - low
        return np.repeat(at, count), np.repeat(low, count) + vec.grouped_arange(count)


class Items:
    """A block of benchmark items, ready to be met."""

    def __init__(self, ids: list, texts: list[str], similarity: float, recall: float) -> None:
        words, bounds = word_hashes(pa.array(texts, pa.string()))
        size = np.diff(bounds)
        self._lay(ids, words, bounds, similarity)
        self.of_class = np.digitize(size, CLASSES)
        by_keys = size >= SHORT
        # walks of each class: as many as its recall takes
        self.class_walks = np.zeros(len(CLASSES) + 1, np.int64)
        self.class_recall = np.ones(len(CLASSES) + 1)
        for k in np.unique(self.of_class[by_keys]).tolist():
            own = np.flatnonzero(by_keys & (self.of_class == k))
            trial = self._edited(own)
            found = np.zeros(len(trial), bool)
            for walk in range(MOST_WALKS):
                tables = self._walk(own, walk)
                found |= np.array([self._met(words_, item, walk, tables) for item, words_ in trial])
                self.class_walks[k], self.class_recall[k] = walk + 1, found.mean()
                if found.mean() >= recall:
                    break
            else:
                self.class_walks[k], self.class_recall[k] = 0, 1.0
        self._build()

    def __getstate__(self) -> tuple:
        return self.ids, self.words, self.bounds, self.similarity, self.of_class, self.class_walks, self.class_recall

    def __setstate__(self, state: tuple) -> None:
        self._lay(*state[:4])
        self.of_class, self.class_walks, self.class_recall = state[4:]
        self._build()

    def _lay(self, ids: list, words: np.ndarray, bounds: np.ndarray, similarity: float) -> None:
        self.ids, self.words, self.bounds, self.similarity = ids, words, bounds, similarity
        self.size = np.diff(bounds)
        self.edits = np.array([allowed(int(n), similarity) for n in self.size], np.int64)

    def _build(self) -> None:
        walks = np.where(self.size >= SHORT, self.class_walks[self.of_class], 0)
        self.recall = self.class_recall[self.of_class]
        self.pieces = self._pieces(np.flatnonzero((walks == 0) & (self.size > 0)))
        self.walks = [self._walk(np.flatnonzero(walks > k), k) for k in range(int(walks.max(initial=0)))]
        item = np.repeat(np.arange(len(self.ids)), self.size)
        self.pair_bits = min(26, max(14, int(len(item)).bit_length() + 6))
        self.pairs = np.zeros(1 << self.pair_bits, bool)
        key = vec.mix(self.words + item.astype(np.uint64) * vec._MULTIPLIER)
        self.pairs[(key >> np.uint64(64 - self.pair_bits)).astype(np.int64)] = True
        firsts = np.unique(self.words[walks[item] > 0])
        self.first = _Table(firsts, np.zeros(len(firsts), np.int64), np.zeros(len(firsts), np.int64))

    def _walk(self, own: np.ndarray, walk: int) -> list[_Table]:
        """For each sample the keys of one walk from every word of some items."""
        item = np.repeat(own, self.size[own])
        offset = vec.grouped_arange(self.size[own])
        tables = []
        for key, inside in walk_keys(self.words, self.bounds[item] + offset, self.bounds[item + 1], walk):
            tables.append(_Table(key[inside], item[inside], offset[inside]))
        return tables

    def _edited(self, own: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """TRIALS items with as many random edits as allowed, all of a small class by turns; a bounded trial of the keys, not of the corpus."""
        rng = np.random.default_rng(11)
        out = []
        for i in rng.permutation(own)[np.arange(TRIALS) % len(own)]:
            words = self.words[self.bounds[i] : self.bounds[i + 1]].tolist()
            for _ in range(self.edits[i]):
                at = int(rng.integers(len(words)))
                new = int(rng.integers(1, 2**63)) | 1
                kind = rng.integers(3)
                words[at : at + (kind != 0)] = [new] if kind != 1 else []
            out.append((int(i), np.array(words, np.uint64)))
        return out

    def _met(self, words: np.ndarray, item: int, walk: int, tables: list[_Table]) -> bool:
        stop = np.full(len(words), len(words))
        keys = walk_keys(words, np.arange(len(words)), stop, walk)
        for (key, inside), table in zip(keys, tables):
            _, entry = table.meet(key[inside])
            if (table.item[entry] == item).any():
                return True
        return False

    def _pieces(self, own: np.ndarray) -> dict[int, _Table]:
        """Length of a piece -> table of the pieces of that length of some items."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i in own:
            n, k = int(self.size[i]), int(self.edits[i])
            edges = [n * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(edges, edges[1:]):
                key = _run_keys(self.words[self.bounds[i] + a : self.bounds[i] + b], b - a)[0]
                found.setdefault(b - a, []).append((int(key), int(i), a))
        return {n: _Table(np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])) for n, rows in found.items()}

    def candidates(self, words: np.ndarray, stop: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, word at which its window would start, row of the words that met) of every meeting, once each."""
        items, starts, met = [], [], []
        if self.walks:
            at, _ = self.first.meet(words)
            for walk, tables in enumerate(self.walks):
                for (key, inside), table in zip(walk_keys(words, at, stop[at], walk), tables):
                    hit, entry = table.meet(key)
                    hit, entry = hit[inside[hit]], entry[inside[hit]]
                    items.append(table.item[entry])
                    starts.append(at[hit] - table.offset[entry])
                    met.append(at[hit])
        for n, table in self.pieces.items():
            key = _run_keys(words, n)
            hit, entry = table.meet(key)
            good = hit + n <= stop[hit] if len(hit) else np.zeros(0, bool)
            items.append(table.item[entry[good]])
            starts.append(hit[good] - table.offset[entry[good]])
            met.append(hit[good])
        if not items:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        item, start = np.concatenate(items), np.concatenate(starts)
        row = np.searchsorted(bounds, np.concatenate(met), "right") - 1
        # starts that differ by no more than the edits allowed are looked at as one window
        bucket = (start + _SHIFT) // np.maximum(self.edits[item], 1)
        packed = (item << 40) + bucket
        order = np.lexsort((row, packed))
        first = np.ones(len(order), bool)
        first[1:] = (packed[order[1:]] != packed[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
        keep = order[first]
        return item[keep], start[keep], row[keep]

    def plausible(self, item: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the window [low, high) holds so many of the item's words as the edits allowed would leave.

        Membership goes by a bit table of (item, word), which only errs by saying yes.
        """
        size = high - low
        at = np.repeat(low, size) + vec.grouped_arange(size)
        key = vec.mix(words[at] + np.repeat(item, size).astype(np.uint64) * vec._MULTIPLIER)
        held = self.pairs[(key >> np.uint64(64 - self.pair_bits)).astype(np.int64)]
        total = np.concatenate(([0], np.cumsum(held)))
        ends = np.cumsum(size)
        return total[ends] - total[ends - size] >= self.size[item] - self.edits[item]


def _run_keys(words: np.ndarray, n: int) -> np.ndarray:
    """Key of every run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    key = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        key = vec.mix(key + words[k : len(words) - n + 1 + k] * np.uint64(2 * k + 3))
    return key


def least_edits(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end): for each pair the least word edits between the item and any run of the window, and where that run ends.

    One dynamic program for all pairs: a row per item word, vectorised over pairs and window words.
    """
    rows, n_max, m_max = len(items), max(map(len, items)), max(map(len, windows), default=0)
    item = np.zeros((rows, n_max), np.uint64)
    window = np.full((rows, m_max), 2, np.uint64)
    for r, (a, b) in enumerate(zip(items, windows)):
        item[r, : len(a)], window[r, : len(b)] = a, b
    n, m = np.array([len(a) for a in items]), np.array([len(b) for b in windows])
    slope = np.arange(m_max + 1, dtype=np.int32)
    outside = slope[None, :] > m[:, None]
    cost = np.zeros((rows, m_max + 1), np.int32)
    best, end = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i in range(n_max):
        step = np.empty_like(cost)
        step[:, 0] = i + 1
        step[:, 1:] = np.minimum(cost[:, :-1] + (window != item[:, i : i + 1]), cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - slope, axis=1) + slope
        done = np.flatnonzero(n == i + 1)
        if len(done):
            last = np.where(outside[done], np.iinfo(np.int32).max, cost[done])
            end[done] = last.argmin(1)
            best[done] = last[np.arange(len(done)), end[done]]
    return best, end


#: The items whose tables this worker holds, by their block's name; one block at most.
_BUILT: dict[str, Items] = {}


class _Block:
    """A block of items as a broadcast of its words."""

    def __init__(self, spark: SparkSession, items: Items) -> None:
        self.name = uuid.uuid4().hex
        self.sent = spark.sparkContext.broadcast(items.__getstate__())

    def items(self) -> Items:
        if self.name not in _BUILT:
            _BUILT.clear()
            held = Items.__new__(Items)
            held.__setstate__(self.sent.value)
            _BUILT[self.name] = held
        return _BUILT[self.name]


def _matches(items: Items, words: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """(row, item) -> (edits, word after the match) of the best match of each."""
    stop = np.repeat(bounds[1:], np.diff(bounds))
    item, start, row = items.candidates(words, stop, bounds)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    if len(item):
        slack = 2 * items.edits[item] + 1
        low = np.maximum(start - slack, bounds[row])
        high = np.maximum(low, np.minimum(start + items.size[item] + slack, bounds[row + 1]))
        good = np.flatnonzero(items.plausible(item, words, low, high))
        for at in range(0, len(good), 1000):
            some = good[at : at + 1000]
            edits, end = least_edits([items.words[items.bounds[i] : items.bounds[i + 1]] for i in item[some]], [words[a:b] for a, b in zip(low[some], high[some])])
            for i, r, e, z, limit in zip(item[some].tolist(), row[some].tolist(), edits.tolist(), (low[some] + end).tolist(), items.edits[item[some]].tolist()):
                if e <= limit and (e, z) < best.get((r, i), (1 << 60, 0)):
                    best[r, i] = (e, z)
    return best


def _rows(items: Items, ids: list, bounds: np.ndarray, best: dict[tuple[int, int], tuple[int, int]]) -> pa.RecordBatch:
    out = [(ids[r], items.ids[i], int(items.size[i]), e, int(z - bounds[r]), float(items.recall[i])) for (r, i), (e, z) in sorted(best.items())]
    cols = list(zip(*out)) if out else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*[pa.int64()] * 5, pa.float64()])], ["doc_id", "item_id", "item_words", "edits", "end_word", "recall"])


def _found(items: Items, part: pa.RecordBatch) -> pa.RecordBatch:
    words, bounds = word_hashes(part.column(1))
    return _rows(items, part.column(0).to_pylist(), bounds, _matches(items, words, bounds))


def _turns(batches: Iterator[pa.RecordBatch], at: int, blocks: list[_Block]) -> Iterator[tuple[list[tuple], Iterator[Items]]]:
    """Slices of rows as (rows, word hashes, bounds), up to HELD_BYTES together, with the blocks that meet them.

    The block whose tables are held comes first. One block needs no turns, so each slice goes alone.
    """

    def in_turn() -> Iterator[Items]:
        for block in sorted(blocks, key=lambda b: b.name not in _BUILT):
            yield block.items()

    held, size = [], 0
    for batch in batches:
        for part in vec.slices(batch, at):
            words, bounds = word_hashes(part.column(at))
            held.append((part, words, bounds))
            size += part.nbytes + words.nbytes
            if len(blocks) == 1 or size >= HELD_BYTES:
                yield held, in_turn()
                held, size = [], 0
    if held:
        yield held, in_turn()


def _passes(benchmark: DataFrame, similarity: float, recall: float) -> Iterator[list[_Block]]:
    """The benchmark's items as blocks, the blocks of one pass together; the driver holds a block's texts at a time."""
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    held: list[_Block] = []
    for block in range(blocks):
        some = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = some.toArrow()
        held.append(_Block(benchmark.sparkSession, Items(rows.column(0).to_pylist(), rows.column(1).to_pylist(), similarity, recall)))
        if len(held) == PASS_BLOCKS or block == blocks - 1:
            yield held
            held = []


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, item_words, edits, end_word, recall, similarity) of every item that a document holds.

    end_word is the number of words before the end of the best match; recall the share
    of the trial of the item's class of sizes that its keys found, 1 for items met by pieces.
    """
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].alias("text"))
    parts = []
    for blocks in _passes(benchmark, similarity, recall):

        def run(batches, blocks=blocks):
            for held, in_turn in _turns(batches, 1, blocks):
                for items in in_turn:
                    for part, words, bounds in held:
                        yield _rows(items, part.column(0).to_pylist(), bounds, _matches(items, words, bounds))

        parts.append(rows.mapInArrow(vec.lean(run), "doc_id long, item_id long, item_words long, edits long, end_word long, recall double"))
    return reduce(DataFrame.union, parts).withColumn("similarity", 1 - F.col("edits") / F.col("item_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """docs without those that hold an item; a document's verdict is found where its text lies, without a join."""
    names, at = docs.columns, docs.columns.index("text")
    for blocks in _passes(benchmark, similarity, recall):

        def run(batches, blocks=blocks):
            for held, in_turn in _turns(batches, at, blocks):
                clean = [np.ones(part.num_rows, bool) for part, _, _ in held]
                for items in in_turn:
                    for good, (_, words, bounds) in zip(clean, held):
                        good[[row for row, _ in _matches(items, words, bounds)]] = False
                for good, (part, _, _) in zip(clean, held):
                    yield part.filter(pa.array(good)).rename_columns(names)

        docs = store.mapped(docs, vec.lean(run), docs.schema)
    return docs
