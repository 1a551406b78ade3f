"""Operator 1: byte-level BPE encoding and decoding in batched numpy merge rounds.

Words that a worker hasn't met are laid out as one flat array of symbols. Each
round looks up the rank of changed neighbour pairs by binary search over the
sorted pair keys, finds each word's lowest rank, merges all of that pair's
non-overlapping occurrences from the left, and closes the array up. A word
leaves when no pair of it has a rank. (Every merge makes a token of its own, so
a pair that a merge brings about always ranks behind it: merging all
occurrences of a word's best pair at once gives what merging one by one does.)

Defined results: a null text counts as empty; an empty text has no ids; a
special token's string inside a text becomes that token; repeated rows are each
encoded; extra columns, clashing names included, are not read. One text is held
by one task, in memory in proportion to its length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestone.llm import vec

VOCABULARY = "byte_bpe_50k.json"
#: The published pattern that cuts a text before the merges of this vocabulary.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Characters whose class is the same in every Unicode version in use; a text
#: with others is cut by the library's own cutter.
SETTLED = regex.compile(r"[\x00-ԯ؀-ۿऀ-ॿก-ฺ -⁯₠-₿℀-⏿　-ヿ一-龥가-힣！-～\U0001F300-\U0001F64F]*")
CACHED_WORDS = 300_000
_NONE = np.int64(1 << 40)


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """word -> its number; a word met first gets the next number and waits in ``fresh``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, word):
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class ByteBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        letters = byte_letters()
        of_letter = {c: b for b, c in letters.items()}
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        size = max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            if all(c in of_letter for c in token):
                self.token_bytes[i] = bytes(of_letter[c] for c in token)
            else:
                self.token_bytes[i] = token.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self.token_size = np.array([len(b) for b in self.token_bytes], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_body = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._cutter = None
        self._forget()

    def _forget(self) -> None:
        self.known = _Known()
        self.pool = np.zeros(1 << 16, np.int64)
        self.pool_end = 0
        self.word_start = np.zeros(1 << 12, np.int64)
        self.word_size = np.zeros(1 << 12, np.int64)

    # -- cutting ---------------------------------------------------------

    def _cut_plain(self, text: str) -> list[str]:
        if text.isascii() or SETTLED.fullmatch(text):
            return PATTERN.findall(text)
        if self._cutter is None:
            from tokenizers import Tokenizer

            self._cutter = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._cutter.pre_tokenize_str(text)]

    def cut(self, text: str) -> list:
        """Words of a text in order; a special token comes as its id."""
        if self.cut_special is None or not self.cut_special.search(text):
            return self._cut_plain(text)
        out: list = []
        for part in self.cut_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._cut_plain(part)
        return out

    # -- merging ---------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per piece) of pieces that no merge crosses."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces)), sizes)
        done_sym, done_word = [], []
        rank = np.full(len(sym), _NONE)
        if len(sym) > 1:
            inner = np.flatnonzero(word[1:] == word[:-1])
            rank[inner] = self._rank(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            count = np.diff(np.append(first, len(sym)))
            low = np.minimum.reduceat(rank, first)
            over = low == _NONE
            if over.any():
                gone = np.repeat(over, count)
                done_sym.append(sym[gone])
                done_word.append(word[gone])
                stay = ~gone
                sym, word, rank = sym[stay], word[stay], rank[stay]
                low, count = low[~over], count[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, count))
            run = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
            since = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[since % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            stale = np.zeros(len(sym), bool)
            stale[hit] = True
            stale[hit[hit > 0] - 1] = True
            # the symbol before a pair may itself have just been merged away
            before = hit[hit > 1]
            stale[before[~keep[before - 1]] - 2] = True
            sym, word, rank, stale = sym[keep], word[keep], rank[keep], stale[keep]
            at = np.flatnonzero(stale)
            rank[at] = _NONE
            at = at[at + 1 < len(sym)]
            at = at[word[at] == word[at + 1]]
            rank[at] = self._rank(sym[at], sym[at + 1])
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(pieces))

    def _learn(self) -> None:
        fresh = self.known.fresh
        self.known.fresh = []
        at = len(self.known) - len(fresh)
        for k in range(0, len(fresh), 20_000):
            part = fresh[k : k + 20_000]
            ids, sizes = self.merge([b"" if isinstance(w, int) else w.encode() for w in part])
            if any(isinstance(w, int) for w in part):
                lists = np.split(ids, np.cumsum(sizes)[:-1])
                lists = [np.array([w]) if isinstance(w, int) else x for w, x in zip(part, lists)]
                ids, sizes = np.concatenate(lists), np.array([len(x) for x in lists])
            while self.pool_end + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            while at + len(part) > len(self.word_start):
                self.word_start = np.concatenate((self.word_start, np.zeros_like(self.word_start)))
                self.word_size = np.concatenate((self.word_size, np.zeros_like(self.word_size)))
            self.pool[self.pool_end : self.pool_end + len(ids)] = ids
            self.word_start[at : at + len(part)] = self.pool_end + np.cumsum(sizes) - sizes
            self.word_size[at : at + len(part)] = sizes
            self.pool_end += len(ids)
            at += len(part)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text)."""
        if len(self.known) > CACHED_WORDS:
            self._forget()
        numbers, sizes = [], []
        for text in texts:
            cut = self.cut(text)
            number = np.fromiter(map(self.known.__getitem__, cut), np.int64, len(cut))
            numbers.append(number)
            if self.known.fresh:
                self._learn() if len(self.known.fresh) > 20_000 else None
        if self.known.fresh:
            self._learn()
        for number in numbers:
            sizes.append(int(self.word_size[number].sum()))
        number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        size = self.word_size[number]
        ids = self.pool[np.repeat(self.word_start[number], size) + vec.grouped_arange(size)]
        return ids, np.array(sizes, np.int64)

    # -- decoding --------------------------------------------------------

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.token_size[ids]
        return self.token_body[np.repeat(self.token_start[ids], size) + vec.grouped_arange(size)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; broken sequences become U+FFFD."""
        return self.bytes_of(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBPE:
    """One codec a worker and vocabulary."""
    return ByteBPE(path)


def encoded(path: str, batches: Iterator[pa.RecordBatch], text: str, make: Callable) -> Iterator[pa.RecordBatch]:
    """Applies make(codec, slice, texts, ids, ids per text) to slices of the batches."""
    bpe = codec(path)
    for batch in batches:
        for part in vec.slices(batch, text):
            texts = [t or "" for t in part.column(text).to_pylist()]
            yield make(bpe, part, texts, *bpe.encode(texts))


def encode_documents(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every document."""
    path = path or vocabulary_path()

    def make(bpe, part, texts, ids, sizes):
        return pa.RecordBatch.from_arrays([part.column(0), vec.lists(pa.array(ids.astype(np.int32)), sizes)], ["doc_id", "ids"])

    def run(batches):
        yield from encoded(path, batches, text, make)

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].alias(text)).mapInArrow(vec.lean(run), "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""
    path = path or vocabulary_path()

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            texts = [bpe.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(vec.lean(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256, and whether decoding gave the text back.

    Ids and decoded texts live only within a slice, so nothing wide is shuffled or stored.
    """
    path = path or vocabulary_path()

    def make(bpe, part, texts, ids, sizes):
        ends = np.cumsum(sizes)
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        body = bpe.bytes_of(ids)
        body_end = np.cumsum(np.add.reduceat(np.append(bpe.token_size[ids], 0), np.append(ends - sizes, len(ids)))[:-1] * (sizes > 0)) if len(sizes) else []
        rows, at = ([], [], []), 0
        for text_, size, end, to in zip(texts, sizes.tolist(), ends.tolist(), body_end):
            decoded = body[at:to].tobytes().decode("utf-8", "replace")
            rows[0].append(hashlib.sha256(raw[4 * (end - size) : 4 * end]).hexdigest())
            rows[1].append(hashlib.sha256(decoded.encode()).hexdigest())
            rows[2].append(decoded == text_)
            at = to
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(sizes), pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.bool_())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"],
        )

    def run(batches):
        yield from encoded(path, batches, text, make)

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].alias(text)).mapInArrow(
        vec.lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean"
    )
