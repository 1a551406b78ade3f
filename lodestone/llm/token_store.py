"""Operator 6: token ids in a content-addressed store.

Each document is a stream of ids, closed by an end id. A rolling hash over the
last WINDOW ids cuts the stream into chunks, so equal passages of ids give equal
chunks wherever they stand; a chunk's address is the SHA-256 of its ids. The
store is three tables in the shared folder:

* ``chunks``: address, ids, and the packed ids, once for each address;
* ``recipes``: in ascending doc_id order over its files, each document's
  addresses, number of ids, and place in its file's stream;
* ``manifest``: for each file its first id's place in the whole stream and the
  Merkle root over its documents' leaves (a leaf digests a recipe), with the
  root over all files.

Reading a document back unpacks its chunks, checks every address, and lays them
end to end. A checksum of whole documents needs no payload to move: each chunk
is unpacked once where it lies, and CRC-32 of a concatenation follows from the
parts' by polynomial arithmetic, summed by XOR.

What stands between white space is cut by the vocabulary's own normaliser and
pattern, and each piece encoded by the tokenizers library once a worker (bounded cache); a
text with characters that Unicode versions class differently goes to the
library whole.

Defined results: a null text counts as empty and has the end id only; null
doc_ids come first; rows of one doc_id follow one another by text hash; repeated
rows are each stored as a recipe; an empty table gives an empty store; extra
columns are ignored. One text is held by one task.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import store, vec
from lodestone.llm.bpe import SETTLED, _Known, byte_letters, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
CACHED_WORDS = 400_000
WINDOW = 8
LEAST, MEAN_BITS, MOST = 128, 10, 8192
#: The published pattern that cuts a normalised text into the words of this vocabulary.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


#: Split at by str.split, but no white space to the pattern.
SEPARATORS = regex.compile("[\x1c-\x1f]")


class WordEncoder:
    """The library's ids for whole texts, with a cache of its ids for words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.letters = byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known = _Known()
        self.pool = np.zeros(1 << 16, np.int32)
        self.pool_end = 0
        self.start = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.met = np.zeros(0, np.int64)

    def _trim(self) -> None:
        """Forgets the strings met least, so that half of the cache at most stays."""
        met = np.zeros(len(self.known), np.int64)
        met[: len(self.met)] = self.met
        least = 2
        while (met >= least).sum() > CACHED_WORDS // 2:
            least *= 2
        keep = np.flatnonzero(met >= least)
        strings = list(self.known)
        start, size, pool = self.start[keep], self.size[keep], self.pool
        self._forget()
        self.known.update(zip(map(strings.__getitem__, keep.tolist()), range(len(keep))))
        self.pool = np.resize(pool[np.repeat(start, size) + vec.grouped_arange(size)], max(1 << 16, int(size.sum())))
        self.pool_end = int(size.sum())
        self.start = np.resize(np.cumsum(size) - size, max(1 << 12, len(size)))
        self.size = np.resize(size, max(1 << 12, len(size)))
        self.met = met[keep] // 2

    def _learn(self) -> None:
        """Ids of the strings met first: matches of the pattern from the library, each once; longer strings from those of their matches."""
        known, at = self.known, len(self.known) - len(self.known.fresh)
        single, longer, pieces, count = [], [], [], []
        for number, string in enumerate(list(known.fresh), at):
            found = None if string.isalpha() else PATTERN.findall(string)
            if found is None or found == [string]:
                single.append(number)
            else:
                longer.append(number)
                pieces += map(known.__getitem__, found)
                count.append(len(found))
        fresh, known.fresh = known.fresh, []
        single += range(at + len(single) + len(longer), len(known))  # pieces that were no string themselves
        while len(known) > len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
            self.size = np.concatenate((self.size, np.zeros_like(self.size)))
        tokenize, letters = self.library.model.tokenize, self.letters
        # printable ASCII stands for itself among the byte letters
        plain = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letters) for w in (fresh[k - at] for k in single)]
        ids, size = [], []
        for w in plain:
            found = [t.id for t in tokenize(w)]
            ids += found
            size.append(len(found))
        self._keep(np.array(single, np.int64), np.array(ids, np.int32), np.array(size, np.int64))
        if longer:
            part = np.array(pieces, np.int64)
            each = self.size[part]
            ids = self.pool[np.repeat(self.start[part], each) + vec.grouped_arange(each)]
            ends = np.concatenate(([0], np.cumsum(each)))[np.cumsum(count)]
            self._keep(np.array(longer, np.int64), ids, np.diff(ends, prepend=0))

    def _keep(self, numbers: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Adds to the pool the ids of the strings of these numbers, so many of each."""
        while self.pool_end + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.pool_end : self.pool_end + len(ids)] = ids
        self.start[numbers] = self.pool_end + np.cumsum(size) - size
        self.size[numbers] = size
        self.pool_end += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text)."""
        if len(self.known) > CACHED_WORDS:
            self._trim()
        parts: list[np.ndarray | None] = []
        whole: dict[int, np.ndarray] = {}
        for k, text in enumerate(texts):
            if not (text.isascii() or SETTLED.fullmatch(text)) or SEPARATORS.search(text) or (self.special is not None and self.special.search(text)):
                whole[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
                parts.append(None)
                continue
            if not text.isascii():
                # the library lower-cases one character at a time, so sigma has no final form
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            # no word of the pattern holds white space, so what stands between is encoded by itself
            words = text.lower().split()
            parts.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
        if self.known.fresh:
            self._learn()
        number = np.concatenate([np.zeros(0, np.int64), *(p for p in parts if p is not None)])
        met = np.bincount(number, minlength=len(self.known))
        met[: len(self.met)] += self.met
        self.met = met
        if not whole:
            size = self.size[number]
            ids = self.pool[np.repeat(self.start[number], size) + vec.grouped_arange(size)]
            ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
            return ids, np.diff(np.concatenate(([0], np.cumsum(size)))[ends], prepend=0)
        out = []
        for k, number in enumerate(parts):
            if number is None:
                out.append(whole[k])
            else:
                size = self.size[number]
                out.append(self.pool[np.repeat(self.start[number], size) + vec.grouped_arange(size)])
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# -- chunks ---------------------------------------------------------------------


def cut(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of chunks within streams that end at ``ends``: where a rolling hash of the last WINDOW ids has MEAN_BITS zero bits.

    A chunk has LEAST ids at least (but for a stream's last) and MOST at most.
    """
    h = np.zeros(len(ids), np.uint64)
    seed = vec.mix(ids.astype(np.uint64) + np.uint64(1))
    for back in range(min(WINDOW, len(ids))):
        h[back:] += seed[: len(ids) - back] * np.uint64(pow(int(vec._MULTIPLIER), back, 1 << 64))
    marks = np.flatnonzero((vec.mix(h) & np.uint64((1 << MEAN_BITS) - 1)) == 0) + 1
    out = []
    begin, m = 0, 0
    marks = marks.tolist()
    for end in ends.tolist():
        at = begin
        while m < len(marks) and marks[m] <= begin:
            m += 1
        while at < end:
            while m < len(marks) and marks[m] < at + LEAST:
                m += 1
            stop = min(marks[m] if m < len(marks) else end, at + MOST, end)
            out.append(stop)
            at = stop
        begin = end
    return np.array(out, np.int64)


def pack(ids: np.ndarray) -> bytes:
    """One byte of width, then the ids at that width, compressed."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + _packer().compress(ids.astype(f"<u{width}").tobytes())


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(_unpacker().decompress(payload[1:]), f"<u{payload[0]}").astype("<u4")


@lru_cache(maxsize=1)
def _packer():
    return zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False)


@lru_cache(maxsize=1)
def _unpacker():
    return zstandard.ZstdDecompressor()


# -- CRC-32 of concatenations ----------------------------------------------------

#: The reflected CRC-32 polynomial, a fixed value.
_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the polynomial, bit-reflected."""
    a, b = np.broadcast_arrays(a, b)
    out = np.zeros(a.shape, np.uint64)
    b = b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), _POLY, np.uint64(0))
    return out


@lru_cache(maxsize=1)
def _doublings() -> list[np.ndarray]:
    """x^(8 * 2^k) for k = 0.."""
    out = [np.array([1 << 23], np.uint64)]
    for _ in range(40):
        out.append(_times(out[-1], out[-1]))
    return out


def shift_crc(crc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What parts with these CRC-32s add, by XOR, to that of a whole in which so many bytes follow them."""
    crc, count = crc.astype(np.uint64), count.astype(np.int64)
    for k in range(int(count.max(initial=0)).bit_length()):
        at = np.flatnonzero((count >> k) & 1)
        crc[at] = _times(crc[at], _doublings()[k])
    return crc


# -- Merkle tree ------------------------------------------------------------------


class Merkle:
    """Root over leaves as they come: subtrees of equal size are joined, in memory logarithmic in the leaves."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        node = (0, hashlib.sha256(b"\0" + leaf).digest())
        while self.stack and self.stack[-1][0] == node[0]:
            node = (node[0] + 1, hashlib.sha256(b"\1" + self.stack.pop()[1] + node[1]).digest())
        self.stack.append(node)

    def root(self) -> bytes:
        if not self.stack:
            return hashlib.sha256(b"").digest()
        node = self.stack[-1][1]
        for _, left in reversed(self.stack[:-1]):
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


def leaf(size: int, addresses: list[bytes]) -> bytes:
    return hashlib.sha256(size.to_bytes(8, "little") + b"".join(addresses)).digest()


# -- the store ----------------------------------------------------------------------


def write_store(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, id_column: str = "doc_id", text: str = "text") -> str:
    """Encodes docs and writes the store; returns its folder."""
    spark = docs.sparkSession
    folder = folder or store.fresh(spark, "token-store")
    path = path or vocabulary_path(VOCABULARY)

    def run(batches):
        words = encoder(path)
        for batch in batches:
            for part in vec.slices(batch, "text", 1 << 20):
                yield _chunked(words, part, end_id)

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].alias("text"))
    staged = f"{folder}/staged"
    rows.mapInArrow(vec.lean(run), "doc_id long, tie long, n long, addresses array<binary>, sizes array<int>, payloads array<binary>").write.option("compression", "none").parquet(staged)
    stage = spark.read.parquet(staged)
    each = stage.select(F.explode(F.arrays_zip("addresses", "sizes", "payloads")).alias("c"))
    unique = each.select(F.col("c.addresses").alias("address"), F.col("c.sizes").alias("n"), F.col("c.payloads").alias("payload")).dropDuplicates(["address"])
    unique.write.option("compression", "none").parquet(f"{folder}/chunks")

    def placed(batches):
        number = TaskContext.get().partitionId()
        tree, at, last = Merkle(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(1).to_numpy()
            for n, addresses in zip(sizes.tolist(), batch.column(2).to_pylist()):
                tree.add(leaf(n, addresses))
            begin = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            if last is not None:
                yield last
            last = _with_place(batch, number, begin, None, at)
        if last is not None:
            yield _with_place(last, number, None, tree.root(), at)

    order = stage.select("doc_id", "n", "addresses", "sizes", "tie")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = order.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "tie").drop("tie")
    order.mapInArrow(vec.lean(placed), "doc_id long, n long, addresses array<binary>, sizes array<int>, file int, at long, root binary, total long").write.parquet(f"{folder}/recipes")
    store.discard(spark, staged)
    store.release(spark)
    # one row a file of recipes, as many as partitions
    recipes = spark.read.parquet(f"{folder}/recipes")
    tops = sorted(recipes.where(F.col("root").isNotNull()).select("file", "root", "total").collect(), key=lambda r: r["file"])
    tree, base, lines = Merkle(), 0, []
    for r in tops:
        tree.add(bytes(r["root"]))
        lines.append((r["file"], base, r["total"], bytes(r["root"])))
        base += r["total"]
    manifest = spark.createDataFrame([(*x, tree.root()) for x in lines], "file int, base long, total long, root binary, whole binary")
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


def _with_place(batch: pa.RecordBatch, number: int, begin, root: bytes | None, total: int) -> pa.RecordBatch:
    n = batch.num_rows
    cols = list(batch.columns[:4])
    cols.append(pa.array(np.full(n, number, np.int32)))
    cols.append(pa.array(begin) if begin is not None else batch.column(5))
    cols.append(pa.array([None] * (n - 1) + [root], pa.binary()))
    cols.append(pa.array([None] * (n - 1) + [total], pa.int64()))
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "addresses", "sizes", "file", "at", "root", "total"])


def _chunked(words: WordEncoder, part: pa.RecordBatch, end_id: int) -> pa.RecordBatch:
    texts = [t or "" for t in part.column(1).to_pylist()]
    raw, sizes = words.encode(texts)
    sizes = sizes + 1
    ends = np.cumsum(sizes)
    ids = np.full(int(ends[-1]), end_id, np.int32)
    inner = np.ones(len(ids), bool)
    inner[ends - 1] = False
    ids[inner] = raw
    stops = cut(ids, ends)
    starts = np.concatenate(([0], stops[:-1]))
    body = memoryview(ids.astype("<u4")).cast("B")
    addresses = [hashlib.sha256(body[4 * a : 4 * b]).digest() for a, b in zip(starts.tolist(), stops.tolist())]
    payloads = [pack(ids[a:b]) for a, b in zip(starts.tolist(), stops.tolist())]
    count = np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(texts))
    tie = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little", signed=True) for t in texts]
    return pa.RecordBatch.from_arrays(
        [
            part.column(0),
            pa.array(tie, pa.int64()),
            pa.array(sizes),
            vec.lists(pa.array(addresses, pa.binary()), count),
            vec.lists(pa.array((stops - starts).astype(np.int32)), count),
            vec.lists(pa.array(payloads, pa.binary()), count),
        ],
        ["doc_id", "tie", "n", "addresses", "sizes", "payloads"],
    )


def chunk_sums(spark: SparkSession, folder: str) -> DataFrame:
    """(address, ids, crc) of every stored chunk, unpacked and held against its address."""

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for address, n, payload in zip(*[c.to_pylist() for c in batch.columns]):
                raw = unpack(payload).tobytes()
                if hashlib.sha256(raw).digest() != address or len(raw) != 4 * n:
                    raise ValueError("a chunk does not match its address")
                out[0].append(address)
                out[1].append(n)
                out[2].append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["address", "ids", "crc"])

    chunks = spark.read.parquet(f"{folder}/chunks").select("address", F.col("n").cast("long").alias("n"), "payload")
    return chunks.mapInArrow(vec.lean(run), "address binary, ids long, crc long")


def read_sums(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks) of every document, from the files."""
    recipes = spark.read.parquet(f"{folder}/recipes").select("doc_id", "n", "addresses", "sizes", "file", "at")
    base = F.broadcast(spark.read.parquet(f"{folder}/manifest").select("file", "base"))  # one row a file
    docs = recipes.join(base, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n", "addresses", "sizes")
    # ids after each chunk: the document's less the running sum
    running = F.aggregate(
        "sizes",
        F.struct(F.col("n").alias("left"), F.array().cast("array<bigint>").alias("all")),
        lambda a, s: F.struct((a["left"] - s).alias("left"), F.array_append(a["all"], a["left"] - s).alias("all")),
        lambda a: a["all"],
    )
    refs = docs.select("doc_id", "start", "n", F.explode(F.arrays_zip("addresses", running.alias("after"))).alias("c"))
    refs = refs.select("doc_id", "start", "n", F.col("c.addresses").alias("address"), F.col("c.after").alias("after"))
    met = refs.join(chunk_sums(spark, folder), "address").select("doc_id", "start", "n", "crc", "after", "ids")

    def run(batches):
        for batch in vec.gathered(batches):
            crc = shift_crc(batch.column(3).to_numpy(), 4 * batch.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc.astype(np.int64)), batch.column(5)], ["doc_id", "start", "n", "part", "ids"])

    parts = met.mapInArrow(vec.lean(run), "doc_id long, start long, n long, part long, ids long")
    sums = parts.groupBy("doc_id", "start", "n").agg(F.bit_xor("part").alias("ids_crc32"), F.sum("ids").alias("read"), F.count(F.lit(1)).alias("n_chunks"))
    whole = F.when(F.col("read") == F.col("n"), F.col("n")).otherwise(F.raise_error(F.lit("a document's chunks do not add up")).cast("long"))
    return sums.select("doc_id", "start", whole.alias("n_tokens"), "ids_crc32", "n_chunks")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids array<int>): the documents' ids, from their chunks."""
    recipes = spark.read.parquet(f"{folder}/recipes").select("doc_id", "addresses", "file", "at")
    base = F.broadcast(spark.read.parquet(f"{folder}/manifest").select("file", "base"))
    refs = recipes.join(base, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), F.posexplode("addresses").alias("k", "address"))
    met = refs.join(spark.read.parquet(f"{folder}/chunks").select("address", "payload"), "address")
    rows = met.groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("k", "payload"))).alias("c")).select("doc_id", "start", F.col("c.payload").alias("payloads"))

    def run(batches):
        for batch in batches:
            lists = [np.concatenate([unpack(p) for p in payloads]).astype(np.int32) for payloads in batch.column(2).to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            ids = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vec.lists(pa.array(ids), sizes)], ["doc_id", "start", "ids"])

    return rows.mapInArrow(vec.lean(run), "doc_id long, start long, ids array<int>")


def verify(spark: SparkSession, folder: str) -> bool:
    """Whether the recipes give the manifest's roots; a file's recipes are read in order by one task."""

    def run(batches):
        file, tree = None, Merkle()
        for batch in batches:
            for f, n, addresses in zip(*[c.to_pylist() for c in batch.columns]):
                if file is not None and f != file:
                    yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([tree.root()], pa.binary())], ["file", "found"])
                    tree = Merkle()
                file = f
                tree.add(leaf(n, addresses))
        if file is not None:
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([tree.root()], pa.binary())], ["file", "found"])

    recipes = spark.read.parquet(f"{folder}/recipes").repartition("file").sortWithinPartitions("file", "at").select("file", "n", "addresses")
    found = recipes.mapInArrow(vec.lean(run), "file int, found binary")
    manifest = spark.read.parquet(f"{folder}/manifest")
    bad = manifest.join(found, "file", "left").where(~F.col("root").eqNullSafe(F.col("found"))).count()
    tops = manifest.orderBy("file").select("root", "whole").collect()
    tree = Merkle()
    for r in tops:
        tree.add(bytes(r["root"]))
    return bad == 0 and all(bytes(r["whole"]) == tree.root() for r in tops)


def report(docs: DataFrame) -> DataFrame:
    """Writes the store and returns what its files say of each document, once its recipes have given the manifest's roots."""
    folder = write_store(docs)
    if not verify(docs.sparkSession, folder):
        raise ValueError("the recipes do not give the manifest's roots")
    return read_sums(docs.sparkSession, folder)
