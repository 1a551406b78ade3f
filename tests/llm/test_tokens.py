"""Operators 1, 6 and 9: against the tokenizers library, and round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, store, token_counts, token_store
from tests.conftest import SF

PIECES = ["a", "B", "The", " ", "  ", "\n", "\t", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "É", "é", "H̱", "Σ", "ΑΣ ", "İ", "ß", "中文", "1", "٣", "!", "…", "​", "՘", "😀", "\x00", "ſ", "\r", "\xa0", "\x1c", "\x85", "Ꟁ", "aaaa", "ed"]


def strings(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 25))) for _ in range(n)]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path(name))
    t.no_padding()
    t.no_truncation()
    return t


def test_settled_characters_have_one_class():
    import regex
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    known = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and bpe.SETTLED.fullmatch(chr(c))]
    for pattern in (r"\p{L}", r"\p{N}", r"\s"):
        cut = Split(Regex(pattern), "removed")
        left = {t for c in range(0, len(known), 5000) for piece, _ in cut.pre_tokenize_str("".join("\x00" + x for x in known[c : c + 5000])) for t in piece}
        own = regex.compile(pattern)
        assert [c for c in known if (own.fullmatch(c) is not None) == (c in left)] == []


def test_bpe_ids_and_text():
    own, lib = bpe.codec(bpe.vocabulary_path()), library(bpe.VOCABULARY)
    texts = strings(1500) + ["", "x" * 5000, "ab" * 3000, "word " * 20000]
    ids, sizes = own.encode(texts)
    for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        want = lib.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want
        assert own.decode(got) == lib.decode(want, skip_special_tokens=False)
    assert own.decode([128, 50256]) == lib.decode([128, 50256], skip_special_tokens=False)


def test_pieces_of_words_are_encoded_once():
    from types import SimpleNamespace

    words, lib, asked = token_store.WordEncoder(bpe.vocabulary_path(token_store.VOCABULARY)), library(token_store.VOCABULARY), []
    model = words.library.model
    words.library = SimpleNamespace(model=SimpleNamespace(tokenize=lambda w: asked.append(w) or model.tokenize(w)))
    texts = ["alpha alpha. (alpha) Alpha,alpha!? it's 'so' 12 1.2.", "", "beta.alpha éa éa. l'éa É中 beta", "gamma. ALPHA gamma"]
    for some in (texts[:3], texts[3:], texts):
        ids, sizes = words.encode(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [lib.encode(t, add_special_tokens=False).ids for t in some]
    assert len(asked) == len(set(asked))


def test_bpe_documents(spark):
    rows = [(1, "hello there"), (1, "hello there"), (2, None), (None, ""), (3, "é" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    back = bpe.decode_documents(bpe.encode_documents(docs))
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert bpe.round_trip(docs.limit(0)).count() == 0
    sums = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    assert sums[2].n_tokens == 0 and sums[2].ids_sha256 == hashlib.sha256(b"").hexdigest() == sums[2].decoded_sha256
    assert all(r.lossless for r in sums.values())


def test_word_encoder():
    own, lib = token_store.encoder(bpe.vocabulary_path(token_store.VOCABULARY)), library(token_store.VOCABULARY)
    texts = strings(1500, 4) + [""]
    ids, sizes = own.encode(texts)
    for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert got.tolist() == lib.encode(text, add_special_tokens=False).ids
    own._trim()
    assert own.encode(["the the cat"])[0].tolist() == lib.encode("the the cat", add_special_tokens=False).ids


def test_token_store(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = [(5, None), (5, "same"), (5, "same"), (None, "first")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    folder = token_store.write_store(docs)
    assert token_store.verify(spark, folder)
    lib = library(token_store.VOCABULARY)
    order = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    sums = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read_sums(spark, folder).collect())
    assert [s[1] for s in sums] == [i for i, _ in order]
    want = {}
    for i, t in order:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [token_store.END_ID], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    got = {}
    at = 0
    for start, i, n, crc in sums:
        assert start == at
        at += n
        got.setdefault(i, []).append((n, crc))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    whole = token_store.read_documents(spark, folder).where("doc_id = 7").first()
    assert whole.ids == lib.encode(dict(order)[7], add_special_tokens=False).ids + [token_store.END_ID]
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("address").distinct().count()


def test_a_changed_chunk_is_noticed(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    folder = token_store.write_store(docs)
    chunks = spark.read.parquet(f"{folder}/chunks")
    bad = chunks.withColumn("payload", F.lit(bytearray(token_store.pack(np.array([1, 2], np.int32)))))
    rows = store.settled(bad, "bad")
    store.discard(spark, f"{folder}/chunks")
    rows.write.parquet(f"{folder}/chunks")
    with pytest.raises(Exception, match="does not match its address"):
        token_store.read_sums(spark, folder).collect()


def test_swapped_recipes_are_noticed(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words here {i}") for i in range(9)], "doc_id long, text string")

    def swapped(docs, write=token_store.write_store):
        folder = write(docs)
        rows = store.settled(spark.read.parquet(f"{folder}/recipes").withColumn("addresses", F.reverse(F.transform("addresses", lambda a: F.sha2(a, 256).cast("binary")))), "bad")
        store.discard(spark, f"{folder}/recipes")
        rows.write.parquet(f"{folder}/recipes")
        return folder

    monkeypatch.setattr(token_store, "write_store", swapped)
    with pytest.raises(ValueError, match="roots"):
        token_store.report(docs)


def test_empty_store(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.report(docs).count() == 0


def test_crc_of_parts():
    raw = bytes(range(256)) * 5
    cuts = [0, 3, 100, 100, 1000, len(raw)]
    parts = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
    after = [len(raw) - b for b in cuts[1:]]
    shifted = token_store.shift_crc(np.array([zlib.crc32(p) for p in parts]), np.array(after))
    assert int(np.bitwise_xor.reduce(shifted)) == zlib.crc32(raw)


def brute_counts(text, own, rule):
    ids = own.encode([text])[0].tolist()
    edges = [0]
    for i, c in enumerate(text):
        if c == "\n" and i + 1 < len(text):
            edges.append(i + 1)
    ends = edges[1:] + [10**9]
    raw = text.encode()
    of_byte = []
    for i, c in enumerate(text):
        of_byte += [i] * len(c.encode())
    out, at = [0] * len(edges), 0
    for t in ids:
        n = len(own.token_bytes[t])
        s, e = of_byte[at], of_byte[at + n - 1] + 1
        at += n
        share = [max(0, min(e, b) - max(s, a)) for a, b in zip(edges, ends)]
        held = [k for k, x in enumerate(share) if x]
        out[{"start": held[0], "end": held[-1], "majority": max(held, key=lambda k: (share[k], -k))}[rule]] += 1
    assert at == len(raw)
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    own = bpe.codec(bpe.vocabulary_path())
    texts = ["", "one\ntwo\n\n\n\nthree", "é\n😀\n", "\n\n", "a\n \n  \nb c"] + strings(60, 5) + ["<|endoftext|>", "a\n<|endoftext|>\n<|endoftext|>b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_counts.count_tokens(docs, rule=rule).collect():
        assert r.section_tokens == brute_counts(texts[r.doc_id], own, rule)
        assert r.n_tokens == sum(r.section_tokens) == r.field_tokens[0]


def test_token_counts_of_fields(spark):
    docs = spark.createDataFrame([(1, "t1", None, "body\nmore"), (2, None, "", None)], "doc_id long, title string, lang string, text string")
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs, ("title", "lang", "text")).collect()}
    assert len(rows[1].field_tokens) == 3 and sum(rows[1].field_tokens) == rows[1].n_tokens
    assert len(rows[1].section_tokens) == 4 and sum(rows[2].section_tokens) == rows[2].n_tokens
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, rule="half")
