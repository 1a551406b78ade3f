"""Operators 2, 3, 7 and 10, components, and the pipeline, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, graph, line_dedup, prefixes, simhash, store, substring_dedup
from lodestone.llm import pipeline as corpus_pipeline
from tests.conftest import SF


def least_of(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def words_text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


# -- components ---------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(6, 40)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(80)] + [(7, 7)]
    links = [(a, b) for a, b in links if a != b]
    df = spark.createDataFrame(links + [(b, a) for a, b in links[:9]], "x long, y long")
    assert {r.node: r.component for r in graph.components(df, "x", "y").collect()} == {x: r for x, r in least_of(links).items() if x != r}
    assert graph.components(df.limit(0), "x", "y").count() == 0


# -- simhash -------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_rows(rng):
    base = words_text(rng, 60).split()
    rows = [(0, None), (1, "  \n"), (2, "one"), (3, "ONE"), (4, "one two"), (5, "é ß"), (None, "one")]
    for i in range(6, 60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(i, words_text(rng, 40)) for i in range(60, 120)] + [(6, rows[12][1])]
    return rows


def test_simhash(spark):
    rows = simhash_rows(random.Random(2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(0))
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.report(docs).collect()]
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in fps})
    root = least_of([(a, b) for a in distinct for b in distinct if (a ^ b).bit_count() <= 3])
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = [(i, f"{f:016x}", least.get(root[f])) for i, f in fps]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tau", [0, 1, 3, 5])
def test_pairs_are_complete(spark, tau):
    rng = np.random.default_rng(tau)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(6)]
    # many share most of their bits: one value of a partition is heavy
    heavy = [0xABCDEF0000000000 | int(x) for x in rng.integers(0, 2**34, 400)]
    values = np.unique(np.array(near + heavy, np.uint64)).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in values], "fp long")
    u = values.view(np.uint64)
    want = {(min(a, b), max(a, b)) for i, x in enumerate(u) for j in np.flatnonzero(np.bitwise_count(x ^ u) <= tau) if j > i for a, b in [(int(values[i]), int(values[j]))]}
    assert {(r.a, r.b) for r in simhash.near_pairs(df, tau).collect()} == want


def test_thresholds():
    cost, picks = simhash.allocate([[0, 5, 90, 900], [0, 50, 60, 70], [0, 5, 9, 900]], 1)
    assert sum(picks) == 1 and cost == min(sum(c[t + 1] for c, t in zip([[0, 5, 90, 900], [0, 50, 60, 70], [0, 5, 9, 900]], (i, j, 1 - i - j))) for i in range(-1, 3) for j in range(-1, 3) if -1 <= 1 - i - j <= 2)
    assert simhash.ball(16, 2) == 1 + 16 + 120 and simhash.ball(5, -1) == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_copy_rows(rng):
    rows = []
    for g in range(12):
        base = words_text(rng, 120).split()
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = words_text(rng, 1)
            rows.append(" ".join(w))
    rows += [words_text(rng, 30) for _ in range(60)] + ["", None, "  ", "x", "x"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_copies(spark):
    rows = near_copy_rows(random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit("clash"))
    s = [shingles(t) for _, t in rows]
    same = lambda a, b: s[a] == s[b] == set() or (s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if same(a, b)]
    want = {x for x, r in least_of(links).items() if x != r}
    kept = simhash.keep_one(docs)
    gone = {i for i, _ in rows} - {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns
    assert gone <= want, "no document without a partner goes"
    assert len(gone) >= 0.9 * len(want)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def plain_near_copies(rows):
    s = [shingles(t) for _, t in rows]
    same = lambda a, b: s[a] == s[b] == set() or (s[a] and s[b] and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if same(a, b)]
    return {(rows[x][0], rows[r][0]) for x, r in least_of(links).items() if x != r}


def test_near_copies_come_from_fingerprints(spark, monkeypatch):
    """With nothing from the join of rare shingles, the stage drops the copies within 3 bits, and those only."""
    rng, rows = random.Random(14), []
    for g in range(40):
        w = words_text(rng, 250).split()
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w[:90] + ["changed"] * (1 + g % 12) + w[90:]))]
    near = {2 * g + 1 for g in range(40) if (plain_fingerprint(rows[2 * g][1]) ^ plain_fingerprint(rows[2 * g + 1][1])).bit_count() <= 3}
    assert near < {x for x, _ in plain_near_copies(rows)} and len(near) > 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "_first_met", lambda classes, *rest: spark.createDataFrame([], "a long, b long, word int"))
    assert {i for i, _ in rows} - {r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, SF).collect()} == near


def test_fingerprint_comparisons_follow_the_sets(spark):
    """40 fingerprints near one another, and 50 sets of one fingerprint: no comparison of all pairs."""
    rows = [(100 + i, sum(1 << b for b in bits)) for i, bits in enumerate([(b,) for b in range(20)] + [(b, 30) for b in range(20)])] + [(i, 0) for i in range(50)]
    got = {(r.a, r.b) for r in simhash._near_sets(spark.createDataFrame(rows, "sid long, fp long"), 3).collect()}
    assert {(0, i) for i in range(1, 50)} <= got and len(got) <= 49 + 2 * 40
    assert {b for _, b in got} == {i for i, _ in rows} - {0}


def cut_copy_rows(rng):
    """Copies with a passage added or cut off, near Jaccard 0.8 on either side."""
    rows = []
    for _ in range(40):
        base = words_text(rng, 200).split()
        rows += [base, base + words_text(rng, rng.randint(30, 60)).split(), base[: rng.randint(150, 175)]]
    # one group by way of its base only
    base = words_text(rng, 100).split()
    rows += [base] + [base + words_text(rng, 20).split() for _ in range(25)]
    rows = [" ".join(w) for w in rows]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("probes", [1, 4])
@pytest.mark.parametrize("list_rows", [4000, 3])
def test_near_copies_with_passages_added_or_cut(spark, probes, list_rows, monkeypatch):
    monkeypatch.setattr(simhash, "PROBES", probes)
    monkeypatch.setattr(prefixes, "LIST_ROWS", list_rows)
    rows = cut_copy_rows(random.Random(11))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc, r.least) for r in simhash.near_copies(docs).collect()} == plain_near_copies(rows)


def test_near_copies_of_one_word_set(spark):
    rng = random.Random(12)
    sentences = [" ".join(f"w{12 * k + i}" for i in range(12)) for k in range(25)]
    a = " ".join(sentences)
    rng.shuffle(sentences)
    b = " ".join(sentences)
    rows = [(1, a), (2, b), (3, b.replace("w5 ", "other ")), (4, " ".join(reversed(a.split()))), (5, b + " w0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc, r.least) for r in simhash.near_copies(docs).collect()}
    assert got == plain_near_copies(rows) == {(3, 2), (5, 2)}


def test_near_copies_of_rows_that_share_an_id(spark):
    rng = random.Random(13)
    a, b, c = (words_text(rng, 50) for _ in range(3))
    rows = [(5, a), (7, a), (7, b), (None, c), (None, b + " more"), (None, None), (9, c), (9, c), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("clash"))
    # of a the row of 5 stays, of b and c the null id's, of texts without words the null one
    assert sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=repr) == sorted([(5, a), (None, b + " more"), (None, c), (None, None)], key=repr)


# -- lines ---------------------------------------------------------------------


def plain_removed(rows, t=0.8):
    """(doc, text) -> numbers of the lines that go."""
    lines = {(i if i is not None else -(2**63), k, text, frozenset(w.lower() for w in x.encode().split())) for i, text in rows for k, x in enumerate((text or "").split("\n"))}
    lines = sorted((r for r in lines if r[3]), key=lambda r: r[:2])
    gone = {}
    for n, (i, k, text, s) in enumerate(lines):
        if any(len(s & z) >= t * len(s | z) for *_, z in lines[:n]):
            gone.setdefault((i, text), set()).add(k)
    return {i: sorted(v) for i, v in gone.items()}


def plain_kept(rows):
    """Rows without the lines that go."""
    gone = plain_removed(rows)
    return sorted(((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i if i is not None else -(2**63), t), ()))) for i, t in rows), key=repr)


def line_rows(rng):
    pool = [words_text(rng, rng.randint(4, 60)) for _ in range(30)]
    rows = []
    for i in range(80):
        out = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(pool).split()
            for _ in range(rng.choice([0, 0, 1, 1, 3, 8])):
                w[rng.randrange(len(w))] = words_text(rng, 1)
            out.append(" ".join(w))
        rows.append((i, "\n".join(out)))
    # a family of variants larger than the probes of one list
    family = words_text(rng, 40).split()
    rows += [(100 + i, " ".join(family[:39] + [f"v{i}"])) for i in range(30)]
    return rows + [(200, None), (201, ""), (202, "a b c d"), (203, "a b c d"), (None, pool[0]), (300, "é " * 5 + "ü ö ä à"), (301, "É " * 5 + "ü ö ä à")]


def removed(docs, rows):
    """removed_lines by document and text; texts by their hash."""
    texts = {(r.d, r.h): r.t for r in docs.select(*(c.alias(n) for c, n in zip(store.doc_key(), "dh")), docs["text"].alias("t")).collect()}
    return {(r.doc, texts[r.doc, r.hash]): r.lines for r in line_dedup.removed_lines(docs).collect()}


@pytest.mark.parametrize("probes, list_rows", [(4, 4000), (1, 4000), (4, 6), (1, 3)])
def test_lines(spark, probes, list_rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "PROBES", probes)
    monkeypatch.setattr(prefixes, "LIST_ROWS", list_rows)
    rows = line_rows(random.Random(7))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("n_chars", F.length("text").cast("long")).withColumn("hash", F.lit("clash"))
    assert removed(docs, rows) == plain_removed(rows)
    left = line_dedup.remove_lines(docs)
    assert left.columns == docs.columns
    got = left.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == plain_kept(rows)
    assert all(r.n_chars == len(r.text or "") for r in got)
    assert line_dedup.removed_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("list_rows", [4000, 20])
def test_lines_that_share_a_frequent_word(spark, list_rows, monkeypatch):
    monkeypatch.setattr(prefixes, "LIST_ROWS", list_rows)
    rng = random.Random(3)
    # the rarest words of every line are among three, so each is sent by a third of all lines
    common = [f"c{i}" for i in range(40)]
    texts = [" ".join(["hot", f"warm{i % 3}", *rng.sample(common, rng.randint(2, 9))]) for i in range(400)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(docs, rows) == plain_removed(rows)


def test_lines_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.removed_lines for r in line_dedup.report(docs).collect()}
    assert got == {i: v for (i, _), v in plain_removed([(r.doc_id, r.text) for r in docs.collect()]).items()}


def test_short_lines(spark):
    long = "one two three four five six seven eight nine ten"
    rows = line_rows(random.Random(8)) + [(400, f"All rights reserved.\n{long}\n\n語語語語語語語語語語語語"), (401, f"{long} x\nall rights  reserved.\n語語語語語語語語語語語語\nreserved. all\nla la la la la la"), (402, "la la\n  \nnew"), (403, "w x y z\nv w x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    want = plain_removed(rows)
    by_doc = {i: v for (i, _), v in want.items()}
    assert by_doc[401] == [0, 1, 2] and by_doc[402] == [0] and by_doc[203] == [0] and by_doc[403] == [1]
    assert removed(docs, rows) == want
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.dedup_lines(spark, docs, SF).collect()), key=repr) == plain_kept(rows)


def test_lines_of_rows_that_share_an_id(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    unique = "three wholly unique words that nobody repeats ever"
    rows = [(None, f"{a}\n{b}"), (None, f"{unique} x\nshort\n{a}"), (None, None), (None, None), (7, f"{b}\n{unique}"), (7, "only here and nowhere else at all"), (7, f"first of this row\n\n{b}"), (8, f"{a}\n{b}"), (8, f"{a}\n{b}"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in line_dedup.remove_lines(docs).collect()), key=repr) == plain_kept(rows)


def test_lines_far_apart_in_one_text():
    filters = line_dedup._Filters("0.8")
    rank = np.arange(1 << prefixes.COUNTER_BITS, dtype=np.uint32)
    far = (1 << 22) + 3
    text = "a b c d e f" + "\n" * far + "g h i j k l"
    part = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["_doc", "_hash", "text"])
    out = line_dedup._sets_of(part, rank, filters)
    assert out.column(2).to_pylist() == [0, far] and out.column(4).to_pylist() == [6, 6]


# -- spans ---------------------------------------------------------------------


def plain_sentences(text):
    out = []
    for line in (text or "").encode().split(b"\n"):
        cur = []
        for w in line.split():
            cur.append(w.lower())
            if re.search(rb"([.!?]|\xe2\x80\xa6)$", w):
                out.append(cur)
                cur = []
        if cur:
            out.append(cur)
    return out


def plain_covered(rows):
    """(doc, text) -> sentences that go. Which of a document's rows of one id comes first is left to the texts' hash."""
    least, alone = substring_dedup.LEAST_WORDS, substring_dedup.ALONE_WORDS
    met = {}
    for i, text in {(i if i is not None else -(2**63), t) for i, t in rows}:
        s = plain_sentences(text)
        size = [len(x) for x in s]
        spans = {(k, 1) for k in range(len(s)) if size[k] >= alone}
        for k in range(len(s)):
            if size[k] < alone:
                spans |= {(k, c) for c in range(2, len(s) - k + 1) if sum(size[k : k + c]) >= least and (c == 2 or sum(size[k : k + c - 1]) < least)}
                spans |= {(k + 1 - c, c) for c in range(2, k + 2) if sum(size[k + 1 - c : k + 1]) >= least and (c == 2 or sum(size[k + 2 - c : k + 1]) < least)}
        for k, c in spans:
            met.setdefault(b" ".join(sum(s[k : k + c], [])), set()).add((i, text, k, c))
    gone = {}
    for v in met.values():
        for i, text, k, c in sorted(v, key=lambda x: (x[0], x[2]))[1:]:
            gone.setdefault((i, text), set()).update(range(k, k + c))
    return {i: sorted(v) for i, v in gone.items()}


def test_spans(spark):
    rng = random.Random(9)
    sentence = lambda n: words_text(rng, n).capitalize() + rng.choice([".", "!", "?", "…", "\n"])
    passage = " ".join(sentence(12) for _ in range(5))
    alone = words_text(rng, 60) + "."
    rows = [(i, " ".join(sentence(rng.randint(3, 15)) for _ in range(6))) for i in range(40)]
    rows = [(i, t + " " + (passage if i % 7 == 0 else "") + " Tail here. " + (alone if i % 9 == 0 else "")) for i, t in rows]
    rows += [(50, None), (51, ""), (52, "  "), (53, passage + "\n" + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1))
    texts = dict(rows)
    got = {r.doc: r.sentences for r in substring_dedup.covered(docs).collect()}
    assert {(i, texts[i]): v for i, v in got.items()} == plain_covered(rows)
    assert 53 in got and 0 not in got
    cleaned = {r.doc_id: r.text for r in substring_dedup.remove_spans(docs).collect()}
    for i, text in rows:
        left = [s for k, s in enumerate(plain_sentences(text)) if k not in got.get(i, ())]
        assert plain_sentences(cleaned[i]) == left
        if i not in got:
            assert cleaned[i] == text
    assert substring_dedup.report(docs.limit(0)).count() == 0


def test_spans_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.removed_sentences for r in substring_dedup.report(docs).collect()}
    assert got == {i: v for (i, _), v in plain_covered([(r.doc_id, r.text) for r in docs.collect()]).items()}


def test_spans_of_rows_that_share_an_id(spark):
    rng = random.Random(10)
    passage = " ".join(words_text(rng, 12) + "." for _ in range(3))
    rows = [(1, passage), (1, "Short. Text."), (2, passage + " End here."), (2, "One. Two. Three."), (None, None), (None, "x"), (3, passage), (3, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    left = [(r.doc_id, r.text, r.n_chars) for r in substring_dedup.remove_spans(docs).collect()]
    want = [(1, passage), (1, "Short. Text."), (2, "End here."), (2, "One. Two. Three."), (None, None), (None, "x"), (3, ""), (3, "")]
    assert sorted(left, key=repr) == sorted([(i, t, len(t or "")) for i, t in want], key=repr)


# -- decontamination -----------------------------------------------------------


def plain_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def plain_words(text):
    out = []
    for w in (text or "").split():
        bare = w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        out.append((bare or w).lower())
    return out


def test_least_edits():
    rng = np.random.default_rng(3)
    items = [rng.integers(3, 9, rng.integers(1, 12)).astype(np.uint64) for _ in range(60)]
    texts = [rng.integers(3, 9, rng.integers(0, 20)).astype(np.uint64) for _ in range(60)]
    edits, _ = decontaminate.least_edits(items, texts)
    assert edits.tolist() == [plain_edits(a.tolist(), b.tolist()) for a, b in zip(items, texts)]


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, words_text(rng, n)) for i, n in enumerate([1, 2, 3, 5, 6, 7, 8, 13, 20, 30, 40, 60] * 2)] + [(98, None), (99, "")]
    rows = []
    for d in range(150):
        i, text = rng.choice(items[:24])
        w = text.split()
        for _ in range(rng.randint(0, int(len(w) * 0.3))):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = [words_text(rng, 1)] * rng.randint(0, 1)
        shown = " ".join(w)
        rows.append((d, words_text(rng, rng.randint(0, 30)) + " " + (shown.upper() if d % 5 == 0 else shown + ",") + " " + words_text(rng, rng.randint(0, 30))))
    rows += [(200, None), (201, ""), (None, items[9][1]), (202, items[8][1]), (202, items[8][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(docs, bench).collect()}
    want = {}
    for d, text in rows:
        w = plain_words(text)
        for i, item in items:
            x = plain_words(item)
            if x:
                e = plain_edits(x, w)
                if e <= decontaminate.allowed(len(x), 0.8):
                    want[d, i] = e
    assert set(got) <= set(want)
    assert all(got[k] == want[k] for k in got)
    assert len(got) >= 0.97 * len(want)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert kept.columns == docs.columns
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_every_class_of_sizes_is_found(spark):
    rng = random.Random(6)
    sizes = [8] * 40 + [9] * 40 + [11] * 40 + [14] * 20 + [60] * 200
    items = [words_text(rng, n) for n in sizes]
    held = decontaminate.Items(list(range(len(items))), items, 0.8, 0.97)
    assert all(r >= 0.97 for r in held.recall)
    found = 0
    for i, text in enumerate(items):
        w = text.split()
        for _ in range(decontaminate.allowed(len(w), 0.8)):
            w[rng.randrange(len(w))] = words_text(rng, 1)
        part = pa.RecordBatch.from_arrays([pa.array([i]), pa.array([" ".join(w)])], ["doc_id", "text"])
        found += i in decontaminate._found(held, part).column(1).to_pylist()
    assert found >= 0.95 * len(items)


def test_a_class_short_of_recall_goes_by_pieces(spark, monkeypatch):
    rng = random.Random(7)
    items = [words_text(rng, 20) for _ in range(30)]
    monkeypatch.setattr(decontaminate, "MOST_WALKS", 1)
    held = decontaminate.Items(list(range(30)), items, 0.8, 1.01)
    assert not held.walks and held.pieces
    docs = []
    for text in items:
        w = text.split()
        for at in rng.sample(range(20), 4):
            w[at] = "other"
        docs.append("before " + " ".join(w) + " after")
    part = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(docs)], ["doc_id", "text"])
    out = decontaminate._found(held, part)
    assert {(a, b) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())} >= {(i, i) for i in range(30)}


def test_blocks_of_items(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 15)
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, bench).collect()} == whole
    verbatim = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in d.text}
    assert verbatim <= {k[:2] for k in whole}
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 2)
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, bench).collect()} == whole
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} - {k[0] for k in whole}


def test_blocks_take_turns_over_held_rows(spark, monkeypatch):
    rng = random.Random(9)
    texts = [words_text(rng, 20) for _ in range(12)]
    blocks = [decontaminate._Block(spark, decontaminate.Items(list(range(k, 12, 3)), texts[k::3], 0.8, 0.97)) for k in range(3)]
    rows = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([f"a {t} b"])], ["doc_id", "text"]) for i, t in enumerate(texts)]
    monkeypatch.setattr(decontaminate, "HELD_BYTES", 1000)
    met, groups = [], 0
    for held, in_turn in decontaminate._turns(iter(rows), 1, blocks):
        groups += 1
        for items in in_turn:
            assert len(decontaminate._BUILT) == 1
            for part, words, bounds in held:
                found = decontaminate._rows(items, part.column(0).to_pylist(), bounds, decontaminate._matches(items, words, bounds))
                met += zip(found.column(0).to_pylist(), found.column(1).to_pylist())
    assert 1 < groups < 12 and sorted(met) == [(i, i) for i in range(12)]


# -- pipeline -------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = Counter()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store.settled(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        counts[name] = docs.count()
    assert counts["quality"] >= counts["line_dedup"] >= counts["simhash"] >= counts["decontaminate"] > 0
    assert counts["quality"] == counts["line_dedup"]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == counts["decontaminate"] and out.where("NOT lossless").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on a small table with every kind of planted case, row by row."""
    from tokenizers import Tokenizer

    from lodestone.llm import bpe
    from tests.llm.test_quality_chat_warc import restated

    rng = random.Random(21)
    items = [(i, words_text(rng, 25)) for i in range(4)]
    base = words_text(rng, 150)
    texts = [words_text(rng, rng.randint(12, 200)) for _ in range(40)]
    texts += [base, base, base + " " + words_text(rng, 10), words_text(rng, 12) + "\n" + texts[3] + "\nAll rights reserved.", "All rights reserved.\n" + texts[5].replace(" ", "  ", 3)]
    texts += [words_text(rng, 30) + " " + items[0][1] + " " + words_text(rng, 30), words_text(rng, 30) + " " + items[1][1].upper() + ", " + words_text(rng, 9)]
    texts += [None, "", "too short", "again and again " * 30, "# * $ | " + words_text(rng, 20), "x y z " * 9, "\n".join(["one line of six words here"] * 9)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def good(text):
        n, chars, symbols, dup, repeat = restated(text)
        lines = sum(1 for x in (text or "").split("\n") if x.strip())
        return n >= 10 and 100 * repeat <= 20 * n and 2 * n <= chars <= 20 * n and not (10 * symbols > n and symbols) and 100 * dup <= 50 * lines

    kept = [(i, t) for i, t in rows if good(t)]
    assert 0 < len(kept) < len(rows)
    lined = sorted(plain_kept(kept))
    assert lined != sorted(kept)
    gone = {x for x, _ in plain_near_copies(lined)}
    assert gone
    single = [r for r in lined if r[0] not in gone]
    clean = [(i, t) for i, t in single if all(plain_edits(plain_words(x), plain_words(t)) > decontaminate.allowed(len(plain_words(x)), 0.8) for _, x in items)]
    assert len(clean) == len(single) - 2
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in clean}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
