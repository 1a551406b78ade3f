"""Operator 12: base patterns against plain ones, the tagger against enumeration and held-out spans, and whole documents."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import pii, tagger
from tests.conftest import SF

PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 14 <= len(d := re.sub("[^0-9]", "", t)) <= 19 and sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d[::-1])) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 10 <= len(re.sub("[^0-9]", "", t)) <= 15),
}


def plain_base(text):
    found = [(k, m.start(), m.end()) for k, (p, holds) in PLAIN.items() for m in re.finditer(p, text) if holds(m[0])]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def tricky(seed, n=400):
    rng = np.random.default_rng(seed)
    parts = ["a", "b.c", "@", "@@", "x@y.z", "x@y", ".", "..", "-", " ", "1", "12", "255.1.2.3", "256.1.1.1", "1.2.3.4.5", "4111111111111111", "4111 1111-1111 1111", "+", "+1 (131) 555-7634", "+12", "(", ")", "\n", "é", "😀", "007.08.09.010", "4242 4242 4242 4242", "q@é.com", "%+_@-.-"]
    return ["".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(n)]


def test_base_spans_are_the_patterns():
    texts = tricky(1) + ["", "1" * 3000, "a" * 3000, "a@" * 500, "1." * 800, "+1" * 400, "1 " * 900 + "+" + "1" * 300, "x@a.b@c.d@e", "@b.c@d.e"]
    for t in texts:
        assert pii.base_spans(t) == plain_base(t), t


def test_base_spans_take_linear_time():
    for t in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "a@" * 500_000, "+1(" * 300_000, "a.b@c" * 200_000):
        pii.base_spans(t)


@pytest.fixture(scope="module")
def model():
    words = [("der the of una para les " * 8, []), ("write to jo.doe@mail.example.com or +1 (131) 555-7634 then", [("email", 9, 32), ("phone", 36, 53)])]
    x, y = pii.examples(words * 50)
    m = tagger.Tagger.fresh(pii.KINDS, pii.HIDDEN, pii.SEED)
    tagger.train(m, x, y, pii.STEPS, seed=pii.SEED)
    return m, words


def test_held_out_spans(model):
    m, words = model
    x, y = pii.examples(words * 50, 1500, seed=99)
    whole = [i for i in range(len(x)) if not y[i, :6].any() and not y[i, -6:].any()]
    em = m.emissions(x[whole])
    best = m.paths(em)
    hit = got = want = 0
    for r, i in enumerate(whole):
        found = {s[:3] for s in m.spans(best[r], em[:, :, r])} if r in best else set()
        true = {s[:3] for s in m.spans(y[i].astype(np.uint8), em[:, :, r])}
        hit, got, want = hit + len(found & true), got + len(found), want + len(true)
    assert want > 500 and hit / want > 0.9 and hit / got > 0.9


def test_gradient():
    rng = np.random.default_rng(0)
    m = tagger.Tagger.fresh(("a", "b"), 3, 1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = rng.integers(0, 6, (4, 7))
    spans = [[("a", 1, 3), ("b", 4, 7)], [], [], [("b", 0, 2)]]
    y = np.stack([tagger.encode_tags(7, s, m.kinds) for s in spans])
    _, g = m.loss(x, y)
    for name, values in m.p.items():
        flat, slope = values.reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(slope))[:6]:
            held = flat[i]
            flat[i] = held + 1e-5
            up = m.loss(x, y)[0]
            flat[i] = held - 1e-5
            down = m.loss(x, y)[0]
            flat[i] = held
            assert abs((up - down) / 2e-5 - slope[i]) < 1e-6


def test_best_paths_by_enumeration():
    rng = np.random.default_rng(4)
    m = tagger.Tagger.fresh(("a", "b"), 3, 1)
    for k in ("trans", "first", "last"):
        m.p[k] = rng.normal(size=m.p[k].shape).astype(np.float32)
    trans, first = m._allowed()
    em = rng.normal(size=(5, 5, 60)).astype(np.float32)
    em[:, 1:] -= rng.uniform(0, 9, (1, 1, 60)).astype(np.float32)
    best = m.paths(em)
    assert 0 < len(best) < 60
    for r in range(60):
        score = lambda p: first[p[0]] + m.p["last"][p[-1]] + sum(em[t, k, r] for t, k in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))
        want = max(itertools.product(range(5), repeat=5), key=score)
        assert tuple(best[r].tolist() if r in best else (0,) * 5) == want


def test_windows_are_reconciled_at_once():
    for n in (0, 1, 64, 65, 767, 768, 769, 1472, 5000):
        windows = pii._windows(n)
        assert {i for s, e in windows for i in range(s, e)} == set(range(n))
        assert all(e - s <= pii.WINDOW for s, e in windows) and all(b[0] <= a[1] - pii.OVERLAP for a, b in zip(windows, windows[1:]))
    # two halves that an edge cut are one span; the whole beats them, and 5 + 5 beats 9
    assert pii.reconciled([("email", 0, 10, 4.0, False, True), ("email", 6, 20, 5.0, True, False)]) == [("email", 0, 20)]
    assert pii.reconciled([("card", 0, 10, 5.0, False, False), ("card", 10, 20, 5.0, False, False), ("phone", 5, 15, 9.0, False, False)]) == [("card", 0, 10), ("card", 10, 20)]
    rng = np.random.default_rng(2)
    for _ in range(60):
        spans = [("ip", int(s), int(s + l), float(w), False, False) for s, l, w in zip(rng.integers(0, 20, 7), rng.integers(1, 8, 7), rng.integers(1, 30, 7))]
        best = max(sum(s[3] for s in c) for n in range(8) for c in itertools.combinations({s[:3]: s for s in sorted(spans, key=lambda s: s[3])}.values(), n) if all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(c, 2)))
        kept = pii.reconciled(spans)
        assert sum(max(s[3] for s in spans if s[:3] == k) for k in kept) == best


def test_added_spans(model):
    m, _ = model
    card = "4111111111111111"
    filler = "the of and una para les der " * 60
    texts = [
        "nothing of the kind at all, 2024-01-31 or v1.2.3",
        f"{filler}write to jo.doe at mail dot example dot com please {filler}",
        f"{filler}call (131) 555-7634 then {filler}",
        f"{filler}card 4111.1111.1111.1111 and {filler}",
        f"{filler}+1 (131) 555-7634 {card} {filler}",
        filler * 20,
        "",
    ]
    base = [pii.base_spans(t) for t in texts]
    got = [[(k, t[s:e]) for k, s, e in spans] for t, spans in zip(texts, pii.added_spans(texts, base, m))]
    assert got[0] == got[5] == got[6] == []
    assert got[1] == [("email", "jo.doe at mail dot example dot com")]
    assert got[2] == [("phone", "(131) 555-7634")]
    assert got[3] == [("card", "4111.1111.1111.1111")]
    assert ("phone", "+1 (131) 555-7634") in got[4]
    # one text at a time, or among others: the same
    assert [pii.added_spans([t], [b], m)[0] for t, b in zip(texts, base)] == pii.added_spans(texts, base, m)


def test_documents(spark, model):
    m, _ = model
    rows = [(1, "mail a.b@c.de"), (1, "mail a.b@c.de"), (2, None), (3, ""), (None, "😀 10.0.0.1 é"), (4, "w " * 40000 + "x@y.zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = {(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in pii.find(docs, m).collect()}
    assert got == {(i, tuple(plain_base(t or ""))) for i, t in rows}
    red = pii.redact(docs, m)
    assert red.columns == docs.columns
    assert {r.text if r.text is None else r.text[-12:] for r in red.collect()} == {"mail [EMAIL]", None, "", "😀 [IP] é", "w w w [EMAIL]"[-12:]}
    assert all(r.n_chars == len(r.text or "") for r in red.collect())
    assert pii.find(docs.limit(0), m).count() == 0


def test_report(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.report(docs).collect()
    assert len(rows) == len(texts)
    text_of = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(text_of(base).encode()).hexdigest()
        every = [tuple(x.split(":")) for x in r.spans.split(",")] if r.spans else []
        assert {(k, int(s), int(e)) for k, s, e in every} >= set(base) and len(every) == len(base) + r.n_added
        keys = [(int(s), pii.KINDS.index(k)) for k, s, _ in every]
        assert keys == sorted(keys)
    assert pii.report(docs.limit(0)).count() == 0
