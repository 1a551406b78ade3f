"""Page and text chunks against plain restatements, row by row over the given documents."""

import re
from itertools import groupby

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions.providers import hashed_embedding
from lodestone.operators import chunkers
from lodestone.plans import service_queries, text_queries
from tests.conftest import SF

CAPTION = re.compile(r"(Fig\.|Figure|Table|Tableau)\s*[\dIVXLC]+[.:\s]", re.I)
LABEL = re.compile(r"(Fig\.|Figure|Table)\s+\d+\.?\s*$", re.I)


def tok(s):
    return max(1, int(len(s) / 3.5))


def curve(texts):
    v = hashed_embedding(texts).astype(np.float64)
    n = np.linalg.norm(v, axis=1)
    return [round(float(a @ b / (p * q)), 6) if p * q else 0.0 for a, b, p, q in zip(v, v[1:], n, n[1:])]


def packed(sents, starts=frozenset()):
    out, cur, held = [], [], 0
    for i, s in enumerate(sents):
        if held >= 80 and (held + tok(s) > 450 or i in starts):
            out, cur, held = [*out, " ".join(cur)], [], 0
        cur.append(s)
        held += tok(s)
    if cur:
        tail = " ".join(cur)
        out = [*out[:-1], f"{out[-1]} {tail}"] if out and tok(tail) < 80 else [*out, tail]
    return out


# -- pages ----------------------------------------------------------------------


def sentences(body):
    return [s.strip() for p in re.split(r"\n\s*\n", body) for s in re.split(r"(?<=[.!?؟])\s+", p) if s.strip()]


def by_meaning(body):
    sents = sentences(body)
    if len(sents) < 2:
        return [body]
    runs = [[sents[0]]]
    for s, near in zip(sents[1:], curve(sents)):
        runs = [*runs, [s]] if near < 0.65 else [*runs[:-1], [*runs[-1], s]]
    out = []
    for r in map(" ".join, runs):
        if out and (tok(out[-1]) < 80 or tok(r) < 80) and tok(f"{out[-1]} {r}") <= 450:
            out[-1] += f" {r}"
        else:
            out.append(r)
    return out


def batches(table):
    if tok(table) <= 450:
        return [table]
    lines = table.split("\n")
    rule = next((i for i, l in enumerate(lines) if not l.strip("|-: ")), None)
    rows = [l for l in lines[rule + 1 :] if l.strip()] if rule is not None else []
    if not rows:
        return [table]
    head, out, cur = "\n".join(lines[: rule + 1]), [], []
    for r in rows:
        if cur and tok("\n".join([head, *cur, r])) > 400:
            out, cur = [*out, "\n".join([head, *cur])], []
        cur.append(r)
    return [*out, "\n".join([head, *cur])]


def cut_caption(text):
    label = re.match(r"(Fig\.|Figure|Table|Tableau)\s*[\dIVXLC]+[.:\s]*", text, re.I)
    end = re.search(r"(?<=[.!?])\s+", text[label.end() :])
    return (text[: label.end() + end.start()].strip(), text[label.end() + end.end() :].strip()) if end else (text, "")


def with_captions(items):
    out, i = [], 0
    while i < len(items):
        kind, body, section = items[i]
        i += 1
        if kind == "text":
            out.append((kind, body, section))
            continue
        below = items[i][1] if i < len(items) and items[i][0] == "text" else None
        more = items[i + 1][1] if below and i + 1 < len(items) and items[i + 1][0] == "text" else None
        used, text = (2, f"{below} {more}") if below and LABEL.match(below) and more else (1, below) if below and CAPTION.match(below) else (0, None)
        if text:
            caption, rest = cut_caption(text)
            out.append((kind, f"{body.rstrip()}\n\nCaption: {caption}", section))
            if len(rest) > 20:
                out.append(("text", rest, items[i][2]))
        elif out and out[-1][0] == "text" and CAPTION.match(out[-1][1]):
            out.append((kind, f"Caption: {out.pop()[1]}\n\n{body}", section))
        else:
            out.append((kind, body, section))
        i += used
    return out


def spread(items):
    out = []
    for (kind, _), run in groupby(items, key=lambda x: (x[0], x[2]) if x[0] == "table" else (x[0], id(x))):
        run = list(run)
        marks = [(m := b.find("\n\nCaption:")) if "\n\nCaption:" in b else b.find("Caption:") for _, b, _ in run]
        own = next((b[m:] if b[m:].startswith("\n\n") else f"\n\n{b[m:]}" for (_, b, _), m in zip(run, marks) if m >= 0), None) if kind == "table" else None
        out += [(k, (b[:m].strip() if m >= 0 else b) + own, s) for (k, b, s), m in zip(run, marks)] if own else run
    return out


def without_tiny(items):
    out, held = [], ""
    for i, (kind, body, _) in enumerate(items):
        body = f"{held} {body}".strip() if held else body
        held = ""
        if kind == "text" and tok(body) < 80 and i + 1 < len(items) and items[i + 1][0] == "text":
            held = body
        elif kind == "text" and tok(body) < 80 and out and out[-1][0] == "text":
            out[-1] = ("text", f"{out[-1][1]} {body}")
        else:
            out.append((kind, body))
    return out


def plain_pages(elements):
    """elements: (type, content, section) in order."""
    rows = [(t if t in ("table", "image") else "text", (c or "").strip(), s or "") for t, c, s in elements]
    rows = [r for r in rows if r[1] and not any(x in r[2].strip().lower() for x in ("references", "bibliography", "acknowledgments", "acknowledgements"))]
    items = []
    for n, ((kind, key), run) in enumerate(groupby(enumerate(rows), key=lambda x: (x[1][0], x[1][2].strip().lower() if x[1][0] == "text" else x[0]))):
        run = [r for _, r in run]
        if kind != "text":
            items += [(kind, p, run[0][2]) for p in (batches(run[0][1]) if kind == "table" else [run[0][1]])]
            continue
        aside = [c for _, c, _ in run if CAPTION.match(c) and len(c) < 200]
        body = " ".join(c for _, c, _ in run if not (CAPTION.match(c) and len(c) < 200))
        pieces = [] if not body else by_meaning(body) if key in ("", "unknown") or tok(body) > 450 else [body]
        items += [("text", p, run[0][2]) for p in pieces + aside]
    return without_tiny(spread(with_captions(items)))


def elements(doc_id, text):
    """The restated elements of a document: lines by turns text, table, image, caption, under sections that change."""
    kinds = ["text", "text", "table", "text", "text", "image", "text", "table", "table", "text", "text"]
    out = []
    for i, line in enumerate((text or "").split("\n")):
        kind = kinds[i % len(kinds)]
        body = line if kind == "text" else f"a | b\n--- | ---\n" + "\n".join(f"{w} | {n}" for n, w in enumerate(line.split())) if kind == "table" else line
        if i % 11 == 3:
            body = f"Table {i}: {line}" if doc_id % 2 else f"Table {i}."
        out.append((kind, body, ["Intro", "intro ", "Unknown", None, "Method", "References"][(i // 4 + doc_id) % 6]))
    return out


def test_page_chunks_of_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [(d, i, *e) for d, t in docs.items() for i, e in enumerate(elements(d, t))]
    df = spark.createDataFrame(rows, "doc_id long, position int, type string, content string, section string")
    got = {}
    for r in chunkers.page_chunks(df).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.type, r.content))
    want = {d: plain_pages(elements(d, t)) for d, t in docs.items()}
    assert got == {d: w for d, w in want.items() if w}
    kinds = [c for w in want.values() for c in w]
    assert sum("Caption:" in c for _, c in kinds) > 50 and sum(k == "text" for k, _ in kinds) > 200


def test_page_chunks_query(spark):
    """The registered query, whose elements are lines, against the restatement."""
    got = {}
    for r in text_queries.page_chunks(spark, SF).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.type, r.content))
    held = {}
    for r in text_queries.page_elements(spark, SF).orderBy("doc_id", "position").collect():
        held.setdefault(r.doc_id, []).append((r.type, r.content, r.section))
    assert got == {d: w for d, e in held.items() if (w := plain_pages(e))}


def test_spread_is_spread_captions(spark):
    """The fold within a row and the window over rows agree."""
    rng = np.random.default_rng(3)
    rows = [(d, i, rng.choice(["table", "table", "text"]), rng.choice(["x", "x\n\nCaption: A.", "Caption: B.\n\ny", "z\n\nCaption: C."]), rng.choice(["s", "t"])) for d in range(60) for i in range(8)]
    df = spark.createDataFrame([tuple(map(lambda v: v.item() if hasattr(v, "item") else v, r)) for r in rows], "doc_id long, position int, type string, content string, section string")
    held = df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("position", "type", "content", "section"))).alias("x"))
    folded = held.select("doc_id", F.posexplode(chunkers.spread(F.transform("x", lambda e: F.struct(e["type"].alias("type"), e["content"].alias("content"), e["section"].alias("section"))))).alias("position", "e"))
    got = sorted((r.doc_id, r.position, r.e.content) for r in folded.collect())
    assert got == sorted((r.doc_id, r.position, r.content) for r in chunkers.spread_captions(df).collect())


# -- texts ----------------------------------------------------------------------


def kind_of(text):
    lines = text.split("\n")
    bullets = sum(bool(re.match(r"\s*[\*\-•]\s+", l)) for l in lines) / len(lines)
    heads = sum(bool(re.match(r"\s*#{1,6}\s+|\d+[\)\.]\s+[A-Z]|[A-Z][A-Z\s\-]{3,}$|\s*_{3,}\s*$|\s*={3,}\s*$|\s*-{3,}\s*$", l)) for l in lines) / len(lines)
    return "structured" if bullets > 0.2 or heads > 0.05 else "mixed" if bullets > 0.05 or heads > 0.02 else "narrative"


def structured(text):
    brk, dot = "\x01", "\x02"
    text = re.sub(r"\r\n?", "\n", text)
    text = re.sub(r"\n{2,}", brk, re.sub(r"_{3,}", brk, text))
    text = re.sub(r"(?m)^([A-Z][A-Z\s\-]{3,})\s*$", rf"{brk}\1{brk}", text)
    text = re.sub(r"\n\*\s+|\n\d+\.\s+|\n\-\s+", brk, text)
    text = re.sub(r"(\d+)\.\s", rf"\1{dot} ", text)
    for short in ("Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "etc", "e.g", "i.e"):
        text = text.replace(f"{short}.", f"{short}{dot}")
    return [s for p in re.split(r"(?<=[.!?])\s+", text) for x in p.split(brk) if (s := x.replace(dot, ".").strip())]


def valleys(near):
    low = round(float(np.mean(near) - 0.5 * np.std(near)), 6) if near else 0
    return {i + 1 for i in range(1, len(near) - 1) if near[i] < near[i - 1] and near[i] < near[i + 1] and near[i] < low}


def plain_texts(text, most=8000):
    text = (text or "").strip()
    if not text:
        return []
    kind = kind_of(text)
    if kind == "narrative" and tok(text) <= most:
        return packed(s) if len(s := structured(text)) > 1 else [text]
    parts = [text] if kind == "narrative" else re.split(r"_{3,}|={3,}|^#{1,3}\s", text, flags=re.M) if kind == "structured" else re.split(r"\n{2,}(?=[A-Z\d#])", text)
    out = []
    for p in filter(None, map(str.strip, parts)):
        s = structured(p)
        out += packed(s, valleys(curve(s))) if len(s) > 1 else [p]
    return out


def test_text_chunks_of_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    # some with headings and bullets, and a narrative beyond the limit
    for d in list(docs):
        if d % 3 == 1:
            docs[d] = "\n".join(f"# Part\n{l}" if i % 5 == 0 else f"- {l}" if d % 2 and i % 3 == 0 else l for i, l in enumerate((docs[d] or "").split("\n")))
    docs[-1] = "One thing is said here. Another follows it there! " * 700
    docs[-2] = "\n\n".join(f"Alpha {i} beta gamma. Delta {i % 7} epsilon zeta eta. Theta iota {i}." for i in range(60)) + "\n# Head"
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got, kinds = {}, set()
    for r in chunkers.text_chunks(df).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
        kinds.add(r.kind)
        assert r.chunk_total >= r.chunk_index == len(got[r.doc_id])
    want = {d: plain_texts(t) for d, t in docs.items()}
    assert got == {d: w for d, w in want.items() if w}
    assert {"structured", "narrative"} <= kinds


def test_text_chunks_query(spark):
    got = {}
    for r in service_queries.text_chunks(spark, SF).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got == {d: w for d, t in docs.items() if (w := plain_texts(t))}
