"""The corrective loop, the question path, its evaluation, and cuts by meaning, restated row by row; the ranked lists come from the SQL twin."""

import math
import re

import pytest

from lodestone.functions.text import STOPWORDS
from lodestone.plans import retrieval_queries as R
from lodestone.plans import service_queries, text_queries
from tests.conftest import SF
from tests.duck import connect
from tests.test_chunkers import by_meaning, sentences


def terms(text):
    return {w for w in re.findall("[a-z0-9]+", (text or "").lower()) if len(w) > 1 and w not in STOPWORDS}


@pytest.fixture(scope="module")
def tables():
    con = connect(SF)
    sql = f"WITH {R._search_sql(R._VISIBLE_SQL)} SELECT 'dense', query_id, doc_id, rank FROM dense_top UNION ALL SELECT 'sparse', query_id, doc_id, rank FROM sparse_top"
    lists = {"dense": {}, "sparse": {}}
    for name, q, d, rank in con.execute(sql).fetchall():
        lists[name].setdefault(q, {})[d] = rank
    docs = {d: (t, s) for d, t, s in con.execute("SELECT doc_id, text, source FROM documents").fetchall()}
    items = dict(con.execute("SELECT item_id, b.text FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id").fetchall())
    return lists, docs, items


def fused(lists, q):
    """Documents of a query's lists, best first."""
    score, best = {}, {}
    for i, ranks in enumerate(lists):
        for d, rank in ranks.get(q, {}).items():
            score[d] = score.get(d, 0) + 1 / (20 + rank)
            best[d] = min(best.get(d, (9, 0)), (i, rank))
    return sorted(score, key=lambda d: (-round(score[d], 9), best[d], d))[:20]


def loop(lists, docs, q, text):
    """(doc_id, coverage, grade, rank, attempt, mode) of the round that a query ends in."""
    mine = terms(text)
    for attempt, mode in enumerate(("hybrid", "dense", "sparse")):
        hits = fused([lists[m] for m in ("dense", "sparse") if mode in ("hybrid", m)], q)
        cover = {d: round(len(mine & terms(docs[d][0])) / len(mine), 6) if mine else 0.0 for d in hits}
        top = sorted(hits, key=lambda d: (-cover[d], hits.index(d)))[:5]
        rows = [(d, cover[d], min(math.floor(cover[d] * 5), 4) + 1, i + 1, attempt, mode) for i, d in enumerate(top)]
        if not rows or sum(r[2] < 3 for r in rows) / len(rows) <= 0.5:
            break
    return rows


def test_corrective_loop(spark, tables):
    lists, docs, items = tables
    got = {}
    for r in R.corrective_loop(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score, r.grade, r.rank, r.attempt, r["mode"]))
    want = {q: sorted(rows) for q, t in items.items() if (rows := loop(lists, docs, q, t))}
    assert {q: sorted(r) for q, r in got.items()} == want
    assert {r[4] for rows in want.values() for r in rows} >= {0}


def said(lists, docs, q, text):
    """(answer, context) of a question."""
    rows, used, taken = sorted(loop(lists, docs, q, text), key=lambda r: r[3]), 0, []
    for r in rows:
        size = max(1, math.floor(len(docs[r[0]][0]) / 3.8))
        if used + size <= 8000:
            used, taken = used + size, [*taken, r[0]]
    taken = taken or [r[0] for r in rows[:1]]
    if not rows:
        return "I don't have enough information in the provided context.", ""
    body, source = docs[rows[0][0]]
    context = "\n\n".join(f"[{i + 1}] {docs[d][1]}\n{docs[d][0]}" for i, d in enumerate(taken))
    return f"{re.split(r'(?<=[.!?])\s+', body.strip())[0]} [Source: {source}]", context


def test_question_path(spark, tables):
    lists, docs, items = tables
    got = {r.query_id: r for r in service_queries.question_path(spark, SF).collect()}
    assert set(got) == set(items) | {q + 100000 for q in items if q % 10 == 0}
    for q, r in got.items():
        if q >= 100000:
            assert (r.route, r.question, r.cited) == ("DIRECT", "hello", 0)
        else:
            answer, _ = said(lists, docs, q, items[q])
            assert (r.route, r.question, r.answer) == ("RAG", items[q], answer)
            assert r.cited == len(set(re.findall(r"(?i)\[Source:\s*([^,\]]+)", answer)))


def test_evaluation(spark, tables):
    lists, docs, items = tables
    words = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    grade = lambda part, whole: min(math.floor(len(words(part) & words(whole)) / len(words(part)) * 5), 4) + 1 if words(part) else None
    for r in service_queries.evaluation(spark, SF).collect():
        answer, context = said(lists, docs, r.query_id, items[r.query_id])
        prompt = f"Context:\n{context}\n\nQuestion: {items[r.query_id]}\n\nAnswer from the context only and cite as [Source: name, page n]."
        want = [grade(answer, prompt), grade(items[r.query_id], answer), grade(items[r.query_id], answer) if r.query_id % 2 == 0 else None]
        assert [r.faithfulness, r.relevance, r.agreement] == want
        held = [x for x in want if x is not None]
        assert r.average == pytest.approx(sum(held) / len(held), abs=0.0051)


def test_semantic_chunks(spark, tables):
    _, docs, _ = tables
    got = {}
    for r in text_queries.semantic_chunks(spark, SF).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    # a text of one sentence is that sentence
    assert got == {d: by_meaning(t) if len(s) > 1 else s for d, (t, _) in docs.items() if (s := sentences(t or ""))}


def plain_page(html):
    """(characters, tables) of a page, by patterns over its mark-up."""
    import html as entities

    body = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>", "", html or "")
    body = re.sub(r"(?is)<(script|style|head|blockquote|template)\b[^>]*>.*?</\1\s*>", "", body)
    tables = 0
    for found in re.findall(r"(?is)<table\b.*?</table>", body):
        rows = [r for r in ([*re.findall(r"(?is)<t[dh]\b[^>]*>.*?</t[dh]>", r)] for r in re.findall(r"(?is)<tr\b[^>]*>.*?(?=<tr\b|</table>)", found)) if r]
        tables += len(rows) >= 2 and max(map(len, rows)) >= 2
    body = re.sub(r"(?is)<t[dh]\b[^>]*>.*?</t[dh]>", "", body)
    body = re.sub(r"(?is)</?(p|div|li|h[1-6])\b[^>]*>|<(br|tr)\b[^>]*>", "\n", body)
    lines = [" ".join(x.split()) for x in entities.unescape(re.sub(r"(?s)<[^>]+>", "", body)).split("\n")]
    return len("\n".join(x for x in lines if x)), tables


def test_html_parts(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: (r.chars, r.tables) for r in text_queries.html_parts(spark, SF).collect()}
    assert got == {p: plain_page(h) for p, h in pages.items()}
