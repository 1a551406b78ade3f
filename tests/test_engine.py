"""Functions, retrieval, changes, sources, and streams on small inputs."""

import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.functions import classify, providers
from lodestone.functions import text as T
from lodestone.operators import answer, chunks, dense, dml, memory, permissions, retrieve, tables
from lodestone.plans.loop import corrective_search
from lodestone.sources import files, sinks
from lodestone.streaming import ingest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, ""),
        ("", ""),
        ("<b>Hi</b>\xa0 there​", "Hi there"),
        ("a\r\n\n\n\n  b\x07 \n-----", "a\n\nb"),
        ("é  ü\tع", "é ü\tع"),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, raw, T.clean_text) == want


def test_other_cleaning(spark):
    assert one(spark, "|a|  b|\n\n|---|---|\n", T.clean_table) == "|a| b|\n|---|---|"
    assert one(spark, "The image contains no charts at all", T.clean_description) == ""
    assert one(spark, 'The image shows **a "red" car**', T.clean_description) == "a red car"
    assert one(spark, "Hello\n> quoted\n[image: x]Unsubscribe\nrest", T.clean_mail) == "Hello"
    assert one(spark, "Hi\nOn Monday X wrote:\nold", T.without_reply) == "Hi"
    assert one(spark, "note\n---- Forwarded message ----\nFrom: a\nTo: b\n\nkept", T.without_forward_header) == "note\n\n\nkept"


def test_identifiers(spark):
    want = str(uuid.uuid5(uuid.NAMESPACE_DNS, "naïve ✓"))
    assert one(spark, "naïve ✓", T.uuid5) == want
    assert one(spark, "2024 Sales-Report", T.slug) == "t_2024_sales_report"
    assert one(spark, "doc_12ab_report.pdf", T.document_id) == "doc_12ab"
    assert one(spark, "report.pdf", T.document_id) is None
    assert bytes(one(spark, "aGk", T.base64url)) == b"hi"
    assert one(spark, " -12 ", T.safe_int) == -12
    assert one(spark, "3.7", T.safe_int) is None
    assert one(spark, "", T.tokens) == 1


def test_sentences(spark):
    assert one(spark, "One. Two!\n\nThree؟ Four", T.sentences) == ["One.", "Two!", "Three؟", "Four"]
    assert one(spark, "Dr. Who is 3. 5 tall. Yes", T.structured_sentences) == ["Dr. Who is 3. 5 tall.", "Yes"]
    assert one(spark, "* a\n* b\ntext", T.structure) == "structured"


def test_captions(spark):
    head, rest = T.caption_parts(F.col("x"))
    row = spark.createDataFrame([("Figure 2: A view. And a long remainder of text here.",)], "x string").select(head.alias("h"), rest.alias("r")).first()
    assert (row.h, row.r) == ("Figure 2: A view.", "And a long remainder of text here.")


def test_classifiers(spark):
    assert [one(spark, q, classify.route) for q in ("Hello!", "translate that", "what can you do", "two words", "What does the annual report say about revenue?")] == ["DIRECT"] * 4 + ["RAG"]
    assert [one(spark, q, classify.tier) for q in ("thanks!", "I prefer tea", "The report is due")] == ["short", "long", "mid"]
    assert one(spark, "what about Tunis", classify.is_vague) and not one(spark, "revenue of 2023", classify.is_vague)
    both = lambda r, q: spark.createDataFrame([(r, q)], "r string, q string").select(classify.accepted_rewrite(F.col("r"), F.col("q")).alias("y")).first().y
    assert both("Question: what is X?", "what is it?") == "what is X?"
    assert both("x", "what is it?") == "what is it?" and both(None, "q?") == "q?"


def docs_with_access(spark):
    rows = [
        (1, "u1", "u1@x", ["u2@x"], False),
        (2, "u2", "u2@x", None, None),
        (3, "u3", None, None, None),
        (4, "u3", "u3@x", [], True),
        (5, None, "", None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, uploaded_by string, owner_email string, allowed_users array<string>, is_public boolean")


def test_access(spark):
    d = docs_with_access(spark)
    see = lambda p: sorted(r.doc_id for r in d.where(p).collect())
    assert see(retrieve.visible("u2", "u2@x")) == [1, 2, 3, 4]
    assert see(retrieve.visible("u9", "u9@x")) == [3, 4], "an empty owner is an owner"
    assert see(retrieve.visible("u9", None, is_admin=True)) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        retrieve.in_scope("single_doc")
    with pytest.raises(ValueError):
        retrieve.equals({"secret": 1})


def test_permissions(spark):
    now = F.to_timestamp(F.lit("2024-01-02"))
    held = spark.createDataFrame([("u", "a", "read", "2024-01-01"), ("u", "b", "read", None)], "user_id string, document_id string, permission_level string, e string")
    held = held.withColumn("expires_at", F.to_timestamp("e")).withColumn("granted_at", F.lit(1)).drop("e")
    d = spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string")
    assert [r.document_id for r in retrieve.allowed_documents(d, held, "u", now).collect()] == ["b"]
    assert retrieve.allowed_documents(d, held, "nobody", now).count() == 0
    assert retrieve.allowed_documents(d, held, "nobody", now, "open_if_empty").count() == 3
    new = held.where("document_id = 'b'").withColumn("permission_level", F.lit("admin")).withColumn("granted_at", F.lit(2))
    after = permissions.grant(held, new)
    assert {(r.document_id, r.permission_level) for r in after.collect()} == {("a", "read"), ("b", "admin")}
    assert permissions.revoke(after, new).count() == 1


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([(0, 10, 1), (0, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(0, 11, 1), (0, 12, 2)], "query_id long, doc_id long, rank int")
    got = [(r.doc_id, r.score, r.found_in) for r in retrieve.fuse({"dense": a, "sparse": b}, 10).orderBy("rank").collect()]
    assert got == [(11, round(1 / 22 + 1 / 21, 9), "both"), (10, round(1 / 21, 9), "dense"), (12, round(1 / 22, 9), "sparse")]


def test_dense_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0])], "doc_id long, vector array<float>")
    q = spark.createDataFrame([(0, [2.0, 0.0])], "query_id long, vector array<float>")
    assert [(r.doc_id, r.score) for r in dense.search(q, rows, 3).orderBy("rank").collect()] == [(1, 1.0), (4, 1.0), (2, 0.0)]
    assert dense.search(q.limit(0), rows, 3).count() == 0
    assert dense.search(q, rows.limit(0), 3).count() == 0


def test_search_with_stopwords_only(spark):
    c = spark.createDataFrame([(1, "the red car", [1.0, 0.0])], "doc_id long, text string, vector array<float>")
    q = spark.createDataFrame([(0, "the of and", [1.0, 0.0])], "query_id long, text string, vector array<float>")
    assert retrieve.search(q, c, "sparse").count() == 0
    assert retrieve.search(q, c, "hybrid").count() == 1
    with pytest.raises(ValueError):
        retrieve.search(q, c, "psychic")


def test_loop_ends_in_three_rounds(spark):
    c = spark.createDataFrame([(i, f"word{i} other text", [float(i), 1.0]) for i in range(8)], "doc_id long, text string, vector array<float>")
    q = spark.createDataFrame([(0, "word3", [3.0, 1.0]), (1, "nothing shared here", [1.0, 1.0])], "query_id long, text string, vector array<float>")
    got = corrective_search(q, c).collect()
    assert {r.attempt for r in got if r.query_id == 1} <= {0, 1, 2}
    assert {r.query_id for r in got if r["rank"] == 1 and r.query_id == 0} == {0}


def test_citations(spark):
    a = spark.createDataFrame([(0, "A [source: R.PDF, page 2]. B [Source: other.txt]"), (1, "none")], "query_id long, answer string")
    c = spark.createDataFrame([(0, "r.pdf", 2), (0, "r.pdf", 3), (0, "Other.txt", None), (1, "r.pdf", 2)], "query_id long, source string, page int")
    got = {(r.query_id, r.source, r.page) for r in answer.cited(c, answer.citations(a)).collect()}
    assert got == {(0, "r.pdf", 2), (0, "Other.txt", None)}
    assert one(spark, "Sorry, I don't have enough information in the provided context.", answer.no_answer)


def test_changes(spark):
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k long, v string")
    pairs = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert pairs(dml.upsert(old, new, ["k"], [F.desc("v")])) == [(1, "b"), (2, "d")]
    assert pairs(dml.insert_absent(old, new, ["k"], [F.asc("v")])) == [(1, "a"), (2, "c")]
    assert pairs(dml.delete(new, old, ["k"])) == [(2, "c"), (2, "d")]


def test_memory(spark):
    t = spark.createDataFrame([(s, i, "user", f"m{i}") for s, n in ((1, 6), (2, 7)) for i in range(n)], "session_id long, turn long, role string, content string")
    assert sorted((r.session_id, r.turn) for r in memory.to_compress(t).collect()) == [(2, 0), (2, 1), (2, 2), (2, 3)]
    assert memory.history_text(t, 2).where("session_id = 1").first().history == "USER: m4\nUSER: m5"
    facts = spark.createDataFrame([(1, f" f{i} ", i, i) for i in range(20)] + [(1, " ", 99, 99), (1, "x" * 201, 98, 98)], "user_id long, fact string, created_at long, id long")
    kept = memory.store_facts(facts.limit(0), facts).collect()
    assert sorted(int(r.fact[1:]) for r in kept) == list(range(5, 20))


def test_guard(spark):
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("allowed_t")
    spark.createDataFrame([(2,)], "a int").createOrReplaceTempView("secret_t")
    assert tables.guarded(spark, "select a from allowed_t;", {"allowed_t"}).first().a == 1
    for bad in ("drop view allowed_t", "select 1; select 2", "select * from secret_t", "with c as (select * from secret_t) select * from c", "select * from allowed_t where a in (select a from secret_t)", "insert into allowed_t values (1)", "select * from parquet.`/tmp/x`",
        "select * from secret_t where 'secret_t AS (' <> ''", "select java_method('java.lang.System', 'getProperty', 'user.home')", "select reflect('java.lang.System', 'getenv', 'PATH') from allowed_t",
        "select (with secret_t as (select 1 a) select max(a) from secret_t) from secret_t", "with c as (select 1 as a) select * from allowed_t join secret_t using (a)", "select * from range(5)", "select exists (select 1 from secret_t)",
        "select case when (select max(a) from secret_t) > 1 then 1 end", "select a from allowed_t union select a from secret_t", "select * from allowed_t, lateral (select * from secret_t)", "describe allowed_t", "set x = 1", "select input_file_name() from allowed_t"):
        with pytest.raises(tables.NotAQuery):
            tables.guarded(spark, bad, {"allowed_t"})
    for good in ("select 'Delete; Command' as x, a from allowed_t where 'secret_t' <> ''", "with c as (select a from allowed_t), e as (select * from c) select count(*) n, round(avg(a), 2) from e where a in (select a from c) group by a having count(*) > 0 order by n limit 3",
        "select a, row_number() over (order by a) from allowed_t"):
        assert tables.guarded(spark, good, {"Allowed_T"}).count() >= 0
    with pytest.raises(tables.NotAQuery):
        tables.ask(spark, "q", lambda q, e: "select nope from allowed_t", {"allowed_t"})


def test_chunks(spark):
    meta = {"source": "a.pdf", "page_start": "3", "section": " ", "token_count": "0"}
    e = spark.createDataFrame([("d", "pdf_digital", 0, "odd", "A body that is long enough to stay.", meta), ("d", "pdf_digital", 1, "text", "short", meta)], chunks.ELEMENT)
    rows = chunks.normalise(e).collect()
    assert len(rows) == 1 and rows[0].type == "text"
    m = rows[0].metadata
    assert (m.page, m.section, m.token_count) == (3, None, 10)
    again = chunks.normalise(e).first()
    assert again.chunk_id == rows[0].chunk_id


def test_sources(spark, tmp_path: Path):
    (tmp_path / "a.txt").write_bytes("﻿Héllo\r\nworld\r\n".encode())
    (tmp_path / "b.csv").write_bytes("﻿my col, other\n1,2\n".encode())
    (tmp_path / "c.eml").write_bytes(b"Subject: Hi\nFrom: a@x\nMIME-Version: 1.0\nContent-Type: text/html\n\n<div>Body <b>text</b></div><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table><blockquote>old</blockquote>")
    (tmp_path / "d.xyz").write_bytes(b"?")
    found = files.scan(spark, str(tmp_path))
    assert {r.name: r.source_type for r in found.collect()} == {"a.txt": "txt", "b.csv": "csv", "c.eml": "eml", "d.xyz": "unknown"}
    t = files.texts(found.where("source_type = 'txt'")).first()
    assert (t.text, t.encoding, t.word_count) == ("Héllo\r\nworld\r\n", "utf-8-sig", 2)
    m = files.mails(found.where("source_type = 'eml'")).first()
    assert m.subject == "Hi" and "Body text" in m.text and "old" not in m.text and m.tables == ["k | v\n--- | ---\n1 | 2"]
    assert files.csv_table(spark, str(tmp_path / "b.csv")).columns == ["my_col", "other"]
    assert files.header_names(["a b", "a b", " "]) == ["a_b", "a_b_2", "column"]
    e = files.elements(found.where("source_type in ('txt', 'eml', 'unknown')"))
    assert sorted(r.type for r in e.collect()) == ["error", "table", "text", "text"]
    none = spark.createDataFrame([], "table_name string, digest string")
    first = files.import_csv(spark, found, none)
    assert [r.status for r in first.collect()] == ["new"]
    assert [r.status for r in files.import_csv(spark, found, first.select("table_name", "digest")).collect()] == ["skipped"]


def test_markdown_elements(spark):
    lines = ["# Intro", "one", "two", "| a | b |", "| --- | --- |", "# Next", "three"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, n int, line string")
    got = [(r.section, r.type, r.content) for r in files.markdown_elements(df, ["doc"], ["n"]).orderBy("element").collect()]
    assert got == [("Intro", "text", "one two"), ("Intro", "table", "| a | b |\n| --- | --- |"), ("Next", "text", "three")]


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    sinks.upsert_table(spark, rows, path, ["id"])
    out = sinks.upsert_table(spark, spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int"), path, ["id"])
    assert {(r.id, r.v) for r in out.collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert sinks.read_table(spark, path).count() == 3
    # of two rows of one key in a batch one stays, and parts that no row touches are not written again
    out = sinks.upsert_table(spark, spark.createDataFrame([("b", 5), ("b", 7)], "id string, v int"), path, ["id"])
    assert {(r.id, r.v) for r in out.collect()} == {("a", 1), ("b", 7), ("c", 2)}
    assert len(list((tmp_path / "t" / "version=000002").glob("_part=*"))) == 1
    assert sinks.table_info(spark, path)["rows"] == 3
    assert sinks.drop_table(spark, path) and sinks.read_table(spark, path) is None
    good, bad = sinks.split_storable(spark.createDataFrame([("x", "t", [1.0, 0.0], [1], [0.5]), ("y", "t", [1.0], [1], [0.5]), ("", "t", [1.0, 0.0], [1], [0.5])], "chunk_id string, content string, vector array<double>, indices array<int>, weights array<double>"), dimension=2)
    assert [r.chunk_id for r in good.collect()] == ["x"] and sorted(r.reason for r in bad.collect()) == ["missing chunk_id", "wrong dense_vector dim: 1 (expected 2)"]


def test_providers(spark):
    assert providers.healthy()
    df = spark.createDataFrame([(1, "a b"), (2, "")], "i int, t string")
    got = {r.i: r.vector for r in providers.embedded(df, "t").collect()}
    assert len(got[1]) == providers.DIMENSION and not any(got[2])


def test_streams(spark, tmp_path):
    landing, table, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(landing)

    def run():
        q = ingest.unseen_into(ingest.landing(spark, landing, "k long, v string"), table, ["k"], state).trigger(availableNow=True).start()
        q.awaitTermination(60)

    run()
    spark.createDataFrame([(2, "b"), (3, "c")], "k long, v string").write.mode("append").parquet(landing)
    run()
    assert sorted(r.k for r in spark.read.parquet(table).collect()) == [1, 2, 3]


def test_turn_buffer(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    landing, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    rows = [(1, i, "user", f"m{i}") for i in range(7)] + [(2, 0, "user", "x")]
    spark.createDataFrame(rows, "session_id long, turn long, role string, content string").write.parquet(landing)
    stream = ingest.compression_stream(ingest.landing(spark, landing, "session_id long, turn long, role string, content string"))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.session_id, r.turn) for r in spark.read.parquet(out).collect()) == [(1, 0), (1, 1), (1, 2), (1, 3)]
