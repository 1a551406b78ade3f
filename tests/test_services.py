"""Composed flows, routing, memory saving, and providers that fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import providers
from lodestone.functions import text as T
from lodestone.operators import answer, chunkers, chunks, index, memory, permissions, tables, windows
from lodestone.plans import services
from lodestone.sources import files, sinks


def test_upload_and_removal(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("A text that is long enough to stay, of one paragraph.")
    (tmp_path / "in" / "b.eml").write_bytes(b"Subject: Hi\nFrom: a@x\n\nA body of a mail that is long enough to stay.\n")
    place = f"file://{tmp_path}/chunks"
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    documents = spark.createDataFrame([], "document_id string, source string, source_type string, uploaded_by string, uploaded_at timestamp, chunks long")
    grants = spark.createDataFrame([], "user_id string, document_id string, permission_level string, granted_at timestamp, expires_at timestamp")
    found = files.scan(spark, str(tmp_path / "in"))
    stored, documents, grants = services.upload(spark, found, "u1", place, documents, grants, now)
    assert stored.count() == 2 and {r.source_type for r in documents.collect()} == {"txt", "eml"}
    assert {(r.user_id, r.permission_level) for r in grants.collect()} == {("u1", "admin")}
    # again: the same rows, no new ones
    again, documents, grants = services.upload(spark, found, "u1", place, documents, grants, now)
    assert again.count() == 2 and documents.count() == 2 and grants.count() == 2
    gone = documents.where("source = 'a.txt'").first().document_id
    left, documents, grants = services.remove_document(spark, place, documents, grants, gone)
    assert left.count() == 1 and documents.count() == 1 and grants.count() == 1
    (tmp_path / "in" / "c.xyz").write_text("?")
    with pytest.raises(ValueError, match="c.xyz"):
        services.upload(spark, files.scan(spark, str(tmp_path / "in")), "u1", place, documents, grants, now)
    (tmp_path / "in" / "c.xyz").unlink()
    (tmp_path / "in" / "d.txt").write_text(" ")
    with pytest.raises(ValueError, match="d.txt"):
        services.upload(spark, files.scan(spark, str(tmp_path / "in")), "u1", place, documents, grants, now)


def test_source_types(spark):
    rows = spark.createDataFrame([("a.PDF", None), ("b.tif", None), ("c", None), ("d.pdf", "pdf_scanned")], "path string, o string")
    assert [r.k for r in rows.select(chunks.source_type(F.col("path"), F.col("o")).alias("k")).collect()] == ["pdf_digital", "image", None, "pdf_scanned"]
    with pytest.raises(Exception, match="no source type for c"):
        rows.select(chunks.source_type(F.col("path"), strict=True)).collect()


def test_embedding_drops_failed_batches(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "id int, t string").coalesce(1)

    def embed(texts):
        if "text 2" in texts:
            raise RuntimeError("limit")
        return np.ones((len(texts), 3), np.float32)

    good, bad = providers.embedded_or_dropped(rows, "t", "id", embed, batch=2)
    assert {r.id for r in good.collect()} == {0, 1, 4, 5} and {r.id for r in bad.collect()} == {2, 3}
    with pytest.raises(ValueError):
        providers.embedded_or_dropped(rows.withColumn("t", F.lit(" ")), "t", "id", embed)
    with pytest.raises(ValueError):
        providers.query_vector(" ")
    assert providers.query_vector("a b").any()


def test_segments_where_texts_lie(spark):
    """The same runs as by windows over exploded rows."""
    texts = [["a b c", "a b c d", "x y", "x y z", ""], [], None, ["one"], [f"w{i % 3} same {i}" for i in range(9)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s array<string>")
    got = {r.id: r.s for r in providers.segmented(df, "s", 0.65).collect()}
    rows = providers.embedded(df.select("id", F.posexplode("s").alias("i", "t")), "t")
    parts = windows.segments(windows.neighbours(rows, ["id"], ["i"], "vector"), ["id"], ["i"], cut=0.65)
    want = {}
    for r in parts.orderBy("id", "i").collect():
        want.setdefault(r.id, {}).setdefault(r.segment, []).append(r.t)
    assert {i: v for i, v in got.items() if v} == {i: [" ".join(x) for x in v.values()] for i, v in want.items()}


def test_table_index(spark):
    profiles = spark.createDataFrame([("orders", "Table orders. COLUMNS: price", "1"), ("parts", "Table parts. COLUMNS: size", "1")], "table_name string, summary string, digest string")
    first = tables.table_index(profiles)
    assert {r.table_name: r.status for r in first.collect()} == {"orders": "new", "parts": "new"}
    changed = profiles.withColumn("digest", F.when(F.col("table_name") == "parts", "2").otherwise("1"))
    second = tables.table_index(changed, first.select("table_name", "digest", "vector"))
    assert {r.table_name: r.status for r in second.collect()} == {"orders": "skipped", "parts": "updated"}
    ids = second.withColumn("table_id", F.when(F.col("table_name") == "orders", 1).otherwise(2).cast("long"))
    q = spark.createDataFrame([(7, "Table orders. COLUMNS: price"), (8, "zebra")], "query_id long, text string")
    got = {r.query_id: r.routed_to for r in tables.routed(providers.embedded(q, "text"), ids).collect()}
    assert got == {7: 1, 8: None}


def test_compression(spark):
    turns = spark.createDataFrame([(s, i, "user", f"w{i} " * 120) for s in (1, 2) for i in range(9)], "session_id long, turn long, role string, content string")
    none = spark.createDataFrame([(1, "was")], "session_id long, summary string")
    left, kept = memory.compressed(turns, none, summarise=lambda old, talk: F.concat_ws(" ", old, talk))
    assert left.count() == 6 and {r.session_id: len(r.summary.split()) for r in kept.collect()} == {1: 500, 2: 500}
    # a summary that comes out empty loses nothing
    left, kept = memory.compressed(turns, none, summarise=lambda old, talk: F.lit(None).cast("string"))
    assert left.count() == 18 and [r.summary for r in kept.collect()] == ["was"]
    # a condenser that gives nothing leaves the long one
    _, kept = memory.compressed(turns, none, summarise=lambda old, talk: talk, condense=lambda s: F.lit(None).cast("string"))
    assert all(len(r.summary.split()) > 500 for r in kept.collect())


def test_clean_nested(spark):
    kind = "struct<pages: array<struct<type: string, content: string, metadata: struct<note: string>, parts: array<struct<text: string>>>>, tables: array<struct<type: string, headers: array<string>, rows: array<array<string>>>>, content: string>"
    value = ([("text", "<b>long enough text to stay</b>", ("<i>",), [("a  b",)]), ("text", "short", None, None), ("image", "", None, None)], [("table", ["<b>h</b>"], [["x  y"]]), ("table", [], [])], "<p>c</p>")
    df = spark.createDataFrame([(value,)], f"v {kind}")
    v = df.select(T.clean_nested(F.col("v"), df.schema["v"].dataType).alias("v")).first().v
    assert [(p.content, p.metadata and p.metadata.note) for p in v.pages] == [("long enough text to stay", "<i>")]
    assert v.pages[0].parts[0].text == "a b" and v.content == "c"
    assert [(t.headers, t.rows) for t in v.tables] == [(["h"], [["x y"]])]


def test_access_helpers(spark):
    users = spark.createDataFrame([("dev_a", "a@x")], "user_id string, email string")
    callers = spark.createDataFrame([("dev_a",), ("b",), (None,)], "caller_id string")
    assert sorted((r.caller_id or "", r.email) for r in permissions.emails_of(callers, users).collect()) == [("", ""), ("b", ""), ("dev_a", "a@x")]
    assert permissions.users_like(users, "dev_%").count() == 1


def test_text_chunks(spark):
    texts = ["# Head\n" + "a sentence here. " * 20 + "\n# Next\nshort one", "One two three. " * 200, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = chunkers.text_chunks(df).collect()
    assert {r.doc_id for r in rows} == {0, 1}
    assert {r.doc_id: r.kind for r in rows} == {0: "structured", 1: "narrative"}
    for r in rows:
        assert r.chunk_index <= r.chunk_total and len(r.content) / 3.5 < 600


def test_index_is_read_until_its_source_changes(spark, tmp_path):
    path = f"file://{tmp_path}/docs.parquet"
    spark.createDataFrame([(1, "alpha beta alpha")], "doc_id long, text string").write.parquet(path)
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert index.kept(spark, "t", path, build).count() == index.kept(spark, "t", path, build).count() == 3 and len(calls) == 1
    assert {r.term for r in index.postings(spark, path, "doc_id").collect()} == {"alpha", "beta"}
    spark.createDataFrame([(2, "gamma")], "doc_id long, text string").write.mode("overwrite").parquet(path)
    assert {r.term for r in index.postings(spark, path, "doc_id").collect()} == {"gamma"}
    index.kept(spark, "t", path, build)
    assert len(calls) == 2


def test_judges(spark):
    rows = spark.createDataFrame([(1, 4, None), (2, None, None)], "id int, a int, b int")
    got = {r.id: r.average for r in answer.judged(rows, {"x": F.col("a"), "y": F.col("b")}).collect()}
    assert got == {1: 4.0, 2: None}
    assert answer.direct("q", generate=str.upper) == "Q"
    assert sinks.read_table(spark, "file:///tmp/none-there") is None
