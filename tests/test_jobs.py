"""The two jobs: twice over growing input, replayed batches, reruns, settings, and their SQL."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from jobs import hits, ingest, queries, settings
from tests.conftest import SF
from tests.duck import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, name):
    run, sql = queries.QUERIES[name]
    assert_same(run(spark, SF), connect(SF), sql)


def config(root):
    return settings.read(ingest.DEFAULTS, documents=f"{root}/in", output=f"{root}/out", checkpoint=f"{root}/mark")


def land(spark, root, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.mode("append").parquet(f"{root}/in")


def texts(spark, c):
    rows = ingest.current(spark, c["output"]).orderBy("doc_id", "chunk_index").collect()
    return {r.doc_id: " ".join(x.content for x in rows if x.doc_id == r.doc_id) for r in rows}


def test_ingest_takes_only_what_is_new(spark, tmp_path, caplog):
    c = config(tmp_path)
    land(spark, tmp_path, [(1, "First text of one.", "en", "a"), (2, "Text of two.", "de", "a"), (3, None, "en", None), (None, "Nobody's text.", "en", "a")])
    with caplog.at_level(logging.INFO, "jobs.ingest"):
        assert ingest.run(spark, c) == {"rows": 4, "documents": 3, "chunks": 2}
    assert "read 4 new rows" in caplog.text and "wrote 3 documents and 2 chunks" in caplog.text
    assert ingest.run(spark, c) == {"rows": 0, "documents": 0, "chunks": 0}
    assert texts(spark, c) == {1: "First text of one.", 2: "Text of two."}
    # one changes, two comes again as it was, three gets a text, four is new and twice the same
    land(spark, tmp_path, [(1, "Second text of one.", "en", "a"), (2, "Text of two.", "de", "a"), (3, "Text of three.", "en", None), (4, "Text of four.", "fr", "b"), (4, "Text of four.", "fr", "b")])
    assert ingest.run(spark, c) == {"rows": 5, "documents": 3, "chunks": 3}
    assert texts(spark, c) == {1: "Second text of one.", 2: "Text of two.", 3: "Text of three.", 4: "Text of four."}
    # back to the first text, and to none
    land(spark, tmp_path, [(1, "First text of one.", "en", "a"), (4, "", "fr", "b")])
    assert ingest.run(spark, c) == {"rows": 2, "documents": 2, "chunks": 1}
    assert texts(spark, c) == {1: "First text of one.", 2: "Text of two.", 3: "Text of three."}
    assert sorted(p.name for p in (tmp_path / "out" / "chunks").glob("batch=*")) == ["batch=0", "batch=1", "batch=2"]


def test_ingest_in_two_runs_is_ingest_in_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    c = config(tmp_path)
    docs.where("doc_id % 3 = 0").write.parquet(f"{tmp_path}/in")
    ingest.run(spark, c)
    docs.where("doc_id % 3 <> 0").write.mode("append").parquet(f"{tmp_path}/in")
    docs.where("doc_id % 7 = 0").write.mode("append").parquet(f"{tmp_path}/in")
    ingest.run(spark, c)
    assert_same(ingest.current(spark, c["output"]), connect(SF), queries.JOB1_SQL)


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark, tmp_path):
    """The mark is lost after the output was written: the run repeats the batch, and the rows stay the same."""
    c = config(tmp_path)
    land(spark, tmp_path, [(1, "Text of one.", "en", "a"), (2, "Text of two.", "de", "a")])
    ingest.run(spark, c)
    first = texts(spark, c)
    for p in (tmp_path / "mark" / "commits").iterdir():
        p.unlink()
    ingest.run(spark, c)
    assert texts(spark, c) == first
    assert spark.read.parquet(f"{tmp_path}/out/documents").count() == 2


def test_ingest_restores_settings(spark, tmp_path):
    key = ingest._PROVIDER
    before = spark.conf.get(key, None)
    c = config(tmp_path)
    land(spark, tmp_path, [(1, "Text.", "en", "a")])
    try:
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
        ingest.run(spark, c)
        assert spark.conf.get(key).endswith("HDFSBackedStateStoreProvider")
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_hits_rerun_and_keep_other_callers(spark, tmp_path, caplog):
    c = settings.read(hits.DEFAULTS, tables=SF, output=f"{tmp_path}/hits", callers=["u7", "u12"], hits=3)
    with caplog.at_level(logging.INFO, "jobs.hits"):
        first = hits.run(spark, c)
    assert set(first) == {"u7", "u12"} and all(n > 0 for n in first.values()) and "wrote" in caplog.text
    rows = lambda: sorted(map(tuple, hits.written(spark, c["output"]).collect()))
    before = rows()
    assert hits.run(spark, c | {"callers": ["u7"]}) == {"u7": first["u7"]}
    assert rows() == before
    held = spark.read.parquet(f"{SF}/documents.parquet")
    assert hits.written(spark, c["output"]).join(held, "doc_id", "left_anti").count() == 0
    assert hits.written(spark, c["output"]).groupBy("caller", "query_id").agg(F.max("rank").alias("m")).where("m > 3").count() == 0


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"tables": "a", "hits": 4}))
    got, master = settings.from_command_line("doc", hits.DEFAULTS, [str(path), "--output", "o", "--hits", "5", "--callers", '["x"]', "--master", "local[2]"])
    assert got == {"tables": "a", "output": "o", "shared": "", "callers": ["x"], "hits": 5} and master == "local[2]"
    with pytest.raises(ValueError, match="output"):
        settings.read(hits.DEFAULTS, str(path))
    path.write_text('{"table": "a"}')
    with pytest.raises(ValueError, match="table"):
        settings.read(hits.DEFAULTS, str(path))
    for name, defaults in (("ingest", ingest.DEFAULTS), ("hits", hits.DEFAULTS)):
        settings.read(defaults, f"jobs/{name}.json", **{k: "x" for k, v in defaults.items() if v is None})


def test_texts_are_packed_once(spark):
    """No filter on a text's number of chunks stands below the explosion: it would clean, cut and pack every text again."""
    docs = spark.createDataFrame([(1, "One. Two.", "en", "s"), (2, None, "en", "s"), (3, "", "en", "s")], ingest.SCHEMA)
    cut = ingest.cut(docs)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
    assert [(r.doc_id, r.chunk_index, r.chunk_total, r.content) for r in cut.collect()] == [(1, 1, 1, "One. Two.")]
