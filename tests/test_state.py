"""Streaming state: versions of keys and tiers that expire; imports of CSV folders; memory in the question path."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.operators import memory, retrieve
from lodestone.plans import inputs, services
from lodestone.sources import files
from lodestone.streaming import ingest
from tests.conftest import SF

TURNS = "session_id long, turn long, content string, created_at timestamp"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_tiers_expire_with_event_time(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    landing, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    said = {"short": "ok", "mid": "where is the report of the last year", "long": "i work on the sales report"}
    batches = [
        [(1, 0, said["short"], at(0)), (1, 1, said["mid"], at(1)), (1, 2, said["long"], at(2)), (2, 0, said["short"], at(10))],
        [(2, 1, said["mid"], at(35)), (1, 3, said["short"], at(36))],
        [(3, 0, said["long"], at(24 * 60 + 3))],
    ]
    seen, want = [], []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(landing)
        stream = ingest.purge_stream(ingest.landing(spark, landing, TURNS))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
        seen += rows
        mark = max(r[3] for r in seen)
        tiers = memory.with_tiers(spark.createDataFrame(seen, TURNS))
        want = sorted((r.session_id, r.turn, r.tier, r.expires_at) for r in memory.expired(tiers, F.lit(mark)).collect())
        got = sorted(tuple(r) for r in spark.read.parquet(out).select("session_id", "turn", "tier", "expires_at").collect())
        assert got == want, n
    assert [w[:3] for w in want] == [(1, 0, "short"), (1, 1, "mid"), (1, 3, "short"), (2, 0, "short")]


def test_versions_in_state(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    landing, state = f"{tmp_path}/in", f"{tmp_path}/state"
    out = []

    def run(rows):
        spark.createDataFrame(rows, "k long, v string, at long, note long").coalesce(1).write.mode("append").parquet(landing)
        stream = ingest.changed(ingest.landing(spark, landing, "k long, v string, at long, note long"), "k", "v", ("at",))
        out.clear()
        stream.writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(out)

    assert run([(1, "a", 1, None), (1, "b", 2, 7), (2, "a", 1, None)]) == [(1, "b", 2, 7), (2, "a", 1, None)]
    assert run([(1, "b", 3, 8), (2, "c", 2, 9), (3, "a", 1, 1), (3, "z", 0, 2)]) == [(2, "c", 2, 9), (3, "a", 1, 1)]
    assert run([(2, "a", 3, None)]) == [(2, "a", 3, None)]  # a version that comes back


def test_csv_folders(spark, tmp_path):
    folder, place = tmp_path / "in", f"file://{tmp_path}/tables"
    folder.mkdir()
    (folder / "Sales 2024.csv").write_bytes("Id,Amount (EUR),Näme\n1,2.5,\"a, b\"\n2,,c\n3,4\n4,5,d,more\n".encode("cp1252"))
    (folder / "parts.CSV").write_bytes("size\n1\n2\n".encode("utf-16"))
    (folder / "empty.csv").write_text("a,b\n")
    (folder / "note.txt").write_text("no table")

    def run(hour, force=False):
        done = files.import_tables(spark, files.scan(spark, str(folder)), place, F.lit(dt.datetime(2024, 1, 1, hour)), force)
        return {r.table_name: r.status for r in done.collect()}

    assert run(1) == {"sales_2024": "new", "parts": "new", "empty": "new"}
    sales = files.load_table(spark, place, "sales_2024")
    assert sales.dtypes == [("row", "bigint"), ("id", "bigint"), ("amounteur", "double"), ("nme", "string")]
    assert sorted(map(tuple, sales.collect())) == [(0, 1, 2.5, "a, b"), (1, 2, None, "c"), (2, 3, 4.0, None), (3, 4, 5.0, "d")]
    assert run(2) == {"sales_2024": "skipped", "parts": "skipped", "empty": "skipped"}
    # a changed file replaces its own table, with other columns; a file that loses its rows, its rows
    (folder / "parts.CSV").write_text("size,price\n7,x\n")
    (folder / "Sales 2024.csv").write_text("Id\n")
    assert run(3) == {"sales_2024": "updated", "parts": "updated", "empty": "skipped"}
    assert [tuple(r) for r in files.load_table(spark, place, "parts").collect()] == [(0, 7, "x")]
    assert files.load_table(spark, place, "sales_2024").count() == 0 == files.load_table(spark, place, "empty").count()
    assert [(r.table_name, r.imported_at.hour) for r in files.registered(spark, place).collect()] == [("parts", 3), ("sales_2024", 3), ("empty", 1)]
    assert run(4, force=True)["parts"] == "updated"


@pytest.mark.parametrize("text, encoding, found", [("é" * 30_000, "utf-8", "utf-8"), ("aé" * 9, "cp1252", "cp1252"), ("abc", "utf-8-sig", "utf-8-sig"), ("abc é", "utf-16", "utf-16"), ("abc" * 40, "utf-16-le", "utf-16-le"), ("abc" * 40, "utf-16-be", "utf-16-be"), ("", "utf-8", "utf-8")])
def test_sniffed_encodings(text, encoding, found):
    assert files.decode(text.encode(encoding)) == (text, found)
    assert files.sniff(b"\x81\x8d") == "latin-1"


def test_memory_in_the_question_path(spark):
    q = inputs.queries(spark, SF).where("query_id < 6").withColumn("text", F.when(F.col("query_id") == 5, "what about the second one and its parts").otherwise(F.concat(F.lit("what about the second one of "), F.col("text"))))
    rows = [
        (0, "earlier words", "Rewritten question: plain words of a question", "the summary", "the facts", "USER: hi", '["facts"]'),
        (1, "earlier words", None, "the summary", "", "USER: hi", None),
        (2, "earlier words", " ".join(["word"] * 300), None, "the facts", "USER: hi", '["summary"]'),
        (3, None, "never asked", "the summary", "the facts", "USER: hi", None),
    ]
    past = spark.createDataFrame(rows, "query_id long, last_question string, rewrite string, summary string, facts string, recent string, layers string")
    got = {r.query_id: r for r in services.answered(q, inputs.chunks(spark, SF), retrieve.visible("u7", "u7@x"), past).collect()}
    text = {r.query_id: r.text for r in q.collect()}
    assert got[0].question == "plain words of a question" and "the facts" in got[0].prompt and "the summary" not in got[0].prompt
    assert got[1].question in (f"earlier words {text[1]}", text[1]) and "the summary" in got[1].prompt and "Known facts" not in got[1].prompt
    assert got[2].question == text[2] and "the facts" not in got[2].prompt and "USER: hi" in got[2].prompt
    assert got[3].question == text[3] and "the summary" not in got[3].prompt
    assert got[4].question == text[4] and "Recent conversation" not in got[4].prompt
