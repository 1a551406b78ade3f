"""Operators 4, 5 and 8: against SQL twins and plain restatements."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, files, quality, registry, warc
from tests.conftest import SF
from tests.duck import assert_same, connect


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    assert_same(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name])


def restated(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = Counter(grams)
    covered = {p for i, g in enumerate(grams) if twice[g] > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark):
    texts = [None, "", " \t\n", "a b c d e " * 3, "x y\nx y\n\nx y", "# * $ é", "a b c d e f a b c d e", "w " * 20000, "\x85 \xa0 b", "one two three four five"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_words", F.lit(-1))
    for r in quality.verdicts(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == restated(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.verdicts(docs.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    plan = quality.ledger(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_rules(spark):
    texts = {1: "- one two\n  * three four\n• five six seven eight nine ten", 2: "one two three four...\nfive six seven eight … \nnine ten", 3: "1 2 3 4 5 6 7 8 é x", 4: "a b c d e f g h i j k"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in quality.ledger(docs).collect()}
    assert [rows[i].n_bullet_lines for i in texts] == [3, 0, 0, 0]
    assert [rows[i].n_ellipsis_lines for i in texts] == [0, 2, 0, 0]
    assert [rows[i].n_letter_words for i in texts] == [11, 11, 2, 11]
    failed = lambda i: {n for k, n in enumerate(quality.RULES) if rows[i].failed_bits >> k & 1}
    assert "bullet_lines" in failed(1) and "ellipsis_lines" in failed(2) and "few_letters" in failed(3)
    one = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert one[4].saved_by == quality.mask(["mean_word_length"]) and not one[4].kept


def test_verdicts_come_from_the_stored_ledger(spark, monkeypatch):
    monkeypatch.setattr(quality.store, "settled", lambda df, name: df.where("doc_id = 1"))
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert [r.doc_id for r in quality.verdicts(docs).collect()] == [1]


def test_ablations(spark):
    rows = quality.stored(spark.read.parquet(f"{SF}/documents.parquet"))
    bits = [r.failed_bits for r in rows.collect()]
    names = list(quality.RULES)
    for r in quality.ablations(rows).collect():
        m, b = quality.mask(quality.POLICIES[r.policy]), 1 << names.index(r.rule)
        assert r.rejected == sum(1 for x in bits if x & b)
        assert r.only_by_rule == sum(1 for x in bits if x & m == b)
        assert r.kept_without == sum(1 for x in bits if not x & m & ~b)


def test_keep_good_keeps_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want


def test_chat_round_trip(spark):
    control = "</s>[INST] x [/INST] <|turn|> <\\|next|> [\\\\INST] <|end|>\n<|im_start|>"
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", control), (1, 3, "assistant", control), (1, 3, "assistant", control), (2, None, None, None), (3, 1, "we\nird\\n\\", ""), (None, 1, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    done = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", control), ("assistant", "b"), ("assistant", control), ("assistant", control)]
    assert back[1].loss_text == "b" + control + control
    assert done[1].formatted.count(chat.TURN) == 2 and done[1].formatted.count(chat.NEXT) == 2
    assert [(t.role, t.text) for t in back[2].turns] == [("", "")]
    assert [(t.role, t.text) for t in back[3].turns] == [("we\nird\\n\\", "")]
    assert chat.digests(turns.limit(0)).count() == 0
    d = {r.conv_id: r for r in chat.digests(turns).collect()}
    assert d[2].n_turns == 1 and d[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()


def page_rows(spark):
    big, small = "p" * 100, "s" * 99
    rows = [(3, "u3", big), (1, "u1\r\nX: y", big), (2, None, small), (4, "u4", small), (5, "u5", None), (1, "u1", big), (None, "n", big), (6, "u6", "é" * 50), (7, "u7", "WARC/1.1\r\n\r\n" * 40)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


def test_warc_types(spark):
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.report(page_rows(spark)).collect()), key=repr)
    assert got == sorted(
        [(3, 100, "revisit", 1), (1, 100, "response", None), (1, 100, "response", None), (0, 100, "revisit", 1), (2, 99, "response", None), (4, 99, "response", None), (5, 0, "response", None), (6, 100, "response", None), (7, 480, "response", None)],
        key=repr,
    )
    assert warc.report(page_rows(spark).limit(0)).count() == 0


def test_bundles_are_seekable(spark):
    import zstandard

    index = warc.write_bundles(page_rows(spark), frame_bytes=300, bundle_bytes=900)
    rows = index.collect()
    assert len({r.bundle for r in rows}) > 1
    for path in {r.bundle for r in rows}:
        with files.open_read(path) as f:
            sizes = warc.read_seek_table(f)
            f.seek(0)
            # a plain reader sees the frames and skips the seek table
            whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        assert sum(d for _, d in sizes) == len(whole)
        assert warc.parse(whole[: sizes[0][1]])[0]["WARC-Type"] == "warcinfo"
        for r in (r for r in rows if r.bundle == path):
            assert r.frame > 0
            base = sum(d for _, d in sizes[: r.frame])
            headers, _ = warc.parse(whole[base + r.at : base + r.at + r.size])
            assert headers["WARC-Record-ID"] == f"<{r.record_id}>"
            if headers["WARC-Type"] == "revisit":
                # the record that it names is there, and holds the payload
                assert headers["WARC-Refers-To"] in {f"<{x.record_id}>" for x in rows if x.page_id == int(headers["WARC-Refers-To-Page-ID"])}


def test_the_footer_is_read(spark, monkeypatch):
    index = warc.write_bundles(page_rows(spark))
    path = index.first().bundle
    with files.open_read(path) as f:
        body = f.read()
    files.write(path, body[:-4] + b"none")
    with pytest.raises(Exception, match="no seek table"):
        warc.read_bundles(index.where(F.col("bundle") == path)).collect()


def test_a_broken_payload_is_noticed():
    name, raw = warc.record(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), None, "response")
    headers, payload = warc.parse(raw)
    assert payload == b"body" and headers["WARC-Target-URI"] == "u"
    with pytest.raises(ValueError):
        warc.parse(raw[:-1])
