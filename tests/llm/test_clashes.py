"""Stages and removers on documents whose extra columns are named like every column that they use within."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, line_dedup, pii, pipeline, quality, simhash, store, substring_dedup

NAMES = [
    *quality.MEASURES, "failed_bits", "_t", "_w", "_l", "_x", "_z", "_keep", "_doc", "_hash", "__gone", "gone", "doc", "hash", "lines", "line", "sentences", "sid", "least", "component", "node",
    "ids", "n_tokens", "item_id", "edits", "recall", "rank", "spans", "piece", "c0", "a.b", "N_Symbols_", "first_docs", "word", "n", "bucket", "body", "kept", "saved_by", "saved_with",
]
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen. fourteen fifteen sixteen seventeen eighteen nineteen twenty more words here to go."
ROWS = [
    (1, f"{PASSAGE}\nalpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (2, f"{PASSAGE}\nalpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (3, "some other text that stands alone here, with words enough to be kept by the rules"),
    (4, "short"),
    (5, "the benchmark item stands in here for all to see and to find again in the end"),
    (None, None),
]
BENCHMARK = [(1, "the benchmark item stands in here for all to see and to find again")]


def stages():
    yield "keep_good", lambda s, d, b: quality.keep_good(d)
    yield "remove_lines", lambda s, d, b: line_dedup.remove_lines(d)
    yield "remove_spans", lambda s, d, b: substring_dedup.remove_spans(d)
    yield "keep_one", lambda s, d, b: simhash.keep_one(d)
    yield "drop_contaminated", lambda s, d, b: decontaminate.drop_contaminated(d, b)
    yield "round_trip", lambda s, d, b: bpe.round_trip(d)
    yield "verdicts", lambda s, d, b: quality.verdicts(d)


@pytest.mark.parametrize("name, stage", list(stages()), ids=[n for n, _ in stages()])
def test_extra_columns_stay(spark, name, stage):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string")
    extra = plain.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in NAMES])
    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    got, want = stage(spark, extra, benchmark), stage(spark, plain, benchmark)
    rows = got.collect()
    pick = lambda rs: sorted((tuple(r[c] for c in want.columns) for r in rs), key=repr)
    assert pick(rows) == pick(want.collect())
    if want.columns == plain.columns:
        assert got.columns == extra.columns
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in NAMES)


def test_redact_keeps_extra_columns(spark):
    model = pii.tagger.Tagger.fresh(pii.KINDS, 4, 1)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").select("*", *[F.lit(c).alias(c) for c in NAMES])
    assert pii.redact(docs, model).columns == docs.columns


def test_a_ledger_refuses_its_own_names(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_words", F.lit(1)).withColumn("other", F.lit(2))
    with pytest.raises(ValueError, match="n_words"):
        quality.ledger(docs, keep=("n_words",))
    assert quality.ledger(docs, keep=("doc_id", "other")).columns[-1] == "other"


def test_unused_names():
    assert store.unused(["Gone", "gone_"], "gone") == "gone__"


def test_stages_of_the_pipeline():
    import corpus_pipeline

    assert corpus_pipeline.STAGES is pipeline.STAGES and corpus_pipeline.run is pipeline.run
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "simhash", "decontaminate", "bpe"]
