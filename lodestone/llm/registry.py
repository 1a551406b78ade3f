"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where it can express one."""

from __future__ import annotations

from lodestone.llm import bpe, centroids, chat, decontaminate, line_dedup, pii, pipeline, quality, simhash, store, substring_dedup, token_counts, token_store, warc


def _table(spark, sf_dir, name):
    return store.tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark, sf_dir):
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.report(_table(spark, sf_dir, "documents"))


def op3_simhash(spark, sf_dir):
    return simhash.report(_table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op5_chat(spark, sf_dir):
    return chat.digests(chat.with_probe(_table(spark, sf_dir, "conversations")))


def op6_token_store(spark, sf_dir):
    return token_store.report(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_warc(spark, sf_dir):
    return warc.report(_table(spark, sf_dir, "pages"))


def op9_token_counts(spark, sf_dir):
    """Tokens of a document's source, language and text, and of each line."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), fields=("source", "lang", "text"))


def op10_line_dedup(spark, sf_dir):
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op11_centroids(spark, sf_dir):
    return centroids.report(_table(spark, sf_dir, "embeddings"))


def op12_pii(spark, sf_dir):
    return pii.report(_table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_bpe": op1_bpe,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_simhash": op3_simhash,
        "op4_quality": op4_quality,
        "op5_chat": op5_chat,
        "op6_token_store": op6_token_store,
        "op7_decontaminate": op7_decontaminate,
        "op8_warc": op8_warc,
        "op9_token_counts": op9_token_counts,
        "op10_line_dedup": op10_line_dedup,
        "op11_centroids": op11_centroids,
        "op12_pii": op12_pii,
        "pipeline": pipeline.run,
    }


def oracle_sql():
    return {
        "op4_quality": quality.ORACLE_SQL,
        "op5_chat": chat.ORACLE_SQL,
        "op8_warc": warc.ORACLE_SQL,
        "op11_centroids": centroids.ORACLE_SQL,
    }
