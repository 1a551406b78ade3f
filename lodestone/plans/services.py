"""Whole flows: taking in files, answering a batch of questions, and judging the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import classify, providers
from lodestone.functions.text import strip
from lodestone.operators import answer, chunks, dml, packing, permissions
from lodestone.operators import memory as memories
from lodestone.plans.loop import corrective_search
from lodestone.session import pinned, sent
from lodestone.sources import files, sinks


#: What memory holds of a question's past.
MEMORY = ("last_question", "rewrite", "summary", "facts", "recent", "layers")


def ingest(found: DataFrame, override: Column | None = None, parsers: dict | None = None) -> DataFrame:
    """Canonical chunks of scanned files, by extension or an override; a file of no known type is an error."""
    kind = chunks.source_type(F.col("path"), override, strict=True)
    return chunks.normalise(files.elements(found.withColumn("source_type", kind), parsers))


def upload(spark: SparkSession, found: DataFrame, user: str, place: str, documents: DataFrame, grants: DataFrame, now: Column, parsers: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored chunks, documents, grants) after a user's upload of scanned files.

    Files of other extensions are refused; a file that gives no chunk is an error. Chunks
    carry the document and who uploaded it; the user gets an admin grant.
    """
    kind = chunks.source_type(F.col("path"))
    bad = found.where(kind.isNull()).select("name").limit(5).collect()
    if bad:
        raise ValueError(f"no upload of {[r['name'] for r in bad]}")
    key = F.concat(F.lit("doc_"), F.substring(F.md5(F.concat_ws(":", F.lit(user), "path")), 1, 12))
    named = found.withColumn("document_id", key)
    rows = ingest(named, None, parsers).join(named.select(F.col("path").alias("doc_id"), "document_id"), "doc_id")
    rows = rows.select("document_id", F.lit(user).alias("uploaded_by"), "chunk_id", "type", "content", "embed_text", "position")
    empty = named.join(rows.select("document_id").distinct(), "document_id", "left_anti").select("name").limit(5).collect()
    if empty:
        raise ValueError(f"nothing to read in {[r['name'] for r in empty]}")
    vectors = providers.embedded(rows, "embed_text")
    stored = sinks.upsert_table(spark, vectors, place, ["chunk_id"])
    counts = rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    own = named.join(counts, "document_id").select("document_id", F.col("name").alias("source"), kind.alias("source_type"), F.lit(user).alias("uploaded_by"), now.alias("uploaded_at"), "chunks")
    granted = own.select(F.lit(user).alias("user_id"), "document_id", F.lit("admin").alias("permission_level"), now.alias("granted_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    return stored, dml.upsert(documents, own, ["document_id"], [F.desc("uploaded_at")]), permissions.grant(grants, granted)


def remove_document(spark: SparkSession, place: str, documents: DataFrame, grants: DataFrame, document: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, documents, grants) without a document."""
    held = sinks.read_table(spark, place)
    return held.where(F.col("document_id") != document), documents.where(F.col("document_id") != document), grants.where(F.col("document_id") != document)


def context_block(number: Column, source: Column, page: Column, section: Column, content: Column) -> Column:
    """One chunk as the prompt shows it: its heading, then its text."""
    return F.concat(answer.header(number, source, page, section), F.lit("\n"), content)


def answered(questions: DataFrame, chunks_: DataFrame, visible: Column | None = None, memory: DataFrame | None = None, budget: int = packing.BUDGET, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, route, question, prompt, answer, cited) of a batch of questions (query_id, text, vector), with the stand-in generator.

    Small talk is answered without retrieval. memory holds (query_id, last_question, rewrite,
    summary, facts, recent, layers) of the questions that have a past: a vague question is
    asked as its rewrite where that is acceptable (a null rewrite: the last question before
    it), and the prompt begins with the layers that it needs; layers is a model's answer, and
    null stands for all. Hits come from the corrective search; as many as fit the budget follow.
    chunks_ needs doc_id, text, vector, source, and what ``visible`` reads; texts, the same but vector
    where that lies in a table of its own.
    """
    rows = questions.withColumn("route", classify.route(F.col("text")))
    if memory is None:
        memory = questions.select("query_id", *[F.lit(None).cast("string").alias(c) for c in MEMORY]).limit(0)
    held = rows.join(memory.select("query_id", *MEMORY), "query_id", "left")
    both = F.coalesce("rewrite", F.concat_ws(" ", "last_question", "text"))
    past = F.col("last_question").isNotNull()
    asked = F.when(classify.is_vague(F.col("text")) & past, classify.accepted_rewrite(both, F.col("text"))).otherwise(F.col("text"))
    has = {c: F.coalesce(strip(F.col(c)) != "", F.lit(False)) for c in ("summary", "facts")}
    needed = memories.layers(F.col("layers"), F.col("text"), has["summary"], has["facts"])
    layer = {c: F.when(F.array_contains(needed, c), F.col(c)) for c in has}
    held = held.withColumn("question", asked).withColumn("context", F.when(past, memories.context(layer["summary"], layer["facts"], F.col("recent"))))
    talk = held.where("route = 'DIRECT'").select("query_id", "route", "question", F.lit(None).cast("string").alias("prompt"), F.lit(answer.direct("")).alias("answer"), F.lit(0).cast("long").alias("cited"))
    search = held.where("route <> 'DIRECT'")
    hits = corrective_search(search.select("query_id", F.col("question").alias("text"), "vector"), chunks_, visible, texts=texts)
    named = sent(pinned(hits)).join((chunks_ if texts is None else texts).select("doc_id", "source", F.col("text").alias("content")), "doc_id")
    sized = named.withColumn("tokens", packing.prompt_tokens(F.lit(None), F.col("content")))
    lists = sized.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source", "content", "tokens"))).alias("h"))
    taken = lists.withColumn("t", packing.within_budget(F.col("h.tokens").cast("array<bigint>"), budget))
    block = lambda x, i: context_block(i + 1, x["source"], F.lit(None).cast("int"), F.lit(None).cast("string"), x["content"])
    found = taken.select("query_id", F.array_join(F.transform(F.transform("t", lambda i: F.get("h", i)), block), "\n\n").alias("context_"), F.get("h", F.lit(0)).alias("best"))
    out = search.join(found, "query_id", "left")
    prompt = answer.prompt(F.col("question"), F.concat_ws("\n\n", F.nullif(F.col("context"), F.lit("")), F.col("context_")))
    sentence = F.element_at(F.split(strip(F.col("best.content")), r"(?<=[.!?])\s+"), 1)
    said = F.when(F.col("best").isNull(), F.lit("I don't have enough information in the provided context.")).otherwise(F.concat(sentence, F.lit(" [Source: "), F.col("best.source"), F.lit("]")))
    full = out.select("query_id", "route", "question", prompt.alias("prompt"), said.alias("answer"))
    cites = answer.citations(full).groupBy("query_id").agg(F.count(F.lit(1)).alias("cited"))
    return full.join(cites, "query_id", "left").withColumn("cited", F.coalesce("cited", F.lit(0)).cast("long")).unionByName(talk)


def evaluated(answers: DataFrame, references: DataFrame) -> DataFrame:
    """answers (query_id, question, prompt, answer) with stand-in judges' 1..5 scores and their average.

    faithfulness: the share of the answer's words that the prompt holds; relevance: of the
    question's words that the answer holds; reference: of the reference's, null without one.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)")))
    share = lambda part, whole: F.when(F.size(words(part)) > 0, F.size(F.array_intersect(words(part), words(whole))) / F.size(words(part)))
    rows = answers.join(references.select("query_id", "reference"), "query_id", "left")
    judges = {
        "faithfulness": answer.relevance(share(F.col("answer"), F.col("prompt"))),
        "relevance": answer.relevance(share(F.col("question"), F.col("answer"))),
        "agreement": answer.relevance(share(F.col("reference"), F.col("answer"))),
    }
    return answer.judged(rows, judges)


__all__ = ["answered", "context_block", "evaluated", "ingest", "remove_document", "upload"]
