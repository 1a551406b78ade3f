"""The jobs as queries: each runs its function twice into one new folder and gives the output as it then stands."""

from __future__ import annotations

import uuid

from jobs import hits, ingest, settings
from lodestone.plans import retrieval_queries as retrieval
from lodestone.plans import text_queries as texts
from lodestone.session import shared_dir


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/jobs/{name}-{uuid.uuid4().hex[:12]}"


def job1_ingest(spark, d):
    root = _folder(spark, "ingest")
    config = settings.read(ingest.DEFAULTS, documents=f"{d}/documents.parquet", output=f"{root}/output", checkpoint=f"{root}/checkpoint")
    for _ in range(2):
        ingest.run(spark, config)
    return ingest.current(spark, config["output"])


def job2_hits(spark, d):
    config = settings.read(hits.DEFAULTS, tables=d, output=_folder(spark, "hits"))
    for _ in range(2):
        hits.run(spark, config)
    return hits.written(spark, config["output"])


_CHUNKS = texts._chunks_sql(
    "doc_id, lang, source, total", "i", f"SELECT doc_id, lang, source, 0 AS total, {texts._sentence_groups(texts._SENT.replace('text', texts._clean_sql('text')))} AS f FROM documents WHERE doc_id IS NOT NULL", texts._TAIL
)
_ID = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('txt:' || coalesce(source, '') || ':' || substring(content, 1, 200)))"
JOB1_SQL = f"""WITH c AS (SELECT doc_id, lang, source, i, content, {_ID} AS h FROM ({_CHUNKS}))
SELECT doc_id, lang, source, (i + 1)::INT AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::INT AS chunk_total,
  concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], lower(to_hex((('0x' || h[17])::INT & 3) | 8)) || h[18:20], h[21:32]) AS chunk_id,
  {texts._tok('content')} AS tokens, content FROM c"""


def _sheet_sql(caller: str) -> str:
    sees = f"(owner_email IS NULL OR is_public OR uploaded_by = '{caller}' OR other_user = '{caller}@x' OR owner_email = '{caller}@x')"
    first = texts._SENT.replace("text", texts._clean_sql("text"))
    return f"""SELECT * FROM (WITH {retrieval._search_sql(sees, 'hybrid', hits.DEFAULTS['hits'])}
SELECT query_id, doc_id, rank::INT AS rank, score, found_in, source, '[Source: ' || coalesce(source, 'unknown') || ']' AS citation,
  coalesce({first}[1], '') AS snippet, '{caller}' AS caller FROM fused_top JOIN documents USING (doc_id))"""


QUERIES = {
    "job1_ingest": (job1_ingest, JOB1_SQL),
    "job2_hits": (job2_hits, "\nUNION ALL ".join(_sheet_sql(c) for c in hits.DEFAULTS["callers"])),
}
