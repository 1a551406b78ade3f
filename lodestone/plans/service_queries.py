"""Queries of routing, memory saving, scanned pages, captions, attachments, and whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answer, chunkers, memory, packing, permissions, retrieve, tables
from lodestone.plans import inputs, services
from lodestone.plans.retrieval_queries import _HITS, CALLER, EMAIL, sparse_topk
from lodestone.plans.text_queries import _STRIP, _clean_sql
from lodestone.session import pinned, sent, table


def vector_router(spark, d):
    """Every twentieth vector as a question, all others as tables' summaries."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    held = e.where("vec_id % 20 <> 0").withColumnRenamed("vec_id", "table_id")
    return tables.routed(q, held).select("query_id", "routed_to", "score")


def id_intersection(spark, d):
    """Documents that a user has both uploaded and a valid permission for."""
    now = F.to_timestamp(F.lit(inputs.NOW))
    docs = inputs.documents(spark, d)
    return permissions.uploads_allowed(docs, inputs.permissions(spark, d), "u4", now)


def caller_emails(spark, d):
    users = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.concat(F.lower("c_name"), F.lit("@x")).alias("email"))
    return permissions.emails_of(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("caller_id")), users).select("o_orderkey", "email")


def users_like(spark, d):
    return permissions.users_like(table(spark, d, "customer").select(F.col("c_name").alias("user_id"), "c_custkey"), "%1_").select("c_custkey")


def registrations(spark, d):
    c = table(spark, d, "customer")
    email = F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("@x.org")))
    email = F.regexp_replace(email, "[ #]", "")
    password = F.expr("substring(c_mktsegment, 1, cast(c_custkey % 9 as int))")
    name = F.when(F.pmod("c_custkey", F.lit(5)) == 0, "  ").otherwise(F.col("c_name"))
    return c.select("c_custkey", permissions.registrable(email, password, name).alias("refused"))


def shape_order(spark, d):
    """Each user's events as shapes of a slide."""
    e = table(spark, d, "events")
    shape = F.struct(F.nullif(F.pmod("event_id", F.lit(5)), F.lit(0)).cast("int").alias("top"), F.pmod("event_id", F.lit(3)).cast("int").alias("left"), F.col("event_id").alias("id"))
    rows = e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", shape.alias("s")))), lambda x: x["s"]).alias("shapes"))
    return rows.select("user_id", F.posexplode(chunkers.ordered_shapes(F.col("shapes"))).alias("place", "s")).select("user_id", "place", F.col("s.id").alias("event_id"))


def crawl_preview(spark, d):
    """Documents as chunks of their source, grouped for a look before a crawl is stored."""
    t = table(spark, d, "documents")
    head = F.min_by(F.struct("doc_id", "lang", F.substring("text", 1, 300).alias("head")), "doc_id")
    g = t.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.sum(T.tokens(F.col("text"))).alias("tokens"), head.alias("f"))
    return g.select("source", "chunks", "tokens", F.col("f.doc_id").alias("first_doc"), F.col("f.lang").alias("first_lang"), F.col("f.head").alias("head"))


def candidate_lengths(spark, d):
    return answer.length_stats(sent(pinned(sparse_topk(spark, d))), table(spark, d, "documents"))


def clean_walk(spark, d):
    """Conversations as nested handler output, cleaned by what stands beside each text."""
    c = table(spark, d, "conversations")
    noisy = F.concat(F.lit("<b>x</b>  "), F.col("text"), F.lit("\n\n\n\n---- y"))
    item = F.struct(F.when(F.col("role") == "assistant", "table").otherwise("text").alias("type"), noisy.alias("content"), F.struct(F.lit("<kept>").alias("note")).alias("metadata"))
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", item.alias("item")))).alias("items"))
    kind = rows.schema["items"].dataType
    return rows.select("conv_id", F.explode(T.clean_nested(F.col("items"), kind)).alias("x")).select("conv_id", "x.turn", "x.item.type", "x.item.content", F.col("x.item.metadata.note").alias("note"))


def model_preambles(spark, d):
    t = table(spark, d, "documents")
    made = F.concat(F.lit("## Step 1: look\nHere is the table:\nI can see rows\n"), F.col("text"), F.lit("\n\n\n\n**Step 2** done\nLet me end.\nThere are two tables in the image, yes\nlast"))
    return t.select("doc_id", T.without_preamble(made).alias("text"))


def slide_marks(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", T.without_placeholders(F.concat(F.lit("‹#› "), F.col("text"), F.lit("\n\n\n\n<#> end #"))).alias("text"))


def scanned_pages(spark, d):
    """Documents as scanned files whose pages are their lines, of all classes."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("page", "line"))
    n = F.col("doc_id") + F.col("page")
    label = F.element_at(F.array(*[F.lit(x) for x in ("text_only", "has_chart", " HAS_TABLE", "mixed", "odd")]), F.pmod(n, F.lit(5)).cast("int") + 1)
    pages = t.select(
        "doc_id", "page", label.alias("label"), F.col("line").alias("ocr"),
        F.concat(F.lit("Here is what it shows\nchart "), n.cast("string")).alias("description"), F.when(F.pmod(n, F.lit(7)) != 0, F.lit("a | b")).alias("table"),
    )
    out = chunkers.scanned_text(pages)
    return out.select("doc_id", "text", F.array_join(F.transform("visuals", lambda v: F.concat_ws(":", v["type"], v["content"])), "\n").alias("visuals"))


def table_captions(spark, d):
    """Events as page items: runs of tables of a section, some with a caption below or above."""
    e = table(spark, d, "events")
    nth = lambda n: F.pmod("event_id", F.lit(n))
    body = F.concat(F.lit("| t "), F.col("event_id").cast("string"), F.lit(" |"))
    content = F.when(nth(6) == 0, F.concat(body, F.lit("\n\nCaption: Table "), F.col("event_id").cast("string"))).when(nth(25) == 1, F.concat(F.lit("Caption: above\n\n"), body)).otherwise(body)
    rows = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("position"), F.when(F.col("event_type") == "click", "text").otherwise("table").alias("type"), content.alias("content"), F.when(nth(4) == 0, "A").otherwise("B").alias("section"))
    return chunkers.spread_captions(rows)


def attachment_chunks(spark, d):
    """Orders as mails, their items as chunks of attachments."""
    o, i = table(spark, d, "orders"), table(spark, d, "lineitem")
    mails = o.select(F.col("o_orderkey").cast("string").alias("path"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file_id"), F.col("o_orderpriority").alias("subject"), F.lit("a@x").alias("from"), F.lit("b@x").alias("to"), F.col("o_orderstatus").alias("date"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string"), F.lit(".eml")).alias("name"))
    name = F.concat(F.lit("part"), F.pmod("l_partkey", F.lit(4)).cast("string"), F.element_at(F.array(F.lit(".pdf"), F.lit(".CSV"), F.lit(".txt")), F.pmod("l_partkey", F.lit(3)).cast("int") + 1))
    rows = i.select(F.col("l_orderkey").cast("string").alias("path"), name.alias("name"), F.col("l_linenumber").alias("position"), F.lit(None).cast("string").alias("type"), F.col("l_returnflag").alias("content"), F.when(F.pmod("l_partkey", F.lit(2)) == 0, "docx").alias("source_type"))
    return chunkers.attachment_chunks(mails, rows).select("path", "source", "file_id", "attachment_guid", "source_type", "eml_source", "subject", "position", "type", "content")


def save_turns(spark, d):
    """Each conversation's turns after the third saved to what the first three left: how many stay, and the summary's words."""
    t = inputs.turns(spark, d).withColumn("user_id", F.col("session_id")).withColumn("created_at", F.col("turn").cast("long"))
    cols = ["session_id", "turn", "role", "content"]
    first = t.where("session_id % 3 = 0").select("session_id", F.lit("old summary").alias("summary")).distinct()
    titles = t.where("session_id % 2 = 0").select("session_id", F.lit("named").alias("title")).distinct()
    facts = t.limit(0).select("user_id", F.lit("").alias("fact"), "created_at", F.col("turn").cast("long").alias("id"))
    said = F.filter(F.split("content", r"(?<=[.!?])\s+"), lambda s: F.length(s) < 60)
    out = memory.saved(t.where("turn < 3").select(*cols), first, facts, titles, t.where("turn >= 3"), said)
    n = out["turns"].groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.min("turn").alias("first_turn"))
    s = out["summaries"].select("session_id", F.md5("summary").alias("summary"))
    f = out["facts"].groupBy(F.col("user_id").alias("session_id")).agg(F.count(F.lit(1)).alias("facts"))
    rows = n.join(s, "session_id", "left").join(out["titles"], "session_id", "left").join(f, "session_id", "left")
    return rows.select("session_id", "turns", "first_turn", "summary", "title", F.coalesce("facts", F.lit(0)).cast("long").alias("facts"))


def text_chunks(spark, d):
    """Plain texts by their structure."""
    return chunkers.text_chunks(table(spark, d, "documents"))


def artifacts(spark, d):
    """Lines that hold nothing but rules, page numbers, and digits."""
    e = table(spark, d, "events")
    forms = ["---", "Page {}", "P. {}", "{}", "== {} ==", "page{}", "___\n{}", "Page {} of", "- {}", "p.{} --"]
    line = F.replace(F.element_at(F.array(*[F.lit(x) for x in forms]), F.pmod("event_id", F.lit(len(forms))).cast("int") + 1), F.lit("{}"), F.col("event_id").cast("string"))
    return e.select("event_id", packing.bare(line).alias("bare"))


def question_path(spark, d):
    """Benchmark items and greetings as questions: routed, searched, answered with a citation."""
    q = inputs.queries(spark, d)
    hello = q.select((F.col("query_id") + 100000).alias("query_id"), F.lit("hello").alias("text"), "vector").where("query_id % 10 = 0")
    return services.answered(q.unionByName(hello), inputs.chunks(spark, d), retrieve.visible(CALLER, EMAIL), texts=inputs.documents(spark, d)).select("query_id", "route", "question", "answer", "cited")


def evaluation(spark, d):
    q = inputs.queries(spark, d)
    refs = q.where("query_id % 2 = 0").select("query_id", F.col("text").alias("reference"))
    rows = services.answered(q, inputs.chunks(spark, d), retrieve.visible(CALLER, EMAIL), texts=inputs.documents(spark, d))
    return services.evaluated(rows, refs).select("query_id", "faithfulness", "relevance", "agreement", "average")


_GUID = "concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], lower(to_hex((('0x' || h[17])::INT & 3) | 8)) || h[18:20], h[21:32])"

QUERIES = {
    "vector_router": (
        vector_router,
        """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS t, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b
WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) = 1)
SELECT query_id, CASE WHEN score >= 0.45 THEN t END AS routed_to, score FROM s""",
    ),
    "id_intersection": (
        id_intersection,
        f"""WITH {inputs.DOCUMENTS_SQL}, {inputs.PERMISSIONS_SQL} SELECT document_id FROM docs WHERE uploaded_by = 'u4'
AND document_id IN (SELECT document_id FROM perms WHERE user_id = 'u4' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{inputs.NOW}'))""",
    ),
    "caller_emails": (caller_emails, "SELECT o_orderkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) || '@x' ELSE '' END AS email FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "users_like": (users_like, "SELECT c_custkey FROM customer WHERE c_name LIKE '%1_'"),
    "registrations": (
        registrations,
        """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'bad email' WHEN length(substring(c_mktsegment, 1, (c_custkey % 9)::INT)) < 6 THEN 'short password' WHEN c_custkey % 5 = 0 THEN 'blank name' END AS refused FROM customer""",
    ),
    "shape_order": (shape_order, "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id % 5, event_id % 3, event_id) - 1)::INT AS place, event_id FROM events"),
    "crawl_preview": (
        crawl_preview,
        """SELECT source, count(*) AS chunks, sum(greatest(1, floor(length(text) / 3.5::DOUBLE))::BIGINT)::BIGINT AS tokens, min(doc_id) AS first_doc, arg_min(lang, doc_id) AS first_lang, arg_min(substring(text, 1, 300), doc_id) AS head
FROM documents GROUP BY source""",
    ),
    "candidate_lengths": (
        candidate_lengths,
        f"WITH {_HITS} SELECT query_id, count(*) AS candidates, round(avg(length(text)), 2) AS mean_chars, max(length(text))::BIGINT AS most_chars FROM hits JOIN documents USING (doc_id) GROUP BY query_id",
    ),
    "clean_walk": (
        clean_walk,
        f"""WITH a AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'table' ELSE 'text' END AS type, '<b>x</b>  ' || text || repeat(chr(10), 4) || '---- y' AS t FROM conversations),
c AS (SELECT conv_id, turn, type, CASE WHEN type = 'table' THEN regexp_replace(array_to_string(list_transform(list_filter(string_split(t, chr(10)), lambda l: {_STRIP.format('l')} <> ''),
  lambda l: CASE WHEN regexp_matches(l, '^[\\|\\s\\-:]+$') THEN l ELSE {_STRIP.format("regexp_replace(l, ' {2,}', ' ', 'g')")} END), chr(10)), '^\\s+|\\s+$', '', 'g') ELSE {_clean_sql('t')} END AS content FROM a)
SELECT conv_id, turn, type, CASE WHEN type <> 'table' AND length(content) < 20 THEN '' ELSE content END AS content, '<kept>' AS note FROM c""",
    ),
    "model_preambles": (
        model_preambles,
        f"""WITH a AS (SELECT doc_id, '## Step 1: look' || chr(10) || 'Here is the table:' || chr(10) || 'I can see rows' || chr(10) || text || repeat(chr(10), 4) || '**Step 2** done' || chr(10) || 'Let me end.' || chr(10) || 'There are two tables in the image, yes' || chr(10) || 'last' AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '##\\s*Step\\s*\\d+[:\\-].*\\n?', '', 'gi'), '\\*\\*Step\\s*\\d+.*?\\*\\*\\n?', '', 'gi') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '(?im)^(Let me|I will|I''ll|First,|Here is|Here are|The following|Below is|Below are|Sure,|Certainly,|Of course,).*\\n?', '', 'g') AS t FROM b),
e AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?im)^There (is|are) \\w+ (table|chart)[s]? in the image.*\\n?', '', 'g'), '(?im)^I (can see|found|identified|detected|notice).*\\n?', '', 'g') AS t FROM c)
SELECT doc_id, {_STRIP.format("regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM e""",
    ),
    "slide_marks": (
        slide_marks,
        f"""WITH a AS (SELECT doc_id, replace(replace(replace(text || repeat(chr(10), 4) || '<#> end #', '<#>', ''), '#', ''), chr(8203), '') AS t FROM documents)
SELECT doc_id, {_STRIP.format("regexp_replace(' ' || t, '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM a""",
    ),
    "scanned_pages": (
        scanned_pages,
        f"""WITH t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS page FROM documents),
p AS (SELECT doc_id, page, '---' || chr(10) || 'Page ' || page || chr(10) || {_STRIP.format("line")} AS body,
 CASE WHEN (doc_id + page) % 5 = 2 AND (doc_id + page) % 7 <> 0 THEN 'table:a | b' WHEN (doc_id + page) % 5 IN (1, 3) THEN 'image:chart ' || (doc_id + page) END AS v FROM t)
SELECT doc_id, string_agg(body, chr(10) || chr(10) ORDER BY page) AS text, coalesce(string_agg(v, chr(10) ORDER BY page), '') AS visuals FROM p GROUP BY doc_id""",
    ),
    "table_captions": (
        table_captions,
        """WITH r AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 'text' ELSE 'table' END AS type, '| t ' || event_id || ' |' AS body, CASE WHEN event_id % 4 = 0 THEN 'A' ELSE 'B' END AS section,
 event_id % 6 = 0 AS below, event_id % 6 <> 0 AND event_id % 25 = 1 AS above FROM events),
a AS (SELECT *, CASE WHEN type = 'table' AND lag(type) OVER w = 'table' AND lag(section) OVER w = section THEN 0 ELSE 1 END AS c FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a),
f AS (SELECT *, first_value(CASE WHEN type = 'table' AND below THEN 'Caption: Table ' || event_id WHEN type = 'table' AND above THEN 'Caption: above' || chr(10) || chr(10) || body END IGNORE NULLS)
  OVER (PARTITION BY user_id, run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cap FROM b)
SELECT user_id AS doc_id, event_id AS position, type, section, CASE WHEN type = 'table' AND cap IS NOT NULL THEN CASE WHEN above THEN '' ELSE body END || chr(10) || chr(10) || cap
 WHEN below THEN body || chr(10) || chr(10) || 'Caption: Table ' || event_id WHEN above THEN 'Caption: above' || chr(10) || chr(10) || body ELSE body END AS content FROM f""",
    ),
    "attachment_chunks": (
        attachment_chunks,
        f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, 'part' || (l_partkey % 4) || CASE l_partkey % 3 WHEN 0 THEN '.pdf' ELSE '.txt' END AS name FROM lineitem WHERE l_partkey % 3 <> 1),
b AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('f' || l_orderkey || ':' || name)) AS h FROM a)
SELECT l_orderkey::VARCHAR AS path, name AS source, 'f' || l_orderkey AS file_id, {_GUID} AS attachment_guid, CASE WHEN l_partkey % 2 = 0 THEN 'docx' WHEN l_partkey % 3 = 0 THEN 'pdf' ELSE 'txt' END AS source_type,
 'm' || l_orderkey || '.eml' AS eml_source, o_orderpriority AS subject, l_linenumber AS position, 'text' AS type, l_returnflag AS content FROM b JOIN orders ON o_orderkey = l_orderkey""",
    ),
    "save_turns": (
        save_turns,
        r"""WITH t AS (SELECT conv_id, turn, role, text, count(*) OVER w AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WINDOW w AS (PARTITION BY conv_id)),
old AS (SELECT * FROM t WHERE n > 6 AND back > 3),
l AS (SELECT conv_id, turn, unnest(string_split(upper(role) || ': ' || coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(upper(role) || ': ' || coalesce(text, ''), chr(10)), 1) AS k FROM old),
s AS (SELECT conv_id, string_agg(array_to_string(list_slice(string_split(line, ' '), 1, 8), ' '), chr(10) ORDER BY turn, k) AS s FROM l GROUP BY conv_id),
m AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'old summary' || coalesce(chr(10) || s, '') ELSE s END AS summary FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN s USING (conv_id)),
c AS (SELECT conv_id, CASE WHEN len(regexp_extract_all(summary, '\S+')) > 500 THEN array_to_string(list_slice(regexp_extract_all(summary, '\S+'), -500, -1), ' ') ELSE summary END AS summary FROM m),
said AS (SELECT conv_id, regexp_replace(f, '^\s+|\s+$', '', 'g') AS f, turn FROM (SELECT conv_id, turn, unnest(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) < 60)) AS f FROM conversations WHERE role = 'user' AND turn >= 3)),
facts AS (SELECT conv_id, least(15, count(DISTINCT f)) AS facts FROM said WHERE length(f) > 0 GROUP BY conv_id),
first AS (SELECT conv_id, regexp_replace(regexp_replace(arg_min(text, turn), '^\s+|\s+$', '', 'g'), '^["'']+|["'']+$', '', 'g') AS title FROM conversations WHERE role = 'user' AND turn >= 3 GROUP BY conv_id)
SELECT conv_id AS session_id, count(*) AS turns, min(turn) AS first_turn, any_value(md5(summary)) AS summary,
 any_value(CASE WHEN conv_id % 2 = 0 THEN 'named' WHEN length(title) > 50 THEN substring(title, 1, 50) || '...' ELSE title END) AS title, coalesce(any_value(facts), 0)::BIGINT AS facts
FROM t LEFT JOIN c USING (conv_id) LEFT JOIN facts USING (conv_id) LEFT JOIN first USING (conv_id) WHERE NOT (n > 6 AND back > 3) GROUP BY conv_id""",
    ),
    "text_chunks": (text_chunks, None),
    "artifacts": (artifacts, "SELECT event_id, event_id % 10 IN (0, 1, 2, 3, 4, 6, 9) AS bare FROM events"),
    "question_path": (question_path, None),
    "evaluation": (evaluation, None),
}
