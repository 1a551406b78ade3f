"""Queries of conversation memory, keyed changes, incremental loads, and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import text as T
from lodestone.operators import answer, crawl, dml, memory, permissions
from lodestone.plans import inputs
from lodestone.session import table

TTL_NOW = "2024-01-15 00:00:00"


def last_n_turns(spark, d):
    return memory.history(inputs.turns(spark, d), 4).select("session_id", "turn", "role")


def history_text(spark, d):
    return memory.history_text(inputs.turns(spark, d), 4)


def compress_set(spark, d):
    return memory.to_compress(inputs.turns(spark, d)).select("session_id", "turn")


def session_turn_count(spark, d):
    return memory.sessions(inputs.turns(spark, d), n=50).select("session_id", "turns")


def facts_cap(spark, d):
    """Each customer's order priorities and statuses as facts about a nation's user."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    facts = o.select(F.col("c_nationkey").alias("user_id"), F.concat(F.lit(" order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("fact"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"))
    return memory.store_facts(facts.limit(0), facts).select("user_id", "fact", "id")


def route_heuristic(spark, d):
    return inputs.turns(spark, d).groupBy(C.route(F.col("content")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


def vague_queries(spark, d):
    return inputs.turns(spark, d).select("session_id", "turn", C.is_vague(F.col("content")).alias("vague"))


def tier_of_turns(spark, d):
    return inputs.turns(spark, d).select("session_id", "turn", C.tier(F.col("content")).alias("tier"))


def role_check(spark, d):
    return memory.bad_roles(inputs.turns(spark, d)).select("session_id", "turn", "role")


def _ttl(spark, d):
    tier = F.element_at(F.array(F.lit("short"), F.lit("mid"), F.lit("long")), F.pmod("event_id", F.lit(3)).cast("int") + 1)
    e = inputs.events(spark, d).withColumn("tier", tier)
    return e.withColumn("expires_at", C.expiry(F.col("tier"), F.col("ts")))


def ttl_active(spark, d):
    return memory.active(_ttl(spark, d), F.to_timestamp(F.lit(TTL_NOW))).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def ttl_purge(spark, d):
    return memory.expired(_ttl(spark, d), F.to_timestamp(F.lit(TTL_NOW))).select("event_id", "tier")


_CHOSEN = ('["summary"]', '```json\n["facts"]\n```', "summary and facts", '{"a": 1}', '["facts", "summary", "other"]', "[]", '["summary"', None)


def memory_layers(spark, d):
    """What a model's answers, well formed and not, choose of each turn's memory."""
    t = inputs.turns(spark, d)
    chosen = F.element_at(F.array(*[F.lit(x).cast("string") for x in _CHOSEN]), F.pmod(F.col("session_id") + F.col("turn"), F.lit(len(_CHOSEN))).cast("int") + 1)
    has = lambda n: F.pmod("session_id", F.lit(n)) != 0
    question = F.when(F.pmod("turn", F.lit(5)) == 4, F.lit("what of it")).otherwise(F.concat(F.lit("and so then "), F.col("content")))
    return t.select("session_id", "turn", F.array_join(memory.layers(chosen, question, has(2), has(3)), ",").alias("layers"))


def rewrite_acceptance(spark, d):
    """Rewrites with and without preambles, too short and too long, and none."""
    t = inputs.turns(spark, d)
    forms = ["Rewritten question: {}", "{}", "QUERY:{} and more", "ok", "{} {} {} {} {} {} {} {} {} {}", "Question: Answer: {}"]
    form = F.get(F.array(*map(F.lit, forms)), F.pmod("turn", F.lit(7)).cast("int"))
    short = F.substring_index(F.coalesce("content", F.lit("")), " ", 6)
    return t.select("session_id", "turn", C.accepted_rewrite(F.replace(form, F.lit("{}"), short), short).alias("asked"))


def upsert_changed(spark, d):
    """Customers merged with a later state in which every third has another balance and every seventh's segment is unknown."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.when(F.pmod("c_custkey", F.lit(5)) != 0, F.col("c_mktsegment")).alias("segment"))
    old = c.where("c_custkey % 4 <> 0").withColumn("updated_at", F.lit(1))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + F.when(F.pmod("c_custkey", F.lit(3)) == 0, 1).otherwise(0)).alias("c_acctbal"), F.when(F.pmod("c_custkey", F.lit(7)) != 0, F.col("segment")).alias("segment"))
    return dml.upsert_changed(old, new, ["c_custkey"], [F.desc("c_acctbal")], "updated_at", F.lit(2))


def incremental_antijoin(spark, d):
    """Orders that are not registered, or not in their present state."""
    o = table(spark, d, "orders")
    seen = o.where("o_orderkey <= 1000").select("o_orderkey", F.when(F.pmod("o_orderkey", F.lit(10)) == 0, "?").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return dml.unseen(o, seen, ["o_orderkey"], "o_orderstatus").select("o_orderkey", "o_orderstatus")


def registry_status(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("table_name"), "p_partkey", F.md5(F.concat_ws("|", "p_name", "p_brand").cast("binary")).alias("digest"))
    held = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey"), F.when(F.col("p_size") > 40, "old").otherwise(F.md5(F.concat_ws("|", "p_name", "p_brand").cast("binary"))).alias("digest"))
    return dml.status(p, held, "p_partkey", "digest").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _changes(spark, d):
    e = inputs.events(spark, d).select(F.col("user_id").alias("key"), "event_type", F.col("event_id").alias("version"))
    old = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.lit("known").alias("event_type"), F.lit(-1).cast("long").alias("version"))
    return old, e


def upsert_last_wins(spark, d):
    old, new = _changes(spark, d)
    return dml.upsert(old, new, ["key"], [F.desc("version")])


def insert_do_nothing(spark, d):
    old, new = _changes(spark, d)
    return dml.insert_absent(old, new, ["key"], [F.asc("version")])


def insert_returning(spark, d):
    old, new = _changes(spark, d)
    return dml.added(old, new, ["key"], [F.asc("version")])


def delete_cascade(spark, d):
    """Suppliers of a region go, and what refers to them."""
    nations = table(spark, d, "nation").where("n_regionkey = 2")
    s = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "suppkey")
    gone = s.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("suppkey")
    items = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "suppkey")
    left = dml.cascade(s, {"items": items}, gone, ["suppkey"])
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1])


def update_where(spark, d):
    rows = inputs.turns(spark, d).select("session_id", "turn", "role", F.lit(True).alias("is_active"))
    return dml.update(rows, F.col("turn") < 2, is_active=F.lit(False))


def crawl_permissions(spark, d):
    """Entries of crawled files: who may read them, and whether anyone may."""
    e = table(spark, d, "events")
    role = F.element_at(F.array(F.lit("reader"), F.lit("writer"), F.lit("none")), F.pmod("event_id", F.lit(3)).cast("int") + 1)
    entries = e.select(F.col("user_id").alias("file_id"), F.when(F.pmod("event_id", F.lit(50)) == 0, "anyone").otherwise("user").alias("type"), role.alias("role"), F.concat(F.lit("U"), F.pmod("event_id", F.lit(20)).cast("string"), F.lit("@X")).alias("email"))
    owners = e.select(F.col("user_id").alias("file_id")).distinct().withColumn("owner_email", F.concat(F.lit("o"), F.col("file_id").cast("string"), F.lit("@x")))
    out = permissions.resolved(entries, owners)
    return out.select("file_id", F.array_join("allowed_users", ",").alias("allowed"), "is_public")


def crawl_stamps(spark, d):
    """Documents as chunks of crawled files, some without a listing, with their file's access columns."""
    t = table(spark, d, "documents")
    chunks = t.select("doc_id", F.pmod("doc_id", F.lit(97)).alias("file_id"))
    files = t.where("doc_id < 90").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("O"), F.col("doc_id").cast("string"), F.lit("@x")).alias("owner_email"))
    role = F.element_at(F.array(F.lit("reader"), F.lit("owner"), F.lit("none")), F.pmod("doc_id", F.lit(3)).cast("int") + 1)
    entries = t.select(F.pmod("doc_id", F.lit(90)).alias("file_id"), F.when(F.pmod("doc_id", F.lit(7)) == 0, "anyone").otherwise("user").alias("type"), role.alias("role"), F.concat(F.lit("u"), F.pmod("doc_id", F.lit(11)).cast("string"), F.lit("@x")).alias("email"))
    out = crawl.stamped(chunks, files, entries)
    return out.select("doc_id", "file_id", "owner_email", F.array_join(F.coalesce("allowed_users", F.array().cast("array<string>")), ",").alias("allowed"), "is_public")


def _crawls(spark, d):
    """Customers' crawls in every state, and changes wanted of them, some of them of no known crawl or state."""
    c = table(spark, d, "customer")
    nth = lambda *of: F.element_at(F.array(*[F.lit(x).cast("string") for x in of]), F.pmod("c_custkey", F.lit(len(of))).cast("int") + 1)
    held = c.where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("user_id"), nth("pending", "running", "done", "failed").alias("crawl_status"), nth("p1", None, "p3").alias("cursor"), F.pmod("c_custkey", F.lit(5)).cast("int").alias("attempts"), F.lit(1).alias("changed_at"))
    wanted = c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("user_id"), nth("running", "done", "pending", "failed", "lost").alias("state"), nth(None, "n1").alias("cursor"))
    return held, wanted


def crawl_states(spark, d):
    held, wanted = _crawls(spark, d)
    return crawl.advanced(held, wanted, F.lit(2))


def crawl_resumed(spark, d):
    held, wanted = _crawls(spark, d)
    return crawl.resumable(crawl.advanced(held, wanted, F.lit(2)))


def judge_summary(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    scored = rows.select("source", (F.col("quality") * 4 + 1).alias("faithfulness"), F.when(F.pmod("doc_id", F.lit(3)) == 0, 5 - F.col("toxic") * 4).alias("correctness"))
    scored = scored.withColumn("average", answer.judge_average(F.col("faithfulness"), F.col("correctness")))
    return answer.session_summary(scored, ["source"], ["faithfulness", "correctness", "average"])


def judge_json(spark, d):
    """Scores in models' answers, plain, fenced, or in prose."""
    n = F.pmod("event_id", F.lit(5)) + 1
    text = (
        F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit('{"score": '), n.cast("string"), F.lit("}")))
        .when(F.pmod("event_id", F.lit(3)) == 1, F.concat(F.lit('```json\n{"score": '), n.cast("string"), F.lit("}\n```")))
        .otherwise(F.concat(F.lit("I would score: "), n.cast("string"), F.lit(" of five")))
    )
    return table(spark, d, "events").select("event_id", T.json_score(text).alias("score"))


def base64url_text(spark, d):
    plain = F.regexp_replace(F.translate(F.base64(F.encode("text", "UTF-8")), "+/", "-_"), r"[\r\n=]+", "")
    return table(spark, d, "conversations").select("conv_id", "turn", F.decode(T.base64url(plain), "UTF-8").alias("text"))


def _any(c: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '(?i){p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


_STRIPPED = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
_TTL_SQL = "t AS (SELECT *, (['short', 'mid', 'long'])[event_id % 3 + 1] AS tier, CASE event_id % 3 WHEN 0 THEN ts + INTERVAL 30 MINUTE WHEN 1 THEN ts + INTERVAL 24 HOUR END AS expires_at FROM events)"
_CHANGES_SQL = """old AS (SELECT c_custkey AS key, 'known' AS event_type, -1::BIGINT AS version FROM customer WHERE c_custkey % 3 <> 0),
new AS (SELECT user_id AS key, event_type, event_id AS version FROM events)"""

_CRAWLS_SQL = """h AS (SELECT c_custkey AS user_id, (['pending', 'running', 'done', 'failed'])[c_custkey % 4 + 1] AS st, (['p1', NULL, 'p3'])[c_custkey % 3 + 1] AS cur, (c_custkey % 5)::INT AS n FROM customer WHERE c_custkey % 9 <> 0),
w AS (SELECT c_custkey AS user_id, (['running', 'done', 'pending', 'failed', 'lost'])[c_custkey % 5 + 1] AS too, (CASE c_custkey % 2 WHEN 1 THEN 'n1' END) AS nxt FROM customer WHERE c_custkey % 7 <> 0),
b AS (SELECT *, coalesce((st IS NULL AND too = 'pending') OR (too = 'pending' AND st IN ('done', 'failed')) OR (too = 'running' AND st IN ('pending', 'failed')) OR (too IN ('done', 'failed') AND st = 'running'), false) AS m FROM h FULL JOIN w USING (user_id)),
s AS (SELECT user_id, CASE WHEN m THEN too ELSE st END AS crawl_status, CASE WHEN m AND too = 'done' THEN NULL WHEN m THEN coalesce(nxt, cur) ELSE cur END AS cursor,
  (coalesce(n, 0) + CASE WHEN m AND too = 'running' THEN 1 ELSE 0 END)::INT AS attempts, CASE WHEN m THEN 2 WHEN st IS NOT NULL THEN 1 END AS changed_at FROM b WHERE m OR st IS NOT NULL)"""

QUERIES = {
    "last_n_turns": (last_n_turns, "SELECT conv_id AS session_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4"),
    "history_text": (
        history_text,
        """WITH l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)
SELECT conv_id AS session_id, string_agg(upper(role) || ': ' || substring(text, 1, 300), chr(10) ORDER BY turn) AS history FROM l GROUP BY conv_id""",
    ),
    "compress_set": (
        compress_set,
        "SELECT conv_id AS session_id, turn FROM conversations QUALIFY count(*) OVER (PARTITION BY conv_id) > 6 AND row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 3",
    ),
    "session_turn_count": (session_turn_count, "SELECT conv_id AS session_id, count(*) AS turns FROM conversations GROUP BY conv_id ORDER BY max(turn) DESC, conv_id LIMIT 50"),
    "facts_cap": (
        facts_cap,
        """SELECT c_nationkey AS user_id, 'order ' || o_orderkey || ' ' || o_orderpriority AS fact, o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 15""",
    ),
    "route_heuristic": (
        route_heuristic,
        f"""WITH t AS (SELECT {_STRIPPED} AS t FROM conversations)
SELECT CASE WHEN {_any('t', C.CHITCHAT + C.FOLLOW_UP + C.META)} OR len(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) <= 3 THEN 'DIRECT' ELSE 'RAG' END AS route, count(*) AS n FROM t GROUP BY 1""",
    ),
    "vague_queries": (vague_queries, f"SELECT conv_id AS session_id, turn, {_any('lower(text)', C.VAGUE)} AS vague FROM conversations"),
    "tier_of_turns": (
        tier_of_turns,
        f"SELECT conv_id AS session_id, turn, CASE WHEN {_any(f'lower({_STRIPPED})', C.FILLER)} THEN 'short' WHEN {_any(f'lower({_STRIPPED})', C.LASTING)} THEN 'long' ELSE 'mid' END AS tier FROM conversations",
    ),
    "role_check": (role_check, "SELECT conv_id AS session_id, turn, role FROM conversations WHERE role NOT IN ('user', 'assistant')"),
    "ttl_active": (ttl_active, f"WITH {_TTL_SQL} SELECT tier, count(*) AS n FROM t WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{TTL_NOW}' GROUP BY tier"),
    "memory_layers": (
        memory_layers,
        """WITH t AS (SELECT conv_id, turn, (conv_id + turn) % 8 AS k, conv_id % 2 <> 0 AS s, conv_id % 3 <> 0 AS f,
  len(regexp_extract_all(CASE WHEN turn % 5 = 4 THEN 'what of it' ELSE 'and so then ' || text END, '\\S+')) AS w FROM conversations)
SELECT conv_id AS session_id, turn, CASE WHEN NOT (s OR f) OR w < 4 THEN '' WHEN k = 0 THEN CASE WHEN s THEN 'summary' ELSE '' END WHEN k = 1 THEN CASE WHEN f THEN 'facts' ELSE '' END
  WHEN k = 3 THEN 'summary,facts' WHEN k = 4 THEN concat_ws(',', CASE WHEN f THEN 'facts' END, CASE WHEN s THEN 'summary' END, 'other') WHEN k = 5 THEN ''
  ELSE concat_ws(',', CASE WHEN s THEN 'summary' END, CASE WHEN f THEN 'facts' END) END AS layers FROM t""",
    ),
    "rewrite_acceptance": (
        rewrite_acceptance,
        """WITH t AS (SELECT conv_id, turn, array_to_string(list_slice(string_split(coalesce(text, ''), ' '), 1, 6), ' ') AS q FROM conversations),
r AS (SELECT *, CASE turn % 7 WHEN 0 THEN trim(q) WHEN 1 THEN q WHEN 2 THEN q || ' and more' WHEN 3 THEN 'ok' WHEN 4 THEN array_to_string(list_transform(range(10), lambda i: q), ' ') WHEN 5 THEN trim(q) END AS a FROM t),
n AS (SELECT *, len(regexp_extract_all(q, '\\S+')) AS wq, len(regexp_extract_all(a, '\\S+')) AS wa FROM r)
SELECT conv_id AS session_id, turn, CASE WHEN turn % 7 = 6 OR turn % 7 = 3 OR (turn % 7 IN (1, 4) AND length(a) < 3) OR wa > greatest(wq * 3, 25) THEN q ELSE a END AS asked FROM n""",
    ),
    "upsert_changed": (
        upsert_changed,
        """WITH c AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment FROM customer),
o AS (SELECT *, 1 AS updated_at FROM c WHERE c_custkey % 4 <> 0),
n AS (SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS c_acctbal, CASE WHEN c_custkey % 7 <> 0 THEN segment END AS segment FROM c WHERE c_custkey % 2 = 0)
SELECT * FROM o WHERE c_custkey % 2 <> 0 UNION ALL
SELECT n.*, CASE WHEN o.c_custkey IS NOT NULL AND n.c_acctbal = o.c_acctbal AND n.segment IS NOT DISTINCT FROM o.segment THEN 1 ELSE 2 END FROM n LEFT JOIN o USING (c_custkey)""",
    ),
    "ttl_purge": (ttl_purge, f"WITH {_TTL_SQL} SELECT event_id, tier FROM t WHERE expires_at <= TIMESTAMP '{TTL_NOW}'"),
    "incremental_antijoin": (incremental_antijoin, "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderkey <= 1000 AND o_orderkey % 10 <> 0)"),
    "registry_status": (registry_status, "SELECT CASE WHEN p_size <= 10 THEN 'new' WHEN p_size > 40 THEN 'updated' ELSE 'skipped' END AS status, count(*) AS n FROM part GROUP BY 1"),
    "upsert_last_wins": (
        upsert_last_wins,
        f"WITH {_CHANGES_SQL} SELECT * FROM old WHERE key NOT IN (SELECT key FROM new) UNION ALL SELECT * FROM (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC) = 1)",
    ),
    "insert_do_nothing": (
        insert_do_nothing,
        f"WITH {_CHANGES_SQL} SELECT * FROM old UNION ALL SELECT * FROM (SELECT * FROM new WHERE key NOT IN (SELECT key FROM old) QUALIFY row_number() OVER (PARTITION BY key ORDER BY version) = 1)",
    ),
    "insert_returning": (insert_returning, f"WITH {_CHANGES_SQL} SELECT * FROM new WHERE key NOT IN (SELECT key FROM old) QUALIFY row_number() OVER (PARTITION BY key ORDER BY version) = 1"),
    "delete_cascade": (
        delete_cascade,
        """WITH g AS (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2)
SELECT 'parent' AS relation, count(*) AS n FROM supplier WHERE s_suppkey NOT IN (FROM g) UNION ALL SELECT 'items', count(*) FROM lineitem WHERE l_suppkey NOT IN (FROM g)""",
    ),
    "update_where": (update_where, "SELECT conv_id AS session_id, turn, role, turn >= 2 AS is_active FROM conversations"),
    "crawl_permissions": (
        crawl_permissions,
        """WITH e AS (SELECT user_id AS file_id, event_id % 50 = 0 AS anyone, event_id % 3 < 2 AS reads, 'u' || (event_id % 20) || '@x' AS email FROM events),
u AS (SELECT file_id, email FROM e WHERE reads UNION SELECT DISTINCT file_id, 'o' || file_id || '@x' FROM e)
SELECT file_id, string_agg(email, ',' ORDER BY email) AS allowed, (SELECT coalesce(bool_or(anyone), false) FROM e WHERE e.file_id = u.file_id AND reads) AS is_public FROM u GROUP BY file_id""",
    ),
    "crawl_stamps": (
        crawl_stamps,
        """WITH e AS (SELECT doc_id % 90 AS file_id, doc_id % 7 = 0 AS anyone, doc_id % 3 < 2 AS reads, 'u' || (doc_id % 11) || '@x' AS email FROM documents),
f AS (SELECT doc_id AS file_id, 'O' || doc_id || '@x' AS owner FROM documents WHERE doc_id < 90),
u AS (SELECT file_id, email FROM e WHERE reads AND file_id IN (SELECT file_id FROM f) UNION SELECT file_id, lower(owner) FROM f),
a AS (SELECT file_id, string_agg(email, ',' ORDER BY email) AS allowed FROM u GROUP BY file_id),
p AS (SELECT file_id, bool_or(anyone) AS is_public FROM e WHERE reads GROUP BY file_id)
SELECT doc_id, doc_id % 97 AS file_id, coalesce(owner, 'unknown') AS owner_email, coalesce(allowed, '') AS allowed, coalesce(owner IS NOT NULL AND is_public, false) AS is_public
FROM documents d LEFT JOIN f ON f.file_id = d.doc_id % 97 LEFT JOIN a ON a.file_id = f.file_id LEFT JOIN p ON p.file_id = f.file_id""",
    ),
    "crawl_states": (crawl_states, f"WITH {_CRAWLS_SQL} SELECT * FROM s"),
    "crawl_resumed": (crawl_resumed, f"WITH {_CRAWLS_SQL} SELECT * FROM s WHERE crawl_status = 'pending' OR (crawl_status = 'failed' AND attempts < 3)"),
    "judge_summary": (
        judge_summary,
        """WITH s AS (SELECT source, (quality * 4 + 1)::DOUBLE AS f, CASE WHEN l.doc_id % 3 = 0 THEN (5 - toxic * 4)::DOUBLE END AS c FROM labels l JOIN documents d USING (doc_id)),
a AS (SELECT *, round(CASE WHEN c IS NULL THEN f ELSE (f + c) / 2 END, 2) AS a FROM s),
g AS (SELECT source, count(*) AS "rows", round(avg(f), 2) AS avg_faithfulness, round(avg(c), 2) AS avg_correctness, round(avg(a), 2) AS avg_average FROM a GROUP BY source)
SELECT *, avg_faithfulness < 3 AS low_faithfulness, coalesce(avg_correctness < 3, false) AS low_correctness, avg_average < 3 AS low_average FROM g""",
    ),
    "judge_json": (judge_json, "SELECT event_id, (event_id % 5 + 1)::DOUBLE AS score FROM events"),
    "base64url_text": (base64url_text, "SELECT conv_id, turn, text FROM conversations"),
}
