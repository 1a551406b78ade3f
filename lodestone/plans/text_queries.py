"""Queries of cleaning, splitting, chunking, windows over sections, and chunk validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.providers import segmented
from lodestone.operators import chunkers, chunks, crawl, packing, windows
from lodestone.plans import inputs
from lodestone.session import table
from lodestone.sources import files


def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"), T.tokens(F.col("text"), T.PROMPT_RATIO).alias("prompt_tokens"))


def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


def clean_table(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_table(F.col("text")).alias("text"))


def clean_mail(spark, d):
    quoted = F.concat(F.lit("> quoted\nSee https://t.example/"), F.repeat(F.lit("a"), F.lit(70)), F.lit("\n"), F.col("text"), F.lit("\nUnsubscribe here\nmore"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.clean_mail(quoted).alias("text"))


def keep_filter(spark, d):
    t = table(spark, d, "documents")
    kind = F.when(F.pmod("doc_id", F.lit(3)) == 0, "table").otherwise("text")
    return t.select("doc_id", kind.alias("type"), T.clean(kind, F.col("text")).alias("content")).where(T.keeps(F.col("type"), F.col("content"))).select("doc_id", "type", "content")


def embed_text(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in chunks.TYPES]), F.pmod("doc_id", F.lit(3)).cast("int") + 1)
    return table(spark, d, "documents").select("doc_id", T.embed_text(kind, F.col("text")).alias("embed_text"))


def uuid5_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", T.chunk_id(F.lit(None).cast("string"), F.lit("txt"), F.col("source"), F.col("text")).alias("chunk_id"))


def table_slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"), T.slug(F.concat(F.col("p_size").cast("string"), F.lit("-"), F.col("p_brand"))).alias("numbered"))


def safe_casts(spark, d):
    e = table(spark, d, "events")
    raw = F.when(F.pmod("event_id", F.lit(3)) == 0, F.col("value").cast("string")).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")))
    return e.select("event_id", T.safe_int(raw).alias("number"), T.safe_text(F.when(F.pmod("event_id", F.lit(2)) == 0, F.lit("  ")).otherwise(F.col("event_type"))).alias("word"))


def sentence_split(spark, d):
    s = T.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("sentences"), F.array_join(s, "|").alias("joined"))


def structured_split(spark, d):
    return table(spark, d, "documents").select("doc_id", T.structured_sentences(F.col("text")).alias("sentences"))


def structure_kind(spark, d):
    return table(spark, d, "documents").select("doc_id", T.structure(F.col("text")).alias("kind"))


def structure_sections(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", T.sections(F.col("text"), T.structure(F.col("text"))).alias("sections"))


def sentence_chunks(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.posexplode(packing.sentence_groups(T.sentences(F.col("text")))).alias("chunk", "content"))


def paragraph_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(packing.paragraphs(F.col("text"))).alias("chunk", "content"))


def table_chunks(spark, d):
    """Each nation's customers as one table, split into batches that repeat the header; customers without a key come last."""
    c = table(spark, d, "customer")
    row = F.concat_ws(" | ", "c_name", "c_mktsegment", T.fixed(F.col("c_acctbal")))
    keyed = F.struct(F.col("c_custkey").isNull().alias("last"), "c_custkey", row.alias("r"))
    grouped = c.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(keyed)).alias("rows"))
    head = F.lit("name | segment | balance\n--- | --- | ---")
    return grouped.select("c_nationkey", F.posexplode(packing.row_batches(head, F.col("rows.r"))).alias("batch", "content"))


def adjacent_cosine(spark, d):
    """Vectors in order within their label."""
    e = table(spark, d, "embeddings")
    return windows.neighbours(e, ["label"], ["vec_id"], "embedding").select("vec_id", "label", "similarity")


def valley_boundaries(spark, d):
    return windows.valleys(adjacent_cosine(spark, d), ["label"], ["vec_id"]).select("vec_id", "label", "is_boundary")


def semantic_segments(spark, d):
    return windows.segments(adjacent_cosine(spark, d), ["label"], ["vec_id"], cut=0.0).select("vec_id", "label", F.col("segment").cast("long").alias("segment"))


def semantic_chunks(spark, d):
    """Sentences of each document cut where neighbours' embeddings differ, then short segments merged."""
    t = table(spark, d, "documents")
    runs = segmented(t.select("doc_id", T.sentences(F.col("text")).alias("s")), "s", windows.SEGMENT_CUT)
    return runs.select("doc_id", F.posexplode(packing.merge_short(F.col("s"))).alias("chunk", "content"))


def section_islands(spark, d):
    e = inputs.events(spark, d)
    rows = windows.islands(e, ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return rows.groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def carry_forward(spark, d):
    e = inputs.events(spark, d)
    label = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return windows.carried(e, ["user_id"], ["ts", "event_id"], label, "last_purchase").select("event_id", "user_id", "last_purchase")


def running_counts(spark, d):
    e = inputs.events(spark, d)
    return windows.running_count(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", "clicks").select("event_id", "clicks")


def caption_spread(spark, d):
    e = inputs.events(spark, d)
    caption = F.when(F.col("value") > 50, F.round("value", 2))
    return windows.spread_over_runs(e, ["user_id"], ["ts", "event_id"], F.col("event_type"), caption, "caption").select("event_id", "caption")


def chunk_index_total(spark, d):
    return windows.numbered(table(spark, d, "documents"), ["source"], ["doc_id"]).select("doc_id", "source", "chunk_index", "chunk_total")


def tiny_merge(spark, d):
    """Lines of each document as text and table chunks, tiny texts merged."""
    t = table(spark, d, "documents")
    lines = F.filter(F.split("text", "\n"), lambda l: F.trim(l) != "")
    typed = F.transform(lines, lambda l, i: F.struct(F.when(i % 7 == 3, "table").otherwise("text").alias("type"), l.alias("content")))
    return t.select("doc_id", F.posexplode(packing.merge_tiny(typed)).alias("chunk", "c")).select("doc_id", "chunk", "c.type", "c.content")


def artifact_merge(spark, d):
    t = table(spark, d, "documents")
    lines = F.split(F.concat(F.lit("---\nPage 1\n"), F.col("text"), F.lit("\nPage 2")), "\n")
    return t.select("doc_id", F.posexplode(packing.merge_artifacts(lines)).alias("part", "content"))


def digital_elements(spark, d):
    """Documents' lines as a parser's items over pages of five: headings, texts, pictures, and tables of cells, some missing and some twice."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("position", "text"))
    n = F.col("position") + F.pmod("doc_id", F.lit(10)).cast("int")
    kind = F.when(n % 10 == 0, "section").when(n % 7 == 3, "table").when(n % 11 == 6, "image").otherwise("text")
    words = F.filter(F.split("text", " "), lambda x, i: (i % 4 != 2))
    cells = F.transform(words, lambda x, i: F.struct(F.floor(i / 3).cast("int").alias("row"), (i % 2).alias("col"), x.alias("text")))
    return chunkers.digital_elements(t.select("doc_id", "position", kind.alias("kind"), (F.floor(F.col("position") / 5) + 1).cast("int").alias("page"), "text", F.when(F.col("text") != "", cells).alias("cells")))


def page_elements(spark, d):
    """Documents' lines as page elements: every ninth a table, with a caption below it."""
    t = table(spark, d, "documents")
    rows = t.select(F.col("doc_id"), F.col("lang").alias("section"), F.posexplode(F.split("text", "\n")).alias("position", "content"))
    n = F.pmod("position", F.lit(9))
    kind = F.when(n == 3, "table").otherwise("text")
    content = F.when(n == 4, F.concat(F.lit("Figure 1: "), F.col("content"))).otherwise(F.col("content"))
    return rows.withColumn("type", kind).withColumn("content", content)


def page_chunks(spark, d):
    return chunkers.page_chunks(page_elements(spark, d))


def slide_chunks(spark, d):
    """Conversations as decks: system turns name sections, every third turn has a table, every fourth an image."""
    c = table(spark, d, "conversations")
    some = lambda n, text: F.when(F.pmod("turn", F.lit(n)) == 0, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    slides = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("slide"), (F.col("role") == "system").alias("is_section"), F.substring("text", 1, 40).alias("name"), "text", some(3, "a | b").alias("tables"), some(4, "an image").alias("images"))
    return chunkers.slide_chunks(slides)


_LISTED = [*crawl.MIME_TYPES, *crawl.EXPORTS, "video/mp4", "text/csv"]


def crawl_due(spark, d):
    """Orders as listed files of every type: those not seen in their present state."""
    o = table(spark, d, "orders")
    mime = F.element_at(F.array(*map(F.lit, _LISTED)), F.pmod("o_orderkey", F.lit(len(_LISTED))).cast("int") + 1)
    listed = o.select(F.col("o_orderkey").alias("file_id"), mime.alias("mime_type"), F.col("o_orderstatus").alias("modified_time"))
    seen = o.where("o_orderkey <= 500").select(F.col("o_orderkey").alias("file_id"), F.lit("F").alias("modified_time"))
    return crawl.due(listed, seen).select("file_id", "source_type", "fetch_as", "modified_time")


def markdown_elements(spark, d):
    """Documents' lines as a page's mark-up: headings, bars with and without a rule below, and texts."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "l"))
    nth = lambda m, *of: F.pmod(F.col("n") + F.col("doc_id"), F.lit(m)).isin(*of)
    line = F.when(nth(13, 0), F.concat(F.lit("## "), F.substring_index("l", " ", 2))).when(nth(13, 3, 4, 6, 7, 9), F.concat(F.lit("| "), F.col("l"))).when(nth(13, 5), F.lit(" |---|---|"))
    return files.markdown_elements(t.select("doc_id", "n", F.coalesce(line, F.col("l")).alias("line")), ["doc_id"], ["n"]).select("doc_id", "element", "section", "type", "content")


def mail_chunks(spark, d):
    """Documents as parsed mails, some with tables: body paragraphs packed, then the tables."""
    t = table(spark, d, "documents")
    held = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.array(F.lit("a | b"), F.concat(F.lit("n | "), F.col("doc_id").cast("string"))))
    body = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    mails = t.select(F.col("doc_id").cast("string").alias("path"), body.alias("text"), held.alias("tables"), F.col("source").alias("subject"), F.lit("a@x").alias("from"), F.col("lang").alias("date"))
    return chunkers.mail_chunks(mails).select("path", "position", "type", "content", "subject", "date")


def fenced_code(spark, d):
    """A model's answers with and without a fence."""
    t = table(spark, d, "documents")
    nth = F.pmod("doc_id", F.lit(4))
    made = F.when(nth == 0, F.concat(F.lit("So:\n```sql\n"), F.col("text"), F.lit("\n```\ndone ``` x"))).when(nth == 1, F.concat(F.lit("``` \n"), F.col("text"), F.lit("```"))).when(nth == 2, F.concat(F.lit("```"), F.col("text"))).otherwise(F.col("text"))
    return t.select("doc_id", T.fenced_code(made).alias("code"))


def mail_marks(spark, d):
    """Conversations as HTML mails with each kind of quoted part: what is left of them."""
    plain = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    marks = ["<div class='x gmail_attr'>{}</div>", "<span class='gmail_attr'>kept</span>", "<p class='moz-cite-prefix'>{}</p>", "<div class='outlookmessageheader'>{}</div>", "<p class='OutlookMessageHeader'>kept</p>", "<div id='olk_src_body_section'><b>{}</b></div>", "<div id='divRplyFwdMsg'>{}</div>", "<i id='MT-Signature'>{}</i>", "<blockquote>{}</blockquote>"]
    mark = F.replace(F.element_at(F.array(*map(F.lit, marks)), F.pmod("turn", F.lit(len(marks))).cast("int") + 1), F.lit("{}"), F.lit("gone"))
    rows = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.concat(F.lit("<html><body><p>"), plain, F.lit("</p>"), mark, F.lit("</body></html>")).alias("html"))
    return files.pages(rows, "key").select("key", "text")


def _typed(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in chunks.TYPES]), F.pmod("doc_id", F.lit(3)).cast("int") + 1)
    return table(spark, d, "documents").select("doc_id", kind.alias("type"), "source", "lang", T.tokens(F.col("text")).alias("tokens"))


def type_counts(spark, d):
    return chunks.of_kind(_typed(spark, d), ["type"])


def length_stats(spark, d):
    rows = _typed(spark, d)
    limits = [F.count_if(F.col("tokens") > packing.MOST).alias("over"), F.count_if(F.col("tokens") < packing.LEAST).alias("under")]
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("tokens").alias("least"), F.floor(F.avg("tokens")).cast("long").alias("mean"), F.max("tokens").alias("most"), *limits)


def group_by_section(spark, d):
    """Documents of a source and language as a section: their numbers and their tokens."""
    rows = _typed(spark, d).withColumn("section", F.coalesce(F.concat_ws("/", "source", "lang"), F.lit("__no_section__")))
    agg = rows.groupBy("section").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("type") == "table").alias("tables"), F.count_if(F.col("type") == "image").alias("images"), F.min("doc_id").alias("first_doc"))
    return agg


def section_exclusion(spark, d):
    e = inputs.events(spark, d)
    section = F.when(F.pmod("event_id", F.lit(11)) == 0, "References and notes").when(F.pmod("event_id", F.lit(13)) == 0, "Acknowledgements").otherwise(F.col("event_type"))
    skipped = F.lower(section).rlike("|".join(T.SKIPPED_SECTIONS))
    return e.where(~skipped).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _broken(spark, d):
    """Documents as chunks that each break some rules."""
    t = table(spark, d, "documents")
    nth = lambda n: F.pmod("doc_id", F.lit(n)) == 0
    fields = F.filter(F.array(*[F.lit(x) for x in chunks.REQUIRED]), lambda x: ~(nth(17) & (x == "chunk_id")) & ~(nth(37) & (x == "embed_text")))
    names = F.filter(F.array(*[F.lit(x) for x in chunks.REQUIRED_METADATA]), lambda x: ~(nth(29) & x.isin("source", "page")))
    values = F.transform(names, lambda x: F.when(x == "source_type", F.when(nth(31), "fax").otherwise("txt")).otherwise("v"))
    return t.select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"),
        fields.alias("fields"),
        F.when(nth(19), "figure").when(~nth(41), "text").alias("type"),
        F.when(nth(23), "  ").otherwise(F.col("text")).alias("content"),
        F.when(~nth(37), F.col("text")).alias("embed_text"),
        F.map_from_arrays(names, values).alias("metadata"),
    )


def validate_chunks(spark, d):
    return chunks.problems(_broken(spark, d))


def upsert_refusals(spark, d):
    e = table(spark, d, "embeddings")
    nth = lambda n: F.pmod("vec_id", F.lit(n)) == 0
    size = F.size("embedding")
    rows = e.select(
        "vec_id",
        F.when(nth(17), F.when(nth(2), "")).otherwise(F.concat(F.lit("c"), F.col("vec_id").cast("string"))).alias("chunk_id"),
        F.when(nth(19), " ").otherwise("x").alias("content"),
        F.when(nth(23), F.slice("embedding", 1, 3)).when(~nth(29), F.col("embedding")).alias("vector"),
        F.when(~nth(13), F.array(F.lit(1), F.lit(5))).alias("indices"),
        F.when(nth(11), F.array(F.lit(0.5))).otherwise(F.array(F.lit(0.5), F.lit(0.25))).alias("weights"),
    )
    dimension = table(spark, d, "embeddings").select(size.alias("n")).first()["n"]
    return rows.select("vec_id", F.coalesce(chunks.refusal(dimension=dimension), F.lit("stored")).alias("reason"))


def source_types(spark, d):
    """Files of many names, a few with an override."""
    p = table(spark, d, "part")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".DOCX", ".pptx", ".eml", ".txt", ".jpg", ".tif", ".bmp", ".xyz", "")]), F.pmod("p_partkey", F.lit(10)).cast("int") + 1)
    path = F.concat(F.lit("/in/part."), F.col("p_partkey").cast("string"), ext)
    override = F.when(F.pmod("p_partkey", F.lit(7)) == 0, "pdf_scanned")
    return p.select("p_partkey", chunks.source_type(path, override).alias("source_type"))


def shape_unification(spark, d):
    """Conversations as handler outputs: a list, a mapping with chunks, a single chunk, or neither."""
    c = table(spark, d, "conversations")
    one = F.struct("turn", F.col("text").alias("content"))
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("chunks"))
    shape = F.element_at(F.array(F.lit("list"), F.lit("chunks"), F.lit("single"), F.lit("odd")), F.pmod("conv_id", F.lit(4)).cast("int") + 1)
    out = rows.select(F.col("conv_id").cast("string").alias("source"), F.lit("txt").alias("source_type"), shape.alias("shape"), "chunks", F.get("chunks", F.lit(0)).alias("chunk"))
    return chunks.unified(out).select("source", "position", "turn", "content")


def descriptions(spark, d):
    """Image descriptions made of documents' texts."""
    t = table(spark, d, "documents")
    made = F.concat(F.lit("The image shows, "), F.regexp_replace("text", r"[\x{A0}<>]", ""), F.lit("\n\n* **bold** \"quoted\"\n  \n- last"))
    return t.select("doc_id", T.clean_description(made).alias("text"))


def canonical_chunks(spark, d):
    """Documents as text elements, made canonical."""
    t = table(spark, d, "documents")
    meta = F.create_map(F.lit("file_name"), F.col("source"), F.lit("section"), F.col("lang"), F.lit("page_start"), F.pmod("doc_id", F.lit(9)).cast("string"))
    e = t.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("pdf_digital").alias("source_type"), F.lit(0).alias("position"), F.lit("note").alias("type"), F.col("text").alias("content"), meta.alias("metadata"))
    n = chunks.normalise(e)
    return n.select(F.col("doc_id").cast("long").alias("doc_id"), "type", F.col("metadata.source").alias("source"), F.col("metadata.page").alias("page"), F.col("metadata.section").alias("section"), "chunk_id", "content", "embed_text")


def html_text(spark, d):
    """Tags out of pages, white space closed up."""
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]+>", " ")
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(body, r"\s+", " ")).alias("text"))


def html_parts(spark, d):
    p = files.pages(table(spark, d, "pages"))
    return p.select("page_id", F.length("text").alias("chars"), F.size("tables").alias("tables"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '<[^>]+>', ' ', 'g'), '-{{3,}}', '', 'g'),
 '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), ' {{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"""


def _clean_sql(c: str) -> str:
    lines = f"list_transform(string_split({_CLEAN.format(f'replace({c}, chr(160), chr(32))')}, chr(10)), lambda l: {_STRIP.format('l')})"
    return _STRIP.format(f"array_to_string({lines}, chr(10))")


_TABLE = (
    "array_to_string(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: "
    + _STRIP.format("l")
    + r" <> ''), lambda l: CASE WHEN regexp_matches(l, '^[\|\s\-:]+$') THEN l ELSE "
    + _STRIP.format("regexp_replace(l, ' {2,}', ' ', 'g')")
    + " END), chr(10))"
)
_TOKENS = "greatest(1, floor(length({}) / {}::DOUBLE))::BIGINT"
_UUID = """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('txt:' || source || ':' || substring(text, 1, 200))) AS h FROM documents)
SELECT doc_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], lower(to_hex((('0x' || h[17])::INT & 3) | 8)) || h[18:20], h[21:32]) AS chunk_id FROM h"""
_SLUG = "CASE WHEN regexp_matches({0}, '^\\d') THEN 't_' || {0} ELSE {0} END"
_SENT = r"""list_filter(list_transform(flatten(list_transform(string_split_regex(coalesce(text, ''), '\n\s*\n'),
 lambda p: string_split(regexp_replace(p, '([.!?؟])\s+', '\1' || chr(1), 'g'), chr(1)))), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""
_COS = """n AS (SELECT *, lead(embedding) OVER w AS nx FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
c AS (SELECT vec_id, label, CASE WHEN nx IS NOT NULL THEN round(list_cosine_similarity(embedding::DOUBLE[], nx::DOUBLE[]), 6) END AS similarity FROM n)"""
_TYPED = "t AS (SELECT doc_id, (['text', 'table', 'image'])[doc_id % 3 + 1] AS type, source, lang, greatest(1, floor(length(text) / 3.5::DOUBLE))::BIGINT AS tokens FROM documents)"
_STRUCTURE = r"""l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
r AS (SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '^\s*[\*\-•]\s+'))) / len(l)::DOUBLE AS b,
 len(list_filter(l, lambda x: regexp_matches(x, '^\s*#{1,6}\s+') OR regexp_matches(x, '^\d+[\)\.]\s+[A-Z]') OR regexp_matches(x, '^[A-Z][A-Z\s\-]{3,}$')
   OR regexp_matches(x, '^\s*_{3,}\s*$') OR regexp_matches(x, '^\s*={3,}\s*$') OR regexp_matches(x, '^\s*-{3,}\s*$'))) / len(l)::DOUBLE AS h FROM l)"""



def _tok(x: str) -> str:
    return _TOKENS.format(x, 3.5)


def _fold(parts: str, state: str, start: str, item: str, step: str) -> str:
    """A fold over a list: state names the fields, start and item give them for the start and for one part x, step from a to x."""
    return f"list_reduce(list_transform({parts}, lambda x: {{{item}}}), lambda a, x: {{{step}}}, {{{start}}})"


def _but_last(x: str) -> str:
    return f"list_slice({x}, 1, len({x}) - 1)"


#: The open chunk joins the last one if it is short.
_TAIL = f"CASE WHEN f.cur = '' THEN f.out WHEN len(f.out) > 0 AND {_tok('f.cur')} < 80 THEN list_append({_but_last('f.out')}, f.out[-1] || ' ' || f.cur) ELSE list_append(f.out, f.cur) END"
_OPEN = "'out': []::VARCHAR[], 'cur': ''"


def _chunks_sql(key: str, chunk: str, source: str, chunks: str) -> str:
    """Rows of a list of chunks, numbered from 0."""
    return f"SELECT {key}, (unnest(range(1, len(c) + 1)) - 1)::INT AS {chunk}, unnest(c) AS content FROM (SELECT {key}, {chunks} AS c FROM ({source}))"


_CLOSE = "(a.tok + x.tok > 450 AND a.tok >= 80)"


def _sentence_groups(parts: str) -> str:
    return _fold(
        parts, "out cur tok", _OPEN + ", 'tok': 0::BIGINT", f"'out': [x], 'cur': x, 'tok': {_tok('x')}",
        f"'out': CASE WHEN {_CLOSE} THEN list_append(a.out, a.cur) ELSE a.out END, 'cur': CASE WHEN {_CLOSE} OR a.cur = '' THEN x.cur ELSE a.cur || ' ' || x.cur END, 'tok': CASE WHEN {_CLOSE} THEN x.tok ELSE a.tok + x.tok END",
    )


_BOTH = "CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || ' ' || x.cur END"
_FITS = f"(a.cur = '' OR {_tok(_BOTH)} <= 450)"
_PARAGRAPHS = _fold(
    r"""list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')""",
    "out cur", _OPEN, "'out': [x], 'cur': x",
    f"'out': CASE WHEN {_FITS} THEN a.out ELSE list_append(a.out, a.cur) END, 'cur': CASE WHEN {_FITS} THEN {_BOTH} ELSE x.cur END",
)
_HEAD = "'name | segment | balance' || chr(10) || '--- | --- | ---'"
_ROWS = "CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || chr(10) || x.cur END"
_OVER = f"({_tok(f'{_HEAD} || chr(10) || ' + _ROWS)} > 400 AND a.cur <> '')"
_BATCHES = _fold("rows", "out cur", _OPEN, "'out': [x], 'cur': x", f"'out': CASE WHEN {_OVER} THEN list_append(a.out, {_HEAD} || chr(10) || a.cur) ELSE a.out END, 'cur': CASE WHEN {_OVER} THEN x.cur ELSE {_ROWS} END")
_TINY_TEXT = "CASE WHEN x.type = 'text' AND a.held <> '' THEN a.held || ' ' || x.content ELSE x.content END"
_TINY_SHORT = f"(x.type = 'text' AND {_tok(_TINY_TEXT)} < 80)"
_TINY_ON = f"({_TINY_SHORT} AND x.next = 'text')"
_TINY_BACK = f"({_TINY_SHORT} AND x.next <> 'text' AND len(a.out) > 0 AND coalesce(a.out[-1].type, '') = 'text')"
_TINY = _fold(
    "items", "", "'out': []::STRUCT(type VARCHAR, content VARCHAR)[], 'held': '', 'type': '', 'content': '', 'next': ''", "'out': [{'type': x.type, 'content': x.content}], 'held': '', 'type': x.type, 'content': x.content, 'next': x.next",
    f"""'out': CASE WHEN {_TINY_ON} THEN a.out WHEN {_TINY_BACK} THEN list_append({_but_last('a.out')}, {{'type': a.out[-1].type, 'content': a.out[-1].content || ' ' || {_TINY_TEXT}}})
 ELSE list_append(a.out, {{'type': x.type, 'content': {_TINY_TEXT}}}) END, 'held': CASE WHEN {_TINY_ON} THEN {_TINY_TEXT} ELSE '' END, 'type': '', 'content': '', 'next': ''""",
)
_BARE = r"regexp_matches(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[-_=]{2,}', '', 'g'), '(?i)\bPage\s+\d+\b', '', 'g'), '(?i)\bP\.\s*\d+\b', '', 'g'), '\d+', '', 'g'), '^\s*$')"
_LINE = "CASE WHEN a.held = '' THEN x.p ELSE a.held || chr(10) || x.p END"
_ARTIFACTS = _fold(
    "parts", "", "'out': []::VARCHAR[], 'held': '', 'p': '', 'bare': false", f"'out': [x], 'held': '', 'p': x, 'bare': {_BARE}",
    f"""'out': CASE WHEN x.bare AND len(a.out) = 0 THEN a.out WHEN x.bare THEN list_append({_but_last('a.out')}, CASE WHEN a.out[-1] = '' THEN x.p ELSE a.out[-1] || chr(10) || x.p END) ELSE list_append(a.out, {_LINE}) END,
 'held': CASE WHEN x.bare AND len(a.out) = 0 THEN {_LINE} WHEN x.bare THEN a.held ELSE '' END, 'p': '', 'bare': false""",
)
_KIND = "CASE WHEN b > 0.2 OR h > 0.05 THEN 'structured' WHEN b > 0.05 OR h > 0.02 THEN 'mixed' ELSE 'narrative' END"
_SECTIONS = r"""list_filter(list_transform(CASE kind WHEN 'structured' THEN string_split_regex(text, '(?m)_{3,}|={3,}|^#{1,3}\s')
 WHEN 'mixed' THEN string_split(regexp_replace(text, '\n{2,}([A-Z\d#])', chr(1) || '\1', 'g'), chr(1)) ELSE [text] END, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""
_STRUCTURED_TEXT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'),
 '_{3,}', chr(1), 'g'), '\n{2,}', chr(1), 'g'), '(?m)^([A-Z][A-Z\s\-]{3,})\s*$', chr(1) || '\1' || chr(1), 'g'), '\n\*\s+', chr(1), 'g'), '\n\d+\.\s+', chr(1), 'g'), '\n\-\s+', chr(1), 'g'), '(\d+)\.\s', '\1' || chr(2) || ' ', 'g')"""


def _structured_sql() -> str:
    text = _STRUCTURED_TEXT
    for short in T.ABBREVIATIONS:
        text = f"replace({text}, '{short}.', '{short}' || chr(2))"
    cut = f"string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {_STRIP.format('replace(s, chr(2), chr(46))')}), lambda s: s <> '')"


QUERIES = {
    "token_estimate": (token_estimate, f"SELECT doc_id, {_TOKENS.format('text', 3.5)} AS tokens, {_TOKENS.format('text', 3.8)} AS prompt_tokens FROM documents"),
    "clean_text": (clean_text, f"SELECT doc_id, {_clean_sql('text')} AS text FROM documents"),
    "clean_table": (clean_table, f"SELECT doc_id, {_STRIP.format(_TABLE)} AS text FROM documents"),
    "clean_mail": (
        clean_mail,
        f"""WITH m AS (SELECT conv_id, turn, text || chr(10) AS t FROM conversations),
n AS (SELECT conv_id, turn, regexp_replace('See ' || chr(10) || t, '(?is)opt out\\s*·?.*|unsubscribe.*|©\\s*\\d{{4}}.*|all rights reserved.*', '') AS t FROM m),
k AS (SELECT conv_id, turn, array_to_string(list_filter(string_split(t, chr(10)), lambda l: NOT starts_with(ltrim(l), '>')), chr(10)) AS t FROM n)
SELECT conv_id, turn, {_clean_sql('t')} AS text FROM k""",
    ),
    "keep_filter": (
        keep_filter,
        f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'table' ELSE 'text' END AS type,
CASE WHEN doc_id % 3 = 0 THEN {_STRIP.format(_TABLE)} ELSE {_clean_sql('text')} END AS content FROM documents)
SELECT doc_id, type, content FROM c WHERE (type = 'table' AND content <> '') OR (type = 'text' AND length(content) >= 20)""",
    ),
    "embed_text": (embed_text, "SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'Table: ' || text WHEN 2 THEN 'Image description: ' || text ELSE text END AS embed_text FROM documents"),
    "uuid5_ids": (uuid5_ids, _UUID),
    "table_slugs": (
        table_slugs,
        f"""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' ' || p_type)), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS a,
regexp_replace(regexp_replace(lower(p_size || '-' || p_brand), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS b FROM part)
SELECT p_partkey, {_SLUG.format('a')} AS slug, {_SLUG.format('b')} AS numbered FROM s""",
    ),
    "safe_casts": (safe_casts, "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id::INT END AS number, CASE WHEN event_id % 2 <> 0 THEN event_type END AS word FROM events"),
    "sentence_split": (sentence_split, f"SELECT doc_id, len({_SENT})::INT AS sentences, array_to_string({_SENT}, '|') AS joined FROM documents"),
    "structured_split": (structured_split, f"SELECT doc_id, {_structured_sql()} AS sentences FROM documents"),
    "structure_kind": (
        structure_kind,
        f"WITH {_STRUCTURE} SELECT doc_id, CASE WHEN b > 0.2 OR h > 0.05 THEN 'structured' WHEN b > 0.05 OR h > 0.02 THEN 'mixed' ELSE 'narrative' END AS kind FROM r",
    ),
    "structure_sections": (structure_sections, f"WITH {_STRUCTURE}, k AS (SELECT doc_id, {_KIND} AS kind, text FROM r JOIN documents USING (doc_id)) SELECT doc_id, {_SECTIONS} AS sections FROM k"),
    "sentence_chunks": (sentence_chunks, _chunks_sql("doc_id", "chunk", f"SELECT doc_id, {_sentence_groups(_SENT)} AS f FROM documents", _TAIL)),
    "paragraph_chunks": (paragraph_chunks, _chunks_sql("doc_id", "chunk", f"SELECT doc_id, {_PARAGRAPHS} AS f FROM documents", _TAIL)),
    "table_chunks": (
        table_chunks,
        _chunks_sql(
            "c_nationkey", "batch",
            f"""SELECT c_nationkey, rows, {_BATCHES} AS f FROM (SELECT c_nationkey, list(c_name || ' | ' || c_mktsegment || ' | ' || CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || format('{{:,.2f}}', abs(c_acctbal)) ORDER BY c_custkey) AS rows FROM customer GROUP BY c_nationkey)""",
            f"CASE WHEN {_tok(_HEAD + ' || chr(10) || array_to_string(rows, chr(10))')} <= 450 THEN [{_HEAD} || chr(10) || array_to_string(rows, chr(10))] WHEN f.cur = '' THEN f.out ELSE list_append(f.out, {_HEAD} || chr(10) || f.cur) END",
        ),
    ),
    "adjacent_cosine": (adjacent_cosine, f"WITH {_COS} SELECT vec_id, label, similarity FROM c"),
    "valley_boundaries": (
        valley_boundaries,
        f"""WITH {_COS}, v AS (SELECT *, coalesce(similarity < lag(similarity) OVER w AND similarity < lead(similarity) OVER w
  AND similarity < round(avg(similarity) OVER (PARTITION BY label) - 0.5::DOUBLE * stddev_pop(similarity) OVER (PARTITION BY label), 6), false) AS v FROM c WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id, label, coalesce(lag(v) OVER (PARTITION BY label ORDER BY vec_id), false) AS is_boundary FROM v""",
    ),
    "semantic_segments": (
        semantic_segments,
        f"""WITH {_COS}, k AS (SELECT *, CASE WHEN lag(similarity) OVER (PARTITION BY label ORDER BY vec_id) < 0 THEN 1 ELSE 0 END AS cut FROM c)
SELECT vec_id, label, (sum(cut) OVER (PARTITION BY label ORDER BY vec_id))::BIGINT AS segment FROM k""",
    ),
    "semantic_chunks": (semantic_chunks, None),
    "section_islands": (
        section_islands,
        """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM a)
SELECT user_id, island::BIGINT AS island, event_type, count(*) AS n, min(event_id) AS first_event FROM b GROUP BY ALL""",
    ),
    "carry_forward": (
        carry_forward,
        """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""",
    ),
    "running_counts": (running_counts, "SELECT event_id, (sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS clicks FROM events"),
    "caption_spread": (
        caption_spread,
        """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
SELECT event_id, first_value(CASE WHEN value > 50 THEN round(value, 2) END IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS caption FROM b""",
    ),
    "chunk_index_total": (
        chunk_index_total,
        "SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INT AS chunk_index, count(*) OVER (PARTITION BY source) AS chunk_total FROM documents",
    ),
    "tiny_merge": (
        tiny_merge,
        f"""WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l) <> '') AS l FROM documents),
t AS (SELECT doc_id, list_transform(l, lambda x, i: {{'type': CASE WHEN (i - 1) % 7 = 3 THEN 'table' ELSE 'text' END, 'content': x, 'next': CASE WHEN i = len(l) THEN '' WHEN i % 7 = 3 THEN 'table' ELSE 'text' END}}) AS items FROM l),
f AS (SELECT doc_id, ({_TINY}).out AS c FROM t)
SELECT doc_id, (unnest(range(1, len(c) + 1)) - 1)::INT AS chunk, unnest(c).type AS type, unnest(c).content AS content FROM f""",
    ),
    "artifact_merge": (
        artifact_merge,
        f"""WITH t AS (SELECT doc_id, string_split('---' || chr(10) || 'Page 1' || chr(10) || text || chr(10) || 'Page 2', chr(10)) AS parts FROM documents), f AS (SELECT doc_id, {_ARTIFACTS} AS f FROM t),
c AS (SELECT doc_id, CASE WHEN f.held <> '' THEN list_append(f.out, f.held) ELSE f.out END AS c FROM f)
SELECT doc_id, (unnest(range(1, len(c) + 1)) - 1)::INT AS part, unnest(c) AS content FROM c""",
    ),
    "type_counts": (type_counts, f"WITH {_TYPED} SELECT type, count(*) AS chunks, min(tokens) AS least, floor(avg(tokens))::BIGINT AS mean, max(tokens) AS most FROM t GROUP BY type"),
    "length_stats": (
        length_stats,
        f"WITH {_TYPED} SELECT lang, count(*) AS n, min(tokens) AS least, floor(avg(tokens))::BIGINT AS mean, max(tokens) AS most, count(*) FILTER (tokens > 450) AS \"over\", count(*) FILTER (tokens < 80) AS under FROM t GROUP BY lang",
    ),
    "group_by_section": (
        group_by_section,
        f"""WITH {_TYPED} SELECT source || '/' || lang AS section, sum(tokens)::BIGINT AS tokens, count(*) FILTER (type = 'table') AS tables, count(*) FILTER (type = 'image') AS images, min(doc_id) AS first_doc FROM t GROUP BY 1""",
    ),
    "section_exclusion": (section_exclusion, "SELECT event_type, count(*) AS n FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 GROUP BY event_type"),
    "validate_chunks": (
        validate_chunks,
        """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'figure' WHEN doc_id % 41 <> 0 THEN 'text' END AS type,
 CASE WHEN doc_id % 23 = 0 THEN '  ' ELSE text END AS content, CASE WHEN doc_id % 37 <> 0 THEN text END AS embed_text FROM documents)
SELECT 'c' || doc_id AS chunk_id, problem FROM (SELECT doc_id, unnest(list_filter([
 CASE WHEN doc_id % 629 = 0 THEN 'missing top-level fields: chunk_id, embed_text' WHEN doc_id % 17 = 0 THEN 'missing top-level fields: chunk_id' WHEN doc_id % 37 = 0 THEN 'missing top-level fields: embed_text' END,
 CASE WHEN type IS NULL OR type NOT IN ('text', 'table', 'image') THEN 'invalid type: ' || coalesce(type, 'None') END,
 CASE WHEN regexp_matches(content, '^\\s*$') THEN 'empty content' END, CASE WHEN embed_text IS NULL OR regexp_matches(embed_text, '^\\s*$') THEN 'empty embed_text' END,
 CASE WHEN doc_id % 29 = 0 THEN 'missing metadata fields: source, page' END, CASE WHEN doc_id % 31 = 0 THEN 'invalid source_type: fax' END], lambda x: x IS NOT NULL)) AS problem FROM c)""",
    ),
    "upsert_refusals": (
        upsert_refusals,
        """SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN 'missing chunk_id' WHEN vec_id % 23 = 0 THEN 'wrong dense_vector dim: 3 (expected ' || len(embedding) || ')' WHEN vec_id % 29 = 0 THEN 'missing dense_vector'
 WHEN vec_id % 13 = 0 THEN 'missing or empty sparse_vector' WHEN vec_id % 11 = 0 THEN 'sparse_vector indices/values length mismatch' WHEN vec_id % 19 = 0 THEN 'empty content' ELSE 'stored' END AS reason FROM embeddings""",
    ),
    "source_types": (
        source_types,
        """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'pdf_scanned' ELSE CASE p_partkey % 10 WHEN 0 THEN 'pdf_digital' WHEN 1 THEN 'docx' WHEN 2 THEN 'pptx' WHEN 3 THEN 'eml' WHEN 4 THEN 'txt'
 WHEN 5 THEN 'image' WHEN 6 THEN 'image' WHEN 7 THEN 'image' END END AS source_type FROM part""",
    ),
    "shape_unification": (
        shape_unification,
        """SELECT conv_id::VARCHAR AS source, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1)::INT AS position, turn, text AS content FROM conversations
WHERE conv_id % 4 < 3 QUALIFY conv_id % 4 < 2 OR (position = 0 AND content IS NOT NULL)""",
    ),
    "descriptions": (
        descriptions,
        f"""WITH a AS (SELECT doc_id, regexp_replace(text, '[<>' || chr(160) || ']', '', 'g') || chr(10) || chr(10) || '* **bold** "quoted"' || chr(10) || '  ' || chr(10) || '- last' AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('The image shows, ' || t, '^the image (shows?|presents?|depicts?|displays?|contains?|illustrates?)[,.]?\\s*', '', 'i'),
 '\\*{{1,2}}([^*]+)\\*{{1,2}}', '\\1', 'g'), '\\*+', '', 'g'), '[\\\\"]', '', 'g'), '(?m)^\\s*[*-]\\s+', '', 'g') AS t FROM a),
c AS (SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda l: NOT regexp_matches(l, '^\\s*$')), chr(10)) AS t FROM b)
SELECT doc_id, {_clean_sql('t')} AS text FROM c""",
    ),
    "canonical_chunks": (
        canonical_chunks,
        f"""WITH c AS (SELECT doc_id, source, lang, {_clean_sql('text')} AS content FROM documents),
h AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('pdf_digital:' || source || ':' || substring(content, 1, 200))) AS h FROM c)
SELECT doc_id, 'text' AS type, source, (doc_id % 9)::INT AS page, lang AS section,
concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], lower(to_hex((('0x' || h[17])::INT & 3) | 8)) || h[18:20], h[21:32]) AS chunk_id, content, content AS embed_text FROM h WHERE length(content) >= 20""",
    ),
    "html_text": (
        html_text,
        r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""",
    ),
    "html_parts": (html_parts, None),
    "digital_elements": (
        digital_elements,
        f"""WITH t AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, (generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1)::INT AS position FROM documents),
k AS (SELECT *, {_STRIP.format('text')} AS t, CASE WHEN (position + doc_id % 10) % 10 = 0 THEN 'section' WHEN (position + doc_id % 10) % 7 = 3 THEN 'table' WHEN (position + doc_id % 10) % 11 = 6 THEN 'image' ELSE 'text' END AS kind, position // 5 + 1 AS page FROM t),
s AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'section' THEN t END IGNORE NULLS) OVER w, 'Unknown') AS section, count(CASE WHEN kind <> 'text' THEN 1 END) OVER w AS run FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY position ROWS UNBOUNDED PRECEDING)),
x AS (SELECT doc_id, position, list_filter(string_split(text, ' '), lambda q, i: (i - 1) % 4 <> 2) AS ws FROM s WHERE kind = 'table' AND text <> ''),
c AS (SELECT doc_id, position, w, (i - 1) // 3 AS r, (i - 1) % 2 AS c, i FROM (SELECT doc_id, position, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM x)),
m AS (SELECT doc_id, position, r, c, arg_max(w, i) AS w FROM c GROUP BY ALL),
z AS (SELECT doc_id, position, max(r) AS h, max(c) AS v FROM m GROUP BY ALL),
y AS (SELECT doc_id, position, r, unnest(range(0, v + 1)) AS c FROM (SELECT doc_id, position, v, unnest(range(0, h + 1)) AS r FROM z)),
g AS (SELECT doc_id, position, r, string_agg(coalesce(w, ''), ' | ' ORDER BY c) AS line FROM y LEFT JOIN m USING (doc_id, position, r, c) GROUP BY doc_id, position, r),
b AS (SELECT g.doc_id, g.position, string_agg(line || CASE WHEN r = 0 AND h > 0 THEN chr(10) || CASE v WHEN 0 THEN '---' ELSE '--- | ---' END ELSE '' END, chr(10) ORDER BY r) AS grid FROM g JOIN z USING (doc_id, position) GROUP BY g.doc_id, g.position),
e AS (SELECT s.*, CASE kind WHEN 'table' THEN grid WHEN 'section' THEN NULL ELSE nullif(t, '') END AS body FROM s LEFT JOIN b USING (doc_id, position)),
f AS (SELECT *, CASE WHEN kind = 'table' THEN count(CASE WHEN kind = 'table' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY position) END AS table_index FROM e WHERE body IS NOT NULL),
a AS (SELECT doc_id, run, kind AS type, section, table_index, string_agg(body, ' ' ORDER BY position) AS content, arg_min(page, position) AS page_start, arg_max(page, position) AS page_end, min(position) AS first FROM f GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first))::INT AS number, type, content, section, page_start::INT AS page_start, page_end::INT AS page_end, table_index FROM a""",
    ),
    "page_chunks": (page_chunks, None),
    "slide_chunks": (
        slide_chunks,
        """WITH s AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'system' THEN substring(text, 1, 40) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations),
b AS (SELECT *, text <> '' AND length(text) < 150 AS short, turn % 3 = 0 AS t, turn % 4 = 0 AS i FROM s WHERE role <> 'system'),
c AS (SELECT conv_id, turn, section, 'table' AS type, 1 AS o, CASE WHEN short THEN text || chr(10) || chr(10) ELSE '' END || 'a | b' AS content FROM b WHERE t
UNION ALL SELECT conv_id, turn, section, 'image', 2, CASE WHEN short THEN text || chr(10) || chr(10) ELSE '' END || 'an image' FROM b WHERE i
UNION ALL SELECT conv_id, turn, section, 'text', 3, text FROM b WHERE text <> '' AND NOT (short AND (t OR i)))
SELECT conv_id AS doc_id, turn AS slide, section, type, content, CASE WHEN type <> 'text' THEN (row_number() OVER (PARTITION BY conv_id, type ORDER BY turn, o))::INT END AS number FROM c""",
    ),
    "crawl_due": (
        crawl_due,
        f"""WITH m(k, source_type, fetch_as) AS (VALUES {", ".join(f"({_LISTED.index(k)}, '{crawl.MIME_TYPES[crawl.EXPORTS.get(k, k)]}', '{crawl.EXPORTS.get(k, k)}')" for k in _LISTED if crawl.EXPORTS.get(k, k) in crawl.MIME_TYPES)})
SELECT o_orderkey AS file_id, source_type, fetch_as, o_orderstatus AS modified_time FROM orders JOIN m ON m.k = o_orderkey % {len(_LISTED)} WHERE NOT (o_orderkey <= 500 AND o_orderstatus = 'F')""",
    ),
    "markdown_elements": (
        markdown_elements,
        f"""WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
a AS (SELECT doc_id, n, CASE (n + doc_id) % 13 WHEN 0 THEN '## ' || array_to_string(list_slice(string_split(l, ' '), 1, 2), ' ') WHEN 3 THEN '| ' || l WHEN 4 THEN '| ' || l WHEN 6 THEN '| ' || l WHEN 7 THEN '| ' || l WHEN 9 THEN '| ' || l
  WHEN 5 THEN ' |---|---|' ELSE l END AS line FROM t),
b AS (SELECT *, {_STRIP.format('line')} AS t, starts_with({_STRIP.format('line')}, '|') AS bar, coalesce(contains(lead(line) OVER (PARTITION BY doc_id ORDER BY n), '---'), false) AS rule FROM a),
c AS (SELECT *, CASE WHEN starts_with(t, '#') THEN {_STRIP.format("regexp_replace(t, '^#+', '')")} END AS head, CASE WHEN lag(bar) OVER (PARTITION BY doc_id ORDER BY n) = bar THEN 0 ELSE 1 END AS ch FROM b),
e AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY n) AS run, count(head) OVER (PARTITION BY doc_id ORDER BY n) AS heads,
  coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING), 'Unknown') AS section FROM c),
f AS (SELECT *, CASE WHEN max((bar AND rule)::INT) OVER (PARTITION BY doc_id, run ORDER BY n ROWS UNBOUNDED PRECEDING) = 1 THEN 'table' ELSE 'text' END AS type FROM e),
g AS (SELECT *, concat_ws('/', heads, type, CASE WHEN type = 'table' THEN run END) AS k FROM f WHERE head IS NULL AND t <> ''),
h AS (SELECT *, CASE WHEN lag(k) OVER (PARTITION BY doc_id ORDER BY n) = k THEN 0 ELSE 1 END AS ck FROM g),
i AS (SELECT *, (sum(ck) OVER (PARTITION BY doc_id ORDER BY n))::BIGINT AS element FROM h)
SELECT doc_id, element, section, type, CASE type WHEN 'table' THEN string_agg(t, chr(10) ORDER BY n) ELSE string_agg(t, ' ' ORDER BY n) END AS content FROM i GROUP BY doc_id, element, section, type""",
    ),
    "mail_chunks": (
        mail_chunks,
        f"""WITH p AS ({_chunks_sql("doc_id, source, lang", "i", f"SELECT doc_id, source, lang, {_PARAGRAPHS} AS f FROM (SELECT doc_id, source, lang, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)", _TAIL)}),
n AS (SELECT d.doc_id, count(p.i) AS n FROM documents d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id::VARCHAR AS path, i AS position, 'text' AS type, content, source AS subject, lang AS date FROM p
UNION ALL SELECT doc_id::VARCHAR, (n + k)::INT, 'table', CASE k WHEN 0 THEN 'a | b' ELSE 'n | ' || doc_id END, source, lang FROM documents JOIN n USING (doc_id), (VALUES (0), (1)) AS v(k) WHERE doc_id % 3 = 0""",
    ),
    "fenced_code": (
        fenced_code,
        f"""SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN {_STRIP.format('text')} WHEN doc_id % 4 = 2 THEN {_STRIP.format("'```' || text")} ELSE {_STRIP.format('text')} END AS code FROM documents""",
    ),
    "mail_marks": (
        mail_marks,
        r"""WITH l AS (SELECT conv_id || '-' || turn AS key, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '') AS l,
  CASE turn % 9 WHEN 1 THEN 'kept' WHEN 4 THEN 'kept' END AS m FROM conversations)
SELECT key, array_to_string(CASE WHEN m IS NULL THEN l ELSE list_append(l, m) END, chr(10)) AS text FROM l""",
    ),
}
