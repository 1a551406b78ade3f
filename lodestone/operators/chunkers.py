"""Chunkers of whole documents: pages with captions, slides, mail.

Elements come as rows (doc_id, position, type, content, section). Runs are found
by windows over one document; what depends on earlier output is a fold over the
document's array (packing, attach_captions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.providers import Embed, hashed_embedding, segmented, with_valleys
from lodestone.functions.text import ANY_CAPTION, CAPTION_LABEL, SKIPPED_SECTIONS, caption_parts, sections, sentences, strip, structure, structured_sentences, tokens, uuid5, without_preamble
from lodestone.operators import packing
from lodestone.operators.windows import SEGMENT_CUT, VALLEY_STD, islands

#: Longest caption line of its own, and longest text of a slide that is a caption.
CAPTION_LINE, SLIDE_CAPTION = 200, 150
#: Fixed value: most tokens of a narrative that is packed as a whole.
NARRATIVE_MOST = 8000
#: Fixed values of a section slide: most paragraphs, words, title characters and title lines.
SLIDE_PARAGRAPHS, SLIDE_WORDS, TITLE_CHARS, TITLE_LINES = 4, 30, 80, 3
_ITEM = "struct<type:string,content:string,section:string>"


def _item(type_: Column, content: Column, section: Column) -> Column:
    return F.struct(type_.alias("type"), content.alias("content"), section.alias("section"))


def attach_captions(items: Column) -> Column:
    """Tables and images with their caption: a label line and the text after it, else a caption line below, else one above.

    items is array<struct<type, content, section>>. What follows a caption's
    sentence stays as a text of its own if it is longer than 20 characters.
    """
    n = F.size(items)
    rows = F.transform(items, lambda e, i: F.struct(e.alias("e"), F.get(items, i + 1).alias("a"), F.get(items, i + 2).alias("b"), i.alias("i")))
    start = F.struct(F.array().cast(f"array<{_ITEM}>").alias("out"), F.lit(0).alias("skip"))

    def step(s, r):
        e, a, b, out = r["e"], r["a"], r["b"], s["out"]
        holder = e["type"].isin("table", "image")
        below = (r["i"] + 1 < n) & (a["type"] == "text")
        label = F.coalesce(below & strip(a["content"]).rlike(CAPTION_LABEL) & (r["i"] + 2 < n) & (b["type"] == "text"), F.lit(False))
        line = F.coalesce(below & strip(a["content"]).rlike(ANY_CAPTION), F.lit(False))
        text = F.when(label, F.concat(strip(a["content"]), F.lit(" "), strip(b["content"]))).when(line, strip(a["content"]))
        head, rest = caption_parts(text)
        last = F.get(out, F.size(out) - 1)
        above = F.coalesce(text.isNull() & (last["type"] == "text") & strip(last["content"]).rlike(ANY_CAPTION), F.lit(False))
        content = (
            F.when(text.isNotNull(), F.concat(F.regexp_replace(e["content"], r"\s+$", ""), F.lit("\n\nCaption: "), head))
            .when(above, F.concat(F.lit("Caption: "), strip(last["content"]), F.lit("\n\n"), e["content"]))
            .otherwise(e["content"])
        )
        before = F.when(holder & above, F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(out)
        grown = F.array_append(before, _item(e["type"], F.when(holder, content).otherwise(e["content"]), e["section"]))
        left = holder & text.isNotNull() & rest.isNotNull()
        grown = F.when(left, F.array_append(grown, _item(F.lit("text"), rest, a["section"]))).otherwise(grown)
        skip = F.when(holder & label, 2).when(holder & line, 1).otherwise(0)
        skipped = s["skip"] > 0
        return F.struct(F.when(skipped, out).otherwise(grown).alias("out"), F.when(skipped, s["skip"] - 1).otherwise(skip).alias("skip"))

    return F.aggregate(rows, start, step, lambda s: s["out"])


def spread(items: Column) -> Column:
    """Items in which every run of tables of one section carries the caption of the first that has one.

    A table's own caption goes for it: what stands before the mark stays, trimmed.
    items is array<struct<type, content, section>>; spread_captions does the same over rows.
    """
    state = f"struct<out:array<struct<e:{_ITEM},bare:string,own:string,last:boolean>>,own:string>"
    rows = F.transform(items, lambda e, i: F.struct(e.alias("e"), F.get(items, i - 1).alias("before"), F.get(items, i + 1).alias("after")))
    of_one = lambda a, b: F.coalesce((a["type"] == "table") & (b["type"] == "table") & a["section"].eqNullSafe(b["section"]), F.lit(False))

    def forward(s, r):
        content = r["e"]["content"]
        mark = F.coalesce(F.nullif(F.instr(content, "\n\nCaption:"), F.lit(0)), F.nullif(F.instr(content, "Caption:"), F.lit(0)))
        table = r["e"]["type"] == "table"
        caption = F.when(table & mark.isNotNull(), F.concat(F.lit("\n\n"), F.regexp_replace(F.substring(content, mark, F.length(content)), r"^\n\n", "")))
        bare = F.when(mark.isNotNull(), strip(F.substring(content, F.lit(1), mark - 1))).otherwise(content)
        own = F.coalesce(F.when(of_one(r["before"], r["e"]), s["own"]), caption)
        row = F.struct(r["e"].alias("e"), bare.alias("bare"), own.alias("own"), (~of_one(r["e"], r["after"])).alias("last"))
        return F.struct(F.array_append(s["out"], row).alias("out"), own.alias("own"))

    # the last of a run knows the run's first caption; it goes back from there
    known = F.aggregate(rows, F.struct(F.array().alias("out"), F.lit(None).cast("string").alias("own")).cast(state), forward, lambda s: F.reverse(s["out"]))

    def back(s, r):
        own = F.when(r["last"], r["own"]).otherwise(s["own"])
        content = F.when((r["e"]["type"] == "table") & own.isNotNull(), F.concat(r["bare"], own)).otherwise(r["e"]["content"])
        return F.struct(F.array_append(s["out"], _item(r["e"]["type"], content, r["e"]["section"])).alias("out"), own.alias("own"))

    return F.aggregate(known, F.struct(F.array().cast(f"array<{_ITEM}>").alias("out"), F.lit(None).cast("string").alias("own")), back, lambda s: F.reverse(s["out"]))


def page_chunks(elements: DataFrame, embed: Embed = hashed_embedding) -> DataFrame:
    """(doc_id, chunk_index, chunk_total, type, content) of page elements.

    Texts of a section that follow one another are joined; where they pass the budget
    or have no known section they are cut by meaning, at neighbouring sentences whose
    embeddings differ, and short pieces joined again. Tables are split by rows;
    captions are attached, and spread over the pieces of a table; tiny texts merged;
    references are left out.
    """
    section = F.lower(strip(F.coalesce("section", F.lit(""))))
    skipped = section.rlike("|".join(SKIPPED_SECTIONS))
    rows = elements.where(~skipped & (strip(F.coalesce("content", F.lit(""))) != "")).withColumn("section", F.coalesce("section", F.lit("")))
    kind = F.when(F.col("type").isin("table", "image"), F.col("type")).otherwise("text")
    rows = rows.withColumn("type", kind).withColumn("_key", F.when(F.col("type") == "text", section).otherwise(F.concat(F.lit("\0"), F.col("position").cast("string"))))
    runs = islands(rows, ["doc_id"], ["position"], F.col("_key"), "run")
    ordered = F.sort_array(F.collect_list(F.struct("position", strip(F.col("content")).alias("c"), F.col("section").alias("s"))))
    runs = runs.groupBy("doc_id", "run", "type").agg(ordered.alias("o"))
    is_caption = lambda c: c.rlike(ANY_CAPTION) & (F.length(c) < CAPTION_LINE)
    runs = runs.select("doc_id", "run", "type", F.get("o.s", F.lit(0)).alias("section"), F.col("o.c").alias("parts"))
    runs = runs.withColumn("body", F.when(F.col("type") == "text", F.array_join(F.filter("parts", lambda c: ~is_caption(c)), " ")).otherwise(""))
    unknown = F.lower(strip(F.col("section"))).isin("", "unknown")
    whole = (F.col("body") == "") | (~unknown & (tokens(F.col("body")) <= packing.MOST))
    cut = segmented(runs.withColumn("cut", F.when(whole, F.array().cast("array<string>")).otherwise(sentences(F.col("body")))), "cut", SEGMENT_CUT, embed)
    pieces = F.when(F.col("body") == "", F.array().cast("array<string>")).when(F.size("cut") < 2, F.array("body")).otherwise(packing.merge_short(F.col("cut")))
    texts = F.concat(pieces, F.filter("parts", is_caption))
    each = F.when(F.col("type") == "text", texts).when(F.col("type") == "table", packing.table_batches(F.get("parts", F.lit(0)))).otherwise(F.col("parts"))
    items = cut.withColumn("items", F.transform(each, lambda p: _item(F.col("type"), p, F.col("section"))))
    docs = items.groupBy("doc_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("run", "items")))["items"]).alias("items"))
    # each fold stands alone: within one another they would be written out many times over
    docs = docs.select("doc_id", attach_captions(F.col("items")).alias("items"))
    docs = docs.select("doc_id", F.transform(spread(F.col("items")), lambda x: F.struct(x["type"].alias("type"), x["content"].alias("content"))).alias("items"))
    # outer, and documents without a chunk dropped after: a filter on their number would run all folds a second time
    out = docs.select("doc_id", F.posexplode_outer(packing.merge_tiny(F.col("items"))).alias("_i", "c")).where("_i IS NOT NULL")
    return out.select("doc_id", (F.col("_i") + 1).alias("chunk_index"), F.count(F.lit(1)).over(W.partitionBy("doc_id")).alias("chunk_total"), "c.type", "c.content")


def grid(cells: Column) -> Column:
    """A table's text of its cells, array<struct<row, col, text>>: each stands where it begins, what it spans stays blank.

    Of several cells of one place the last counts. The first row is the header, unless it is
    the only one; no cells: null. One fold over the cells in order of their places.
    """
    placed = F.array_sort(F.transform(cells, lambda c, i: F.struct(c["row"].cast("int").alias("row"), c["col"].cast("int").alias("col"), i.alias("i"), F.coalesce(c["text"], F.lit("")).alias("text"))))
    bars = lambda n: F.repeat(F.lit(" | "), n)
    none = F.lit(-1)
    # w: width; r, c, cur, text: the last cell's place, its line before it, and itself; lines: those that are full
    start = F.struct((F.array_max(F.transform(cells, lambda c: c["col"].cast("int"))) + 1).alias("w"), none.alias("r"), none.alias("c"), F.lit("").alias("cur"), F.lit("").alias("text"), F.array().cast("array<string>").alias("lines"))
    full = lambda a: F.concat(a["cur"], a["text"], bars(a["w"] - 1 - a["c"]))

    def step(a, x):
        same_row = x["row"] == a["r"]
        same = same_row & (x["col"] == a["c"])
        closed = F.when(a["r"] < 0, a["lines"]).otherwise(F.array_append(a["lines"], full(a)))
        skipped = F.array_repeat(bars(a["w"] - 1), x["row"] - a["r"] - 1)
        return F.struct(
            a["w"].alias("w"), x["row"].alias("r"), x["col"].alias("c"),
            F.when(same, a["cur"]).when(same_row, F.concat(a["cur"], a["text"], bars(x["col"] - a["c"]))).otherwise(bars(x["col"])).alias("cur"),
            x["text"].alias("text"),
            F.when(same_row, a["lines"]).otherwise(F.concat(closed, skipped)).alias("lines"),
        )

    def text(a):
        rule = F.array_join(F.array_repeat(F.lit("---"), a["w"]), " | ")
        below = F.concat(F.slice(a["lines"], 1, 1), F.array(rule), F.slice(a["lines"], F.lit(2), F.greatest(F.size(a["lines"]) - 1, F.lit(0))), F.array(full(a)))
        return F.array_join(F.when(a["r"] > 0, below).otherwise(F.array(full(a))), "\n")

    return F.when(F.size(cells) > 0, F.aggregate(placed, start, step, text))


def digital_elements(parsed: DataFrame) -> DataFrame:
    """(doc_id, number, type, content, section, page_start, page_end, table_index) of a parser's items (doc_id, position, kind, page, text, cells).

    kind is section, text, table, or image, whose text describes it. Texts that follow one another are one
    element, across pages: its first and last page are those of its first and last text. Any
    other item ends it. A section is that of the last heading, "Unknown" before the first.
    Tables are numbered within the document; blank texts, images without a description and tables without cells go.
    """
    w = W.partitionBy("doc_id").orderBy("position")
    text = strip(F.coalesce("text", F.lit("")))
    rows = parsed.withColumn("_t", text)
    rows = rows.withColumn("section", F.coalesce(F.last(F.when(F.col("kind") == "section", F.col("_t")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit("Unknown")))
    rows = rows.withColumn("_run", F.count(F.when(F.col("kind") != "text", 1)).over(w))
    body = F.when(F.col("kind") == "table", grid(F.col("cells"))).when(F.col("kind").isin("text", "image"), F.nullif(F.col("_t"), F.lit("")))
    rows = rows.withColumn("_body", body).where(F.col("_body").isNotNull())
    rows = rows.withColumn("table_index", F.when(F.col("kind") == "table", F.count(F.when(F.col("kind") == "table", 1)).over(w)))
    held = F.sort_array(F.collect_list(F.struct("position", "page", "_body")))
    # texts of a run are one element; a table or image is a run's first item, and stands alone
    runs = rows.groupBy("doc_id", "_run", F.col("kind").alias("type"), "section", "table_index").agg(held.alias("h"))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy(F.get("h.position", F.lit(0))))
    return runs.select("doc_id", number.alias("number"), "type", F.array_join("h._body", " ").alias("content"), "section", F.get("h.page", F.lit(0)).alias("page_start"), F.element_at("h.page", -1).alias("page_end"), "table_index")


def is_section_slide(tables: Column, images: Column, paragraphs: Column, bullets: Column, words: Column, title: Column) -> Column:
    """A slide that only names a section: no table or image, few words, no bullets, a short title."""
    text = strip(F.coalesce(title, F.lit("")))
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: strip(x) != ""))
    few = (paragraphs <= SLIDE_PARAGRAPHS) & ~bullets & (words <= SLIDE_WORDS)
    return (tables == 0) & (images == 0) & few & title.isNotNull() & (F.length(text) <= TITLE_CHARS) & (lines <= TITLE_LINES)


def section_name(titles: Column, others: Column, number: Column) -> Column:
    """A section slide's name: its longest title that isn't a number, after the number if there is one; else the longest other text."""
    numeric = F.filter(titles, lambda t: t.rlike(r"^\s*\d+\s*$") | (F.length(strip(t)) <= 3))
    real = F.array_except(titles, numeric)
    rest = F.filter(others, lambda t: ~strip(t).rlike(r"^\d+$") & (F.length(strip(t)) > 2))
    longest = lambda a: F.aggregate(a, F.lit(""), lambda m, x: F.when(F.length(x) > F.length(m), x).otherwise(m))
    first = F.get(numeric, F.lit(0))
    with_number = lambda text: F.when(first.isNotNull(), F.concat(first, F.lit(" - "), text)).otherwise(text)
    return (
        F.when(F.size(real) > 0, with_number(longest(real)))
        .when(first.isNotNull() & (F.size(rest) > 0), with_number(longest(rest)))
        .otherwise(F.coalesce(F.get(titles, F.lit(0)), F.concat(F.lit("Section "), number.cast("string"))))
    )


def slide_chunks(slides: DataFrame) -> DataFrame:
    """(doc_id, slide, section, type, content, number) of slides (doc_id, slide, is_section, name, text, tables, images).

    Section slides name the section of those after them and give no chunk. A
    short text goes before the first table and the first image of its slide;
    otherwise it is a chunk of its own. Tables and images are numbered within the document.
    """
    order = W.partitionBy("doc_id").orderBy("slide").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = slides.withColumn("section", F.last(F.when(F.col("is_section"), F.col("name")), ignorenulls=True).over(order)).where(~F.col("is_section"))
    text = F.coalesce("text", F.lit(""))
    held = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    short = (text != "") & (F.length(text) < SLIDE_CAPTION)
    led = lambda a, kind: F.transform(held(F.col(a)), lambda x, i: F.struct(F.lit(kind).alias("type"), F.when(short & (i == 0), F.concat(text, F.lit("\n\n"), x)).otherwise(x).alias("content")))
    used = short & (F.size(held(F.col("tables"))) + F.size(held(F.col("images"))) > 0)
    own = F.when((text != "") & ~used, F.array(F.struct(F.lit("text").alias("type"), text.alias("content")))).otherwise(F.array().cast("array<struct<type:string,content:string>>"))
    out = rows.select("doc_id", "slide", "section", F.posexplode(F.concat(led("tables", "table"), led("images", "image"), own)).alias("_i", "c"))
    out = out.select("doc_id", "slide", "section", "_i", "c.type", "c.content")
    number = F.row_number().over(W.partitionBy("doc_id", "type").orderBy("slide", "_i"))
    return out.withColumn("number", F.when(F.col("type") != "text", number)).drop("_i")


def mail_chunks(mails: DataFrame) -> DataFrame:
    """(path, position, type, content, subject, from, date) of parsed mails: body paragraphs packed, then one chunk a table."""
    body = F.transform(packing.paragraphs(F.coalesce("text", F.lit(""))), lambda p: F.struct(F.lit("text").alias("type"), p.alias("content")))
    tables = F.transform(F.coalesce("tables", F.array().cast("array<string>")), lambda t: F.struct(F.lit("table").alias("type"), t.alias("content")))
    return mails.select("path", "subject", "from", "date", F.posexplode(F.concat(body, tables)).alias("position", "c")).select("path", "position", "c.type", "c.content", "subject", "from", "date")


def attachment_chunks(mails: DataFrame, attachments: DataFrame) -> DataFrame:
    """Chunks of attachments (path, name, position, type, content, source_type) with their mail's header fields and file id.

    All chunks of an attachment share one identifier, made of the mail's and its name.
    Attached CSVs are tables of their own and give no chunk.
    """
    head = mails.select("path", "file_id", "subject", "from", "to", "date", F.col("name").alias("eml_source"))
    rows = attachments.where(~F.lower("name").endswith(".csv")).join(head, "path")
    kind = F.coalesce("source_type", F.nullif(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)), F.lit("")), F.lit("attachment"))
    return rows.select(
        "path", F.col("name").alias("source"), "file_id", uuid5(F.concat_ws(":", "file_id", "name")).alias("attachment_guid"), kind.alias("source_type"),
        "eml_source", "subject", "from", "to", "date", "position", F.coalesce("type", F.lit("text")).alias("type"), F.coalesce("content", F.lit("")).alias("content"),
    )


def ordered_shapes(shapes: Column) -> Column:
    """A slide's shapes from top to bottom, then left to right; a missing place counts as 0, ties keep their order."""
    place = F.transform(shapes, lambda x, i: F.struct(F.coalesce(x["top"], F.lit(0)).alias("t"), F.coalesce(x["left"], F.lit(0)).alias("l"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(place, lambda a, b: _by(a, b, ("t", "l", "i"))), lambda s: s["x"])


def _by(a: Column, b: Column, names: tuple[str, ...]) -> Column:
    order = F.lit(0)
    for name in reversed(names):
        order = F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(order)
    return order


def scanned_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text, visuals) of scanned pages (doc_id, page, label, ocr, description, table).

    Pages are laid one after the other under a rule with their number. What else a page
    gives goes by its class: a table for has_table, a description for has_chart and
    mixed; an unknown class counts as text_only. visuals lists them in order of pages.
    """
    label = F.lower(strip(F.coalesce("label", F.lit(""))))
    known = F.when(label.isin("has_chart", "has_table", "mixed"), label).otherwise("text_only")
    extra = F.when(known == "has_table", F.struct(F.lit("table").alias("type"), without_preamble(F.col("table")).alias("content"))).when(
        known.isin("has_chart", "mixed"), F.struct(F.lit("image").alias("type"), without_preamble(F.col("description")).alias("content"))
    )
    body = F.concat(F.lit("---\nPage "), F.col("page").cast("string"), F.lit("\n"), strip(F.coalesce("ocr", F.lit(""))))
    rows = pages.select("doc_id", F.struct("page", body.alias("body"), F.when(extra["content"] != "", extra).alias("extra")).alias("p"))
    held = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return held.select("doc_id", F.array_join("p.body", "\n\n").alias("text"), F.array_compact("p.extra").alias("visuals"))


def spread_captions(items: DataFrame) -> DataFrame:
    """Items (doc_id, position, type, content, section) in which every run of tables of one section carries the caption of the first that has one.

    A table's own caption goes for it: what stands before the mark stays, trimmed.
    """
    runs = islands(items, ["doc_id"], ["position"], F.struct(F.when(F.col("type") == "table", "").otherwise(F.col("position").cast("string")), "section"), "_run")
    content = F.col("content")
    mark = F.coalesce(F.nullif(F.instr(content, "\n\nCaption:"), F.lit(0)), F.nullif(F.instr(content, "Caption:"), F.lit(0)))
    own = F.when((F.col("type") == "table") & mark.isNotNull(), F.concat(F.lit("\n\n"), F.regexp_replace(F.substring(content, mark, F.length(content)), r"^\n\n", "")))
    w = W.partitionBy("doc_id", "_run").orderBy("position").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.first(own, ignorenulls=True).over(w)
    bare = F.when(mark.isNotNull(), strip(F.substring(content, F.lit(1), mark - 1))).otherwise(content)
    rows = runs.withColumn("_caption", first)
    return rows.withColumn("content", F.when((F.col("type") == "table") & F.col("_caption").isNotNull(), F.concat(bare, F.col("_caption"))).otherwise(content)).drop("_run", "_caption")


def text_chunks(docs: DataFrame, embed: Embed = hashed_embedding) -> DataFrame:
    """(doc_id, kind, chunk_index, chunk_total, content) of plain texts (doc_id, text).

    A narrative of up to NARRATIVE_MOST tokens is packed by sentences. Others go section
    by section: sentences are packed, and a chunk also ends at a valley of the curve of
    their neighbours' similarity. A section of one sentence stays as it is.
    """
    rows = docs.select("doc_id", strip(F.coalesce("text", F.lit(""))).alias("_t")).where("_t <> ''").withColumn("kind", structure(F.col("_t")))
    packed = (F.col("kind") == "narrative") & (tokens(F.col("_t")) <= NARRATIVE_MOST)
    parts = F.when(packed, F.array("_t")).otherwise(sections(F.col("_t"), F.col("kind")))
    rows = rows.select("doc_id", "kind", packed.alias("packed"), parts.alias("parts"))
    rows = rows.withColumn("s", F.transform("parts", structured_sentences))
    # a packed text has no use for a curve
    curves = with_valleys(rows.withColumn("_c", F.when(F.col("packed"), F.array().cast("array<array<string>>")).otherwise(F.col("s"))), "_c", "b", VALLEY_STD, embed)
    zipped = F.arrays_zip(F.col("parts").alias("p"), F.col("s").alias("s"), F.when(F.col("packed"), F.array(F.array().cast("array<boolean>"))).otherwise(F.col("b")).alias("b"))
    none = F.array().cast("array<boolean>")
    each = lambda x: F.when(F.size(x["s"]) < 2, F.array(x["p"])).otherwise(packing.sentence_groups(x["s"], F.coalesce(x["b"], none)))
    out = curves.select("doc_id", "kind", F.flatten(F.transform(zipped, each)).alias("p")).where(F.size("p") > 0)
    return out.select("doc_id", "kind", F.size("p").alias("chunk_total"), F.posexplode("p").alias("_i", "content")).select("doc_id", "kind", (F.col("_i") + 1).alias("chunk_index"), "chunk_total", "content")
