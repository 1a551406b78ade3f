"""File sources: a folder to a table of files, and files to elements by type.

Binary formats that need a parser (PDF, DOCX, PPTX, images) go through an
injectable provider, bytes -> list of elements; text, mail, CSV and pages are
parsed here with the standard library.
"""

from __future__ import annotations

import codecs
import csv
import email
import email.policy
import io
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import LINE_BREAK, clean_mail, slug, strip, without_forward_header, without_reply
from lodestone.operators.chunks import ELEMENT, source_type
from lodestone.session import pinned

#: Fixed value: bytes by which a file's encoding is told.
SNIFFED = 50_000
#: Rows of a CSV that leave a parser at once.
_ROWS = 10_000


def scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, name, source_type, digest, modified, content) of every file below path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.coalesce(F.when(F.lower("path").endswith(".csv"), "csv"), source_type(F.col("path")), F.lit("unknown")).alias("source_type"), F.md5("content").alias("digest"), F.col("modificationTime").alias("modified"), "content")


def sniff(raw: bytes) -> str:
    """The encoding of a file by its first SNIFFED bytes: a mark, UTF-8, UTF-16 by its zeros, else one byte a character."""
    head = raw[:SNIFFED]
    if head.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    if head[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
        return "utf-16"
    pairs = head[: len(head) // 2 * 2]
    if pairs and pairs[1::2].count(0) > 0.4 * len(pairs) / 2 > pairs[::2].count(0):
        return "utf-16-le"
    if pairs and pairs[::2].count(0) > 0.4 * len(pairs) / 2 > pairs[1::2].count(0):
        return "utf-16-be"
    try:
        # a character may be cut at the end of what is read
        codecs.getincrementaldecoder("utf-8")().decode(head, len(raw) <= SNIFFED)
        return "utf-8"
    except UnicodeDecodeError:
        pass
    try:
        head.decode("cp1252")
        return "cp1252"
    except UnicodeDecodeError:
        return "latin-1"


def decode(raw: bytes) -> tuple[str, str]:
    """(text, encoding); what the encoding found can't read is replaced."""
    name = sniff(raw)
    return raw.decode(name, "replace"), name


def texts(files: DataFrame) -> DataFrame:
    """(path, name, text, encoding, word_count, line_count) of text files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [decode(bytes(x)) for x in part["content"]]
            yield pd.DataFrame({"path": part["path"], "name": part["name"], "text": [t for t, _ in found], "encoding": [e for _, e in found]})

    rows = files.select("path", "name", "content").mapInPandas(run, "path string, name string, text string, encoding string")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return rows.withColumn("word_count", words).withColumn("line_count", F.size(F.split("text", LINE_BREAK)))


class _Body(HTMLParser):
    """Text and data tables of a page or mail; quoted and hidden parts are left out."""

    _SKIP = {"script", "style", "head", "blockquote", "template"}
    _VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
    #: What marks quoted parts and trackers: attribute, tag (any where it is empty), pattern.
    _QUOTE = (
        ("class", "div", re.compile(r"gmail_attr")),
        ("class", "", re.compile(r"moz-cite-prefix")),
        ("class", "div", re.compile(r"OutlookMessageHeader", re.I)),
        ("id", "", re.compile(r"divRplyFwdMsg|OLK_SRC_BODY_SECTION", re.I)),
        ("id", "", re.compile(r"mt-signature", re.I)),
    )

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip: list[str] = []
        self.out: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None
        self.open = 0

    def handle_starttag(self, tag, attrs):
        quoted = any(k == attr and (not of or tag == of) and mark.search(v or "") for k, v in attrs for attr, of, mark in self._QUOTE)
        if self.skip or tag in self._SKIP or quoted:
            if tag not in self._VOID:
                self.skip.append(tag)
            return
        if tag == "table":
            self.open += 1
            if self.open == 1:
                self.tables.append([])
        elif tag == "tr" and self.open:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []
        elif tag in ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip and self.skip.pop() != tag:
                    pass
            return
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.open:
            self.open -= 1
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n")

    def handle_data(self, data):
        if self.skip:
            return
        (self.out if self.cell is None else self.cell).append(data)

    def text(self) -> str:
        lines = (" ".join(x.split()) for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


def page_parts(html: str | None) -> tuple[str, list[str]]:
    """(text, data tables as pipe rows) of a page; a data table has two rows and two columns at least."""
    body = _Body()
    body.feed(html or "")
    body.close()
    tables = [t for t in ([r for r in t if r] for t in body.tables) if len(t) >= 2 and max(map(len, t)) >= 2]
    return body.text(), [table_text(t[0], t[1:]) for t in tables]


def table_text(headers: list[str], rows: list[list[str]]) -> str:
    """Pipe rows with a rule after the header."""
    lines = ([" | ".join(headers), " | ".join(["---"] * len(headers))] if headers else []) + [" | ".join(map(str, r)) for r in rows]
    return "\n".join(lines)


def pages(rows: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text, tables array<string>) of pages."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [page_parts(x) for x in part["html"]]
            yield pd.DataFrame({"k": part["k"], "text": [t for t, _ in found], "tables": [x for _, x in found]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(html).alias("html")).mapInPandas(run, f"k {kind}, text string, tables array<string>").withColumnRenamed("k", key)


def _mail(raw: bytes) -> dict:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    plain = html = None
    attached = []
    for part in m.walk():
        if part.is_multipart():
            continue
        name = part.get_filename()
        if name or part.get_content_disposition() == "attachment":
            attached.append({"name": name or "attachment", "content_type": part.get_content_type(), "content": part.get_payload(decode=True) or b""})
            continue
        body = part.get_content() if part.get_content_maintype() == "text" else ""
        if part.get_content_type() == "text/plain" and plain is None and body.strip():
            plain = body
        if part.get_content_type() == "text/html" and html is None and body.strip():
            html = body
    text, tables = page_parts(html) if html else (plain or "", [])
    return {"subject": m["subject"], "from": m["from"], "to": m["to"], "date": m["date"], "text": text, "tables": tables, "attachments": attached}


def mails(files: DataFrame) -> DataFrame:
    """(path, name, subject, from, to, date, text, tables, attachments) of mail files; HTML bodies are preferred, forwards and replies cut."""
    schema = "path string, name string, subject string, `from` string, `to` string, date string, text string, tables array<string>, attachments array<struct<name:string,content_type:string,content:binary>>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [_mail(bytes(x)) for x in part["content"]]
            out = pd.DataFrame({"path": part["path"].to_numpy(), "name": part["name"].to_numpy()})
            for c in ("subject", "from", "to", "date", "text", "tables", "attachments"):
                out[c] = [r[c] for r in rows]
            yield out

    rows = files.select("path", "name", "content").mapInPandas(run, schema)
    return rows.withColumn("text", clean_mail(without_reply(without_forward_header(F.col("text")))))


def markdown_elements(lines: DataFrame, by: list[str], order: list[str], line: str = "line") -> DataFrame:
    """(*by, element, section, type, content) of marked-up lines; by names a page.

    A line of # opens a section, "Unknown" before the first. A line that begins with a bar is a
    table's first where the line below it holds a rule (---); the table goes on while lines begin
    with a bar. All else is text: unbroken by tables and headings, blank lines or not, one element.
    """
    from lodestone.operators.windows import carried, islands

    w = W.partitionBy(*by).orderBy(*order)
    text = strip(F.coalesce(line, F.lit("")))
    rows = lines.withColumn("_t", text).withColumn("_bar", F.col("_t").startswith("|"))
    rows = rows.withColumn("_head", F.when(F.col("_t").startswith("#"), strip(F.regexp_replace("_t", r"^#+", ""))))
    rows = rows.withColumn("_rule", F.coalesce(F.lead(line).over(w).contains("---"), F.lit(False)))
    rows = islands(rows, by, order, F.col("_bar"), "_run")
    begun = F.max(F.col("_bar") & F.col("_rule")).over(W.partitionBy(*by, "_run").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("type", F.when(begun, "table").otherwise("text")).withColumn("_heads", F.count("_head").over(w))
    rows = carried(rows, by, order, F.col("_head"), "section").withColumn("section", F.coalesce("section", F.lit("Unknown")))
    rows = rows.where(F.col("_head").isNull() & (F.col("_t") != ""))
    rows = islands(rows, by, order, F.struct("_heads", "type", F.when(F.col("type") == "table", F.col("_run"))), "element")
    body = F.sort_array(F.collect_list(F.struct(*order, F.col("_t"))))["_t"]
    kept = rows.groupBy(*by, "element", "section", "type").agg(body.alias("_l"))
    joined = F.when(F.col("type") == "table", F.array_join("_l", "\n")).otherwise(F.array_join("_l", " "))
    return kept.withColumn("content", joined).drop("_l")


def elements(files: DataFrame, providers: dict[str, Callable[[bytes], list[dict]]] | None = None) -> DataFrame:
    """Elements of files, by source type: text and mail here, other types by their provider; a type without one gives an error row."""
    providers = providers or {}

    def parse(kind: str, name: str, raw: bytes) -> list[dict]:
        if kind in providers:
            return providers[kind](raw)
        if kind == "txt":
            return [{"type": "text", "content": decode(raw)[0], "metadata": {"file_name": name}}]
        if kind == "eml":
            m = _mail(raw)
            meta = {k: m[k] for k in ("subject", "from", "date") if m[k]} | {"source": name}
            return [{"type": "text", "content": m["text"], "metadata": meta}] + [{"type": "table", "content": t, "metadata": meta} for t in m["tables"]]
        return [{"type": "error", "content": f"no provider for {kind}", "metadata": {"source": name}}]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, name, kind, raw in zip(part["path"], part["name"], part["source_type"], part["content"]):
                for i, e in enumerate(parse(kind, name, bytes(raw))):
                    meta = {"source": name} | {k: str(v) for k, v in e.get("metadata", {}).items() if v is not None}
                    rows.append((path, kind, i, e.get("type", "text"), e.get("content", ""), meta))
            yield pd.DataFrame(rows, columns=["doc_id", "source_type", "position", "type", "content", "metadata"])

    return files.select("path", "name", "source_type", "content").mapInPandas(run, ELEMENT)


def header_names(names: list[str]) -> list[str]:
    """CSV headers without a byte-order mark, trimmed, spaces as underscores, repeats numbered."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        clean = "_".join(name.replace("﻿", "").strip().split()) or "column"
        seen[clean] = seen.get(clean, 0) + 1
        out.append(clean if seen[clean] == 1 else f"{clean}_{seen[clean]}")
    return out


def csv_table(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """A CSV with inferred types and clean headers."""
    df = spark.read.option("header", "true").option("inferSchema", "true").option("encoding", encoding).option("multiLine", "true").option("escape", '"').option("sep", sep).csv(path)
    return df.toDF(*header_names(df.columns))


def column_names(names: list[str]) -> list[str]:
    """Columns of an imported table: lower case, letters and digits only, repeats numbered, "column" where nothing is left."""
    return header_names([re.sub(r"[^a-z0-9]+", "", n.lower()) for n in names])


def csv_rows(files: DataFrame) -> DataFrame:
    """(table_name, digest, row, names, cells) of CSV files (name, digest, content): one row a line, whatever the files' encodings and columns.

    names and cells are arrays of one length; a short line's last cells are null, and what a long one
    has beyond its header goes. An empty cell is null. A file is read by one task, and leaves it in runs of lines.
    """
    schema = "name string, digest string, row long, names array<string>, cells array<string>"
    columns = ["name", "digest", "row", "names", "cells"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, digest, raw in zip(part["name"], part["digest"], part["content"]):
                lines = csv.reader(io.StringIO(decode(bytes(raw))[0], newline=""))
                header = next(lines, None)
                if header is None:
                    continue
                names, held = column_names(header), []
                for n, line in enumerate(x for x in lines if x):
                    cells = [c if c != "" else None for c in line[: len(names)]]
                    held.append((name, digest, n, names, cells + [None] * (len(names) - len(cells))))
                    if len(held) == _ROWS:
                        yield pd.DataFrame(held, columns=columns)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=columns)

    rows = files.select("name", "digest", "content").mapInPandas(run, schema)
    return rows.select(table_name(F.col("name")).alias("table_name"), "digest", "row", "names", "cells")


def table_name(name: Column) -> Column:
    """The table that a CSV file becomes."""
    return slug(F.regexp_replace(name, r"(?i)\.csv$", ""))


def import_csv(spark: SparkSession, files: DataFrame, registry: DataFrame, force: bool = False) -> DataFrame:
    """Which CSV files are new, updated, or skipped, by digest: (table_name, path, digest, status)."""
    from lodestone.operators.dml import status

    rows = files.where(F.lower("path").endswith(".csv")).select(table_name(F.col("name")).alias("table_name"), "path", "digest")
    return status(rows, registry, "table_name", "digest", force)


def import_tables(spark: SparkSession, files: DataFrame, place: str, now: Column, force: bool = False) -> DataFrame:
    """Imports the new and changed CSV files of a scan into tables below ``place``, all in one job; (table_name, path, digest, status) of each file.

    Rows lie in ``rows`` below it, a partition a table, so a changed file replaces its own table by
    dynamic overwrite and the others stay; ``registry`` has a partition a table too, and follows once the
    rows are written: a run that dies in between imports its files again.
    """
    held = registered(spark, place)
    # as the registry was before the import
    found = pinned(import_csv(spark, files, held.select("table_name", "digest"), force))
    due = found.where("status <> 'skipped'")
    if not due.isEmpty():
        rows = csv_rows(files.join(due.select("path"), "path", "left_semi"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_name").parquet(f"{place}/rows")
        noted = due.select("path", "digest", now.alias("imported_at"), "table_name")
        noted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_name").parquet(f"{place}/registry")
    return found


def registered(spark: SparkSession, place: str) -> DataFrame:
    """(table_name, path, digest, imported_at) of imported tables, newest first."""
    schema = "path string, digest string, imported_at timestamp, table_name string"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/registry")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema).select("table_name", "path", "digest", "imported_at")
    return spark.read.schema(schema).parquet(f"{place}/registry").select("table_name", "path", "digest", "imported_at").orderBy(F.desc("imported_at"), "table_name")


def typed(rows: DataFrame) -> DataFrame:
    """One table's rows (row, names, cells) as columns: whole numbers, numbers, or texts, by what all cells of a column are."""
    first = rows.select("names").limit(1).collect()
    if not first:
        return rows.select("row")
    names = first[0]["names"]
    cell = lambda i: F.get("cells", F.lit(i))
    fits = lambda kind: [F.bool_and(cell(i).isNull() | cell(i).try_cast(kind).isNotNull()).alias(f"{kind}{i}") for i in range(len(names))]
    kinds = rows.agg(*fits("bigint"), *fits("double")).collect()[0]
    pick = lambda i: "bigint" if kinds[f"bigint{i}"] else "double" if kinds[f"double{i}"] else "string"
    return rows.select("row", *[cell(i).try_cast(pick(i)).alias(n) for i, n in enumerate(names)])


def load_table(spark: SparkSession, place: str, name: str) -> DataFrame:
    """An imported table as the registry has it, typed, in the order of its file by ``row``."""
    held = spark.read.schema("digest string, row long, names array<string>, cells array<string>, table_name string").parquet(f"{place}/rows")
    known = registered(spark, place).where(F.col("table_name") == name).select("digest")
    return typed(held.where(F.col("table_name") == name).join(known, "digest", "left_semi"))
