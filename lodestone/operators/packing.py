"""Greedy packers whose state depends on what they have emitted, as folds over one document's array.

A document is one row with an array of its parts; the fold runs within the row,
so nothing is shuffled and documents are packed side by side.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import CHUNK_RATIO, strip, tokens

#: Most and least tokens of a chunk, most of a table batch, and the prompt's budget.
MOST, LEAST, TABLE_MOST, BUDGET = 450, 80, 400, 8000
_STRINGS = "array<string>"


def _empty() -> Column:
    return F.array().cast(_STRINGS)


def _joined(a: Column, b: Column, by: str = " ") -> Column:
    return F.when(a == "", b).otherwise(F.concat(a, F.lit(by), b))


def _with_tail(out: Column, cur: Column, least: int) -> Column:
    """out with the open chunk: joined to the last one if it is short."""
    short = (F.size(out) > 0) & (tokens(cur) < least)
    merged = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.concat(F.get(out, F.size(out) - 1), F.lit(" "), cur)))
    return F.when(cur == "", out).when(short, merged).otherwise(F.array_append(out, cur))


def sentence_groups(parts: Column, boundaries: Column | None = None, most: int = MOST, least: int = LEAST) -> Column:
    """Chunks of sentences: closed when the next would pass ``most`` and ``least`` are held, or at a boundary once ``least`` are held.

    parts is array<string>; boundaries, array<boolean>, marks sentences that may begin a chunk.
    """
    marks = boundaries if boundaries is not None else F.transform(parts, lambda _: F.lit(False))
    rows = F.arrays_zip(parts.alias("s"), marks.alias("b"))
    start = F.struct(_empty().alias("out"), F.lit("").alias("cur"), F.lit(0).cast("long").alias("tok"))

    def step(a, x):
        n = tokens(x["s"])
        close = ((a["tok"] + n > most) & (a["tok"] >= least)) | (F.coalesce(x["b"], F.lit(False)) & (a["tok"] >= least))
        return F.struct(
            F.when(close, F.array_append(a["out"], a["cur"])).otherwise(a["out"]).alias("out"),
            F.when(close, x["s"]).otherwise(_joined(a["cur"], x["s"])).alias("cur"),
            F.when(close, n).otherwise(a["tok"] + n).alias("tok"),
        )

    return F.aggregate(rows, start, step, lambda a: _with_tail(a["out"], a["cur"], least))


def paragraphs(text: Column, most: int = MOST, least: int = LEAST) -> Column:
    """Chunks of whole paragraphs: a paragraph joins while the chunk stays within ``most``; a short tail joins the last."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")
    start = F.struct(_empty().alias("out"), F.lit("").alias("cur"))

    def step(a, p):
        both = _joined(a["cur"], p)
        fits = (a["cur"] == "") | (tokens(both) <= most)
        return F.struct(
            F.when(fits, a["out"]).otherwise(F.array_append(a["out"], a["cur"])).alias("out"),
            F.when(fits, both).otherwise(p).alias("cur"),
        )

    return F.aggregate(parts, start, step, lambda a: _with_tail(a["out"], a["cur"], least))


def _row_batches(head: str, rows: list[str], most: int) -> list[str]:
    """Rows in batches below the head: a batch ends before the row that would take it past ``most`` tokens."""
    out, cur, size = [], [], 0
    for r in rows:
        # code points of the batch with this row and the line breaks
        grown = size + len(r) + (1 if cur or head else 0)
        if cur and max(1, math.floor((len(head) + grown) / CHUNK_RATIO)) > most:
            out.append("\n".join([head, *cur] if head else cur))
            cur, grown = [], len(r) + (1 if head else 0)
        cur.append(r)
        size = grown
    return [*out, "\n".join([head, *cur] if head else cur)] if cur else out


def _in_batches(table: Column, head: Column, rows: Column, whole: int, most: int) -> Column:
    """The table in one chunk up to ``whole`` tokens, else its rows in batches below the head.

    Batches are made in Arrow batches: a fold copies what it holds at every item,
    which for a long table is the square of its text.
    """
    long = tokens(table) > whole

    @F.arrow_udf(_STRINGS)
    def packed(heads: pa.Array, bodies: pa.Array) -> pa.Array:
        pairs = zip(heads.to_pylist(), bodies.to_pylist())
        return pa.array([_row_batches(h or "", r, most) if r else None for h, r in pairs], pa.list_(pa.string()))

    return F.coalesce(packed(F.when(long, head), F.when(long, rows)), F.array(table))


def row_batches(head: Column, rows: Column, whole: int = MOST, most: int = TABLE_MOST) -> Column:
    """A table given as its head and its rows, array<string> without nulls: a row stays whole, line breaks in it included."""
    return _in_batches(F.concat(head, F.lit("\n"), F.array_join(rows, "\n")), head, rows, whole, most)


def table_batches(table: Column, whole: int = MOST, most: int = TABLE_MOST) -> Column:
    """A table in one chunk, or its rows in batches that each repeat the header.

    The header ends with the first line of nothing but bars, dashes, colons and
    spaces; a table without one stays whole.
    """
    lines = F.split(strip(table), "\n")
    rule = F.array_position(F.transform(lines, lambda l: F.translate(l, "|-: ", "") == ""), True).cast("int")
    header = F.slice(lines, 1, rule)
    below = F.when(rule > 0, F.slice(lines, rule + 1, F.greatest(F.size(lines) - rule, F.lit(0)))).otherwise(_empty())
    rows = F.filter(below, lambda l: strip(l) != "")
    return _in_batches(table, F.array_join(header, "\n"), rows, whole, most)


def merge_short(parts: Column, most: int = MOST, least: int = LEAST) -> Column:
    """Neighbours joined from the left while either is short and both together are within ``most``."""

    def step(a, s):
        last = F.get(a, F.size(a) - 1)
        both = F.concat(last, F.lit(" "), s)
        join = (F.size(a) > 0) & ((tokens(last) < least) | (tokens(s) < least)) & (tokens(both) <= most)
        return F.when(join, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(both))).otherwise(F.array_append(a, s))

    return F.aggregate(parts, _empty(), step)


def merge_tiny(chunks: Column, least: int = LEAST) -> Column:
    """Text chunks below ``least`` tokens join the next text chunk, else the text chunk before, else stay.

    chunks is array<struct<type, content>>; the next chunk may be short again and pass on what it got.
    """
    start = F.struct(F.array().cast("array<struct<type:string,content:string>>").alias("out"), F.lit("").alias("held"))
    size = F.size(chunks)
    indexed = F.transform(chunks, lambda c, i: F.struct(c["type"].alias("type"), c["content"].alias("content"), F.get(chunks, i + 1)["type"].alias("next"), (i + 1 < size).alias("more")))

    def step(a, c):
        text = c["type"] == "text"
        content = F.when(text, _joined(a["held"], c["content"])).otherwise(c["content"])
        short = text & (tokens(content) < least)
        onward = short & c["more"] & (F.coalesce(c["next"], F.lit("")) == "text")
        out = a["out"]
        last = F.get(out, F.size(out) - 1)
        back = short & ~onward & (F.size(out) > 0) & (F.coalesce(last["type"], F.lit("")) == "text")
        joined_back = F.concat(
            F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))),
            F.array(F.struct(last["type"].alias("type"), F.concat(last["content"], F.lit(" "), content).alias("content"))),
        )
        item = F.struct(c["type"].alias("type"), content.alias("content"))
        return F.struct(
            F.when(onward, out).when(back, joined_back).otherwise(F.array_append(out, item)).alias("out"),
            F.when(onward, content).otherwise(F.lit("")).alias("held"),
        )

    return F.aggregate(indexed, start, step, lambda a: a["out"])


def within_budget(sizes: Column, budget: int = BUDGET) -> Column:
    """Positions from 0 of the items taken in order: one that doesn't fit is skipped; if none fits, the first."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"), F.lit(0).alias("i"))

    def step(a, n):
        fits = a["used"] + n <= budget
        return F.struct(
            F.when(fits, a["used"] + n).otherwise(a["used"]).alias("used"),
            F.when(fits, F.array_append(a["taken"], a["i"])).otherwise(a["taken"]).alias("taken"),
            (a["i"] + 1).alias("i"),
        )

    first = F.when(F.size(sizes) > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(sizes, start, step, lambda a: F.when(F.size(a["taken"]) > 0, a["taken"]).otherwise(first))


def prompt_tokens(stored: Column, content: Column, ratio: float = 3.8) -> Column:
    """The stored estimate if there is one, else that of the content."""
    return F.coalesce(F.nullif(stored.cast("long"), F.lit(0).cast("long")), tokens(content, ratio))


def bare(part: Column) -> Column:
    """Whether a part holds nothing but rules, page numbers and digits."""
    left = strip(part)
    for pattern in (r"[-_=]{2,}", r"(?i)\bPage\s+\d+\b", r"(?i)\bP\.\s*\d+\b", r"\d+"):
        left = F.regexp_replace(left, pattern, "")
    return strip(left) == ""


def merge_artifacts(parts: Column) -> Column:
    """Page artifacts (rules, page numbers, digits) joined to the part before, or to the next one where they come first."""
    start = F.struct(_empty().alias("out"), F.lit("").alias("held"))

    def step(a, p):
        first = F.size(a["out"]) == 0
        last = F.get(a["out"], F.size(a["out"]) - 1)
        grown = F.concat(F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(_joined(last, p, "\n")))
        return F.struct(
            F.when(bare(p) & first, a["out"]).when(bare(p), grown).otherwise(F.array_append(a["out"], _joined(a["held"], p, "\n"))).alias("out"),
            F.when(bare(p) & first, _joined(a["held"], p, "\n")).when(bare(p), a["held"]).otherwise(F.lit("")).alias("held"),
        )

    return F.aggregate(parts, start, step, lambda a: F.when(a["held"] != "", F.array_append(a["out"], a["held"])).otherwise(a["out"]))


