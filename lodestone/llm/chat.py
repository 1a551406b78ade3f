"""Operator 5: chat formatting in Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of
one role are merged by an array fold, and the text is concatenated:

    <|turn|>role\\ntext<|next|>text<|end|><|turn|>...

``<|next|>`` stands between the texts of merged turns, so the rows can be read
back. Inside texts and roles one backslash is put behind the first character of
every control string (and of one that already has backslashes there), which is
undone by taking one away; so no text can forge a mark, and each comes back as
it was.

Defined results: null text or role: empty; null turn: sorted first; equal turns:
by role, then text; repeated rows: all kept; null conv_id: a conversation of its
own; an empty table gives no rows; extra columns are ignored. A conversation is
one row of output, so one task holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, NEXT, END = "<|turn|>", "<|next|>", "<|end|>"
#: Strings that have a meaning to this template or to common tokenizers.
CONTROL = r"\|[A-Za-z_]+\||/?s>|/?INST\]"
_ESCAPE = rf"([<\[])(\\*)({CONTROL})"
_UNESCAPE = rf"([<\[])\\(\\*)({CONTROL})"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _UNESCAPE, "$1$2$3")


def _role(c: Column) -> Column:
    """A role on one line."""
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(c: Column) -> Column:
    # a doubled backslash is parked as \0 while \n becomes a line feed
    held = F.replace(unescape(c), F.lit("\\\\"), F.lit("\\0"))
    return F.replace(F.replace(held, F.lit("\\n"), F.lit("\n")), F.lit("\\0"), F.lit("\\"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of rows (conv_id, turn, role, text).

    loss_spans are the code-point ranges [start, end) of assistant texts in formatted.
    """
    rows = turns.select(
        F.col("conv_id"),
        F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    t = F.col("t")
    marked = F.transform(
        t,
        lambda x, i: F.struct(
            x["role"].alias("role"),
            escape(x["text"]).alias("body"),
            # adjacent turns of one role are one block
            F.when((i > 0) & (F.get(t, i - 1)["role"] == x["role"]), F.lit(NEXT))
            .otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(TURN), _role(x["role"]), F.lit("\n")))
            .alias("lead"),
        ),
    )
    chats = chats.select("conv_id", marked.alias("m"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(a, x):
        begin = a["at"] + F.length(x["lead"])
        end = begin + F.length(x["body"])
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["role"] == "assistant", F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return chats.select(
        "conv_id",
        F.concat(F.array_join(F.transform("m", lambda x: F.concat(x["lead"], x["body"])), ""), F.lit(END)).alias("formatted"),
        F.aggregate("m", start, step, lambda a: a["spans"]).alias("loss_spans"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text): what the formatted text and its mask say, unescaped.

    turns is array<struct<role, text>>, one for each row that went in.
    """
    text = F.col("formatted")
    blocks = F.filter(F.split(text, r"<\|turn\|>"), lambda b, i: i > 0)
    parsed = F.transform(
        blocks,
        lambda b: F.struct(
            _role_back(F.substring_index(b, "\n", 1)).alias("role"),
            F.split(F.regexp_replace(F.regexp_replace(b, r"^[^\n]*\n", ""), r"<\|end\|>\z", ""), r"<\|next\|>").alias("texts"),
        ),
    )
    turns = F.flatten(F.transform(parsed, lambda p: F.transform(p["texts"], lambda x: F.struct(p["role"].alias("role"), unescape(x).alias("text")))))
    loss = F.transform("loss_spans", lambda s: unescape(text.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), text.alias("formatted"))


def digests(turns: DataFrame) -> DataFrame:
    """Formats, reads back, and digests each conversation."""
    back = read_chats(format_chats(turns))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns plus conversation -7, whose texts are control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    return turns.select("conv_id", "turn", "role", "text").unionByName(turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


ORACLE_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS n,
             regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z_]+\||/?s>|/?INST\])', '\1\\\2\3', 'g') AS body
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(length(body) + CASE WHEN before = role THEN 8 ELSE 9 + length(role) + 7 END))::BIGINT AS formatted_chars
FROM o GROUP BY conv_id"""
