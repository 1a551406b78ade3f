"""Conversation memory: history windows, compression sets, facts, tiers, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.classify import expiry, tier
from lodestone.functions.text import strip, title_of
from lodestone.operators import dml
from lodestone.operators.windows import last_n

#: Turns that set off compression, turns kept, facts kept a user, longest fact, history excerpt.
COMPRESS_ABOVE, KEEP, FACTS, FACT_CHARS, EXCERPT = 6, 3, 15, 200, 300
#: Fixed value: most words of a summary.
SUMMARY_WORDS = 500
#: Fixed value: a question of fewer words needs no memory but the last turns.
LAYER_WORDS = 4
ROLES = ("user", "assistant")


def history(turns: DataFrame, n: int, session: str = "session_id", order: str = "turn") -> DataFrame:
    """The last n turns of each session."""
    return last_n(turns, [session], [F.desc(order)], n)


def history_text(turns: DataFrame, n: int, session: str = "session_id", order: str = "turn", excerpt: int = EXCERPT) -> DataFrame:
    """(session, history): the last n turns as ROLE: content lines, oldest first, each cut at ``excerpt`` characters."""
    rows = history(turns, n, session, order)
    line = F.concat(F.upper("role"), F.lit(": "), F.substring("content", 1, excerpt))
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return rows.groupBy(session).agg(F.array_join(ordered["l"], "\n").alias("history"))


def to_compress(turns: DataFrame, session: str = "session_id", order: str = "turn", above: int = COMPRESS_ABOVE, keep: int = KEEP) -> DataFrame:
    """All but the last ``keep`` turns of sessions with more than ``above``."""
    newest = W.partitionBy(session).orderBy(F.desc(order))
    rows = turns.withColumn("_n", F.row_number().over(newest)).withColumn("_all", F.count(F.lit(1)).over(W.partitionBy(session)))
    return rows.where((F.col("_all") > above) & (F.col("_n") > keep)).drop("_n", "_all")


def store_facts(facts: DataFrame, new: DataFrame, most: int = FACTS) -> DataFrame:
    """facts with the new ones (user_id, fact, created_at, id): trimmed, not blank or longer than FACT_CHARS, once each; the newest ``most`` a user."""
    fact = strip(F.col("fact"))
    clean = new.withColumn("fact", fact).where((F.length("fact") > 0) & (F.length("fact") <= FACT_CHARS))
    return newest_facts(dml.insert_absent(facts, clean, ["user_id", "fact"], [F.asc("created_at"), F.asc("id")]), most)


def newest_facts(facts: DataFrame, most: int = FACTS) -> DataFrame:
    return last_n(facts, ["user_id"], [F.desc("created_at"), F.desc("id")], most)


def with_tiers(turns: DataFrame, content: str = "content", created: str = "created_at") -> DataFrame:
    """tier and expires_at of each turn."""
    return turns.withColumn("tier", tier(F.col(content))).withColumn("expires_at", expiry(F.col("tier"), F.col(created)))


def active(turns: DataFrame, now: Column) -> DataFrame:
    return turns.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def expired(turns: DataFrame, now: Column) -> DataFrame:
    return turns.where(F.col("expires_at") <= now)


def sessions(turns: DataFrame, known: DataFrame | None = None, n: int = 50, session: str = "session_id", order: str = "turn") -> DataFrame:
    """Sessions with their number of turns, newest first, n at most; known sessions without turns have none."""
    counts = turns.groupBy(session).agg(F.count(F.lit(1)).alias("turns"), F.max(order).alias("last_active"))
    if known is not None:
        counts = known.where("is_active").select(session).join(counts, session, "left").withColumn("turns", F.coalesce("turns", F.lit(0)))
    return counts.orderBy(F.desc_nulls_last("last_active"), F.asc(session)).limit(n)


def bad_roles(turns: DataFrame) -> DataFrame:
    """Turns whose role a conversation table doesn't take."""
    return turns.where(~F.col("role").isin(*ROLES) | F.col("role").isNull())


def context(summary: Column, facts: Column, recent: Column) -> Column:
    """Memory sections with their headings; absent ones are left out."""
    section = lambda head, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(head + "\n"), body))
    return F.concat_ws("\n\n", section("## Conversation summary", summary), section("## Known facts about the user", facts), section("## Recent conversation", recent))


def layers(chosen: Column, question: Column, has_summary: Column, has_facts: Column) -> Column:
    """Which of summary and facts a question needs, by a model's JSON list with or without a fence.

    None where there is neither, or for a question of under LAYER_WORDS words. An answer that is
    no JSON: all that there are; JSON but no list: both names. What there isn't goes from a list.
    """
    has = {"summary": has_summary, "facts": has_facts}
    words = F.size(F.filter(F.split(F.coalesce(question, F.lit("")), r"\s+"), lambda w: w != ""))
    plain = strip(F.coalesce(chosen, F.lit("")))
    fenced = F.regexp_replace(F.get(F.split(plain, "```"), F.lit(1)), "^json", "")
    plain = strip(F.when(plain.startswith("```"), fenced).otherwise(plain))
    listed = F.from_json(F.when(plain.startswith("["), plain), "array<string>")
    there = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in has.items()]))
    known = F.filter(listed, lambda x: (x != "summary") | has_summary)
    known = F.filter(known, lambda x: (x != "facts") | has_facts)
    both = F.array(F.lit("summary"), F.lit("facts"))
    none = F.array().cast("array<string>")
    # a value of JSON other than a list: an object, a text, a number, a word of its own
    other = plain.rlike(r'^(\{.*\}|"[^"]*"|-?\d+(\.\d+)?|true|false|null)$')
    return F.when(~(has_summary | has_facts) | (words < LAYER_WORDS), none).when(listed.isNotNull(), known).when(other, both).otherwise(there)


def excerpted(existing: Column, conversation: Column) -> Column:
    """A stand-in summary: what there is, and the start of each line since."""
    lines = F.transform(F.split(conversation, "\n"), lambda l: F.substring_index(l, " ", 8))
    return F.concat_ws("\n", F.nullif(existing, F.lit("")), F.array_join(lines, "\n"))


def condensed(summary: Column, most: int = SUMMARY_WORDS) -> Column:
    """A stand-in condenser: the last ``most`` words."""
    words = F.split(strip(summary), r"\s+")
    return F.array_join(F.slice(words, F.greatest(F.size(words) - most + 1, F.lit(1)), F.lit(most)), " ")


def compressed(turns: DataFrame, summaries: DataFrame, summarise=excerpted, condense=condensed, session: str = "session_id", order: str = "turn") -> tuple[DataFrame, DataFrame]:
    """(turns that stay, summaries): sessions with too many turns give all but the last to their summary.

    A summary of more than SUMMARY_WORDS words is condensed; where the condenser gives
    nothing the long one stays. A session whose summary comes out empty keeps its turns.
    """
    old = to_compress(turns, session, order)
    line = F.concat(F.upper("role"), F.lit(": "), F.coalesce("content", F.lit("")))
    talk = old.groupBy(session).agg(F.array_join(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))["l"], "\n").alias("_talk"))
    made = talk.join(summaries, session, "left").withColumn("_new", summarise(F.coalesce("summary", F.lit("")), F.col("_talk")))
    made = made.where(strip(F.coalesce("_new", F.lit(""))) != "")
    long = F.size(F.split(strip(F.col("_new")), r"\s+")) > SUMMARY_WORDS
    new = made.select(session, F.coalesce(F.when(long, F.nullif(condense(F.col("_new")), F.lit(""))), F.col("_new")).alias("summary"))
    gone = old.join(new.select(session), session, "left_semi").select(session, order)
    return turns.join(gone, [session, order], "left_anti"), summaries.join(new, session, "left_anti").select(session, "summary").unionByName(new)


def saved(turns: DataFrame, summaries: DataFrame, facts: DataFrame, titles: DataFrame, new: DataFrame, extract: Column | None = None) -> dict[str, DataFrame]:
    """The memory after new turns (session_id, user_id, turn, role, content, created_at): turns, summaries, facts, titles.

    Facts come from user turns only: ``extract``, an array of texts, none where it isn't
    given. A session without a title gets one from its first user turn.
    """
    left, kept = compressed(turns.unionByName(new.select(*turns.columns)), summaries)
    said = new.where("role = 'user'")
    found = extract if extract is not None else F.array().cast("array<string>")
    learnt = said.select("user_id", F.explode(found).alias("fact"), "created_at", F.col("turn").cast("long").alias("id"))
    first = said.groupBy("session_id").agg(F.min_by("content", "turn").alias("content"))
    named = first.join(titles, "session_id", "left_anti").select("session_id", title_of(F.col("content")).alias("title"))
    return {"turns": left, "summaries": kept, "facts": store_facts(facts, learnt), "titles": titles.unionByName(named)}
