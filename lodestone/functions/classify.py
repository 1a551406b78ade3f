"""Pattern classifiers of questions and turns, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import strip

# -- fixed values ------------------------------------------------------------
CHITCHAT = (
    r"^\s*hi\s*[!.?]?\s*$",
    r"^\s*hello\s*[!.?]?\s*$",
    r"^\s*hey\s*[!.?]?\s*$",
    r"^\s*hola\s*[!.?]?\s*$",
    r"^\s*bonjour\s*[!.?]?\s*$",
    r"^\s*salut\s*[!.?]?\s*$",
    r"^\s*good\s+(morning|afternoon|evening|night)\s*[!.?]?\s*$",
    r"^\s*thanks?\s*[!.?]?\s*$",
    r"^\s*thank\s+you\s*[!.?]?\s*$",
    r"^\s*ok\s*[!.?]?\s*$",
    r"^\s*okay\s*[!.?]?\s*$",
    r"^\s*cool\s*[!.?]?\s*$",
    r"^\s*nice\s*[!.?]?\s*$",
    r"^\s*great\s*[!.?]?\s*$",
    r"^\s*bye\s*[!.?]?\s*$",
    r"^\s*goodbye\s*[!.?]?\s*$",
    r"^\s*see\s+you\s*[!.?]?\s*$",
)
FOLLOW_UP = (
    r"\b(summarize|summarise|summary)\b.*\b(that|it|this|previous)\b",
    r"\b(make|rewrite)\b.*(shorter|longer|simpler|formal|informal)",
    r"\btranslate\b.*\b(that|it|this|to|in|into)\b",
    r"\bin\s+(french|english|arabic|spanish|german|chinese|japanese|italian)\b",
    r"\b(explain|elaborate)\b.*\b(more|better|simpler|further)\b",
    r"^\s*(what\s+do\s+you\s+mean|what\s+did\s+you\s+mean)\b",
    r"\brephrase\b",
    r"\bbullet\s+points?\b",
    r"^\s*(continue|go on|keep going)\s*[!.?]?\s*$",
)
META = (
    r"^\s*(what|who)\s+(can|are|do)\s+you\b",
    r"\bwhat\s+(can|do)\s+you\s+(do|help)\b",
    r"\bhow\s+do\s+you\s+work\b",
    r"\bwhat\s+is\s+your\s+(name|purpose)\b",
)
FILLER = (
    r"^(yes|no|ok|okay|sure)\.?$",
    r"^(thanks|thank you|thx)[\s!.]*$",
    r"^(got it|i see|makes sense|understood)[\s.]*$",
    r"^(hi|hello|hey|good morning|good afternoon|good evening)[\s!.]*$",
    r"^(continue|go on|next|more)[\s.]*$",
    r"^(cool|great|nice|perfect|awesome)[\s!.]*$",
)
LASTING = (
    r"\b(i (always|usually|prefer|like|love|hate|never|tend to))\b",
    r"\b(my (background|experience|stack|setup|project|team|company))\b",
    r"\b(i am (a|an|the) \w+)\b",
    r"\b(i work (on|in|with|at|for))\b",
    r"\b(i use \w+)\b",
    r"\b(my preference|my goal|my constraint)\b",
    r"\b(i('m| am) (building|developing|working on|creating))\b",
)
VAGUE = (
    r"\b(it|its|they|them|their|theirs)\b",
    r"\b(this|that|these|those)\b",
    r"\bthe (first|second|third|previous|latter|former|same|other)\b",
    r"\b(which one|the one)\b",
    r"\b(above|mentioned|just said)\b",
    r"^(and|but|so|or|also)\s+\w+",
    r"^(what about|how about)\b",
)
PREAMBLES = ("rewritten question:", "question:", "answer:", "query:")
#: Minutes that a turn of a tier is kept; None: for good.
TIER_MINUTES = {"short": 30, "mid": 24 * 60, "long": None}
# ----------------------------------------------------------------------------


def matches(c: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern is found, in either case."""
    return reduce(lambda a, p: a | c.rlike("(?i)" + p), patterns, F.lit(False))


def route(question: Column) -> Column:
    """DIRECT for small talk, follow-ups, and questions about the assistant, and for three words or fewer; else RAG."""
    text = strip(F.coalesce(question, F.lit("")))
    short = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) <= 3
    return F.when(matches(text, CHITCHAT + FOLLOW_UP + META) | short, "DIRECT").otherwise("RAG")


def is_vague(question: Column) -> Column:
    return matches(F.lower(F.coalesce(question, F.lit(""))), VAGUE)


def tier(message: Column) -> Column:
    """short for fillers, long for statements about oneself, else mid."""
    text = strip(F.lower(F.coalesce(message, F.lit(""))))
    return F.when(matches(text, FILLER), "short").when(matches(text, LASTING), "long").otherwise("mid")


def expiry(tier_: Column, created: Column) -> Column:
    """When a turn of a tier expires; null: never."""
    minutes = F.when(tier_ == "short", TIER_MINUTES["short"]).when(tier_ == "mid", TIER_MINUTES["mid"])
    return created + F.make_dt_interval(mins=minutes)


def accepted_rewrite(rewrite: Column, question: Column) -> Column:
    """The rewritten question without its preamble, or the question where the rewrite is too short or too long."""
    text = rewrite
    for p in PREAMBLES:
        text = F.when(F.lower(text).startswith(p), strip(F.substring(text, F.lit(len(p) + 1), F.length(text)))).otherwise(text)
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    bad = rewrite.isNull() | (F.length(rewrite) < 3) | (words(text) > F.greatest(words(question) * 3, F.lit(25)))
    return F.when(bad, question).otherwise(text)
