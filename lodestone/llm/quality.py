"""Operator 4: quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit for each rule that failed, and is written to the shared folder, so a
policy is a versioned mask over the stored bits and an ablation is a bitwise
aggregate over them, never a new scan of texts.

Defined results: a null text has no words; an empty or blank text fails the
length rule and no other; repeated rows each get their ledger row; a null
doc_id stays null; extra columns are ignored. Windows of five words are told
apart by a 64-bit hash within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import store

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: A line that opens with a bullet; one that ends in an ellipsis; a word with an ASCII letter or a character beyond ASCII,
#: from its start on. Each is counted by one pass over the text; lines end at \n only.
BULLET = r"(?dm)^[\x20\x09]*+(-|\*|\u2022|\u2023|\u25CF|\u25AA)"
ELLIPSIS = r"(?dm)(\.\.\.|\u2026)[\x20\x09\x0B-\x0D]*+$"
LETTER_WORD = r"(?<![^\x20\x09-\x0D])[\x00-\x08\x0E-\x1F\x21-\x40\x5B-\x60\x7B-\x7F]*+[^\x00-\x40\x5B-\x60\x7B-\x7F][^\x20\x09-\x0D]*+"
WINDOW = 5

#: Rule name -> failure, over the measurements. The order fixes each rule's bit.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "mean_word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
    "symbol_ratio": "10 * n_symbols > n_words AND n_symbols > 0",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "too_many_words": "n_words > 1000000",
    "bullet_lines": "100 * n_bullet_lines > 90 * n_lines",
    "ellipsis_lines": "100 * n_ellipsis_lines > 30 * n_lines",
    "few_letters": "100 * n_letter_words < 70 * n_words",
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_letter_words", "n_repeat_words")
#: Policy version -> the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("too_few_words", "repeated_windows"),
    "v2": ("too_few_words", "repeated_windows", "mean_word_length", "symbol_ratio", "duplicate_lines"),
    "v3": ("too_few_words", "repeated_windows", "mean_word_length", "symbol_ratio", "duplicate_lines", "bullet_lines", "ellipsis_lines", "few_letters"),
}
CURRENT = "v2"


def mask(rules: tuple[str, ...] | list[str]) -> int:
    """Bits of the named rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def _covered(positions: Column) -> Column:
    """Words covered by windows at ascending positions."""
    step = lambda a, p: F.struct(
        (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(positions, start, step, lambda a: a["n"])


def _measured(docs: DataFrame, id_column: str, text: str, kept: list[str]) -> DataFrame:
    """doc_id, the measurements, failed_bits, and _keep: a struct of the columns named in kept, under names of its own."""
    keep = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)], F.lit(0).alias("_"))
    df = docs.select(docs[f"`{id_column}`"].alias("doc_id"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("_t"), keep.alias("_keep"))
    trimmed = F.trim(F.col("_t"), F.lit(SPACE))
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("long")
    df = df.select(
        "doc_id",
        "_keep",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)).alias("_w"),
        F.filter(F.split(F.col("_t"), "\n"), lambda l: F.trim(l, F.lit(SPACE)) != "").alias("_l"),
        count(SYMBOLS).alias("n_symbols"),
        count(BULLET).alias("n_bullet_lines"),
        count(ELLIPSIS).alias("n_ellipsis_lines"),
        count(LETTER_WORD).alias("n_letter_words"),
    )
    w = F.col("_w")
    df = df.select(
        "doc_id",
        "_keep",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        "n_bullet_lines",
        "n_ellipsis_lines",
        "n_letter_words",
        F.when(
            F.size(w) > WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
        ).alias("_x"),
    )
    x = F.col("_x")
    df = df.withColumn("_z", F.when(F.size(F.array_distinct(x)) < F.size(x), F.sort_array(F.transform(x, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    z = F.col("_z")
    twice = F.filter(z, lambda s, k: (F.get(z, k - 1)["h"].eqNullSafe(s["h"])) | (F.get(z, k + 1)["h"].eqNullSafe(s["h"])))
    positions = F.sort_array(F.transform(twice, lambda s: s["i"]))
    df = df.withColumn("n_repeat_words", F.coalesce(F.when(z.isNotNull(), _covered(positions)), F.lit(0)).cast("long")).drop("_x", "_z")
    bits = F.lit(0)
    for i, failure in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(failure), F.lit(1 << i)).otherwise(F.lit(0)))
    return df.select("doc_id", *MEASURES, bits.cast("long").alias("failed_bits"), "_keep")


def ledger(docs: DataFrame, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the measurements, failed_bits, and the columns named in keep (as they were); one of the ledger's own names can't be kept."""
    own = {"doc_id", "failed_bits", *MEASURES}
    names = [c for c in keep if c != id_column]
    if clash := sorted(c for c in names if c.lower() in own):
        raise ValueError(f"the ledger has columns of its own named {clash}")
    return _measured(docs, id_column, text, names).select("doc_id", *MEASURES, "failed_bits", *[F.col("_keep")[f"c{i}"].alias(c) for i, c in enumerate(names)])


def passes(policy: str | int = CURRENT, bits: str = "failed_bits") -> Column:
    """Whether a ledger row passes a policy (its version, or a mask)."""
    m = policy if isinstance(policy, int) else mask(POLICIES[policy])
    return F.col(bits).bitwiseAND(F.lit(m)) == 0


def ablations(rows: DataFrame, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(policy, rule, rejected, only_by_rule, kept_without): effect of each rule of each policy.

    The ledger is first counted by its bit pattern, at most 2^rules rows, and all
    policies are read off these counts with bitwise operations.
    """
    patterns = rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    names = list(RULES)
    wanted = [(p, r, mask(rules), 1 << names.index(r)) for p, rules in (policies or POLICIES).items() for r in rules]
    arms = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("m"), F.lit(b).cast("long").alias("b")) for p, r, m, b in wanted])
    each = patterns.select("failed_bits", "n", F.explode(arms).alias("a")).select("failed_bits", "n", "a.*")
    hit = F.col("failed_bits").bitwiseAND(F.col("m"))
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("b")) != 0, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(hit == F.col("b"), F.col("n")).otherwise(0)).alias("only_by_rule"),
        F.sum(F.when(hit.bitwiseAND(F.bitwise_not(F.col("b"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def stored(docs: DataFrame) -> DataFrame:
    """The ledger, written once below the shared folder and read back."""
    return store.settled(ledger(docs), "quality-ledger")


def verdicts(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """What the stored ledger says of each document.

    base_failed: a base rule failed; kept: false if base_failed, else the policy's verdict;
    kept_v3: the same under v3; saved_by: the bits of the rule without which the policy
    would keep the document, 0 where there is none; saved_with: how many documents it would
    keep without that rule, from the ablation of the policy over the ledger's bit patterns.
    """
    rows = stored(docs)
    base = F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES["v1"]))) != 0
    hit = F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[policy])))
    alone = F.when((hit != 0) & (hit.bitwiseAND(hit - 1) == 0), hit).otherwise(F.lit(0)).cast("long")
    # a row for each rule at most
    effect = ablations(rows, {policy: POLICIES[policy]}).select(rule_bit("rule").alias("_bit"), F.col("only_by_rule").alias("saved_with"))
    each = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & passes(policy)).alias("kept"), (~base & passes("v3")).alias("kept_v3"), "failed_bits", alone.alias("saved_by"),
    )
    return each.join(F.broadcast(effect), F.col("saved_by") == F.col("_bit"), "left").drop("_bit").withColumn("saved_with", F.coalesce("saved_with", F.lit(0).cast("long")))


def rule_bit(rule: str) -> Column:
    """Bit of the rule that a column names."""
    bits = [x for i, name in enumerate(RULES) for x in (F.lit(name), F.lit(1 << i).cast("long"))]
    return F.element_at(F.create_map(*bits), F.col(rule))


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that a policy keeps, with their own columns, whatever their names."""
    rows = _measured(docs, "doc_id", "text", docs.columns)
    # a term that counts as nondeterministic: else the optimiser pushes the filter down and writes
    # the measurements out again, many times over, within it
    good = rows.withColumn("failed_bits", F.col("failed_bits") + F.monotonically_increasing_id() * 0).where(passes(policy) & passes("v1"))
    return good.select(*[F.col("_keep")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def _failure_bits_sql() -> str:
    return " | ".join(f"(CASE WHEN {f} THEN {1 << i} ELSE 0 END)" for i, f in enumerate(RULES.values()))


_SQL_BULLET = "^[\\x20\\x09]*(-|\\*|\u2022|\u2023|\u25CF|\u25AA)"
_SQL_ELLIPSIS = "(\\.\\.\\.|\u2026)[\\x20\\x09-\\x0D]*$"

#: DuckDB's twin: chr() keeps control characters out of the pattern text.
ORACLE_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS gram
      FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(list_filter(l, lambda x: regexp_matches(x, '{_SQL_BULLET}')))::BIGINT AS n_bullet_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '{_SQL_ELLIPSIS}')))::BIGINT AS n_ellipsis_lines,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')))::BIGINT AS n_letter_words,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, ({_failure_bits_sql()})::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & {mask(POLICIES['v1'])}) <> 0 AS base_failed,
       (failed_bits & {mask(POLICIES['v1']) | mask(POLICIES[CURRENT])}) = 0 AS kept,
       (failed_bits & {mask(POLICIES['v1']) | mask(POLICIES['v3'])}) = 0 AS kept_v3, failed_bits,
       CASE WHEN bit_count(failed_bits & {mask(POLICIES[CURRENT])}) = 1 THEN failed_bits & {mask(POLICIES[CURRENT])} ELSE 0 END::BIGINT AS saved_by,
       CASE WHEN bit_count(failed_bits & {mask(POLICIES[CURRENT])}) = 1 THEN count(*) OVER (PARTITION BY bit_count(failed_bits & {mask(POLICIES[CURRENT])}) = 1, failed_bits & {mask(POLICIES[CURRENT])}) ELSE 0 END::BIGINT AS saved_with
FROM f"""
