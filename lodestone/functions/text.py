"""Text functions as Column expressions: cleaning, splitting, estimates, identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# -- fixed values ------------------------------------------------------------
#: Characters a token, for stored chunks and for prompts.
CHUNK_RATIO, PROMPT_RATIO = 3.5, 3.8
#: Left out of sparse vectors.
STOPWORDS = (
    "the", "a", "an", "is", "it", "in", "on", "at", "to",
    "of", "and", "or", "for", "with", "this", "that", "be",
    "are", "was", "were", "have", "has", "had", "not", "by",
)
#: Footers that end a mail body; the rest of the text goes with them.
MAIL_FOOTERS = (
    r"email tracked with \w+.*",
    r"\·\s*opt out.*",
    r"opt out\s*·?.*",
    r"unsubscribe.*",
    r"this email was sent to.*",
    r"you (are|were) receiving this (email|message) because.*",
    r"©\s*\d{4}.*",
    r"all rights reserved.*",
    r"\d{2}/\d{2}/\d{2,4}\s+\d{2}:\d{2}:\d{2}",
)
LONG_URL = r"https?://\S{60,}"
INLINE_IMAGE = r"\[image:[^\]]*\]"
FORWARD_LINE = r"-{3,}\s*(forwarded message|original message)\s*-{3,}[^\n]*"
#: Descriptions that say nothing.
EMPTY_DESCRIPTIONS = (
    "the image contains no charts",
    "the image contains no figures",
    "the image contains no diagrams",
    "no charts, figures, diagrams, or images",
)
#: Openings that an image description loses.
DESCRIPTION_OPENINGS = (
    r"^the image (shows?|presents?|depicts?|displays?|contains?|illustrates?)[,.]?\s*",
    r"^this image (shows?|presents?|depicts?|displays?|contains?|illustrates?)[,.]?\s*",
    r"^the (picture|photo|photograph|diagram|chart|figure|screenshot) (shows?|presents?|depicts?)[,.]?\s*",
    r"^in this image[,.]?\s*",
    r"^as (seen|shown) in the image[,.]?\s*",
)
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "etc", "e.g", "i.e")
#: Where a forwarded mail's header, and a quoted reply, begin.
FORWARD_MARKERS = (
    r"-+\s*Forwarded message\s*-+",
    r"Begin forwarded message:",
    r"^From:\s.+\r?\nSent:\s",
    r"^From:\s.+\r?\nDate:\s",
    r"^De:\s.+\r?\nEnvoyé:\s",
)
REPLY_MARKERS = (
    r"-+\s*Original Message\s*-+",
    r"-+\s*Message d'origine\s*-+",
    r"On\s.+\swrote:",
    r"Le\s.+\sa\sécrit\s*:",
)
#: What a model writes around its answer: step headings, and lines that only announce.
STEP_HEADINGS = (r"(?i)##\s*Step\s*\d+[:\-].*\n?", r"(?i)\*\*Step\s*\d+.*?\*\*\n?")
PREAMBLES = (
    r"^(Let me|I will|I'll|First,|Here is|Here are|The following|Below is|Below are|Sure,|Certainly,|Of course,).*\n?",
    r"^There (is|are) \w+ table[s]? in the image.*\n?",
    r"^There (is|are) \w+ chart[s]? in the image.*\n?",
    r"^I (can see|found|identified|detected|notice).*\n?",
)
#: Slide-number marks that a deck's template leaves in texts.
PLACEHOLDERS = ("‹#›", "<#>", "‹›", "#", "\u200b")
CAPTION_LABEL = r"(?i)^(Fig\.|Figure|Table)\s+\d+\.?\s*$"
ANY_CAPTION = r"(?i)^(Fig\.|Figure|Table|Tableau|FIGURE|TABLE)\s*[\dIVXLC]+[.:\s]"
SKIPPED_SECTIONS = ("references", "bibliography", "acknowledgments", "acknowledgements")
PREFIXES = {"table": "Table: ", "image": "Image description: "}
#: Namespace of identifiers, RFC 4122's for DNS names.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
LEAST_CHARS = 20
# ----------------------------------------------------------------------------

LINE_BREAK = r"\r\n|[\n\r\x{85}\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    """White space off both ends, as any script writes it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column, ratio: float = CHUNK_RATIO) -> Column:
    """Estimated tokens: code points over the ratio, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / F.lit(ratio))).cast("long")


def fixed(c: Column, places: int = 2) -> Column:
    """A double with grouped thousands and fixed places: the sign of values below zero only, nan and inf in words."""
    size = F.abs(c)
    digits = F.when(F.isnan(size), "nan").when(size == float("inf"), "inf").otherwise(F.format_number(size, places))
    return F.concat(F.when(c < 0, "-").otherwise(""), digits)


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def clean_text(c: Column) -> Column:
    """Tags, odd spaces, rules and control characters out; runs of spaces and lines closed up. Null: empty."""
    text = _chain(
        F.coalesce(c, F.lit("")),
        (r"<[^>]+>", " "),
        (r"\x{A0}", " "),
        (r"[\x{200B}\x{FFFD}]", ""),
        (r"-{3,}", ""),
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
        (r" {2,}", " "),
        (r"\n{3,}", "\n\n"),
    )
    return strip(F.array_join(F.transform(F.split(text, LINE_BREAK), strip), "\n"))


def clean_table(c: Column) -> Column:
    """Blank lines out, separator lines as they are, spaces closed up."""
    kept = F.filter(F.split(F.coalesce(c, F.lit("")), LINE_BREAK), lambda l: strip(l) != "")
    rule = lambda l: F.when(l.rlike(r"^[\|\s\-:]+$"), l).otherwise(strip(F.regexp_replace(l, " {2,}", " ")))
    return strip(F.array_join(F.transform(kept, rule), "\n"))


def clean_description(c: Column) -> Column:
    """An image description without its opening, emphasis, bullets, and quotes; empty where it says nothing."""
    text = F.coalesce(c, F.lit(""))
    empty = reduce(lambda a, p: a | F.lower(text).contains(p), EMPTY_DESCRIPTIONS, F.lit(False))
    out = _chain(text, *(("(?i)" + p, "") for p in DESCRIPTION_OPENINGS))
    out = _chain(out, (r"\*{1,2}([^*]+)\*{1,2}", "$1"), (r"\*+", ""), (r"[\\\"]", ""), (r"(?m)^\s*[\*\-]\s+", ""))
    out = F.array_join(F.filter(F.split(out, LINE_BREAK), lambda l: strip(l) != ""), "\n")
    return F.when(empty, F.lit("")).otherwise(clean_text(out))


def clean_mail(c: Column) -> Column:
    """A mail body without tracking links, images, footers, forward lines, and quoted lines."""
    text = _chain(F.coalesce(c, F.lit("")), (LONG_URL, ""), (INLINE_IMAGE, ""), *(("(?is)" + p, "") for p in MAIL_FOOTERS), ("(?i)" + FORWARD_LINE, ""))
    lines = F.filter(F.split(text, LINE_BREAK), lambda l: ~strip(l).startswith(">"))
    return clean_text(F.array_join(lines, "\n"))


def clean(kind: Column, content: Column) -> Column:
    """The cleaning of a chunk's type."""
    return F.when(kind == "table", clean_table(content)).when(kind == "image", clean_description(content)).otherwise(clean_text(content))


def keeps(kind: Column, content: Column) -> Column:
    """Whether a cleaned chunk is long enough to stay."""
    return F.when(kind == "table", strip(content) != "").otherwise(F.length(strip(content)) >= LEAST_CHARS)


def without_forward_header(c: Column) -> Column:
    """Drops the header block after the first forward marker; what stands before and after it stays."""
    text = F.coalesce(c, F.lit(""))
    for marker in FORWARD_MARKERS:
        text = F.regexp_replace(text, rf"(?im){marker}[^\n]*(\n[A-Za-zÀ-ÿ]+\s?:[^\n]*)*", "")
    return strip(text)


def without_reply(c: Column) -> Column:
    """The text before the earliest reply marker."""
    text = F.coalesce(c, F.lit(""))
    at = [F.nullif(F.regexp_instr(text, F.lit("(?i)" + m)), F.lit(0)) for m in REPLY_MARKERS]
    first = F.least(*at)
    return strip(F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1)))


def sentences(c: Column) -> Column:
    """Sentences of each paragraph: cut at white space after . ! ? or the Arabic question mark."""
    paragraphs = F.split(F.coalesce(c, F.lit("")), r"\n\s*\n")
    cut = F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"(?<=[.!?؟])\s+")))
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def structured_sentences(c: Column) -> Column:
    """Sentences that rules, blank lines, capital headings, bullets, and numbers also end; decimals and abbreviations don't."""
    brk, dot = "\u0001", "\u0002"
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    text = _chain(
        text,
        (r"_{3,}", brk),
        (r"\n{2,}", brk),
        (r"(?m)^([A-Z][A-Z\s\-]{3,})\s*$", f"{brk}$1{brk}"),
        (r"\n\*\s+", brk),
        (r"\n\d+\.\s+", brk),
        (r"\n\-\s+", brk),
        (r"(\d+)\.\s", f"$1{dot} "),
    )
    for short in ABBREVIATIONS:
        text = F.replace(text, F.lit(f"{short}."), F.lit(f"{short}{dot}"))
    cut = F.flatten(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda p: F.split(p, brk)))
    return F.filter(F.transform(cut, lambda s: strip(F.replace(s, F.lit(dot), F.lit(".")))), lambda s: s != "")


_BULLET = r"^\s*[\*\-•]\s+"
_HEADINGS = (r"^\s*#{1,6}\s+", r"^\d+[\)\.]\s+[A-Z]", r"^[A-Z][A-Z\s\-]{3,}$", r"^\s*_{3,}\s*$", r"^\s*={3,}\s*$", r"^\s*-{3,}\s*$")


def structure(c: Column) -> Column:
    """structured, mixed, or narrative, by the shares of bullet and heading lines."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    total = F.greatest(F.size(lines), F.lit(1))
    bullets = F.size(F.filter(lines, lambda l: l.rlike(_BULLET))) / total
    headings = F.size(F.filter(lines, lambda l: reduce(lambda a, p: a | l.rlike(p), _HEADINGS[1:], l.rlike(_HEADINGS[0])))) / total
    return (
        F.when((bullets > 0.2) | (headings > 0.05), "structured")
        .when((bullets > 0.05) | (headings > 0.02), "mixed")
        .otherwise("narrative")
    )


def sections(c: Column, kind: Column) -> Column:
    """Sections of a text of that structure."""
    parts = (
        F.when(kind == "structured", F.split(c, r"(?m)_{3,}|={3,}|^#{1,3}\s"))
        .when(kind == "mixed", F.split(c, r"\n{2,}(?=[A-Z\d#])"))
        .otherwise(F.array(c))
    )
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def embed_text(kind: Column, content: Column) -> Column:
    """What is embedded: tables and images say what they are."""
    return reduce(lambda w, p: w.when(kind == p[0], F.concat(F.lit(p[1]), content)), PREFIXES.items(), F.when(F.lit(False), content)).otherwise(content)


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """Version-5 UUID of a name: SHA-1 of namespace and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(h.substr(17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("5"), h.substr(14, 3)), F.concat(variant, h.substr(18, 3)), h.substr(21, 12))


def chunk_id(given: Column, source_type: Column, source: Column, content: Column) -> Column:
    """The given identifier, else one derived from where and what the chunk is."""
    name = F.concat_ws(":", source_type, source, F.substring(content, 1, 200))
    return F.coalesce(F.nullif(strip(given), F.lit("")), uuid5(name))


def slug(c: Column) -> Column:
    """A table name: lower case, other characters underscores, and a letter in front of a digit."""
    base = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9_]+", "_"), r"^_+|_+$", "")
    return F.when(base.rlike(r"^\d"), F.concat(F.lit("t_"), base)).otherwise(base)


def safe_text(c: Column) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def safe_int(c: Column) -> Column:
    """A whole number, or null."""
    text = c.cast("string")
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.expr("1").cast("int") * strip(text).try_cast("int"))


def base64url(c: Column) -> Column:
    """Bytes of base64url text, padded or not."""
    plain = F.translate(F.regexp_replace(c, "=+$", ""), "-_", "+/")
    return F.unbase64(F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)))))


def document_id(source: Column) -> Column:
    """The doc_ identifier that begins a stored file's name; null if there is none."""
    return F.nullif(F.regexp_extract(source, r"^(doc_[a-f0-9]+)_", 1), F.lit(""))


def title_of(question: Column) -> Column:
    """A fallback title: the first 50 characters."""
    text = F.regexp_replace(strip(question), r"^[\"']+|[\"']+$", "")
    return F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 50), F.lit("..."))).otherwise(text)


def caption_parts(c: Column) -> tuple[Column, Column]:
    """(caption, remainder): the caption ends with the first sentence after its label; a remainder of 20 characters or fewer goes."""
    pattern = r"(?is)^((?:Fig\.|Figure|Table|Tableau)\s*[\dIVXLC]+[.:\s].*?[.!?])\s+(.*)$"
    head = F.regexp_extract(c, pattern, 1)
    rest = strip(F.regexp_extract(c, pattern, 2))
    return F.when(head == "", strip(c)).otherwise(strip(head)), F.when(F.length(rest) > 20, rest)


def json_score(c: Column) -> Column:
    """The score in a model's answer: parsed as JSON without its fences, else the first number after 'score'."""
    plain = F.regexp_replace(c, r"```(?:json)?", "")
    parsed = F.get_json_object(plain, "$.score")
    found = F.nullif(F.regexp_extract(plain, r"(?i)score\W+(\d+(?:\.\d+)?)", 1), F.lit(""))
    return F.coalesce(parsed.try_cast("double"), found.try_cast("double"))


def fenced_code(c: Column) -> Column:
    """The code of the first fence, else the whole text."""
    code = F.regexp_extract(c, r"(?s)```(?:\w+)?\s*\n(.*?)```", 1)
    return strip(F.when(code == "", c).otherwise(code))


def without_preamble(c: Column) -> Column:
    """A model's answer without step headings and announcing lines."""
    text = _chain(F.coalesce(c, F.lit("")), *((p, "") for p in STEP_HEADINGS), *(("(?im)" + p, "") for p in PREAMBLES), (r"\n{3,}", "\n\n"))
    return strip(text)


def without_placeholders(c: Column) -> Column:
    """A slide's text without its template's marks."""
    text = reduce(lambda t, mark: F.replace(t, F.lit(mark), F.lit("")), PLACEHOLDERS, F.coalesce(c, F.lit("")))
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def clean_nested(c: Column, kind: T.DataType) -> Column:
    """Every text within a nested value cleaned by what stands beside it; metadata stays as it is.

    A struct with type and content is cleaned by its type, and a text too short to keep
    becomes empty; content and text without a type are plain texts; headers and rows of
    a table are cleaned cell by cell; other fields are walked into. Empty texts, images
    and mails, and tables without headers and rows, go from arrays.
    """
    if isinstance(kind, T.ArrayType):
        out = F.transform(c, lambda x: clean_nested(x, kind.elementType))
        names = kind.elementType.names if isinstance(kind.elementType, T.StructType) else []
        if "type" in names:
            bare = lambda x, f: F.coalesce(F.size(x[f]), F.lit(0)) <= 0 if f in names else F.lit(True)
            empty = lambda x: (x["type"].isin("text", "image", "email") & (x["content"] == "")) if "content" in names else F.lit(False)
            table = lambda x: (x["type"] == "table") & bare(x, "headers") & bare(x, "rows") if "rows" in names else F.lit(False)
            out = F.filter(out, lambda x: ~F.coalesce(empty(x) | table(x), F.lit(False)))
        return out
    if not isinstance(kind, T.StructType):
        return c
    names = kind.names
    fields = []
    for f in kind.fields:
        x = c[f.name]
        if f.name == "content" and isinstance(f.dataType, T.StringType):
            if "type" in names:
                body = clean(c["type"], x)
                x = F.when(c["type"] == "table", body if "rows" not in names else x).when(keeps(c["type"], body), body).otherwise("")
            else:
                x = clean_text(x)
        elif f.name == "text" and isinstance(f.dataType, T.StringType):
            x = F.when(x.isNotNull(), clean_text(x))
        elif f.name == "headers":
            x = F.transform(x, clean_text)
        elif f.name == "rows" and isinstance(f.dataType, T.ArrayType):
            x = F.transform(x, lambda row: F.transform(row, clean_text))
        elif f.name != "metadata":
            x = clean_nested(x, f.dataType)
        fields.append(x.alias(f.name))
    return F.when(c.isNotNull(), F.struct(*fields))
