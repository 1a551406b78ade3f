"""Operator 12: personal data, by patterns and by a character tagger trained on labelled spans.

Four patterns give the base spans. A bidirectional character LSTM with CRF
transitions (``tagger``) adds what they miss: addresses written with "at" and
"dot", numbers that run into their neighbours, other separators. It is trained
on the driver from a bounded sample, ``SAMPLE_PIECES`` pieces of ``SAMPLE_ROWS``
or so rows: pieces around base spans, and pieces of plain text into which spans
in further spellings, and numbers and marks that are no personal data, are
written. Every whole text is then cut into overlapping windows, each window is
decoded by itself, and a document's windows are reconciled at once: spans that a
window's edge cut are joined with their neighbour's, and of all candidates those
that exclude each other least to the total score stay (weighted interval
scheduling over the whole document). What is added must, with its spelling
undone, be an address or number of its kind, and overlaps no base span.

Nothing is shuffled: texts are tagged where they lie.

Defined results: null and empty texts hold nothing; repeated rows each get their
result; a null doc_id stays null; an empty table gives no rows; extra columns are
ignored, and pass through ``redact``; code points count, whatever their planes; a
text of any length is worked on in pieces of a bounded number of windows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import store, tagger, vec

KINDS = ("email", "ip", "card", "phone")
#: Rows from which pieces are taken, and pieces that are kept of these.
SAMPLE_ROWS, SAMPLE_PIECES, PIECE = 4000, 2000, 160
HIDDEN, STEPS, EXAMPLES, LENGTH, SEED = 16, 900, 8000, 96, 12
WINDOW, OVERLAP, ROUND, ROWS, SLICE = 768, 64, 128, 512, 4 << 20

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")

Span = tuple[str, int, int]


def luhn(digits: list[int]) -> bool:
    twice = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(twice)) % 10 == 0


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))


def _is_card(text: str) -> bool:
    digits = [int(d) for d in _DIGITS.findall(text)] if len(text) <= 64 else []
    return 14 <= len(digits) <= 19 and luhn(digits)


def _is_phone(text: str) -> bool:
    return 10 <= len(_DIGITS.findall(text)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by start and kind. Each pattern takes time in proportion to the text, whatever it holds."""
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    for kind, pattern, holds in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if holds(m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# spellings: how a span is written, and how that is undone

_DOT = re.compile(r"\s*(?:\[\.\]|\(\.\)|[\[({]\s*dot\s*[\])}]|\s+dot\s+)\s*|\s+\.\s*|\s*\.\s+", re.I)
_AT = re.compile(r"\s*(?:\[@\]|\(@\)|[\[({]\s*at\s*[\])}]|\s+at\s+)\s*|\s+@\s*|\s*@\s+", re.I)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def certified(kind: str, text: str) -> bool:
    """Whether a span that the tagger found is, its spelling undone, an address or number of its kind."""
    if kind == "email":
        return bool(_EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", text))))
    if kind == "ip":
        plain = _DOT.sub(".", text)
        return bool(_IP.fullmatch(plain)) and _is_ip(plain)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[^A-Za-z0-9\n]{0,2}[0-9])+", text)) and _is_card(text)
    return bool(re.fullmatch(r"\+?[0-9(][^A-Za-z\n]*[0-9]", text)) and _is_phone(text) and bool(re.search(r"[^0-9]", text))


class Speller:
    """Writes made-up spans, and look-alikes that are none."""

    def __init__(self, rng: np.random.Generator, words: list[str]):
        self.rng, self.words = rng, words or ["the"]

    def pick(self, of):
        return of[int(self.rng.integers(len(of)))]

    def number(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self) -> str:
        return re.sub(r"[^A-Za-z]", "", self.pick(self.words)).lower()[:12] or "mail"

    def email(self) -> str:
        name = self.word() + self.pick(["", ".", "_", "-"]).join(["", self.pick([self.word(), self.number(2), self.number(4)])]) * int(self.rng.integers(2))
        host = [self.pick([self.word(), self.word() + self.number(1)]) for _ in range(self.rng.integers(1, 3))] + [self.pick(["com", "org", "net", "de", "fr", "es", "io", "co", "info"])]
        at = self.pick(["@"] * 3 + [" @ ", " at ", " AT ", "[at]", " [at] ", "(at)", " (at) ", "{at}", " [@] ", "(@)"])
        dot = self.pick([".", ".", " dot ", " DOT ", "[dot]", " [dot] ", "(dot)", " (dot) ", "[.]"]) if at != "@" else self.pick([".", ".", " dot ", "[dot]", "[.]", " (dot) "])
        return name + at + dot.join(host)

    def ip(self) -> str:
        return self.pick([".", ".", ".", "[.]", "(.)", " dot ", "[dot]", " . "]).join(str(x) for x in self.rng.integers(0, 256, 4))

    def card(self) -> str:
        n = self.pick([16, 16, 16, 15, 14, 19])
        digits = [int(self.pick([4, 5, 3, 6]))] + self.rng.integers(0, 10, n - 2).tolist()
        digits.append(next(d for d in range(10) if luhn([*digits, d])))
        s = "".join(map(str, digits))
        cut = [0, 4, 8, 12, 16, 19] if n != 15 else [0, 4, 10, 15]
        return self.pick(["", "", " ", "-", ".", "/", "_", "  ", " - ", "–"]).join(s[a:b] for a, b in zip(cut, cut[1:]) if s[a:b])

    def phone(self) -> str:
        a, b, c = self.number(3), self.number(3), self.number(4)
        return self.pick(
            [f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+{self.number(2)} {a} {b}{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"001 {a} {b} {c}", f"+1/{a}/{b}-{c}", f"+{self.number(2)} (0) {a} {b} {c}", f"0{a}/{b}{c}", f"0{a} {b} {c}", f"+1 ({a}) {b}-{c}"]
        )

    def lookalike(self) -> str:
        r = self.rng.integers
        return self.pick(
            [
                f"{r(1990, 2030)}-{r(1, 13):02}-{r(1, 29):02}", f"{r(1, 29)}.{r(1, 13)}.{r(1990, 2030)}", f"{r(24):02}:{r(60):02}:{r(60):02}", f"{r(1, 999)},{self.number(3)},{self.number(3)}", f"v{r(9)}.{r(20)}.{r(20)}",
                f"#{self.number(5)}", f"{r(100)}.{r(10)}%", self.number(int(r(1, 13))), self.number(int(r(20, 40))), "".join(self.pick("0123456789abcdef") for _ in range(r(16, 41))), f"@{self.word()}", f"{self.word()}@", f"{self.word()} at {self.word()}",
                f"{self.word()} dot {self.word()}", f"{r(10)}+{r(10)}={r(20)}", f"{self.word()}_{r(99)}.txt", f"{self.number(3)}-{self.number(4)}", f"({r(10)}) {r(1000)}", f"ISBN {self.number(3)}-{self.number(1)}-{self.number(4)}-{self.number(4)}-{self.number(1)}", f"{r(99)} {r(999)} {r(99)}", f"${r(1, 999)}.{r(100):02}",
            ]
        )


def examples(pieces: list[tuple[str, list[Span]]], n: int = EXAMPLES, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """n labelled runs of ``length`` characters: a third as they lie, the others with spans or look-alikes written between their words."""
    rng = np.random.default_rng(seed)
    pieces = pieces or [("the and of to in for with that ", [])]
    held = [p for p in pieces if p[1]]
    say = Speller(rng, [w for t, _ in pieces[:500] for w in t.split()])
    x, y = np.zeros((n, length), np.uint8), np.zeros((n, length), np.int64)
    for i in range(n):
        text, spans = say.pick(held) if held and i % 3 == 0 else say.pick(pieces)
        while len(text) < 2 * length:
            more, further = say.pick(pieces)
            text, spans = f"{text}\n{more}", spans + [(k, s + len(text) + 1, e + len(text) + 1) for k, s, e in further]
        if i % 3:
            gaps = [m.start() for m in re.finditer(r"\s", text) if length // 3 < m.start() < length and not any(s <= m.start() < e for _, s, e in spans)]
            at = (say.pick(gaps) if gaps else length) + 1
            kind = say.pick(KINDS) if i % 3 == 1 or rng.random() < 0.3 else ""
            new = getattr(say, kind)() if kind else say.lookalike()
            # a number or mark before it, and after it
            lead = say.pick(["", "", "", "", say.number(int(rng.integers(1, 5))) + " ", "tel: ", "mail: ", "(", '"', "id "])
            tail = say.pick([" ", " ", " ", "\n", ". ", ", ", ") ", " " + say.number(int(rng.integers(1, 6))) + " ", " " + say.number(16) + " " if kind == "phone" else " "])
            spans = [(k, s, e) if s < at else (k, s + len(lead + new + tail), e + len(lead + new + tail)) for k, s, e in spans]
            text = text[:at] + lead + new + tail + text[at:]
            spans = spans + ([(kind, at + len(lead), at + len(lead) + len(new))] if kind else [])
        if rng.random() < 0.08:
            text = text.upper()
        cut = int(rng.integers(0, max(1, len(text) - length)))
        if i % 3:  # what was written lies within, or is cut now and then
            cut = int(np.clip(at - rng.integers(0, length - 10), 0, len(text) - length))
        row = text[cut : cut + length]
        if len(row) < length:
            row += " " * (length - len(row))
        inside = [(k, max(0, s - cut), min(length, e - cut)) for k, s, e in spans if e > cut and s < cut + length]
        # of base spans that overlap the longer one counts
        kept: list[Span] = []
        for s in sorted(inside, key=lambda s: s[1] - s[2]):
            if all(s[2] <= o[1] or s[1] >= o[2] for o in kept):
                kept.append(s)
        x[i], y[i] = tagger.symbols(row), tagger.encode_tags(length, kept, KINDS)
    return x, y


def _pieces(docs: DataFrame) -> list[tuple[str, list[Span]]]:
    """Labelled pieces of a sample of rows: one around each base span, and one elsewhere."""
    total = docs.count()
    if not total:
        return []
    rank = F.xxhash64("doc_id", F.lit(SEED))
    share = min(1.0, SAMPLE_ROWS / total)
    rows = docs.where("text <> ''").select(rank.alias("rank"), "text").where(F.col("rank") <= min(2**63 - 1, int((2 * share - 1) * 2**63)))

    def run(batches):
        for batch in batches:
            out = []
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = base_spans(text)
                rng = np.random.default_rng(r % 2**32)
                for at in [s[1] - int(rng.integers(10, PIECE // 2)) for s in spans] + [int(rng.integers(0, max(1, len(text) - PIECE)))]:
                    at = max(0, at)
                    piece = text[at : at + PIECE]
                    held = [(k, s - at, e - at) for k, s, e in spans if s >= at and e <= at + PIECE]
                    out.append({"rank": r, "held": bool(held), "piece": piece, "spans": [{"kind": k, "start": s, "end": e} for k, s, e in held]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("rank", pa.int64()), ("held", pa.bool_()), ("piece", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]))

    each = rows.mapInArrow(vec.lean(run), "rank long, held boolean, piece string, spans array<struct<kind:string,start:int,end:int>>")
    found = each.orderBy("rank", "piece").limit(SAMPLE_PIECES).collect()
    return [(r.piece, [(s.kind, s.start, s.end) for s in r.spans]) for r in found]


def fit(docs: DataFrame, steps: int = STEPS) -> tagger.Tagger:
    """A tagger trained on a sample of docs (doc_id, text)."""
    x, y = examples(_pieces(docs))
    model = tagger.Tagger.fresh(KINDS, HIDDEN, SEED)
    tagger.train(model, x, y, steps, seed=SEED)
    return model


def _windows(n: int) -> list[tuple[int, int]]:
    """Windows [start, end) that cover n characters; each pair of neighbours shares OVERLAP of them."""
    return [(s, min(n, s + WINDOW)) for s in range(0, max(n - OVERLAP, min(n, 1)), WINDOW - OVERLAP)]


def reconciled(found: list[tuple[str, int, int, float, bool, bool]]) -> list[Span]:
    """Of the spans of a document's windows (kind, start, end, score, cut at its left, cut at its right) those that stay.

    Cut spans of one kind that overlap become one more candidate; then the set of
    candidates of largest total score without overlap is taken, the earlier end
    and the earlier start first among equals.
    """
    best: dict[Span, float] = {}
    for kind, start, end, score, *_ in found:
        best[kind, start, end] = max(score, best.get((kind, start, end), score))
    cut = sorted(s for s in found if s[4] or s[5])
    for kind in {s[0] for s in cut}:
        runs = [list(s[1:4]) for s in cut if s[0] == kind]
        joined = runs[:1]
        for start, end, score in runs[1:]:
            if start <= joined[-1][1]:
                joined[-1] = [joined[-1][0], max(end, joined[-1][1]), max(score, joined[-1][2]) + 1]
            else:
                joined.append([start, end, score])
        for start, end, score in joined:
            best[kind, start, end] = max(score, best.get((kind, start, end), score))
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    total = [0.0]
    for i, s in enumerate(spans):
        total.append(max(total[i], best[s] + total[bisect_right(ends, s[1], 0, i)]))
    kept, i = [], len(spans)
    while i:
        s = spans[i - 1]
        if total[i] > total[i - 1]:
            kept.append(s)
            i = bisect_right(ends, s[1], 0, i - 1)
        else:
            i -= 1
    return kept[::-1]


def _clear(spans: list[Span], base: list[Span]) -> list[Span]:
    """spans that overlap none of base."""
    starts, ends = sorted(s[1] for s in base), sorted(s[2] for s in base)
    # as many begin before its end as end by its start: none lies between
    return [s for s in spans if bisect_left(starts, s[2]) == bisect_right(ends, s[1])]


def added_spans(texts: list[str], base: list[list[Span]], model: tagger.Tagger) -> list[list[Span]]:
    """What the tagger adds to the base spans of each text."""
    chars = [tagger.symbols(t) for t in texts]
    # a short window is followed by white space up to a multiple of ROUND, so that many go at once
    where = sorted((-((s - e) // ROUND) * ROUND, i, s) for i, x in enumerate(chars) for s, e in _windows(len(x)))
    found: list[list] = [[] for _ in texts]
    at = 0
    while at < len(where):
        size = where[at][0]
        to = at
        while to < len(where) and where[to][0] == size and to - at < ROWS:
            to += 1
        x = np.full((to - at, size), tagger.BLANK, np.uint8)
        for row, (_, i, s) in zip(x, where[at:to]):
            part = chars[i][s : s + size]
            row[: len(part)] = part
        em = model.emissions(x)
        for r, tags in model.paths(em).items():
            _, i, s = where[at + r]
            for kind, start, end, score in model.spans(tags, em[:, :, r]):
                end = min(end, len(chars[i]) - s)
                if start < end:
                    found[i].append((kind, s + start, s + end, score, s > 0 and start == 0, end == size and s + end < len(chars[i])))
        at = to
    out = []
    for text, own, spans in zip(texts, base, found):
        spans = reconciled([s for s in spans if s[3] > 0]) if spans else []
        trimmed = [t for t in (_trimmed(text, *s) for s in spans) if t and certified(t[0], text[t[1] : t[2]])]
        out.append(_clear(trimmed, own))
    return out


def _trimmed(text: str, kind: str, start: int, end: int) -> Span | None:
    """The span without white space and closing marks at its ends."""
    while start < end and (text[start].isspace() or text[start] in ",;:\"'"):
        start += 1
    while start < end and (text[end - 1].isspace() or text[end - 1] in ".,;:\"'"):
        end -= 1
    return (kind, start, end) if start < end else None


_SPAN = "struct<kind:string,start:int,end:int,base:boolean>"


def _found(part: pa.Array, model: tagger.Tagger) -> list[list[tuple[str, int, int, bool]]]:
    texts = [t or "" for t in part.to_pylist()]
    base = [base_spans(t) for t in texts]
    every = []
    for own, more in zip(base, added_spans(texts, base, model)):
        spans = [(*s, True) for s in own] + [(*s, False) for s in more]
        every.append(sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))
    return every


def find(docs: DataFrame, model: tagger.Tagger, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): array of (kind, start, end, base) by start, then kind, of every document."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text", SLICE):
                rows = [[dict(zip(("kind", "start", "end", "base"), s)) for s in spans] for spans in _found(part.column(1), model)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(vec.lean(run), f"doc_id long, spans array<{_SPAN}>")


def redact(docs: DataFrame, model: tagger.Tagger, text: str = "text") -> DataFrame:
    """docs with each span written as [KIND]; spans that overlap become one, named by the first; n_chars, where there is one, follows the text."""
    names, at = docs.columns, docs.columns.index(text)

    def without(body: str, spans) -> str:
        out, done = [], 0
        for kind, start, end, _ in spans:
            if start >= done:
                out += [body[done:start], f"[{kind.upper()}]"]
            done = max(done, end)
        return "".join([*out, body[done:]])

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, at, SLICE):
                bodies = part.column(at).to_pylist()
                cols = list(part.columns)
                cols[at] = pa.array([None if b is None else without(b, s) for b, s in zip(bodies, _found(part.column(at), model))], pa.string())
                yield pa.RecordBatch.from_arrays(cols, names)

    out = store.mapped(docs, vec.lean(run), docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, base spans counted by kind (n_email, n_ip, n_card, n_phone), base_sha256, spans (all), n_added."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = find(rows, fit(rows))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
