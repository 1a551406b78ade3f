"""Operator 9: token counts of fields and sections by offset-mapped attribution.

A document's fields are joined by a blank line and encoded once as a whole. Each
token's bytes are known, so running sums give its character span; the spans are
interval-joined (binary search over sorted section starts) to the sections. A
token that crosses a boundary goes where ``rule`` says:

* ``majority``: to the section with most of its characters, the earlier on a tie;
* ``start``: to the section of its first character;
* ``end``: to the section of its last character.

Sections are the lines of each field, line feed included (a line feed at the end
opens no further line); the blank line between
two fields belongs to the earlier field's last section. A character whose bytes
lie in several tokens counts for each of them.

Defined results: null fields are empty; an empty document has one section with
no tokens; repeated rows each count; null doc_id stays null; extra columns are
not read. One document is held by one task, in proportion to its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bpe, vec

RULES = ("majority", "start", "end")
GAP = "\n\n"


def token_spans(codec: bpe.ByteBPE, body: np.ndarray, ids: np.ndarray, sizes: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every token in characters over all texts laid end to end, and the character at which each byte lies."""
    ends = np.cumsum(codec.token_size[ids])
    starts = ends - codec.token_size[ids]
    lead = (body & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), char
    return char[starts], char[ends - 1] + 1, char


def allocate(start: np.ndarray, end: np.ndarray, section_start: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """(section, crosses) of each token, by its character span and the sorted section starts."""
    first = np.searchsorted(section_start, start, "right") - 1
    last = np.searchsorted(section_start, end - 1, "right") - 1
    crosses = first != last
    if rule == "start":
        return first, crosses
    if rule == "end":
        return last, crosses
    out = first.copy()
    at = np.flatnonzero(crosses)
    if len(at):
        count = last[at] - first[at] + 1
        token = np.repeat(np.arange(len(at)), count)
        section = np.repeat(first[at], count) + vec.grouped_arange(count)
        stop = np.append(section_start[1:], np.iinfo(np.int64).max)
        overlap = np.minimum(end[at][token], stop[section]) - np.maximum(start[at][token], section_start[section])
        order = np.lexsort((section, -overlap, token))
        out[at] = section[order[np.concatenate(([0], np.cumsum(count)[:-1]))]]
    return out, crosses


def count_tokens(docs: DataFrame, fields: tuple[str, ...] = ("text",), rule: str = "majority", path: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_crossing, field_tokens (one per field), section_tokens (one per line of each field, in order)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or bpe.vocabulary_path()
    width = len(fields)

    def run(batches):
        codec = bpe.codec(path)
        for batch in batches:
            for part in vec.slices(batch, "text"):
                yield _counted(codec, part, width, rule)

    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    whole = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.concat_ws(GAP, *parts).alias("text"), F.array(*[F.length(p) for p in parts]).alias("lengths"))
    return whole.mapInArrow(vec.lean(run), "doc_id long, n_tokens long, n_crossing long, field_tokens array<long>, section_tokens array<long>")


def _counted(codec: bpe.ByteBPE, part: pa.RecordBatch, width: int, rule: str) -> pa.RecordBatch:
    texts = [t or "" for t in part.column(1).to_pylist()]
    ids, sizes = codec.encode(texts)
    body, offsets = vec.flat(part.column(1))
    start, end, char = token_spans(codec, body, ids, sizes, offsets[1:])
    n = len(texts)
    # characters before each text
    chars = np.append(char, char[-1] + 1 if len(char) else 0)[offsets]
    field_length = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, width).astype(np.int64)
    field_start = chars[:-1, None] + np.concatenate((np.zeros((n, 1), np.int64), np.cumsum(field_length + len(GAP), 1)[:, :-1]), 1)
    # a line starts a section, but a blank line between fields belongs to what is before it
    after = char[np.flatnonzero(body == 10)] + 1
    owner = np.searchsorted(field_start.ravel(), after, "right") - 1
    inside = (after > field_start.ravel()[owner]) & (after < field_start.ravel()[owner] + field_length.ravel()[owner])
    begin = np.concatenate((field_start.ravel(), after[inside]))
    field = np.concatenate((np.arange(n * width), owner[inside]))
    order = np.lexsort((begin, field))
    begin, field = begin[order], field[order]
    # sections without characters share a start: only the last of each start can own tokens
    section, crosses = allocate(start, end, begin, rule)
    tokens = np.bincount(section, minlength=len(begin)) if len(section) else np.zeros(len(begin), np.int64)
    row = np.repeat(np.arange(n), sizes)
    crossing = np.bincount(row[crosses], minlength=n) if len(row) else np.zeros(n, np.int64)
    by_field = np.bincount(field, weights=tokens, minlength=n * width).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            part.column(0),
            pa.array(sizes.astype(np.int64)),
            pa.array(crossing.astype(np.int64)),
            vec.lists(pa.array(by_field), np.full(n, width)),
            vec.lists(pa.array(tokens.astype(np.int64)), np.bincount(field // width, minlength=n)),
        ],
        ["doc_id", "n_tokens", "n_crossing", "field_tokens", "section_tokens"],
    )
