"""Crawls over landed metadata: what is due, what a user's run did, and stamping of access columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import dml, permissions

# -- fixed values ------------------------------------------------------------
_WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
_SLIDES = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
MIME_TYPES = {
    "application/pdf": "pdf_digital", _WORD: "docx", _SLIDES: "pptx", "text/plain": "txt",
    "image/png": "image", "image/jpeg": "image", "image/jpg": "image", "image/bmp": "image", "image/tiff": "image",
}
#: Workspace files can't be fetched as they are; what each is exported as.
EXPORTS = {
    "application/vnd.google-apps.document": _WORD,
    "application/vnd.google-apps.spreadsheet": "text/plain",
    "application/vnd.google-apps.presentation": _SLIDES,
}
STATES = ("pending", "running", "done", "failed")
#: State -> the states that it may follow; a failed or finished crawl may be queued again, and a failed one taken up.
FOLLOWS = {"pending": ("done", "failed"), "running": ("pending", "failed"), "done": ("running",), "failed": ("running",)}
# ----------------------------------------------------------------------------


def _of(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def due(listed: DataFrame, seen: DataFrame, most: int | None = None) -> DataFrame:
    """Listed files of a known type that are new, or whose modified_time has changed, with source_type and fetch_as; the oldest ``most``.

    fetch_as is the type to fetch: that of the export for a Workspace file, else the file's own.
    """
    fetched = F.coalesce(_of(EXPORTS, F.col("mime_type")), F.col("mime_type"))
    rows = listed.withColumn("fetch_as", fetched).withColumn("source_type", _of(MIME_TYPES, F.col("fetch_as"))).where(F.col("source_type").isNotNull())
    rows = dml.unseen(rows, seen, ["file_id"], "modified_time")
    return rows.orderBy("modified_time", "file_id").limit(most) if most else rows


def stamped(chunks: DataFrame, listed: DataFrame, entries: DataFrame) -> DataFrame:
    """Chunks with the access columns of their file; a file without an owner row is visible to nobody but admins."""
    access = permissions.resolved(entries, listed.select("file_id", "owner_email"))
    out = chunks.join(access, "file_id", "left")
    return out.withColumn("owner_email", F.coalesce("owner_email", F.lit("unknown"))).withColumn("is_public", F.coalesce("is_public", F.lit(False)))


def advanced(crawls: DataFrame, wanted: DataFrame, now: Column, key: str = "user_id") -> DataFrame:
    """crawls (key, crawl_status, cursor, attempts, changed_at) after the wanted changes (key, state, cursor), one a key.

    A change takes place only from a state that its own may follow; the others, and
    changes to no known state, leave their row as it is. Running counts an attempt. A
    cursor that comes with a change replaces the one held, so a failed crawl goes on from
    the last page that it had; done clears it. A key without a row begins as pending.
    """
    allowed = F.create_map(*[x for state, before in FOLLOWS.items() for x in (F.lit(state), F.array(*map(F.lit, before)))])
    new = wanted.select(F.col(key), F.col("state").alias("_to"), F.col("cursor").alias("_at"))
    both = crawls.join(new, key, "full_outer")
    first = F.col("crawl_status").isNull() & (F.col("_to") == "pending")
    moves = F.coalesce(first | F.array_contains(F.try_element_at(allowed, F.col("_to")), F.col("crawl_status")), F.lit(False))
    held = F.when(F.col("_to") == "done", F.lit(None)).otherwise(F.coalesce("_at", "cursor"))
    out = both.select(
        key,
        F.when(moves, F.col("_to")).otherwise(F.col("crawl_status")).alias("crawl_status"),
        F.when(moves, held).otherwise(F.col("cursor")).alias("cursor"),
        (F.coalesce("attempts", F.lit(0)) + F.when(moves & (F.col("_to") == "running"), 1).otherwise(0)).alias("attempts"),
        F.when(moves, now).otherwise(F.col("changed_at")).alias("changed_at"),
    )
    return out.where(F.col("crawl_status").isNotNull())


def resumable(crawls: DataFrame, most_attempts: int = 3) -> DataFrame:
    """Crawls to start, with the cursor to go on from: those pending, and those that failed fewer than ``most_attempts`` times."""
    return crawls.where((F.col("crawl_status") == "pending") | ((F.col("crawl_status") == "failed") & (F.col("attempts") < most_attempts)))
