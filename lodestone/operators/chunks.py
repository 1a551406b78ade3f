"""The canonical chunk: unification of handler outputs, metadata, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import LEAST_CHARS, chunk_id, clean, embed_text, keeps, safe_int, safe_text, strip, tokens

# -- fixed values ------------------------------------------------------------
TYPES = ("text", "table", "image")
SOURCE_TYPES = ("pdf_digital", "pdf_scanned", "docx", "pptx", "eml", "txt", "image", "google_drive")
MAIL_TYPES = ("eml", "eml_attachment", "gmail", "eml_body", "eml_body_table")
EXTENSIONS = {
    "pdf": "pdf_digital", "docx": "docx", "pptx": "pptx", "eml": "eml", "txt": "txt",
    "jpg": "image", "jpeg": "image", "png": "image", "bmp": "image", "tiff": "image", "tif": "image",
}
REQUIRED = ("chunk_id", "type", "content", "embed_text", "metadata")
REQUIRED_METADATA = ("source", "file_id", "source_type", "section", "page", "chunk_index", "chunk_total", "token_count", "subject", "from", "date", "attachment_guid")
#: Length of stored dense vectors.
DIMENSION = 1024
# ----------------------------------------------------------------------------

ELEMENT = "doc_id string, source_type string, position int, type string, content string, metadata map<string,string>"


def source_type(path: Column, override: Column | None = None, strict: bool = False) -> Column:
    """The override where there is one, else by extension; null, or with ``strict`` an error, for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    found = F.try_element_at(known, ext)
    if strict:
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("no source type for "), path)).cast("string"))
    return found if override is None else F.coalesce(override, found)


def unified(outputs: DataFrame) -> DataFrame:
    """Elements of handler outputs (source, source_type, shape, chunks, chunk): a list, or a mapping's chunks, each; a single chunk by itself; other shapes none.

    chunks is array<struct>, chunk one such struct; both keep their fields.
    """
    held = F.when(F.col("shape").isin("list", "chunks"), F.col("chunks")).when((F.col("shape") == "single") & F.col("chunk.content").isNotNull(), F.array("chunk"))
    rows = outputs.select("source", "source_type", F.posexplode(held).alias("position", "c"))
    return rows.where("c IS NOT NULL").select("source", "source_type", "position", "c.*")


def _page(kind: Column, meta: Column) -> Column:
    get = lambda k: F.try_element_at(meta, F.lit(k))
    page = F.when(kind.isin("pptx"), get("slide")).when(kind.isin("pdf_scanned", "image"), get("page")).otherwise(F.coalesce(get("page_start"), get("page")))
    return safe_int(page)


def normalise(elements: DataFrame) -> DataFrame:
    """Canonical chunks of cleaned elements: identifiers, embed text, metadata by source type, and place within the document."""
    meta, kind = F.col("metadata"), F.col("source_type")
    get = lambda *ks: safe_text(F.coalesce(*[F.try_element_at(meta, F.lit(k)) for k in ks]))
    type_ = F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("text")
    rows = elements.withColumn("type", type_).withColumn("content", clean(F.col("type"), F.col("content"))).where(keeps(F.col("type"), F.col("content")))
    source = get("source", "file_name")
    mail = kind.isin(*MAIL_TYPES)
    stored = safe_int(F.try_element_at(meta, F.lit("token_count")))
    struct = F.struct(
        source.alias("source"),
        get("file_id").alias("file_id"),
        kind.alias("source_type"),
        get("section").alias("section"),
        _page(kind, meta).alias("page"),
        F.coalesce(F.nullif(stored, F.lit(0)).cast("long"), tokens(F.col("content"))).alias("token_count"),
        F.when(mail, get("subject")).alias("subject"),
        F.when(mail, get("from")).alias("from"),
        F.when(mail, get("date")).alias("date"),
        get("attachment_guid").alias("attachment_guid"),
    )
    given = F.try_element_at(meta, F.lit("chunk_id"))
    return rows.select(
        "doc_id",
        "position",
        chunk_id(given, kind, F.coalesce(source, F.lit("")), F.col("content")).alias("chunk_id"),
        "type",
        "content",
        embed_text(F.col("type"), F.col("content")).alias("embed_text"),
        struct.alias("metadata"),
    )


def missing(present: Column, required: tuple[str, ...]) -> Column:
    """Required names that an array of names lacks, in order."""
    return F.array_except(F.array(*[F.lit(x) for x in required]), present)


def problems(chunks: DataFrame) -> DataFrame:
    """(chunk_id, problem) of chunks (fields, type, content, embed_text, metadata): one row for each rule that a chunk breaks.

    fields names the fields that the chunk has; metadata is map<string,string>, whose keys are the metadata fields that it has.
    """
    top = missing(F.col("fields"), REQUIRED)
    inner = missing(F.map_keys(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), REQUIRED_METADATA)
    kind, of = F.col("type"), F.try_element_at("metadata", F.lit("source_type"))
    named = lambda label, c: F.concat(F.lit(label), F.coalesce(c, F.lit("None")))
    checks = [
        F.when(F.size(top) > 0, F.concat(F.lit("missing top-level fields: "), F.array_join(top, ", "))),
        F.when(~F.coalesce(kind.isin(*TYPES), F.lit(False)), named("invalid type: ", kind)),
        F.when(strip(F.coalesce("content", F.lit(""))) == "", F.lit("empty content")),
        F.when(strip(F.coalesce("embed_text", F.lit(""))) == "", F.lit("empty embed_text")),
        F.when(F.size(inner) > 0, F.concat(F.lit("missing metadata fields: "), F.array_join(inner, ", "))),
        F.when(~F.coalesce(of.isin(*SOURCE_TYPES), F.lit(False)), named("invalid source_type: ", of)),
    ]
    return chunks.select("chunk_id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def refusal(dense: str = "vector", indices: str = "indices", values: str = "weights", dimension: int = DIMENSION) -> Column:
    """Why a chunk can't be stored, the first reason; null: it can."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    held = lambda c: F.greatest(n(c), F.lit(0))
    return (
        F.when(F.coalesce("chunk_id", F.lit("")) == "", "missing chunk_id")
        .when(held(dense) == 0, "missing dense_vector")
        .when(held(dense) != dimension, F.concat(F.lit("wrong dense_vector dim: "), held(dense).cast("string"), F.lit(f" (expected {dimension})")))
        .when((held(indices) == 0) | (held(values) == 0), "missing or empty sparse_vector")
        .when(held(indices) != held(values), "sparse_vector indices/values length mismatch")
        .when(strip(F.coalesce("content", F.lit(""))) == "", "empty content")
    )


def of_kind(rows: DataFrame, by: list[str]) -> DataFrame:
    """Chunks by type, with token statistics."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"), F.min("tokens").alias("least"), F.floor(F.avg("tokens")).cast("long").alias("mean"), F.max("tokens").alias("most"))


__all__ = ["ELEMENT", "EXTENSIONS", "LEAST_CHARS", "SOURCE_TYPES", "TYPES", "missing", "normalise", "of_kind", "problems", "refusal", "source_type", "unified"]
