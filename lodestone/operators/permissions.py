"""Grants on documents, and what a crawled file's permission list says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import dml
from lodestone.operators.retrieve import valid_permissions

#: Roles that may read, and levels of a grant.
READERS = ("reader", "commenter", "writer", "owner", "fileOrganizer", "organizer")
LEVELS = ("read", "write", "admin")


def grant(permissions: DataFrame, new: DataFrame) -> DataFrame:
    """One grant a user and document; a new one replaces the old."""
    bad = new.where(~F.col("permission_level").isin(*LEVELS))
    if not bad.isEmpty():
        raise ValueError(f"a grant's level is one of {LEVELS}")
    return dml.upsert(permissions, new, ["user_id", "document_id"], [F.desc("granted_at")])


def revoke(permissions: DataFrame, gone: DataFrame) -> DataFrame:
    return dml.delete(permissions, gone, ["user_id", "document_id"])


def can_access(permissions: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """pairs (user_id, document_id) with allowed."""
    held = valid_permissions(permissions, now).select("user_id", "document_id").distinct().withColumn("allowed", F.lit(True))
    return pairs.join(held, ["user_id", "document_id"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def documents_of(docs: DataFrame, permissions: DataFrame, user: str) -> DataFrame:
    """A user's documents with their level, newest first."""
    own = permissions.where(F.col("user_id") == user).select("document_id", "permission_level")
    return docs.join(own, "document_id").orderBy(F.desc("uploaded_at"), "document_id")


def resolved(entries: DataFrame, owners: DataFrame) -> DataFrame:
    """(file_id, owner_email, allowed_users, is_public) of permission entries (file_id, type, role, email); owners are always allowed."""
    rows = entries.where(F.col("role").isin(*READERS))
    agg = rows.groupBy("file_id").agg(F.collect_set(F.lower("email")).alias("_users"), F.bool_or(F.col("type") == "anyone").alias("_public"))
    out = owners.join(agg, "file_id", "left")
    named = F.coalesce("_users", F.array().cast("array<string>"))
    users = F.sort_array(F.array_distinct(F.array_compact(F.concat(named, F.array(F.lower("owner_email"))))))
    return out.select("file_id", "owner_email", users.alias("allowed_users"), F.coalesce("_public", F.lit(False)).alias("is_public"))


def emails_of(callers: DataFrame, users: DataFrame, caller: str = "caller_id") -> DataFrame:
    """callers with the email of their user; empty for an unknown one. users is (user_id, email)."""
    held = users.select(F.col("user_id").alias("_u"), F.col("email").alias("_e"))
    return callers.join(held, F.col(caller) == F.col("_u"), "left").withColumn("email", F.coalesce("_e", F.lit(""))).drop("_u", "_e")


def users_like(users: DataFrame, pattern: str, column: str = "user_id") -> DataFrame:
    """Users whose name a LIKE pattern takes."""
    return users.where(F.col(column).like(pattern))


def registrable(email: Column, password: Column, name: Column) -> Column:
    """Why a registration is refused, the first reason; null: it isn't."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(~F.coalesce(email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False)), "bad email")
        .when(F.length(F.coalesce(password, F.lit(""))) < 6, "short password")
        .when(blank(name), "blank name")
    )


def uploads_allowed(uploaded: DataFrame, permissions: DataFrame, user: str, now: Column) -> DataFrame:
    """document_id of a user's own uploads (document_id, uploaded_by) that the user may read too."""
    own = uploaded.where(F.col("uploaded_by") == user).select("document_id")
    return own.intersect(valid_permissions(permissions, now).where(F.col("user_id") == user).select("document_id"))
