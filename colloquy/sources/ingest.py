"""Import: fingerprints, outcomes against what is known, and the merge by id into stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rules import severity

COPY = ("path", "position")
#: What a person or a rule has said of a stored conversation; an updated copy keeps it.
KEPT = ("manual_tags", "auto_tags", "primary_project_id")


def fingerprints(conversations: DataFrame, messages: DataFrame, separator: str = "\x00", key: tuple[str, ...] = ("conversation_id",)) -> DataFrame:
    """key, fingerprint over source, source id, title and every message in order."""
    line = F.concat(F.coalesce("message_id", F.lit("")), F.lit("|"), "role", F.lit("|"), F.coalesce("content_text", F.lit("")), F.lit("\n"))
    lists = messages.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("m"))
    head = F.concat("source", F.lit(separator), F.coalesce("source_conversation_id", F.lit("")), F.lit(separator), F.coalesce("title", F.lit("")), F.lit(separator))
    rows = conversations.join(lists, list(key), "left")
    return rows.select(*key, F.sha2(F.concat(head, F.coalesce(F.array_join(F.transform("m", lambda x: x["line"]), ""), F.lit(""))), 256).alias("fingerprint"))


def outcomes(found: DataFrame, known: DataFrame) -> DataFrame:
    """conversation_id, fingerprint, outcome: imported or duplicate.

    Duplicate where the fingerprint is among the known ones, or came before in
    this import (smallest id first).
    """
    old = known.select("fingerprint").distinct().withColumn("_old", F.lit(True))
    first = F.row_number().over(Window.partitionBy("fingerprint").orderBy("conversation_id"))
    rows = found.join(old, "fingerprint", "left").withColumn("_n", first)
    return rows.select("conversation_id", "fingerprint", F.when(F.col("_old") | (F.col("_n") > 1), "duplicate").otherwise("imported").alias("outcome"))


def decided(copies: DataFrame, stored: DataFrame) -> DataFrame:
    """Every copy with its outcome: imported, updated, duplicate, older or empty.

    ``copies`` has path, position, conversation_id, updated_at, fingerprint and
    message_count; ``stored`` conversation_id, updated_at and fingerprint. Of
    several copies of one id the newest counts: that updated last, then that
    with most messages, then the last by path and position. It is imported
    where the id is new, a duplicate where its fingerprint is the stored one,
    else updated, unless the stored one was updated later. Other copies are
    duplicates of it if their fingerprint is the same, else older. Copies
    without messages are empty and stand for nothing.
    """
    filled = copies.where("message_count > 0")
    order = Window.partitionBy("conversation_id").orderBy(F.col("updated_at").desc_nulls_last(), F.desc("message_count"), F.desc("path"), F.desc("position"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = filled.withColumns({"_rank": F.row_number().over(order), "_newest": F.first("fingerprint").over(whole)})
    old = stored.select(F.col("conversation_id").alias("_id"), F.col("updated_at").alias("_at"), F.col("fingerprint").alias("_print"))
    known = ranked.join(old, ranked["conversation_id"] == old["_id"], "left")
    outcome = (
        F.when((F.col("_rank") > 1) & (F.col("fingerprint") == F.col("_newest")), "duplicate")
        .when(F.col("_rank") > 1, "older")
        .when(F.col("_id").isNull(), "imported")
        .when(F.col("_print").eqNullSafe(F.col("fingerprint")), "duplicate")
        .when(F.col("_at") > F.col("updated_at"), "older")
        .otherwise("updated")
    )
    told = known.withColumn("outcome", outcome).select(*copies.columns, "outcome")
    return told.unionByName(copies.where("message_count = 0").withColumn("outcome", F.lit("empty")))


def counters(told: DataFrame) -> DataFrame:
    """outcome, n copies."""
    return told.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def merged_conversations(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored conversations and fresh ones, a row per id (a full outer join on it).

    A fresh row's values hold, but tags and project stay, and so does the
    state unless a rule asks for a more restrictive one (``asked_state``,
    null without a rule). Derived columns of a fresh row are null until it is
    processed.
    """
    names = stored.columns
    old, new = stored.select("conversation_id", F.struct(*names).alias("o")), fresh.select("conversation_id", "asked_state", F.struct(*names).alias("n"))
    rows = old.join(new, "conversation_id", "full_outer")
    came, was = F.col("n").isNotNull(), F.col("o").isNotNull()

    def value(c: str) -> Column:
        if c == "state":
            stricter = F.col("asked_state").isNotNull() & (severity(F.col("asked_state")) > severity(F.col("o.state")))
            return F.when(came & was & ~stricter, F.col("o.state")).when(came & was, F.col("asked_state")).when(came, F.col("n.state")).otherwise(F.col("o.state"))
        if c in KEPT:
            return F.when(was, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        return F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return rows.select(*[value(c).alias(c) for c in names])


def replaced(stored: DataFrame, fresh: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored rows but those of ``ids`` (conversation_id), and the fresh ones."""
    return stored.join(ids.select("conversation_id"), "conversation_id", "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns))


def without_derived(tables: dict[str, DataFrame], updated: DataFrame) -> dict[str, DataFrame]:
    """chunks, provenance, objects, register and groups without what came from the earlier text of ``updated`` conversations.

    Objects go with their last link; those that never had one stay.
    """
    left = {n: tables[n].join(updated, "conversation_id", "left_anti").select(*tables[n].columns) for n in ("chunks", "provenance", "register", "groups") if n in tables}
    if "objects" in tables and "provenance" in tables:
        lost = tables["provenance"].join(updated, "conversation_id", "left_semi").select("object_id").join(left["provenance"], "object_id", "left_anti").distinct()
        left["objects"] = tables["objects"].join(lost, "object_id", "left_anti").select(*tables["objects"].columns)
    return left
