"""Views: counts, redaction, health checks, workbook sheets, report parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import VISIBLE, in_states
from . import search
from .cluster import display_label


def redacted(conversations: DataFrame) -> DataFrame:
    """Titles of what isn't indexed are hidden."""
    return conversations.select("conversation_id", "state", "source", F.when(F.col("state") == "indexed", F.col("title")).otherwise("[redacted]").alias("title"), "message_count")


def storage_counts(conversations: DataFrame, messages: DataFrame, chunks: DataFrame, provenance: DataFrame) -> DataFrame:
    """conversation_id and how many rows other tables hold of it."""
    out = conversations.select("conversation_id")
    for name, df in (("n_messages", messages), ("n_chunks", chunks), ("n_links", provenance)):
        out = out.join(df.groupBy("conversation_id").agg(F.count(F.lit(1)).alias(name)), "conversation_id", "left")
    return out.na.fill(0)


def register_shares(conversations: DataFrame, register: DataFrame, states: tuple[str, ...] = VISIBLE) -> DataFrame:
    """register, n, percent over visible conversations."""
    rows = conversations.where(in_states("state", states)).select("conversation_id").join(register, "conversation_id", "left").groupBy(F.coalesce("dominant_register", F.lit("other")).alias("register")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def dominant_register(classified: DataFrame) -> DataFrame:
    """conversation_id, dominant_register: the most frequent of user messages, ties by name."""
    counts = classified.where("role = 'user' AND register IS NOT NULL").groupBy("conversation_id", "register").agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("n"), "register"))
    return counts.withColumn("k", best).where("k = 1").select("conversation_id", F.col("register").alias("dominant_register"))


def forward_filled(messages: DataFrame, label: str, default: str = "other") -> DataFrame:
    """Labels of sampled messages carried to the messages after them."""
    w = Window.partitionBy("conversation_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn(label, F.coalesce(F.last_value(label, True).over(w), F.lit(default)))


def kind_counts(objects: DataFrame, provenance: DataFrame, conversations: DataFrame, states: tuple[str, ...] = VISIBLE) -> DataFrame:
    return search.visible_objects(objects, provenance, conversations, states).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def top_objects(objects: DataFrame, provenance: DataFrame, conversations: DataFrame, n: int = 20, states: tuple[str, ...] = VISIBLE) -> DataFrame:
    """Objects by the number of visible conversations that hold them."""
    links = search.visible_provenance(provenance, conversations, states).groupBy("object_id").agg(F.countDistinct("conversation_id").alias("n_conversations"))
    return links.join(objects.where("state = 'active'").select("object_id", "kind", "title"), "object_id").orderBy(F.desc("n_conversations"), "kind", "title").limit(n)


def health(conversations: DataFrame, messages: DataFrame, chunks: DataFrame, objects: DataFrame, provenance: DataFrame) -> DataFrame:
    """check, n: rows that break an invariant."""
    ids = conversations.select("conversation_id")
    starts = messages.select("conversation_id", F.col("ordinal").alias("start_message_ordinal"))
    hidden = conversations.where("state = 'quarantined'").select("conversation_id")
    checks = {
        "chunks_of_no_conversation": chunks.join(ids, "conversation_id", "left_anti"),
        "chunks_without_start_message": chunks.join(starts, ["conversation_id", "start_message_ordinal"], "left_anti"),
        "conversations_without_messages": ids.join(messages.select("conversation_id"), "conversation_id", "left_anti"),
        "links_of_no_conversation": provenance.join(ids, "conversation_id", "left_anti"),
        "links_of_no_object": provenance.join(objects.select("object_id"), "object_id", "left_anti"),
        "links_of_no_chunk": provenance.where("chunk_id IS NOT NULL").join(chunks.select("chunk_id"), "chunk_id", "left_anti"),
        "messages_of_no_conversation": messages.join(ids, "conversation_id", "left_anti"),
        "objects_without_link": objects.join(provenance.select("object_id"), "object_id", "left_anti"),
        "quarantined_with_links": provenance.join(hidden, "conversation_id", "left_semi"),
    }
    parts = [df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n")) for name, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_conversations(conversations: DataFrame, objects: DataFrame, provenance: DataFrame) -> DataFrame:
    """Each conversation with its state and what was derived from it."""
    links = provenance.join(objects.select("object_id", "kind"), "object_id").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_links"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return conversations.join(links, "conversation_id", "left").select("conversation_id", "state", "message_count", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("kinds", F.lit("")).alias("kinds"))


def audit_objects(conversations: DataFrame, objects: DataFrame, provenance: DataFrame) -> DataFrame:
    """Each object with its links and the states of the conversations behind them."""
    rows = provenance.join(conversations.select("conversation_id", F.col("state").alias("_state")), "conversation_id")
    links = rows.groupBy("object_id").agg(F.count(F.lit(1)).alias("n_links"), F.count_if(in_states("_state", VISIBLE)).alias("n_visible"), F.array_join(F.array_sort(F.collect_set("_state")), ",").alias("states"))
    return objects.join(links, "object_id").select("object_id", "kind", "title", "n_links", "n_visible", "states")


def overview(conversations: DataFrame, objects: DataFrame, provenance: DataFrame, states: tuple[str, ...] = VISIBLE) -> DataFrame:
    """section, name, n: conversations by state and by source, visible objects by kind."""
    count = lambda df, column, section: df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "name", "n")
    shown = search.visible_objects(objects, provenance, conversations, states)
    return count(conversations, "state", "state").unionByName(count(conversations, "source", "source")).unionByName(count(shown, "kind", "kind"))


# ---- workbook sheets: DataFrames with fixed columns


def sheet_conversations(conversations: DataFrame, groups: DataFrame | None, states: tuple[str, ...]) -> DataFrame:
    rows = conversations.where(in_states("state", states))
    labels = {}
    for level in ("broad", "fine"):
        name = f"{level}_group_label"
        if groups is not None:
            rows = rows.join(groups.where(F.col("level") == level).groupBy("conversation_id").agg(F.min("keyword_label").alias(name)), "conversation_id", "left")
            labels[name] = F.coalesce(name, F.lit(""))
        else:
            labels[name] = F.lit("")
    return rows.select(
        "conversation_id", "source", "title", X.iso_utc(F.col("created_at")).alias("created_at"), X.iso_utc(F.col("updated_at")).alias("updated_at"), "state", "message_count", "summary_short",
        F.array_join("manual_tags", ", ").alias("manual_tags"), F.array_join("auto_tags", ", ").alias("auto_tags"), "importance_score", "resurfacing_score", X.yes_no(F.col("has_open_loops")).alias("has_open_loops"),
        *[c.alias(n) for n, c in labels.items()],
    )


def sheet_chunks(conversations: DataFrame, chunks: DataFrame, states: tuple[str, ...]) -> DataFrame:
    shown = conversations.where(in_states("state", states)).select("conversation_id", F.col("title").alias("conversation_title"))
    return chunks.join(shown, "conversation_id").select("chunk_id", "conversation_id", "conversation_title", "chunk_index", "chunk_title", "start_message_ordinal", "end_message_ordinal", "summary_short")


def sheet_kind(kind: str, objects: DataFrame, provenance: DataFrame, conversations: DataFrame, states: tuple[str, ...]) -> DataFrame:
    links = search.visible_provenance(provenance, conversations, states).groupBy("object_id").agg(
        F.array_join(F.array_sort(F.collect_set("conversation_id")), ",").alias("source_conversation_ids"), F.array_join(F.array_sort(F.collect_set("chunk_id")), ",").alias("source_chunk_ids")
    )
    return objects.where(F.col("kind") == kind).join(links, "object_id").select("object_id", "kind", "title", "description", "source_conversation_ids", "source_chunk_ids", F.col("state").alias("current_state"))


def sheet_provenance(objects: DataFrame, provenance: DataFrame, conversations: DataFrame, states: tuple[str, ...]) -> DataFrame:
    shown = conversations.where(in_states("state", states)).select("conversation_id", F.col("title").alias("conversation_title"))
    named = objects.select("object_id", F.col("kind").alias("object_kind"), F.col("title").alias("object_title"))
    return provenance.join(shown, "conversation_id").join(named, "object_id").select("link_id", "object_id", "object_kind", "object_title", "conversation_id", "conversation_title", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), F.left("excerpt", F.lit(500)).alias("excerpt"))


def sheet_groups(groups: DataFrame) -> DataFrame:
    """All groups with their members, whatever the profile's states."""
    return groups.groupBy("group_id", "level", "keyword_label").agg(F.count(F.lit(1)).alias("member_count"), F.array_join(F.array_sort(F.collect_list("conversation_id")), ",").alias("member_ids"))


def sheet_review(conversations: DataFrame, messages: DataFrame, chunks: DataFrame, states: tuple[str, ...]) -> DataFrame:
    """For human review: correlated look-ups as joins to aggregates."""
    first = messages.where("role = 'user'").groupBy("conversation_id").agg(F.min_by("content_text", "ordinal").alias("u"))
    sizes = chunks.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    u = F.replace(F.coalesce("u", F.lit("")), F.lit("\n"), F.lit(" "))
    rows = conversations.where(in_states("state", states)).join(first, "conversation_id", "left").join(sizes, "conversation_id", "left")
    return rows.select(
        "conversation_id", "state", "source", "title", "summary_short", F.when(F.length(u) > 500, F.concat(F.left(u, F.lit(497)), F.lit("..."))).otherwise(u).alias("first_user_message"), "message_count",
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit("").alias("operator_decision"), F.lit("").alias("operator_note"),
    )


def listed_groups(groups: DataFrame, level: str | None = None) -> DataFrame:
    """group_id, level, label, member_count by size: the model's label, else the keywords."""
    rows = groups if level is None else groups.where(F.col("level") == level)
    given = F.col("llm_label") if "llm_label" in groups.columns else F.lit(None).cast("string")
    counted = rows.groupBy("group_id", "level").agg(F.max(display_label(given, F.col("keyword_label"))).alias("label"), F.max("keyword_label").alias("words"), F.count(F.lit(1)).alias("member_count"))
    return counted.orderBy(F.desc("member_count"), "words", "group_id").drop("words")
