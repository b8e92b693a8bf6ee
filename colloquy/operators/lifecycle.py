"""Changes of corpus tables, each a new DataFrame; snapshots are in ``store``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import allowed_transition

Tables = dict[str, DataFrame]


def transitions(conversations: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested (conversation_id, new_state) that are allowed, with old_state."""
    rows = conversations.select("conversation_id", F.col("state").alias("old_state")).join(requests, "conversation_id")
    return rows.where(allowed_transition(F.col("old_state"), F.col("new_state")))


def without_orphans(objects: DataFrame, provenance: DataFrame) -> DataFrame:
    """Objects that some link still names."""
    return objects.join(provenance.select("object_id"), "object_id", "left_semi")


def orphans(objects: DataFrame, provenance: DataFrame) -> DataFrame:
    return objects.join(provenance.select("object_id"), "object_id", "left_anti")


def set_states(tables: Tables, requests: DataFrame) -> Tables:
    """Applies state requests; quarantine also takes chunks, links and what they alone held."""
    allowed = transitions(tables["conversations"], requests).select("conversation_id", "new_state")
    moved = tables["conversations"].join(allowed, "conversation_id", "left").withColumn("state", F.coalesce("new_state", "state")).drop("new_state")
    gone = allowed.where("new_state = 'quarantined'").select("conversation_id")
    provenance = tables["provenance"].join(gone, "conversation_id", "left_anti")
    # objects without any link before stay; what lost its last link goes
    lost = orphans(tables["objects"], provenance).join(tables["provenance"].select("object_id"), "object_id", "left_semi")
    return tables | {
        "conversations": moved,
        "chunks": tables["chunks"].join(gone, "conversation_id", "left_anti"),
        "provenance": provenance,
        "objects": tables["objects"].join(lost.select("object_id"), "object_id", "left_anti"),
    }


def delete(tables: Tables, ids: DataFrame) -> Tables:
    """Removes conversations (conversation_id) from every table, and objects left without a link."""
    out = {name: df.join(ids, "conversation_id", "left_anti") if "conversation_id" in df.columns else df for name, df in tables.items()}
    return out | {"objects": without_orphans(tables["objects"], out["provenance"])}


def delete_plan(objects: DataFrame, provenance: DataFrame, ids: DataFrame) -> DataFrame:
    """object_id, kind, title, others, survives of objects that the deletion touches."""
    doomed = ids.select("conversation_id", F.lit(True).alias("doomed"))
    links = provenance.join(doomed, "conversation_id", "left")
    touched = links.groupBy("object_id").agg(F.count_if("doomed").alias("own"), F.count_if(F.col("doomed").isNull()).alias("others")).where("own > 0")
    return touched.join(objects.select("object_id", "kind", "title"), "object_id").select("object_id", "kind", "title", "others", (F.col("others") > 0).alias("survives"))


def upsert_objects(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merges objects by (kind, canonical_key).

    Title, description and updated_at are the new ones; first_seen stays the
    older, other columns take a new value where there is one. ``new`` may hold
    several rows of a key: the one with the largest seq holds.
    """
    keys = ["kind", "canonical_key"]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in new.columns if c not in (*keys, "seq")]), "seq").alias("n")) if "seq" in new.columns else new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("n"))
    rows = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("o")).join(last, keys, "full_outer")
    fresh = set(last.schema["n"].dataType.names)
    columns = []
    for c in [x for x in old.columns if x not in keys]:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}") if c in fresh else F.lit(None)
        if c in ("title", "description", "updated_at"):
            value = F.when(F.col("n").isNotNull(), n).otherwise(o)
        elif c in ("first_seen", "object_id", "state", "created_at"):
            value = F.coalesce(o, n)
        else:
            value = F.coalesce(n, o)
        columns.append(value.alias(c))
    return rows.select(*keys, *columns)


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` give way to its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def replace_provenance(objects: DataFrame, provenance: DataFrame, links: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects and links after ``links`` took the place of all links of some ``conversations`` (conversation_id).

    A conversation without new links loses those it had; objects that no link
    names any more go.
    """
    kept = provenance.join(conversations.select("conversation_id").distinct(), "conversation_id", "left_anti").select(*provenance.columns).unionByName(links)
    return without_orphans(objects, kept), kept


def upsert_rows(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Whole rows by key, the latest by ``order``."""
    rows = old.unionByName(new)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def merge_objects(objects: DataFrame, provenance: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects and links after each loser_id of ``pairs`` went into its winner_id.

    Pairs of one kind only; unknown ids and pairs of an object with itself are
    passed over; links are repointed, not deduplicated.
    """
    kind = objects.select("object_id", "kind")
    loser = kind.select(F.col("object_id").alias("loser_id"), F.col("kind").alias("lk"))
    winner = kind.select(F.col("object_id").alias("winner_id"), F.col("kind").alias("wk"))
    good = pairs.where("loser_id <> winner_id").join(loser, "loser_id").join(winner, "winner_id").where("lk = wk").select("loser_id", "winner_id")
    moved = provenance.join(good, provenance["object_id"] == good["loser_id"], "left").withColumn("object_id", F.coalesce("winner_id", "object_id")).drop("loser_id", "winner_id")
    return objects.join(good, objects["object_id"] == good["loser_id"], "left_anti"), moved


def rename(objects: DataFrame, object_id: str, title: str) -> DataFrame:
    return objects.withColumn("title", F.when(F.col("object_id") == object_id, F.lit(title.strip())).otherwise(F.col("title")))


def suppress(objects: DataFrame, object_id: str, suppressed: bool = True) -> DataFrame:
    return objects.withColumn("state", F.when(F.col("object_id") == object_id, F.lit("suppressed" if suppressed else "active")).otherwise(F.col("state")))


def _clean(tags: list[str]) -> list[str]:
    return list(dict.fromkeys(t.strip() for t in tags if t.strip()))


def add_tags(conversations: DataFrame, conversation_id: str, tags: list[str]) -> DataFrame:
    """Adds tags in order, none twice."""
    added = F.array_union("manual_tags", F.array(*map(F.lit, _clean(tags))).cast("array<string>"))
    return conversations.withColumn("manual_tags", F.when(F.col("conversation_id") == conversation_id, added).otherwise(F.col("manual_tags")))


def remove_tags(conversations: DataFrame, conversation_id: str, tags: list[str]) -> DataFrame:
    left = F.array_except("manual_tags", F.array(*map(F.lit, _clean(tags))).cast("array<string>"))
    return conversations.withColumn("manual_tags", F.when(F.col("conversation_id") == conversation_id, left).otherwise(F.col("manual_tags")))


def link_project(conversations: DataFrame, conversation_id: str, project_id: str | None) -> DataFrame:
    """Sets or (None) clears a conversation's primary project."""
    return conversations.withColumn("primary_project_id", F.when(F.col("conversation_id") == conversation_id, F.lit(project_id)).otherwise(F.col("primary_project_id")))


def update_meta(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """Takes the non-null values of ``changes`` (conversation_id and any columns)."""
    names = [c for c in changes.columns if c != "conversation_id"]
    renamed = changes.select("conversation_id", *[F.col(c).alias("_" + c) for c in names])
    rows = conversations.join(renamed, "conversation_id", "left")
    return reduce(lambda d, c: d.withColumn(c, F.coalesce("_" + c, c)), names, rows).drop(*["_" + c for c in names])
