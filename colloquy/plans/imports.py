"""Queries over exports that are written first, from the ``conversations`` table.

A first batch holds each conversation as a tree (even ids) or a list (odd ids,
and every tenth also as a list, so that two sources share an id), some of them
twice and some also in an older version. A second batch holds newer versions
with one more message, unchanged copies, and versions older than what is stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import import_exports
from ..corpus import NOW
from ..operators import scratch
from ..operators.store import Store
from ..sources import exports

#: Conversations of one export file.
FILE_CONVERSATIONS = 500
NAMES = r"\.txt$"
ADDED = "One more message."

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _tree(title: Column, updated: Column, turns: Column) -> Column:
    """A conversation whose messages are a chain of nodes."""
    name = lambda k: F.concat(F.lit("n"), k.cast("string"))
    last = F.size(turns) - 1

    def node(t: Column, k: Column) -> Column:
        message = F.struct(name(k).alias("id"), F.struct(t["role"].alias("role")).alias("author"), F.struct(F.lit("text").alias("content_type"), F.array(t["text"]).alias("parts")).alias("content"))
        children = F.when(k < last, F.array(name(k + 1))).otherwise(F.array().cast("array<string>"))
        return F.struct(name(k).alias("key"), F.struct(name(k).alias("id"), F.when(k > 0, name(k - 1)).alias("parent"), children.alias("children"), message.alias("message")).alias("value"))

    mapping = F.map_from_entries(F.transform(turns, node))
    return F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id")).alias("id"), title.alias("title"), F.lit(1e9).alias("create_time"), updated.alias("update_time"), name(last).alias("current_node"), mapping.alias("mapping")))


def _list(title: Column, updated: Column, turns: Column) -> Column:
    """A conversation whose messages are a list."""
    said = F.transform(turns, lambda t, k: F.struct(k.cast("string").alias("uuid"), t["role"].alias("sender"), t["text"].alias("text")))
    return F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id")).alias("uuid"), title.alias("name"), updated.cast("string").alias("updated_at"), said.alias("chat_messages")))


def write_exports(spark: SparkSession, sf_dir: str) -> str:
    """Writes both batches; the folder that holds ``first`` and ``second``."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id IS NOT NULL")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = scratch.table(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")), "talks")
    c, at, turns = F.col("conv_id"), F.col("conv_id").cast("double"), F.col("turns")
    added = F.concat(turns, F.array(F.struct(F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(ADDED).alias("text"))))
    path = scratch.new_path(spark, "exports")
    made: dict[str, list[DataFrame]] = {"first": [], "second": []}
    for kind, json, title, which in (("tree", _tree, "T", c % 2 == 0), ("list", _list, "L", (c % 2 == 1) | (c % 10 == 0))):
        mine = talks.where(which)

        def copies(batch: str, label: str, some: Column | None, title_: Column, updated: Column, turns_: Column, kind=kind, json=json, mine=mine) -> None:
            file = F.format_string(f"{kind}-{label}-%d", F.floor(c / FILE_CONVERSATIONS))
            made[batch].append((mine if some is None else mine.where(some)).select(file.alias("file"), json(title_, updated, turns_).alias("json")))

        named = lambda prefix: F.concat(F.lit(prefix), c.cast("string"))
        copies("first", "a", None, named(title), at + 1.5e9, turns)
        copies("first", "b", c % 7 == 0, named(title), at + 1.5e9, turns)
        copies("first", "c", c % 9 == 0, named("old"), at + 1.3e9, turns)
        copies("second", "a", c % 3 == 0, named("U"), at + 1.6e9, added)
        copies("second", "b", c % 3 == 1, named(title), at + 1.5e9, turns)
        copies("second", "c", (c % 3 == 2) & (c % 4 == 0), named("stale"), at + 1.4e9, turns)
    for batch, parts in made.items():
        everything = parts[0]
        for part in parts[1:]:
            everything = everything.unionByName(part)
        texts = everything.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("json"), ","), F.lit("]")).alias("value"))
        texts.write.partitionBy("file").text(f"{path}/{batch}")
    return path


def imported(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame]:
    """A store after both imports, and batch, outcome, n."""
    path = write_exports(spark, sf_dir)
    store = Store(spark, scratch.new_path(spark, "corpus")).init()
    told = []
    for batch in ("first", "second"):
        new = import_exports(spark, f"{path}/{batch}", store.tables(), approve=True, now=NOW, names=NAMES)
        told.append(scratch.table(new.counters.select(F.lit(batch).alias("batch"), "outcome", "n"), "counters"))
        store.commit(new.tables)
    return store, told[0].unionByName(told[1])


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = imported(spark, sf_dir)[0].tables()
    line = F.concat("role", F.lit("|"), "content_text", F.lit("\n"))
    said = tables["messages"].groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.countDistinct("message_id").alias("n_ids"), F.max("ordinal").cast("long").alias("last_ordinal"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"]), ""), 256).alias("said")
    )
    return tables["conversations"].join(said, "conversation_id", "left").select("source", "source_conversation_id", "title", "updated_at", "state", F.col("message_count").cast("long").alias("message_count"), "n_messages", "n_ids", "last_ordinal", "said")


QUERIES["s13_import"] = _conversations
QUERIES["s13_counters"] = lambda spark, sf_dir: imported(spark, sf_dir)[1]

#: Conversations whose turns make one tree.
TREE_CONVERSATIONS = 60


def _deep_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of trees of hundreds of nodes: turns of many conversations in a chain; every third node also has a leaf that isn't on the path.

    A tree whose number is even names its current node, the others are followed down their last children.
    """
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id IS NOT NULL")
    turn = F.struct("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    trees = rows.groupBy(F.floor(F.col("conv_id") / TREE_CONVERSATIONS).alias("tree")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    name = lambda k: F.concat(F.lit("n"), k.cast("string"))
    leaf = lambda k: F.concat(F.lit("x"), k.cast("string"))
    last = F.size("turns") - 1

    def entry(key: Column, parent: Column, children: Column, role: Column, text: Column) -> Column:
        message = F.struct(key.alias("id"), F.struct(role.alias("role")).alias("author"), F.struct(F.lit("text").alias("content_type"), F.array(text).alias("parts")).alias("content"))
        return F.struct(key.alias("key"), F.struct(key.alias("id"), parent.alias("parent"), children.alias("children"), message.alias("message")).alias("value"))

    def node(t: Column, k: Column) -> Column:
        on = F.when(k < last, F.array(name(k + 1))).otherwise(F.array().cast("array<string>"))
        return entry(name(k), F.when(k > 0, name(k - 1)), F.when((k % 3 == 0) & (k < last), F.concat(F.array(leaf(k)), on)).otherwise(on), t["role"], t["text"])

    leaves = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda k: (k % 3 == 0) & (k < last)), lambda k: entry(leaf(k), name(k), F.array().cast("array<string>"), F.lit("user"), F.lit("aside")))
    mapping = F.map_from_entries(F.concat(F.transform("turns", node), leaves))
    current = F.when(F.col("tree") % 2 == 0, name(last))
    json = F.to_json(F.struct(F.concat(F.lit("t"), F.col("tree")).alias("id"), F.lit("Deep").alias("title"), F.lit(1e9).alias("create_time"), current.alias("current_node"), mapping.alias("mapping")))
    path = scratch.new_path(spark, "deep")
    # an export is one list, so a file holds one row: of a second list in it nothing would be read
    trees.select(F.concat(F.lit("["), json, F.lit("]")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    messages = exports.parse_exports(exports.read_exports(spark, path, NAMES))[1]
    return messages.select("source_conversation_id", F.col("ordinal").cast("long").alias("ordinal"), "role", "content_text")


QUERIES["s05_tree_paths"] = _deep_trees
ORACLE_SQL["s05_tree_paths"] = f"""
    SELECT 't' || tree AS source_conversation_id, row_number() OVER (PARTITION BY tree ORDER BY conv_id, turn) - 1 AS ordinal, role, text AS content_text
    FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text, conv_id // {TREE_CONVERSATIONS} AS tree FROM conversations WHERE conv_id IS NOT NULL)"""

_KINDS = """
    kind AS (
        SELECT 'chatgpt' AS source, conv_id FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 2 = 0)
        UNION ALL SELECT 'claude', conv_id FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 2 = 1 OR conv_id % 10 = 0)
    )"""
ORACLE_SQL["s13_import"] = f"""
    WITH {_KINDS}, said AS (
        SELECT source, conv_id, turn, role, coalesce(text, '') AS text FROM kind JOIN conversations USING (conv_id) WHERE NOT (source = 'claude' AND trim(coalesce(text, '')) = '')
        UNION ALL SELECT source, conv_id, 1e9, 'user', '{ADDED}' FROM kind WHERE conv_id % 3 = 0
    )
    SELECT source, 'c' || conv_id AS source_conversation_id, CASE WHEN conv_id % 3 = 0 THEN 'U' WHEN source = 'chatgpt' THEN 'T' ELSE 'L' END || conv_id AS title,
           CASE WHEN conv_id % 3 = 0 THEN 1.6e9 ELSE 1.5e9 END + conv_id AS updated_at, 'indexed' AS state, count(*) AS message_count, count(*) AS n_messages, count(*) AS n_ids, count(*) - 1 AS last_ordinal,
           sha256(string_agg(role || '|' || text || chr(10), '' ORDER BY turn)) AS said
    FROM said GROUP BY source, conv_id"""
ORACLE_SQL["s13_counters"] = f"""
    WITH {_KINDS}, copy AS (
        SELECT 'first' AS batch, 'imported' AS outcome FROM kind
        UNION ALL SELECT 'first', 'duplicate' FROM kind WHERE conv_id % 7 = 0
        UNION ALL SELECT 'first', 'older' FROM kind WHERE conv_id % 9 = 0
        UNION ALL SELECT 'second', 'updated' FROM kind WHERE conv_id % 3 = 0
        UNION ALL SELECT 'second', 'duplicate' FROM kind WHERE conv_id % 3 = 1
        UNION ALL SELECT 'second', 'older' FROM kind WHERE conv_id % 3 = 2 AND conv_id % 4 = 0
    )
    SELECT batch, outcome, count(*) AS n FROM copy GROUP BY batch, outcome"""
