"""Normalised JSON: one object per conversation with its messages, and back."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MESSAGE = "message_id string, ordinal int, role string, timestamp double, content_text string"


def _shard() -> Column:
    return F.left(F.sha2("conversation_id", 256), F.lit(2))


def shard_path(root: str, conversation_id: str) -> str:
    """Folder of a conversation's line."""
    return f"{root.rstrip('/')}/shard={hashlib.sha256(conversation_id.encode()).hexdigest()[:2]}"


def write(conversations: DataFrame, messages: DataFrame, path: str) -> None:
    """A JSON line per conversation, in folders by the first two digits of its id's hash.

    All is written beside ``path`` first and then takes its place, so a crash
    leaves what was there.
    """
    lists = messages.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "message_id", "role", "timestamp", "content_text"))).alias("messages"))
    rows = conversations.join(lists, "conversation_id", "left").select(F.struct(*[F.col(c) for c in conversations.columns]).alias("conversation"), "messages", _shard().alias("shard"))
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    rows.repartition("shard").write.partitionBy("shard").json(beside)
    _replace(conversations.sparkSession, beside, path)


def _replace(spark: SparkSession, new: str, path: str) -> None:
    """Puts a folder in another's place; without a new one the old one goes."""
    jvm = spark.sparkContext._jvm
    target, made = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(new)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if fs.exists(made):
        fs.rename(made, target)


def remove(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Takes some conversations (conversation_id) out of the written lines; only their shards are written anew."""
    gone = ids.select("conversation_id").distinct()
    touched = [r[0] for r in gone.select(_shard().alias("shard")).distinct().collect()]  # 256 at most
    lines = spark.read.schema("value string, shard string").text(path).where(F.col("shard").isin(*touched) if touched else F.lit(False))
    own = F.get_json_object("value", "$.conversation.conversation_id")
    rest = lines.withColumn("conversation_id", own).join(gone, "conversation_id", "left_anti").select("value", "shard")
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    rest.repartition("shard").write.partitionBy("shard").text(beside)
    for shard in touched:
        _replace(spark, f"{beside}/shard={shard}", f"{path.rstrip('/')}/shard={shard}")
    jvm = spark.sparkContext._jvm
    left = jvm.org.apache.hadoop.fs.Path(beside)
    left.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(left, True)


def read(spark: SparkSession, path: str, conversation_schema: str) -> tuple[DataFrame, DataFrame]:
    """Conversations and messages; lines that aren't such an object are passed over."""
    schema = f"conversation struct<{_fields(conversation_schema)}>, messages array<struct<{_fields(_MESSAGE)}>>, _corrupt string"
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = rows.where("conversation.conversation_id IS NOT NULL")
    conversations = good.select("conversation.*")
    messages = good.select(F.col("conversation.conversation_id").alias("conversation_id"), F.explode("messages").alias("m")).select("conversation_id", "m.*")
    return conversations, messages


def _fields(ddl: str) -> str:
    """Columns of a flat schema as the fields of a struct."""
    return ", ".join(": ".join(f.strip().split(" ", 1)) for f in ddl.split(","))


def written(spark: SparkSession, path: str) -> DataFrame:
    """conversation_id, shard, file of every written line; only ids are taken from the text."""
    lines = spark.read.schema("value string, shard string").text(path).select("value", "shard", F.col("_metadata.file_path").alias("file"))
    return lines.select(F.get_json_object("value", "$.conversation.conversation_id").alias("conversation_id"), "shard", "file").where("conversation_id IS NOT NULL")


def reconciled(spark: SparkSession, path: str, conversations: DataFrame) -> DataFrame:
    """conversation_id, problem, file: lines without a conversation (stray), conversations without a line (missing), lines in another shard (misplaced) and written twice (repeated)."""
    lines, ids = written(spark, path), conversations.select("conversation_id").distinct()
    stray = lines.join(ids, "conversation_id", "left_anti").select("conversation_id", F.lit("stray").alias("problem"), "file")
    missing = ids.join(lines.select("conversation_id"), "conversation_id", "left_anti").select("conversation_id", F.lit("missing").alias("problem"), F.lit(None).cast("string").alias("file"))
    misplaced = lines.where(F.col("shard") != _shard()).select("conversation_id", F.lit("misplaced").alias("problem"), "file")
    repeated = lines.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"), F.max("file").alias("file")).where("n > 1").select("conversation_id", F.lit("repeated").alias("problem"), "file")
    return stray.unionByName(missing).unionByName(misplaced).unionByName(repeated)
