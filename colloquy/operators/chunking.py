"""Splits conversations into thematic chunks.

Where to cut depends on what came since the last cut, so it is a fold over a
conversation's messages in order: an ``aggregate`` over an array, without any
Python. A second fold merges chunks that are too small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

MIN_MESSAGES = 4
MIN_CHARS = 1200
MAX_CHARS = 9000
NEW_TOPIC = 0.10


def _cuts(messages: Column) -> Column:
    """Positions (from 0) at which a chunk begins, the first excepted."""
    start = F.struct(
        F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<string>").alias("tokens"), F.lit("").alias("before")
    )

    def step(s: Column, m: Column) -> Column:
        turn = (m["role"] == "user") & (s["before"] == "assistant")
        shift = turn & (X.jaccard(s["tokens"], m["tokens"]) < NEW_TOPIC) & (s["n"] >= MIN_MESSAGES) & (s["chars"] >= MIN_CHARS)
        cut = (s["n"] > 0) & (shift | (turn & (s["chars"] >= MAX_CHARS)))
        return F.struct(
            F.when(cut, F.concat(s["cuts"], F.array(s["at"]))).otherwise(s["cuts"]).alias("cuts"),
            (s["at"] + 1).alias("at"),
            F.when(cut, F.lit(1)).otherwise(s["n"] + 1).alias("n"),
            F.when(cut, m["chars"]).otherwise(s["chars"] + m["chars"]).alias("chars"),
            F.when(cut, m["tokens"]).otherwise(F.array_union(s["tokens"], m["tokens"])).alias("tokens"),
            m["role"].alias("before"),
        )

    return F.aggregate(messages, start, step, lambda s: s["cuts"])


def _merged(cuts: Column, total: Column) -> Column:
    """Cuts that remain once chunks under MIN_MESSAGES joined the next, the last one its predecessor."""
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("from"))
    folded = F.aggregate(
        cuts,
        start,
        lambda s, c: F.when(c - s["from"] >= MIN_MESSAGES, F.struct(F.concat(s["cuts"], F.array(c)).alias("cuts"), c.alias("from"))).otherwise(s),
    )
    short = (F.size(folded["cuts"]) > 0) & (total - folded["from"] < MIN_MESSAGES)
    return F.when(short, F.slice(folded["cuts"], 1, F.greatest(F.size(folded["cuts"]) - 1, F.lit(0)))).otherwise(folded["cuts"])


def boundaries(messages: DataFrame) -> DataFrame:
    """conversation_id, raw_cuts, cuts (positions), ordinals."""
    row = F.struct("ordinal", "role", F.length(F.coalesce("content_text", F.lit(""))).cast("long").alias("chars"), X.chunk_tokens(F.col("content_text")).alias("tokens"))
    lists = messages.groupBy("conversation_id").agg(F.sort_array(F.collect_list(row)).alias("m"))
    return (
        lists.select("conversation_id", F.transform("m", lambda x: x["ordinal"]).alias("ordinals"), _cuts(F.col("m")).alias("raw_cuts"))
        .withColumn("cuts", _merged(F.col("raw_cuts"), F.size("ordinals")))
    )


def chunk_ranges(messages: DataFrame) -> DataFrame:
    """conversation_id, chunk_index, start/end_message_ordinal; chunks partition a conversation."""
    bounds = boundaries(messages).withColumn("starts", F.concat(F.array(F.lit(0)), "cuts"))
    return bounds.select("conversation_id", "ordinals", "starts", F.posexplode("starts").alias("chunk_index", "from")).select(
        "conversation_id",
        "chunk_index",
        F.get("ordinals", F.col("from")).alias("start_message_ordinal"),
        F.get("ordinals", F.coalesce(F.get("starts", F.col("chunk_index") + 1), F.size("ordinals")) - 1).alias("end_message_ordinal"),
    )


def in_chunk(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Messages with the chunk whose ordinals hold theirs: an equi-join with a range."""
    c = chunks.select(F.col("conversation_id").alias("_c"), "chunk_index", "start_message_ordinal", "end_message_ordinal", *[x for x in ("chunk_id",) if x in chunks.columns])
    return messages.join(c, (messages["conversation_id"] == c["_c"]) & messages["ordinal"].between(c["start_message_ordinal"], c["end_message_ordinal"])).drop("_c")


def chunk_id(conversation_id: Column, index: Column) -> Column:
    return F.concat(F.lit("chk_"), F.left(F.sha2(F.concat_ws("|", conversation_id, index.cast("string")), 256), F.lit(16)))


def chunk_rows(messages: DataFrame) -> DataFrame:
    """Chunks with title and summary from their first user and assistant messages."""
    ranges = chunk_ranges(messages)

    def first(role: str) -> Column:
        return F.min_by(F.when(F.col("role") == role, F.col("content_text")), F.when(F.col("role") == role, F.col("ordinal")))

    rows = in_chunk(messages, ranges).groupBy("conversation_id", "chunk_index", "start_message_ordinal", "end_message_ordinal").agg(first("user").alias("user"), first("assistant").alias("assistant"))
    return rows.select(
        chunk_id(F.col("conversation_id"), F.col("chunk_index")).alias("chunk_id"),
        "conversation_id",
        "chunk_index",
        "start_message_ordinal",
        "end_message_ordinal",
        X.chunk_title(F.col("user")).alias("chunk_title"),
        F.concat_ws(" | ", F.when(F.col("user").isNotNull(), X.truncate(F.col("user"), 240)), F.when(F.col("assistant").isNotNull(), F.concat(F.lit("-> "), X.truncate(F.col("assistant"), 240)))).alias("summary_short"),
    )
