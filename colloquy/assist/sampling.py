"""What a text model is shown: content hashes, sampled messages, rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 12


def content_hash(messages: DataFrame) -> DataFrame:
    """conversation_id, content_hash: changes whenever a message does."""
    line = F.concat(F.col("ordinal").cast("string"), F.lit("|"), "role", F.lit("|"), F.coalesce("content_text", F.lit("")), F.lit("\n"))
    rows = messages.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("m"))
    return rows.select("conversation_id", F.sha2(F.array_join(F.transform("m", lambda x: x["line"]), ""), 256).alias("content_hash"))


def sampled(messages: DataFrame, most: int = MOST) -> DataFrame:
    """User and assistant messages to show: all of a short conversation.

    Of one with more than ``most`` / 2 user messages: the first two and the
    last, evenly stepped ones between, and the assistant's reply to each.
    """
    order = Window.partitionBy("conversation_id").orderBy("ordinal")
    everything = Window.partitionBy("conversation_id")
    user = (F.col("role") == "user").cast("int")
    rows = messages.withColumn("_u", F.sum(user).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_n", F.sum(user).over(everything))
    rest = F.col("_n") - 3
    step = F.greatest(F.lit(1), F.floor(rest / max(1, most // 2 - 3)))
    middle = (F.col("_u") > 2) & (F.col("_u") < F.col("_n")) & ((F.col("_u") - 3) % step == 0)
    rows = rows.withColumn("_pick", (user == 1) & ((F.col("_u") <= 2) | (F.col("_u") == F.col("_n")) | middle))
    # middle picks stop once ``most`` messages with their replies are taken
    reply = (F.lead("role").over(order) == "assistant") & (F.lead("ordinal").over(order) == F.col("ordinal") + 1)
    edge = F.col("_pick") & ((F.col("_u") <= 2) | (F.col("_u") == F.col("_n")))
    weight = F.when(F.col("_pick"), 1 + F.coalesce(reply, F.lit(False)).cast("int")).otherwise(0)
    rows = rows.withColumn("_edge", edge).withColumn("_w", weight)
    taken = F.sum(F.when(F.col("_edge"), F.col("_w")).otherwise(0)).over(everything) + F.coalesce(F.sum(F.when(~F.col("_edge"), F.col("_w")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_keep", F.col("_pick") & (F.col("_edge") | (taken < most)))
    answered = F.coalesce(F.lag("_keep").over(order), F.lit(False)) & (F.col("role") == "assistant") & (F.lag("ordinal").over(order) == F.col("ordinal") - 1)
    short = (F.col("_n") <= most // 2) & F.col("role").isin("user", "assistant")
    return rows.withColumn("_answer", answered).where(short | ((F.col("_n") > most // 2) & (F.col("_keep") | F.col("_answer")))).select(*messages.columns)


def json_lines(messages: Column, most: int = 600) -> Column:
    """An array of messages (role, content_text) as JSON lines with cut texts."""
    return F.array_join(F.transform(messages, lambda m: F.to_json(F.struct(m["role"].alias("role"), F.left(m["content_text"], F.lit(most)).alias("text")))), "\n")


def tagged_lines(messages: Column) -> Column:
    """Lines with role, register and reality mode."""
    line = lambda m: F.concat(F.lit("["), m["role"], F.lit(" | register="), m["register"], F.lit(" | reality_mode="), m["reality_mode"], F.lit("] "), m["content_text"])
    return F.array_join(F.transform(messages, line), "\n")


def transcript(messages: Column, roles: tuple[str, ...] = ("user", "assistant"), most: int = 800) -> Column:
    """``role: text`` lines of the given roles."""
    shown = F.filter(messages, lambda m: m["role"].isin(*roles))
    return F.array_join(F.transform(shown, lambda m: F.concat(m["role"], F.lit(": "), F.left(m["content_text"], F.lit(most)))), "\n")
