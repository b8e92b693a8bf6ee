"""Registers of conversations by plain signals, before any model is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that show a register, in the order in which they count.
SIGNALS = {
    "jailbreak_experiment": ["ignore previous", "ignore all previous", "ignore your instructions", "system prompt", "jailbreak", "dan mode", "developer mode", "bypass", "pretend you have no restrictions"],
    "roleplay": ["roleplay", "you are a", "you're a", "i am a", "let's pretend", "in character", "stay in character", "your character", "act as", "play the role"],
    "creative_writing": ["write me a story", "write a story", "write a poem", "write me a poem", "write a script", "creative writing", "short story about", "fiction about"],
}
FIRST = 6
MOST_CHARS = 500


def heuristic(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """conversation_id, register (null: no signal) from title and early user messages."""
    row = F.struct("ordinal", "role", F.left("content_text", F.lit(MOST_CHARS)).alias("t"))
    lists = messages.groupBy("conversation_id").agg(F.slice(F.sort_array(F.collect_list(row)), 1, FIRST).alias("m"))
    said = F.array_join(F.transform(F.filter("m", lambda x: x["role"] == "user"), lambda x: x["t"]), " ")
    text = F.lower(F.concat_ws(" ", "title", said))
    rows = conversations.select("conversation_id", "title").join(lists, "conversation_id").select("conversation_id", text.alias("t"))
    found = F.lit(None).cast("string")
    for register, phrases in reversed(SIGNALS.items()):
        hit = F.exists(F.array(*map(F.lit, phrases)), lambda s: F.col("t").contains(s))
        found = F.when(hit, register).otherwise(found)
    return rows.select("conversation_id", found.alias("register"))
