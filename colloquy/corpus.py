"""A deterministic conversation corpus over the driver's ``conversations`` table.

The source table has no titles, times, states or tags, and none of its text
matches an extraction pattern; all of that is derived from the ids by rule, and
one of a fixed list of sentences is added to each message. The same rules are
written in SQL in ``plans/oracle.py``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import chunking, extraction

EPOCH = 1704067200
#: The time that stands for "now" in ages.
NOW = 1735689600.0
PLANTED = (
    "We decided to use Redis for caching.",
    "I will ship Project Atlas next week.",
    "TODO: revisit the budget.",
    "I still need to email the vendor.",
    "I prefer async standups.",
    "I drafted the spec for billing.",
    "Alice Johnson joined. Alice Johnson left.",
    "CHS CHS CHS review.",
    "I like that idea.",
    "You need to restart it.",
    "SSN 123-45-6789.",
    "Sure John, thanks.",
    "This is an open question for the team.",
    "My rule is to write tests first.",
)


def conversation_name(conv_id: str = "conv_id") -> F.Column:
    return F.format_string("conv_%06d", F.col(conv_id))


@dataclass
class Corpus:
    """The corpus tables; what is derived from others is built when asked for.

    Derived tables that several branches of a plan read are cached (in memory,
    else on disk): in a stored corpus they are tables of their own.
    """

    base: DataFrame
    messages: DataFrame
    register: DataFrame

    @cached_property
    def chunks(self) -> DataFrame:
        return chunking.chunk_rows(self.messages).cache()

    @cached_property
    def hits(self) -> DataFrame:
        return extraction.harvest(self.base, self.messages).cache()

    @cached_property
    def objects(self) -> DataFrame:
        return extraction.objects(self.hits)

    @cached_property
    def provenance(self) -> DataFrame:
        return extraction.provenance(self.hits, self.chunks)

    @cached_property
    def conversations(self) -> DataFrame:
        return extraction.with_scores(self.base, self.messages, self.hits, self.chunks).cache()


def derive(spark: SparkSession, sf_dir: str) -> Corpus:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    planted = F.get(F.array(*map(F.lit, PLANTED)), ((F.col("conv_id") * 31 + F.col("turn")) % len(PLANTED)).cast("int"))
    messages = rows.select(
        F.format_string("msg_%06d_%04d", "conv_id", "turn").alias("message_id"),
        conversation_name().alias("conversation_id"),
        F.col("turn").cast("int").alias("ordinal"),
        "role",
        (F.lit(EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60).cast("double").alias("timestamp"),
        F.concat(F.coalesce("text", F.lit("")), F.lit(" "), planted).alias("content_text"),
    )
    ids = rows.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("message_count"), F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("opening"))
    created = (F.lit(EPOCH) + F.col("conv_id") * 3600).cast("double")
    digit, tag = F.col("conv_id") % 10, F.col("conv_id") % 4
    base = ids.select(
        conversation_name().alias("conversation_id"),
        F.when(F.col("conv_id") % 2 == 0, "chatgpt").otherwise("claude").alias("source"),
        F.left(F.coalesce(X.first_line(F.col("opening")), F.lit("Untitled")), F.lit(80)).alias("title"),
        created.alias("created_at"),
        F.when(F.col("conv_id") % 7 != 0, created + F.col("message_count") * 60).alias("updated_at"),
        F.when(digit <= 5, "indexed").when(digit <= 7, "private").when(digit == 8, "pending_review").otherwise("quarantined").alias("state"),
        "message_count",
        F.when(tag == 0, F.array(F.lit("architecture"))).when(tag == 1, F.array(F.lit("backend"))).when(tag == 2, F.array(F.lit("architecture"), F.lit("backend"))).otherwise(F.array().cast("array<string>")).alias("manual_tags"),
        F.array().cast("array<string>").alias("auto_tags"),
    )
    mode = F.col("conv_id") % 5
    register = ids.select(
        conversation_name().alias("conversation_id"),
        F.when(mode == 0, "work").when(mode == 1, "research").when(mode == 2, "roleplay").when(mode == 4, "personal").alias("dominant_register"),
    )
    return Corpus(base, messages, register)
