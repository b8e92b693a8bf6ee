"""What a model was asked and which conversations it has treated, kept in the store.

Two tables: ``model_cache`` (prompt_key, response, last_used) and
``model_done`` (conversation_id, task, content_hash, at). An answer is asked
for once; a conversation is treated again only when its messages change.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lifecycle, scratch, views
from ..operators.store import Store
from . import runner, sampling, tasks

CACHE = "prompt_key string, response string, last_used double"
DONE = "conversation_id string, task string, content_hash string, at double"
#: Answers that are kept at most.
MOST_ANSWERS = 100_000
_PARTS = 1 << 20


def used(cache: DataFrame, asked: DataFrame, fresh: DataFrame, now: float) -> DataFrame:
    """The cache after a run: answers to what was asked are used now, fresh ones are put in if absent."""
    keys = asked.select("prompt_key").distinct().withColumn("_used", F.lit(True))
    old = cache.join(keys, "prompt_key", "left").select("prompt_key", "response", F.when(F.col("_used"), F.lit(now)).otherwise(F.col("last_used")).alias("last_used"))
    new = fresh.select("prompt_key", "response").dropDuplicates(["prompt_key"]).join(cache.select("prompt_key"), "prompt_key", "left_anti")
    return old.unionByName(new.withColumn("last_used", F.lit(float(now))))


def evicted(cache: DataFrame, most: int = MOST_ANSWERS) -> DataFrame:
    """At most ``most`` rows, those used last.

    The time from which answers stay is an approximate quantile; of those last
    used at that very time, a share stays by a hash of the key. Neither sorts
    the cache.
    """
    n = cache.count()
    if n <= most:
        return cache
    if most <= 0:
        return cache.limit(0)
    edge = cache.agg(F.percentile_approx("last_used", 1 - most / n, 100_000)).first()[0]
    later, ties = cache.agg(F.count_if(F.col("last_used") > edge), F.count_if(F.col("last_used") == edge)).first()
    if later > most:  # the quantile was too low
        return evicted(cache.where(F.col("last_used") > edge), most)
    place, share = F.pmod(F.xxhash64("prompt_key"), F.lit(_PARTS)), (most - later) / max(ties, 1)
    while True:
        kept = cache.where((F.col("last_used") > edge) | ((F.col("last_used") == edge) & (place < int(share * _PARTS))))
        if kept.count() <= most:
            return kept
        share *= 0.98


def pending(messages: DataFrame, done: DataFrame, task: str) -> DataFrame:
    """conversation_id, content_hash of conversations whose messages the task hasn't treated as they are."""
    return tasks.pending(messages, done.where(F.col("task") == task))


@dataclass
class Ledger:
    """The two tables in a store."""

    store: Store
    most: int = MOST_ANSWERS

    def _table(self, name: str, ddl: str) -> DataFrame:
        versions = self.store.versions()
        return self.store.read(name) if name in versions else self.store.spark.createDataFrame([], ddl)

    @property
    def cache(self) -> DataFrame:
        return self._table("model_cache", CACHE)

    @property
    def done(self) -> DataFrame:
        return self._table("model_done", DONE)

    def ask(self, rows: DataFrame, task: str, scorer: runner.Scorer, config: runner.Config, now: float) -> DataFrame:
        """``rows`` (with prompt) and their responses; answers are stored, failures aren't."""
        answered, _ = runner.run(rows, task, scorer, config, self.cache)
        told = scratch.table(answered, "answers")
        fresh = told.where("response IS NOT NULL").select("prompt_key", "response")
        self.store.commit({"model_cache": evicted(scratch.table(used(self.cache, told, fresh, now), "cache"), self.most)})
        return told

    def treat(self, messages: DataFrame, task: str, work: Callable[[DataFrame], DataFrame], now: float, changed: Callable[[DataFrame, DataFrame], dict[str, DataFrame]]) -> int:
        """Does ``work`` on the messages of pending conversations and commits what ``changed`` makes of its result, with their hashes.

        ``changed`` takes the result and the treated ids and returns tables to
        write; they and the hashes become current together, so a crash leaves
        the work pending. Returns how many conversations were treated.
        """
        todo = scratch.table(pending(messages, self.done, task), "pending")
        n = todo.count()
        if n:
            result = scratch.table(work(messages.join(todo.select("conversation_id"), "conversation_id", "left_semi")), "treated")
            mine = todo.select("conversation_id", F.lit(task).alias("task"), "content_hash", F.lit(float(now)).alias("at"))
            rest = self.done.join(mine.select("conversation_id", "task"), ["conversation_id", "task"], "left_anti").select(*mine.columns)
            self.store.commit(changed(result, todo.select("conversation_id")) | {"model_done": rest.unionByName(mine)})
        return n

    def classify(self, conversations: DataFrame, messages: DataFrame, scorer: runner.Scorer, config: runner.Config, now: float) -> int:
        """Dominant registers of conversations that are new or changed, into the store's ``register`` table."""
        old = self._table("register", "conversation_id string, dominant_register string")

        def changed(found: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
            rest = old.join(ids, "conversation_id", "left_anti").select("conversation_id", "dominant_register")
            return {"register": rest.unionByName(found)}

        work = lambda said: views.dominant_register(tasks.classify(conversations.join(said.select("conversation_id").distinct(), "conversation_id", "left_semi"), said, scorer, config, self.cache))
        return self.treat(messages, "classify", work, now, changed)

    def extract(self, messages: DataFrame, scorer: runner.Scorer, config: runner.Config, now: float) -> int:
        """Objects that the model names, merged by kind and key into the store's ``model_objects`` (kind, canonical_key, title, updated_at)."""
        old = self._table("model_objects", "kind string, canonical_key string, title string, updated_at double")

        def changed(found: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
            key = F.regexp_replace(F.lower(F.trim("title")), r"\s+", " ")
            new = found.groupBy("kind", key.alias("canonical_key")).agg(F.min("title").alias("title")).withColumn("updated_at", F.lit(float(now)))
            return {"model_objects": lifecycle.upsert_objects(old, new).select(*old.columns)}

        return self.treat(messages, "extract", lambda said: tasks.extract(said, scorer, config, self.cache), now, changed)


def content_hashes(messages: DataFrame, task: str, now: float) -> DataFrame:
    """Ledger rows that say that a task has treated these messages as they are."""
    return sampling.content_hash(messages).select("conversation_id", F.lit(task).alias("task"), "content_hash", F.lit(float(now)).alias("at"))
