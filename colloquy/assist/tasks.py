"""Model tasks as plans: classification, extraction, summaries, chunk gating, labels, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import chunking, scratch, search, views
from ..schema import VISIBLE, in_states
from . import registers, runner, sampling

SHORT = 30
#: Passes over chunk boundaries, and messages that are shown of each side.
GATE_PASSES = 10
GATE_MESSAGES = 3
GENERIC_NAMES = ("general", "misc", "miscellaneous", "other", "various", "conversation", "conversations", "chat", "group")
_CLASSIFY = "Give the register of each user message as JSON [{\"ordinal\": n, \"register\": name}].\n<<MESSAGES>>"
_EXTRACT = "Give the decisions, open loops and entities as JSON {\"items\": [{\"kind\": name, \"title\": text}]}.\n<<MESSAGES>>"
_SUMMARY = "Summarise this conversation.\n<<MESSAGES>>"
_SAME = "Do these two parts of a conversation treat one topic? Answer yes or no.\n<<BEFORE>>\n---\n<<AFTER>>"
_NAME = "Name the theme of these conversations in at most five words.\n<<TITLES>>"


def _lists(messages: DataFrame, *more: str) -> DataFrame:
    return messages.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "role", "content_text", *more))).alias("m"))


def pending(messages: DataFrame, meta: DataFrame | None) -> DataFrame:
    """conversation_id, content_hash of conversations that changed since they were treated."""
    now = sampling.content_hash(messages)
    if meta is None:
        return now
    return now.join(meta.select("conversation_id", "content_hash"), ["conversation_id", "content_hash"], "left_anti")


def classify(conversations: DataFrame, messages: DataFrame, scorer: runner.Scorer, config: runner.Config, cache: DataFrame | None = None) -> DataFrame:
    """Messages with register: by plain signals where there are any, else by the model on a sample, carried forward."""
    plain = registers.heuristic(conversations, messages)
    open_ = plain.where("register IS NULL").select("conversation_id")
    shown = sampling.sampled(messages.join(open_, "conversation_id", "left_semi"))
    prompts = _lists(shown).select("conversation_id", runner.render(_CLASSIFY, messages=sampling.json_lines(F.col("m"))).alias("prompt"))
    answered, _ = runner.run(prompts, "classify", scorer, config, cache)
    found = answered.select("conversation_id", F.explode(runner.first_json(F.col("response"), "array<struct<ordinal:int,register:string>>")).alias("x")).select("conversation_id", "x.ordinal", "x.register")
    labelled = messages.join(found.dropDuplicates(["conversation_id", "ordinal"]), ["conversation_id", "ordinal"], "left")
    filled = views.forward_filled(labelled, "register")
    return filled.join(plain.withColumnRenamed("register", "_plain"), "conversation_id").withColumn("register", F.coalesce("_plain", "register")).drop("_plain")


def extract(messages: DataFrame, scorer: runner.Scorer, config: runner.Config, cache: DataFrame | None = None) -> DataFrame:
    """conversation_id, kind, title that the model names."""
    prompts = _lists(sampling.sampled(messages)).select("conversation_id", runner.render(_EXTRACT, messages=sampling.json_lines(F.col("m"))).alias("prompt"))
    answered, _ = runner.run(prompts, "extract", scorer, config, cache)
    items = runner.first_json(F.col("response"), "struct<items:array<struct<kind:string,title:string>>>")
    return answered.select("conversation_id", F.explode(items["items"]).alias("x")).select("conversation_id", F.lower("x.kind").alias("kind"), "x.title").where("kind IN ('project', 'entity', 'decision', 'open_loop', 'artifact', 'preference') AND trim(title) <> ''")


def summarise(conversations: DataFrame, messages: DataFrame, scorer: runner.Scorer, config: runner.Config, cache: DataFrame | None = None) -> DataFrame:
    """conversation_id, summary of conversations without a model's summary yet."""
    todo = conversations.where("coalesce(summary_source, '') <> 'llm'").select("conversation_id") if "summary_source" in conversations.columns else conversations.select("conversation_id")
    first = messages.join(todo, "conversation_id", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("conversation_id").orderBy("ordinal"))).where("_n <= 40").drop("_n")
    prompts = _lists(first).select("conversation_id", runner.render(_SUMMARY, messages=sampling.transcript(F.col("m"))).alias("prompt"))
    answered, _ = runner.run(prompts, "summarize", scorer, config, cache)
    return answered.where("response IS NOT NULL").select("conversation_id", F.left(F.trim("response"), F.lit(1200)).alias("summary"))


def _sides(messages: DataFrame, ranges: DataFrame, most: int = GATE_MESSAGES) -> DataFrame:
    """ranges' rows with head and tail: transcripts of their first and last messages; no chunk is gathered as a whole."""
    part = ["conversation_id", "chunk_index"]
    rows = chunking.in_chunk(messages.select("conversation_id", "ordinal", "role", "content_text"), ranges.select(*part, "start_message_ordinal", "end_message_ordinal"))
    first, last = Window.partitionBy(*part).orderBy("ordinal"), Window.partitionBy(*part).orderBy(F.desc("ordinal"))
    ends = rows.withColumns({"_a": F.row_number().over(first), "_z": F.row_number().over(last)}).where((F.col("_a") <= most) | (F.col("_z") <= most))
    said = F.struct("ordinal", "role", "content_text")
    lists = ends.groupBy(*part).agg(*[F.sort_array(F.collect_list(F.when(F.col(c) <= most, said))).alias(n) for c, n in (("_a", "head"), ("_z", "tail"))])
    return ranges.join(lists.select(*part, sampling.transcript(F.col("head")).alias("head"), sampling.transcript(F.col("tail")).alias("tail")), part, "left")


def gate_chunks(messages: DataFrame, chunks: DataFrame, scorer: runner.Scorer, config: runner.Config, cache: DataFrame | None = None, passes: int = GATE_PASSES) -> DataFrame:
    """Chunk ranges with neighbours merged where the model says yes, under fresh ids; failures keep the boundary.

    A pass asks about all boundaries that may have changed, of all
    conversations at once, and merges what belongs together; only boundaries
    next to a merge are asked about again. It ends when nothing merges, after
    ``passes`` at the latest. Answers are written, so that the model is asked
    once for each.
    """
    order = Window.partitionBy("conversation_id").orderBy("chunk_index")
    ranges = scratch.table(chunks.select("conversation_id", "chunk_index", "start_message_ordinal", "end_message_ordinal", F.lit(True).alias("ask")), "gate")
    for _ in range(passes):
        sides = _sides(messages, ranges).withColumns({"_next": F.lead("head").over(order)})
        prompt = runner.render(_SAME, before=F.col("tail"), after=F.col("_next"))
        prompts = sides.where("ask AND coalesce(tail, '') <> '' AND coalesce(_next, '') <> ''").select("conversation_id", "chunk_index", prompt.alias("prompt"))
        answered, fresh = runner.run(prompts, "chunk_gating", scorer, config, cache)
        told = scratch.table(answered.select("conversation_id", "chunk_index", "prompt_key", "response"), "gate-answers")
        if told.where(_yes()).isEmpty():
            break
        known = told.where("response IS NOT NULL").select("prompt_key", "response").dropDuplicates(["prompt_key"])
        cache = known if cache is None else scratch.table(cache.select("prompt_key", "response").unionByName(known.join(cache.select("prompt_key"), "prompt_key", "left_anti")), "gate-cache")
        marked = ranges.join(told.select("conversation_id", "chunk_index", _yes().alias("same")), ["conversation_id", "chunk_index"], "left")
        begins = F.sum(F.when(F.coalesce(F.lag("same").over(order), F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        merged = marked.withColumn("part", (begins - 1).cast("int")).groupBy("conversation_id", F.col("part").alias("chunk_index")).agg(
            F.min("start_message_ordinal").alias("start_message_ordinal"), F.max("end_message_ordinal").alias("end_message_ordinal"), (F.count(F.lit(1)) > 1).alias("grown")
        )
        ranges = scratch.table(merged.withColumn("ask", F.col("grown") | F.coalesce(F.lead("grown").over(order), F.lit(False))).drop("grown"), "gate")
    return ranges.select("conversation_id", chunking.chunk_id(F.col("conversation_id"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", "start_message_ordinal", "end_message_ordinal")


def _yes() -> Column:
    return F.lower(F.trim(F.coalesce("response", F.lit("")))).startswith("yes")


def best_text(title: Column, summary: Column) -> Column:
    """``title: summary``, or whichever there is."""
    return F.concat_ws(": ", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(summary), F.lit("")))


def name_groups(members: DataFrame, scorer: runner.Scorer, config: runner.Config, cache: DataFrame | None = None, least: int = 3, most: int = 15) -> DataFrame:
    """group_id, name: from the best members (group_id, title, summary, rank) of groups of three or more."""
    shown = members.where(F.col("rank") <= most).groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("rank", best_text(F.col("title"), F.col("summary")).alias("t")))).alias("m")).where(F.size("m") >= least)
    prompts = shown.select("group_id", runner.render(_NAME, titles=F.array_join(F.transform("m", lambda x: x["t"]), "\n")).alias("prompt"))
    answered, _ = runner.run(prompts, "label_groups", scorer, config, cache)
    name = F.trim(F.regexp_replace(F.split(F.coalesce("response", F.lit("")), "\n")[0], r'^["\s]+|["\s.]+$', ""))
    return answered.select("group_id", F.left(name, F.lit(80)).alias("name")).where(~F.lower("name").isin("", *GENERIC_NAMES))


def profile(conversations: DataFrame, objects: DataFrame, provenance: DataFrame, register: DataFrame, states: tuple[str, ...] = VISIBLE, top: int = 10) -> DataFrame:
    """section, line: what a profile is written from, through visible conversations only."""
    parts = [views.register_shares(conversations, register, states).select(F.lit("registers").alias("section"), F.format_string("%s: %d", "register", "n").alias("line"))]
    shown = search.visible_objects(objects, provenance, conversations, states)
    order = Window.partitionBy("kind").orderBy("title", "object_id")
    lines = shown.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top).select(F.col("kind").alias("section"), F.col("title").alias("line"))
    count = conversations.where(in_states("state", states)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("conversations").alias("section"), F.col("n").cast("string").alias("line"))
    return parts[0].unionByName(lines).unionByName(count)
