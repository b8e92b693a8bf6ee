"""Search surfaces: conversations, chunks, derived objects, listings, projects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import HIDDEN_REGISTERS, KINDS_THAT_HIDE, SEARCHABLE, VISIBLE, in_states
from . import chunking, fts, stored, vectors

TITLE_BOOST = 1.5
LEAST_COSINE = 0.05


def shown_time() -> Column:
    """updated, else created; zero counts as absent."""
    return F.coalesce(F.nullif("updated_at", F.lit(0.0)), F.nullif("created_at", F.lit(0.0)), F.lit(0.0))


def recency(now: float) -> Column:
    """0.5 for now, falling to 0 over two years; 0 without a time."""
    t = shown_time()
    age = F.greatest(F.lit(0.0), (F.lit(now) - t) / 86400.0)
    return F.when(t == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 0.5 * (1.0 - age / 730.0)))


PHRASE_BONUS = 0.75


def phrase_bonus(query: str, *texts: Column) -> Column:
    """0.75 where a query of several words stands in one of the texts, word by word."""
    held = reduce(Column.__or__, [fts.holds_phrase(t, query) for t in texts])
    return F.when(held, F.lit(PHRASE_BONUS)).otherwise(0.0)


def filtered(conversations: DataFrame, *, after: float | None = None, before: float | None = None, sources: tuple[str, ...] = (), registers: tuple[str, ...] = (), register: DataFrame | None = None) -> DataFrame:
    """Date, source and register filters of a search; a null register passes."""
    if after:
        conversations = conversations.where(shown_time() >= after)
    if before:
        conversations = conversations.where(shown_time() <= before)
    if sources:
        conversations = conversations.where(F.col("source").isin(*sources))
    if registers and register is not None:
        known = register.select("conversation_id", "dominant_register")
        conversations = conversations.join(known, "conversation_id", "left").where(F.col("dominant_register").isNull() | F.col("dominant_register").isin(*registers)).drop("dominant_register")
    return conversations


def has_tag(tags: tuple[str, ...]) -> Column:
    """Any of the tags, in any case, among manual and auto tags."""
    mine = F.transform(F.concat("manual_tags", "auto_tags"), F.lower)
    return F.arrays_overlap(mine, F.array(*[F.lit(t.lower()) for t in tags]))


def keyword_search(conversations: DataFrame, messages: DataFrame, query: str, now: float, states: tuple[str, ...] = VISIBLE, state: stored.SearchState | None = None) -> DataFrame:
    """conversation_id, score: the best of title hits (boosted) and message hits.

    Statistics cover all searchable rows; only visible conversations return.
    With stored ``state`` postings are read by term, and a phrase is found by
    the terms' positions, so no message is read; without, texts are scanned.
    """
    indexed = conversations.where(in_states("state", SEARCHABLE))
    bonus = F.least(F.col("importance_score") * 0.05, F.lit(0.5)) + recency(now)
    visible = conversations.where(in_states("state", states)).select("conversation_id", "title", bonus.alias("bonus"))
    titles = state.titles.search(query) if state else fts.bm25(indexed, "conversation_id", ("title", "summary_short"), query)
    a = titles.join(visible, "conversation_id").select("conversation_id", (F.col("bm25") * TITLE_BOOST + F.col("bonus") + phrase_bonus(query, F.col("title"))).alias("score"))
    if state:
        found, phrase = state.messages.search(query), F.lit(False)
        if len(fts.query_tokens(query)) > 1:
            said = state.messages.phrase(query).select(F.col("message_id").alias("_said"))
            found, phrase = found.join(said, found["message_id"] == said["_said"], "left"), F.col("_said").isNotNull()
        text_bonus = F.when(phrase | fts.holds_phrase(F.col("title"), query), F.lit(PHRASE_BONUS)).otherwise(0.0)
    else:
        text_bonus = phrase_bonus(query, F.col("title"), F.col("content_text"))
        searched = messages.join(indexed.select("conversation_id"), "conversation_id", "left_semi")
        found = fts.bm25(searched, "message_id", ("content_text", "role"), query).join(messages.select("message_id", "conversation_id", "content_text"), "message_id")
    b = found.join(visible, "conversation_id").select("conversation_id", (F.col("bm25") + F.col("bonus") + text_bonus).alias("score"))
    return a.unionByName(b).groupBy("conversation_id").agg(F.max("score").alias("score"))


def chunk_bodies(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, body: the chunk's messages in order, blank lines between."""
    rows = chunking.in_chunk(messages, chunks).groupBy("chunk_id", "conversation_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "content_text"))).alias("m"))
    return rows.select("chunk_id", "conversation_id", F.array_join(F.transform("m", lambda x: x["content_text"]), "\n\n").alias("body"))


def chunk_search(conversations: DataFrame, messages: DataFrame, chunks: DataFrame, query: str, states: tuple[str, ...] = VISIBLE, state: stored.SearchState | None = None) -> DataFrame:
    """chunk_id, conversation_id, title, score of chunks that hold the query's terms."""
    if state:
        found = state.chunks.search(query).select("chunk_id", "bm25")
    else:
        eligible = chunks.join(conversations.where(in_states("state", SEARCHABLE)).select("conversation_id"), "conversation_id", "left_semi")
        rows = eligible.join(chunk_bodies(messages, eligible).select("chunk_id", "body"), "chunk_id")
        found = fts.bm25(rows, "chunk_id", ("chunk_title", "summary_short", "body"), query)
    shown = conversations.where(in_states("state", states)).select("conversation_id", F.col("title").alias("conv_title"))
    return found.join(chunks.select("chunk_id", "conversation_id", "chunk_title"), "chunk_id").join(shown, "conversation_id").select(
        "chunk_id", "conversation_id", F.concat_ws(" :: ", "conv_title", "chunk_title").alias("title"), F.col("bm25").alias("score")
    )


def _chunk_cosines(conversations: DataFrame, messages: DataFrame, chunks: DataFrame, text: str, states: tuple[str, ...], state: stored.SearchState | None) -> DataFrame:
    """chunk_id, conversation_id, score: cosine of a text with the chunks of conversations that may be shown."""
    vocab, embedded = (state.vocabulary, state.vectors) if state else stored.embeddings(conversations, messages, chunks)
    q = vectors.embed(conversations.sparkSession.createDataFrame([(0, text)], "q int, text string"), "q", "text", vocab)
    shown = conversations.where(in_states("state", states)).select("conversation_id")
    if state:  # the terms of a text are few: as values they prune what is read of the vectors
        terms = [(r.term, r.w) for r in q.collect()]
        q = conversations.sparkSession.createDataFrame(terms, "term string, w double")
        embedded = embedded.where(F.col("term").isin(*[t for t, _ in terms]) if terms else F.lit(False))
    return vectors.similar(embedded, ("chunk_id", "conversation_id"), q).join(shown, "conversation_id", "left_semi")


def semantic_search(conversations: DataFrame, messages: DataFrame, chunks: DataFrame, query: str, limit: int = 25, states: tuple[str, ...] = VISIBLE, state: stored.SearchState | None = None) -> DataFrame:
    """conversation_id, score: best cosine of a chunk with the query."""
    scored = _chunk_cosines(conversations, messages, chunks, query, states, state).orderBy(F.desc("score"), "chunk_id").limit(2 * limit)
    return scored.where(F.col("score") >= LEAST_COSINE).groupBy("conversation_id").agg(F.max("score").alias("score"))


def hybrid_search(conversations: DataFrame, messages: DataFrame, chunks: DataFrame, query: str, now: float, limit: int = 25, states: tuple[str, ...] = VISIBLE, state: stored.SearchState | None = None) -> DataFrame:
    """conversation_id, score, match_type: keyword and semantic lists fused by reciprocal rank.

    Without any semantic hit the keyword scores stand.
    """
    k = vectors.ranked(keyword_search(conversations, messages, query, now, states, state), "conversation_id", limit=limit)
    s = vectors.ranked(semantic_search(conversations, messages, chunks, query, limit, states, state), "conversation_id", limit=limit)
    both = k.select("conversation_id", F.col("score").alias("k"), F.col("rank").alias("kr")).join(s.select("conversation_id", F.col("rank").alias("sr")), "conversation_id", "full_outer")
    any_semantic = s.agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
    part = lambda r: F.coalesce(1.0 / (vectors.RRF_K + F.col(r) + 1), F.lit(0.0))
    return both.withColumn("any", any_semantic).select(
        "conversation_id",
        F.when(F.col("any"), part("kr") + part("sr")).otherwise(F.col("k")).alias("score"),
        F.when(F.col("kr").isNull(), "semantic").when(F.col("sr").isNull(), "keyword").otherwise("both").alias("match_type"),
    )


def list_conversations(conversations: DataFrame, now: float, *, sources: tuple[str, ...] = (), tags: tuple[str, ...] = (), after: float | None = None, before: float | None = None, has: tuple[str, ...] = (), chunks: DataFrame | None = None, states: tuple[str, ...] = VISIBLE) -> DataFrame:
    """List mode without text: filters first, then score from importance and recency."""
    rows = conversations.where(in_states("state", states))
    time = F.coalesce("updated_at", "created_at")
    if sources:
        rows = rows.where(F.col("source").isin(*sources))
    if after:
        rows = rows.where(time >= after)
    if before:
        rows = rows.where(time <= before)
    if tags:
        rows = rows.where(has_tag(tags))
    if "open_loops" in has:
        rows = rows.where("has_open_loops")
    if "chunks" in has and chunks is not None:
        rows = rows.join(chunks.select("conversation_id"), "conversation_id", "left_semi")
    score = F.col("importance_score") * 0.1 + recency(now)
    return rows.select("conversation_id", "title", F.left(F.coalesce(F.nullif("summary_short", F.lit("")), "title"), F.lit(240)).alias("snippet"), score.alias("score"), "source", "state", time.alias("shown_at"))


def visible_provenance(provenance: DataFrame, conversations: DataFrame, states: tuple[str, ...] = VISIBLE) -> DataFrame:
    """Links to conversations that may be shown."""
    return provenance.join(conversations.where(in_states("state", states)).select("conversation_id"), "conversation_id", "left_semi")


def visible_objects(objects: DataFrame, provenance: DataFrame, conversations: DataFrame, states: tuple[str, ...] = VISIBLE) -> DataFrame:
    """Active objects with a link to a conversation that may be shown."""
    return objects.where("state = 'active'").join(visible_provenance(provenance, conversations, states), "object_id", "left_semi")


def derived_search(objects: DataFrame, provenance: DataFrame, conversations: DataFrame, text: str = "", kinds: tuple[str, ...] = (), states: tuple[str, ...] = VISIBLE) -> DataFrame:
    """Objects whose title (2.0) or description (1.0) holds the text; 0.5 each without text."""
    rows = visible_objects(objects, provenance, conversations, states)
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    if not text:
        return rows.select("object_id", "kind", "title", "description", F.lit(0.5).alias("score"))
    title, description = F.lower("title").contains(text.lower()), F.lower(F.coalesce("description", F.lit(""))).contains(text.lower())
    return rows.where(title | description).select("object_id", "kind", "title", "description", F.when(title, F.lit(2.0)).otherwise(1.0).alias("score"))


def list_objects(kind: str, objects: DataFrame, provenance: DataFrame, conversations: DataFrame, register: DataFrame, *, registers: tuple[str, ...] | None = None, after: float | None = None, before: float | None = None, sources: tuple[str, ...] = (), states: tuple[str, ...] = VISIBLE) -> DataFrame:
    """Objects of a kind through what may be shown.

    Asked-for registers exclude conversations without one; without any, some
    kinds leave out fiction and jailbreaks, and a null register passes.
    """
    shown = filtered(conversations.where(in_states("state", states)), after=after, before=before, sources=sources).join(register.select("conversation_id", "dominant_register"), "conversation_id", "left")
    if registers:
        shown = shown.where(F.col("dominant_register").isin(*registers))
    elif kind in KINDS_THAT_HIDE:
        shown = shown.where(F.col("dominant_register").isNull() | ~F.col("dominant_register").isin(*HIDDEN_REGISTERS))
    links = provenance.join(shown.select("conversation_id"), "conversation_id", "left_semi")
    return objects.where((F.col("kind") == kind) & (F.col("state") == "active")).join(links, "object_id", "left_semi").select("object_id", "title", "description")


def cooccurring(project_id: str, objects: DataFrame, provenance: DataFrame, conversations: DataFrame, states: tuple[str, ...] = VISIBLE) -> DataFrame:
    """object_id, kind, title, shared: other objects in the project's visible conversations."""
    links = visible_provenance(provenance, conversations, states).select("object_id", "conversation_id").distinct()
    mine = links.where(F.col("object_id") == project_id).select("conversation_id")
    near = links.join(mine, "conversation_id", "left_semi").where(F.col("object_id") != project_id).groupBy("object_id").agg(F.count(F.lit(1)).alias("shared"))
    return near.join(objects.where("state = 'active'").select("object_id", "kind", "title"), "object_id")


def project_timeline(project_id: str, provenance: DataFrame, conversations: DataFrame, states: tuple[str, ...] = VISIBLE) -> DataFrame:
    """Conversations of a project, oldest first."""
    mine = provenance.where(F.col("object_id") == project_id).select("conversation_id")
    return conversations.where(in_states("state", states)).join(mine, "conversation_id", "left_semi").select("conversation_id", "title", F.coalesce("created_at", "updated_at").alias("at"))


def find_related(conversations: DataFrame, messages: DataFrame, chunks: DataFrame, context: str, limit: int = 10, states: tuple[str, ...] = VISIBLE, state: stored.SearchState | None = None) -> DataFrame:
    """Conversations by their best chunk's cosine with a text."""
    best = _chunk_cosines(conversations, messages, chunks, context, states, state).groupBy("conversation_id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "conversation_id").limit(limit).where("score >= 0.01").select("conversation_id", F.round("score", 4).alias("score"))
