"""Queries over the derived corpus, one or more per operator."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..assist import ledger, registers, sampling, tasks
from ..corpus import NOW, Corpus, derive
from ..functions import text as X
from ..operators import chunking, cluster, extraction, fts, lifecycle, rules, scratch, search, stored, vectors, views
from ..operators import query as querylang
from ..operators.store import Store
from ..schema import KINDS, SEARCHABLE, VISIBLE, in_states
from ..sources import ingest, normalized
from .oracle import first_line, quoted, sql, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Conversations whose deletion is asked for.
DOOMED = "SELECT conversation_id FROM conv0 WHERE conv_id % 5 = 1"


def query(name: str, body: str | None = None, extra: dict[str, str] | None = None):
    """Registers a function of a corpus under ``name``, with its SQL."""

    def register(f: Callable[[Corpus], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(derive(spark, sf_dir))
        if body is not None:
            ORACLE_SQL[name] = sql(body, extra)
        return f

    return register


@query("c01_cuts", "SELECT conversation_id, array_to_string(raw_cuts, ',') AS raw_cuts FROM raw")
def _(c: Corpus) -> DataFrame:
    return chunking.boundaries(c.messages).select("conversation_id", F.array_join("raw_cuts", ",").alias("raw_cuts"))


@query("c02_merge", "SELECT conversation_id, array_to_string(cuts, ',') AS cuts FROM cut")
def _(c: Corpus) -> DataFrame:
    return chunking.boundaries(c.messages).select("conversation_id", F.array_join("cuts", ",").alias("cuts"))


@query("c03_chunks", "SELECT * FROM chk")
def _(c: Corpus) -> DataFrame:
    return c.chunks


for _kind in ("project", "decision", "open_loop", "preference", "artifact", "entity"):
    _n = {"project": "e01", "decision": "e02", "open_loop": "e03", "preference": "e04", "artifact": "e05", "entity": "e06"}[_kind]

    @query(f"{_n}_{_kind}", f"SELECT conversation_id, ordinal, title, description, excerpt, canonical_key FROM hit WHERE kind = '{_kind}'")
    def _(c: Corpus, kind: str = _kind) -> DataFrame:
        return c.hits.where(F.col("kind") == kind).select("conversation_id", "ordinal", "title", "description", "excerpt", "canonical_key")


@query("e07_provenance", "SELECT * FROM prov")
def _(c: Corpus) -> DataFrame:
    return c.provenance


@query("m04_upsert", "SELECT * FROM obj")
def _(c: Corpus) -> DataFrame:
    return c.objects


@query("e08_scores", "SELECT conversation_id, importance_score, resurfacing_score, has_open_loops, summary_short FROM conv")
def _(c: Corpus) -> DataFrame:
    return c.conversations.select("conversation_id", "importance_score", "resurfacing_score", "has_open_loops", "summary_short")


@query("a13_acronyms", "SELECT conversation_id, token, CAST(n AS BIGINT) AS n FROM acro")
def _(c: Corpus) -> DataFrame:
    seen = c.messages.join(c.base.where("state IN ('indexed', 'private')"), "conversation_id", "left_semi")
    return extraction.acronyms(seen).select("conversation_id", "token", "n")


# ---- listings, predicates, joins

SEEN = "state = 'indexed'"
SHOWN_TIME = "coalesce(nullif(updated_at, 0), nullif(created_at, 0), 0)"


@query("p01_visible", f"SELECT conversation_id, state FROM conv0 WHERE {SEEN}")
def _(c: Corpus) -> DataFrame:
    return c.base.where(in_states("state", VISIBLE)).select("conversation_id", "state")


@query("p02_list_conversations", f"SELECT conversation_id, source, title FROM conv0 WHERE {SEEN} AND source = 'chatgpt' ORDER BY coalesce(updated_at, created_at) DESC, conversation_id LIMIT 20 OFFSET 3")
def _(c: Corpus) -> DataFrame:
    return c.base.where("state = 'indexed' AND source = 'chatgpt'").orderBy(F.coalesce("updated_at", "created_at").desc_nulls_last(), "conversation_id").offset(3).limit(20).select("conversation_id", "source", "title")


@query("p05_tag_any", f"SELECT conversation_id FROM conv0 WHERE {SEEN} AND list_has_any(list_transform(manual_tags, lambda x: lower(x)), ['backend', 'finance'])")
def _(c: Corpus) -> DataFrame:
    return c.base.where(in_states("state", VISIBLE) & search.has_tag(("Backend", "finance"))).select("conversation_id")


@query("p05_has_flags", f"SELECT conversation_id FROM conv WHERE {SEEN} AND has_open_loops AND conversation_id IN (SELECT conversation_id FROM chk)")
def _(c: Corpus) -> DataFrame:
    return search.list_conversations(c.conversations, NOW, has=("open_loops", "chunks"), chunks=c.chunks).select("conversation_id")


@query("p06_register_null_pass", f"SELECT conversation_id FROM conv0 JOIN reg USING (conversation_id) WHERE {SEEN} AND (dominant_register IS NULL OR dominant_register IN ('work'))")
def _(c: Corpus) -> DataFrame:
    return search.filtered(c.base.where(in_states("state", VISIBLE)), registers=("work",), register=c.register).select("conversation_id")


@query("p07_date_truthy", f"SELECT conversation_id, {SHOWN_TIME} AS t FROM conv0 WHERE {SHOWN_TIME} >= 1704150000 AND {SHOWN_TIME} <= 1704300000")
def _(c: Corpus) -> DataFrame:
    return search.filtered(c.base, after=1704150000.0, before=1704300000.0).select("conversation_id", search.shown_time().alias("t"))


@query("p08_ilike", "SELECT conversation_id, title FROM conv0 WHERE title ILIKE '%th%'")
def _(c: Corpus) -> DataFrame:
    return c.base.where(F.col("title").ilike("%TH%")).select("conversation_id", "title")


@query("p10_list_mode", f"SELECT conversation_id, title, left(coalesce(nullif(summary_short, ''), title), 240) AS snippet, importance_score * 0.1e0 + bonus AS score, source, state, coalesce(updated_at, created_at) AS shown_at FROM conv JOIN recency USING (conversation_id) WHERE {SEEN} AND source = 'chatgpt' AND coalesce(updated_at, created_at) >= 1704153600 AND has_open_loops")
def _(c: Corpus) -> DataFrame:
    return search.list_conversations(c.conversations, NOW, sources=("chatgpt",), after=querylang.date_literal("2024-01-02"), has=("open_loops",))


@query("p11_title_or_summary", "SELECT conversation_id, state FROM conv WHERE (title ILIKE '%project%' OR summary_short ILIKE '%project%') AND state IN ('indexed', 'private')")
def _(c: Corpus) -> DataFrame:
    return c.conversations.where((F.col("title").ilike("%project%") | F.col("summary_short").ilike("%project%")) & in_states("state", SEARCHABLE)).select("conversation_id", "state")


@query("p13_lookup", "SELECT * EXCLUDE (conv_id) FROM conv0 WHERE conversation_id = 'conv_000010'")
def _(c: Corpus) -> DataFrame:
    return c.base.where("conversation_id = 'conv_000010'").drop("auto_tags")


@query("p15_redacted", "SELECT conversation_id, state, source, CASE WHEN state = 'indexed' THEN title ELSE '[redacted]' END AS title, message_count FROM conv0")
def _(c: Corpus) -> DataFrame:
    return views.redacted(c.base)


@query("p16_messages_in_order", "SELECT conversation_id, ordinal, role, content_text, row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal) AS place FROM msg")
def _(c: Corpus) -> DataFrame:
    return c.messages.select("conversation_id", "ordinal", "role", "content_text", F.row_number().over(Window.partitionBy("conversation_id").orderBy("ordinal")).cast("long").alias("place"))


VP = "SELECT p.* FROM prov p JOIN conv0 c USING (conversation_id) WHERE state = 'indexed'"


@query("j01_visible_objects", f"SELECT * FROM obj WHERE object_id IN (SELECT object_id FROM ({VP}))")
def _(c: Corpus) -> DataFrame:
    return search.visible_objects(c.objects, c.provenance, c.base)


BODY = "SELECT chunk_id, k.conversation_id, string_agg(content_text, chr(10) || chr(10) ORDER BY ordinal) AS body FROM chk k JOIN msg m ON m.conversation_id = k.conversation_id AND ordinal BETWEEN start_message_ordinal AND end_message_ordinal GROUP BY 1, 2"


@query("j02_chunk_bodies", BODY)
def _(c: Corpus) -> DataFrame:
    return search.chunk_bodies(c.messages, c.chunks)


@query("j03_chunk_of_message", "SELECT message_id, chunk_id FROM msg m JOIN chk k ON m.conversation_id = k.conversation_id AND ordinal BETWEEN start_message_ordinal AND end_message_ordinal")
def _(c: Corpus) -> DataFrame:
    return chunking.in_chunk(c.messages, c.chunks).select("message_id", "chunk_id")


@query("j05_not_in_group", "SELECT conversation_id FROM conv0 WHERE state = 'indexed' AND conv_id % 3 <> 0")
def _(c: Corpus) -> DataFrame:
    group = c.base.where(F.substring("conversation_id", 6, 6).cast("int") % 3 == 0).select("conversation_id")
    return c.base.where(in_states("state", VISIBLE)).join(group, "conversation_id", "left_anti").select("conversation_id")


@query("l09_reconciled", "SELECT conversation_id, CASE WHEN conv_id % 10 = 4 THEN 'stray' ELSE 'missing' END AS problem FROM conv0 WHERE conv_id % 10 IN (3, 4)")
def _(c: Corpus) -> DataFrame:
    """Lines are written of all conversations but some; of others the row is gone."""
    spark, digit = c.base.sparkSession, F.substring("conversation_id", 6, 6).cast("int") % 10
    path = scratch.new_path(spark, "normalized")
    normalized.write(c.base.where(digit != 3), c.messages, path)
    return normalized.reconciled(spark, path, c.base.where(digit != 4)).select("conversation_id", "problem")


@query("j06_orphans", "SELECT object_id, kind FROM obj WHERE object_id NOT IN (SELECT object_id FROM prov WHERE conversation_id NOT IN (SELECT conversation_id FROM prov JOIN obj USING (object_id) WHERE kind = 'decision'))")
def _(c: Corpus) -> DataFrame:
    """Objects that lose their last link when every conversation with a decision is deleted."""
    doomed = c.provenance.join(c.objects.where("kind = 'decision'"), "object_id", "left_semi").select("conversation_id").distinct()
    left = lifecycle.delete({"objects": c.objects, "provenance": c.provenance}, doomed)["provenance"]
    return lifecycle.orphans(c.objects, left).select("object_id", "kind")


@query("j09_meta_left", "SELECT conversation_id, title, dominant_register FROM conv0 LEFT JOIN (SELECT * FROM reg WHERE dominant_register IS NOT NULL) USING (conversation_id)")
def _(c: Corpus) -> DataFrame:
    return c.base.join(c.register.where("dominant_register IS NOT NULL"), "conversation_id", "left").select("conversation_id", "title", "dominant_register")


ATLAS_ID = "obj_" + hashlib.sha256(b"project|atlas").hexdigest()[:16]


@query(
    "j12_cooccurrence",
    f"WITH v AS (SELECT DISTINCT object_id, conversation_id FROM ({VP})) SELECT v.object_id, kind, title, count(*) AS shared FROM v JOIN obj USING (object_id) WHERE conversation_id IN (SELECT conversation_id FROM v WHERE object_id = '{ATLAS_ID}') AND v.object_id <> '{ATLAS_ID}' GROUP BY ALL",
)
def _(c: Corpus) -> DataFrame:
    return search.cooccurring(ATLAS_ID, c.objects, c.provenance, c.base)


@query("j15_project_scope", f"SELECT DISTINCT conversation_id FROM prov WHERE object_id = '{ATLAS_ID}'")
def _(c: Corpus) -> DataFrame:
    return querylang.in_projects(("Atlas",), c.objects, c.provenance)


# ---- aggregates


@query("a01_state_hist", "SELECT state, source, count(*) AS n FROM conv0 GROUP BY ALL")
def _(c: Corpus) -> DataFrame:
    return c.base.groupBy("state", "source").agg(F.count(F.lit(1)).alias("n"))


@query("a02_kind_counts", f"SELECT kind, count(DISTINCT object_id) AS n FROM obj WHERE object_id IN (SELECT object_id FROM ({VP})) GROUP BY kind")
def _(c: Corpus) -> DataFrame:
    return views.kind_counts(c.objects, c.provenance, c.base)


@query("a03_top_objects", f"SELECT object_id, kind, title, count(DISTINCT conversation_id) AS n_conversations FROM ({VP}) JOIN obj USING (object_id) GROUP BY ALL ORDER BY n_conversations DESC, kind, title LIMIT 5")
def _(c: Corpus) -> DataFrame:
    return views.top_objects(c.objects, c.provenance, c.base, 5)


CLASSIFIED = "SELECT *, CASE WHEN (conv_id + ordinal) % 3 = 0 THEN 'work' WHEN (conv_id * 7 + ordinal) % 4 = 1 THEN 'research' WHEN ordinal % 2 = 1 THEN 'personal' END AS register FROM msg"


def _classified(c: Corpus) -> DataFrame:
    conv = F.substring("conversation_id", 6, 6).cast("long")
    o = F.col("ordinal")
    return c.messages.withColumn("register", F.when((conv + o) % 3 == 0, "work").when((conv * 7 + o) % 4 == 1, "research").when(o % 2 == 1, "personal"))


@query("a04_dominant_register", f"SELECT conversation_id, register AS dominant_register FROM (SELECT conversation_id, register, row_number() OVER (PARTITION BY conversation_id ORDER BY count(*) DESC, register) AS k FROM ({CLASSIFIED}) WHERE role = 'user' AND register IS NOT NULL GROUP BY 1, 2) WHERE k = 1")
def _(c: Corpus) -> DataFrame:
    return views.dominant_register(_classified(c))


@query("a05_register_pct", "SELECT register, n, round(100e0 * n / sum(n) OVER (), 1) AS percent FROM (SELECT coalesce(dominant_register, 'other') AS register, count(*) AS n FROM conv0 LEFT JOIN reg USING (conversation_id) WHERE state = 'indexed' GROUP BY 1)")
def _(c: Corpus) -> DataFrame:
    return views.register_shares(c.base, c.register)


@query("a06_listagg", "SELECT object_id, string_agg(DISTINCT conversation_id, ',' ORDER BY conversation_id) AS conversations FROM prov GROUP BY 1")
def _(c: Corpus) -> DataFrame:
    return c.provenance.groupBy("object_id").agg(F.array_join(F.array_sort(F.collect_set("conversation_id")), ",").alias("conversations"))


@query("a10_storage_counts", "SELECT conversation_id, coalesce(m, 0) AS n_messages, coalesce(k, 0) AS n_chunks, coalesce(p, 0) AS n_links FROM conv0 LEFT JOIN (SELECT conversation_id, count(*) AS m FROM msg GROUP BY 1) USING (conversation_id) LEFT JOIN (SELECT conversation_id, count(*) AS k FROM chk GROUP BY 1) USING (conversation_id) LEFT JOIN (SELECT conversation_id, count(*) AS p FROM prov GROUP BY 1) USING (conversation_id)")
def _(c: Corpus) -> DataFrame:
    return views.storage_counts(c.base, c.messages, c.chunks, c.provenance)


@query("a15_extraction_totals", "SELECT kind, count(*) AS n FROM hit GROUP BY 1")
def _(c: Corpus) -> DataFrame:
    return c.hits.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _doomed(c: Corpus) -> DataFrame:
    return c.base.where(F.substring("conversation_id", 6, 6).cast("int") % 5 == 1).select("conversation_id")


@query("a16_delete_plan", f"SELECT object_id, kind, title, others, others > 0 AS survives FROM (SELECT object_id, count(*) FILTER (WHERE conversation_id IN ({DOOMED})) AS own, count(*) FILTER (WHERE conversation_id NOT IN ({DOOMED})) AS others FROM prov GROUP BY 1) JOIN obj USING (object_id) WHERE own > 0")
def _(c: Corpus) -> DataFrame:
    return lifecycle.delete_plan(c.objects, c.provenance, _doomed(c))


# ---- windows


@query("w01_turn_change", "SELECT conversation_id, ordinal, role = 'user' AND coalesce(lag(role) OVER (PARTITION BY conversation_id ORDER BY ordinal), '') = 'assistant' AS changes FROM msg")
def _(c: Corpus) -> DataFrame:
    w = Window.partitionBy("conversation_id").orderBy("ordinal")
    return c.messages.select("conversation_id", "ordinal", ((F.col("role") == "user") & (F.coalesce(F.lag("role").over(w), F.lit("")) == "assistant")).alias("changes"))


@query("w03_forward_fill", f"SELECT conversation_id, ordinal, coalesce(last_value(register IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'other') AS register FROM ({CLASSIFIED})")
def _(c: Corpus) -> DataFrame:
    return views.forward_filled(_classified(c), "register").select("conversation_id", "ordinal", "register")


@query("w04_first_user", "SELECT conversation_id, arg_min(content_text, ordinal) FILTER (WHERE role = 'user') AS u, arg_min(content_text, ordinal) FILTER (WHERE role = 'assistant') AS a FROM msg GROUP BY 1")
def _(c: Corpus) -> DataFrame:
    first = lambda r: F.min_by(F.when(F.col("role") == r, F.col("content_text")), F.when(F.col("role") == r, F.col("ordinal")))
    return c.messages.groupBy("conversation_id").agg(first("user").alias("u"), first("assistant").alias("a"))


#: Ten conversations as one, since none alone is long enough to be sampled.
LONG = "SELECT left(conversation_id, length(conversation_id) - 1) AS conversation_id, role, row_number() OVER (PARTITION BY left(conversation_id, length(conversation_id) - 1) ORDER BY conversation_id, ordinal) - 1 AS ordinal FROM msg"
SAMPLED = f"""SELECT * FROM (
    WITH counted AS (
        SELECT *, sum((role = 'user')::INT) OVER c AS u, sum((role = 'user')::INT) OVER (PARTITION BY conversation_id) AS n, lead(role) OVER c AS next
        FROM ({LONG}) WINDOW c AS (PARTITION BY conversation_id ORDER BY ordinal)
    ), picked AS (
        SELECT *, role = 'user' AND (u <= 2 OR u = n) AS edge,
               role = 'user' AND u > 2 AND u < n AND (u - 3) % greatest(1, floor((n - 3) / 3)) = 0 AS middle, 1 + coalesce(next = 'assistant', false)::INT AS w
        FROM counted
    ), kept AS (
        SELECT *, edge OR (middle AND sum(CASE WHEN edge THEN w ELSE 0 END) OVER (PARTITION BY conversation_id)
            + coalesce(sum(CASE WHEN middle THEN w ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 12) AS keep
        FROM picked
    ), answered AS (
        SELECT *, role = 'assistant' AND coalesce(lag(keep) OVER (PARTITION BY conversation_id ORDER BY ordinal), false) AS answer FROM kept
    )
    SELECT conversation_id, CAST(ordinal AS BIGINT) AS ordinal, role FROM answered
    WHERE CASE WHEN n <= 6 THEN role IN ('user', 'assistant') ELSE keep OR answer END)"""


@query("w06_sampling", SAMPLED)
def _(c: Corpus) -> DataFrame:
    group = F.expr("left(conversation_id, length(conversation_id) - 1)")
    longer = c.messages.select(group.alias("conversation_id"), "role", F.row_number().over(Window.partitionBy(group).orderBy("conversation_id", "ordinal")).alias("at"))
    longer = longer.select("conversation_id", "role", (F.col("at") - 1).cast("long").alias("ordinal"))
    return sampling.sampled(longer).select("conversation_id", "ordinal", "role")


# ---- scalars and tokens


@query("x03_titles", "SELECT conversation_id, ordinal, CASE WHEN length(f) > 80 THEN rtrim(left(f, 77)) || '...' ELSE f END AS title FROM (SELECT *, " + first_line("content_text") + " AS f FROM msg)")
def _(c: Corpus) -> DataFrame:
    return c.messages.select("conversation_id", "ordinal", X.chunk_title(F.col("content_text")).alias("title"))


@query("x08_tokenisers", "SELECT message_id, array_to_string(" + words("content_text", X.CHUNK_WORD, X.CHUNK_STOP) + ", ' ') AS chunk, array_to_string(" + words("content_text", X.TFIDF_WORD, X.TFIDF_STOP) + ", ' ') AS tfidf, array_to_string(" + words("content_text", X.EMBED_WORD, X.EMBED_STOP) + ", ' ') AS embed FROM msg")
def _(c: Corpus) -> DataFrame:
    t = F.col("content_text")
    return c.messages.select("message_id", F.array_join(X._words(t, X.CHUNK_WORD, X.CHUNK_STOP), " ").alias("chunk"), F.array_join(X.tfidf_tokens(t), " ").alias("tfidf"), F.array_join(X.embed_tokens(t), " ").alias("embed"))


@query("x09_jaccard", "SELECT a.conversation_id, a.ordinal, CASE WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0e0 ELSE len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) END AS jaccard FROM cm a JOIN cm b ON a.conversation_id = b.conversation_id AND b.ordinal = a.ordinal + 1")
def _(c: Corpus) -> DataFrame:
    w = Window.partitionBy("conversation_id").orderBy("ordinal")
    rows = c.messages.select("conversation_id", "ordinal", X.chunk_tokens(F.col("content_text")).alias("a"), F.lead("content_text").over(w).alias("next"))
    return rows.where("next IS NOT NULL").select("conversation_id", "ordinal", X.jaccard(F.col("a"), X.chunk_tokens(F.col("next"))).alias("jaccard"))


@query("x10_content_hash", "SELECT conversation_id, sha256(string_agg(ordinal || '|' || role || '|' || content_text || chr(10), '' ORDER BY ordinal)) AS content_hash FROM msg GROUP BY 1")
def _(c: Corpus) -> DataFrame:
    return sampling.content_hash(c.messages)


@query("g09_pending", "SELECT conversation_id, sha256(string_agg(ordinal || '|' || role || '|' || content_text || chr(10), '' ORDER BY ordinal)) AS content_hash FROM msg WHERE CAST(substr(conversation_id, 6) AS INT) % 3 = 0 OR CAST(substr(conversation_id, 6) AS INT) % 4 = 1 GROUP BY 1")
def _(c: Corpus) -> DataFrame:
    """Of a ledger that lacks some conversations and knows others with an earlier text."""
    number = F.substring("conversation_id", 6, 6).cast("int")
    earlier = c.messages.withColumn("content_text", F.when(number % 4 == 1, F.concat("content_text", F.lit(" once"))).otherwise(F.col("content_text")))
    done = ledger.content_hashes(earlier.where(number % 3 != 0), "classify", NOW).unionByName(ledger.content_hashes(c.messages, "extract", NOW))
    return ledger.pending(c.messages, done, "classify")


@query("x11_dates", "SELECT conversation_id, strftime(make_timestamp(CAST(created_at * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S+00:00') AS iso, coalesce(strftime(make_timestamp(CAST(updated_at * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M'), '') AS minute FROM conv0")
def _(c: Corpus) -> DataFrame:
    return c.base.select("conversation_id", X.iso_utc(F.col("created_at")).alias("iso"), X.minute_utc(F.col("updated_at")).alias("minute"))


QUERIES["x14_html_escape"] = lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", X.html_escape(F.col("html")).alias("escaped"))
ORACLE_SQL["x14_html_escape"] = """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages"""


# ---- full text

FOLD = "list_filter(regexp_split_to_array(translate(lower(coalesce({0}, '')), '" + X._MARKED + "', '" + X._PLAIN + "'), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x <> '')"


def bm25_sql(source: str, key: str, texts: tuple[str, ...], query_text: str) -> str:
    terms = fts.query_terms(query_text)
    tokens = FOLD.format(texts[0])
    for t in texts[1:]:
        tokens = f"list_concat({tokens}, {FOLD.format(t)})"
    counted = f"SELECT {key}, len(t) AS l, " + ", ".join(f"len(list_filter(t, lambda x: x = '{x}')) AS f{k}" for k, x in enumerate(terms)) + f" FROM (SELECT *, {tokens} AS t FROM ({source}))"
    part = "CASE WHEN ln((n - n{0} + 0.5e0) / (n{0} + 0.5e0)) > 0 THEN ln((n - n{0} + 0.5e0) / (n{0} + 0.5e0)) ELSE 1e-6 END * f{0} * 2.2e0 / (f{0} + 1.2e0 * (0.25e0 + 0.75e0 * l / al))"
    stats = "SELECT *, count(*) OVER () AS n, avg(l) OVER () AS al, " + ", ".join(f"count(*) FILTER (WHERE f{k} > 0) OVER () AS n{k}" for k in range(len(terms))) + f" FROM ({counted})"
    return f"SELECT {key}, " + " + ".join(part.format(k) for k in range(len(terms))) + f" AS bm25 FROM ({stats}) WHERE " + " AND ".join(f"f{k} > 0" for k in range(len(terms)))


@query("f03_tokens", "SELECT message_id, array_to_string(" + FOLD.format("content_text") + ", ' ') AS tokens FROM msg")
def _(c: Corpus) -> DataFrame:
    return c.messages.select("message_id", F.array_join(X.index_tokens(F.col("content_text")), " ").alias("tokens"))


@query("f04_bm25_messages", f"SELECT message_id, round(bm25, 6) AS bm25 FROM ({bm25_sql('SELECT * FROM emsg', 'message_id', ('content_text', 'role'), 'the vendor')})")
def _(c: Corpus) -> DataFrame:
    seen = c.messages.join(c.base.where(in_states("state", SEARCHABLE)), "conversation_id", "left_semi")
    return fts.bm25(seen, "message_id", ("content_text", "role"), "the vendor").select("message_id", F.round("bm25", 6).alias("bm25"))


QUERIES["f04_bm25_documents"] = lambda spark, d: fts.bm25(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", ("text",), "the of and").select("doc_id", F.round("bm25", 6).alias("bm25"))
ORACLE_SQL["f04_bm25_documents"] = f"SELECT doc_id, round(bm25, 6) AS bm25 FROM ({bm25_sql('SELECT * FROM documents', 'doc_id', ('text',), 'the of and')})"

ASK = "revisit the budget"
KEYWORD = f"""SELECT conversation_id, max(score) AS score FROM (
    SELECT conversation_id, bm25 * 1.5e0 + least(importance_score * 0.05e0, 0.5e0) + bonus + CASE WHEN contains(lower(title), '{ASK}') THEN 0.75e0 ELSE 0e0 END AS score
    FROM ({bm25_sql("SELECT * FROM conv WHERE state IN ('indexed', 'private')", "conversation_id", ("title", "summary_short"), ASK)}) JOIN conv USING (conversation_id) JOIN recency USING (conversation_id) WHERE state = 'indexed'
    UNION ALL SELECT m.conversation_id, bm25 + least(importance_score * 0.05e0, 0.5e0) + bonus + CASE WHEN contains(lower(title || ' ' || content_text), '{ASK}') THEN 0.75e0 ELSE 0e0 END
    FROM ({bm25_sql("SELECT * FROM emsg", "message_id", ("content_text", "role"), ASK)}) JOIN msg m USING (message_id) JOIN conv c ON c.conversation_id = m.conversation_id JOIN recency r ON r.conversation_id = m.conversation_id WHERE state = 'indexed') GROUP BY 1"""


@query("f06_search_conversations", f"SELECT conversation_id, round(score, 6) AS score FROM ({KEYWORD})")
def _(c: Corpus) -> DataFrame:
    return search.keyword_search(c.conversations, c.messages, ASK, NOW).select("conversation_id", F.round("score", 6).alias("score"))


@query("f08_recency", "SELECT conversation_id, round(bonus, 9) AS bonus FROM recency")
def _(c: Corpus) -> DataFrame:
    return c.base.select("conversation_id", F.round(search.recency(NOW), 9).alias("bonus"))


CHUNK_ROWS = f"SELECT k.*, body FROM chk k JOIN ({BODY}) b USING (chunk_id) JOIN conv0 c ON c.conversation_id = k.conversation_id WHERE state IN ('indexed', 'private')"
CHUNK_HITS = f"SELECT chunk_id, k.conversation_id, c.title || ' :: ' || chunk_title AS title, bm25 AS score FROM ({bm25_sql(CHUNK_ROWS, 'chunk_id', ('chunk_title', 'summary_short', 'body'), ASK)}) JOIN chk k USING (chunk_id) JOIN conv0 c ON c.conversation_id = k.conversation_id WHERE state = 'indexed'"


@query("f14_search_chunks", f"SELECT chunk_id, conversation_id, title, round(score, 6) AS score FROM ({CHUNK_HITS})")
def _(c: Corpus) -> DataFrame:
    return search.chunk_search(c.base, c.messages, c.chunks, ASK).withColumn("score", F.round("score", 6))


@query("f15_derived", f"SELECT object_id, kind, title, description, CASE WHEN contains(lower(title), 'redis') THEN 2.0e0 ELSE 1.0e0 END AS score FROM obj WHERE (contains(lower(title), 'redis') OR contains(lower(description), 'redis')) AND object_id IN (SELECT object_id FROM ({VP}))")
def _(c: Corpus) -> DataFrame:
    return search.derived_search(c.objects, c.provenance, c.base, "Redis")


# ---- vectors

TEXTS = "SELECT conversation_id, string_agg(content_text, ' ' ORDER BY ordinal) AS text FROM emsg GROUP BY 1"
EMBED = words("{0}", X.EMBED_WORD, X.EMBED_STOP).replace("{2,}", "{{2,}}")
VOCAB = f"SELECT term, df, ln(((SELECT count(*) FROM ({TEXTS})) + 1) / (df + 1)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM (SELECT DISTINCT conversation_id, unnest({EMBED.format('text')}) AS term FROM ({TEXTS})) GROUP BY 1 ORDER BY df DESC, term LIMIT 256)"


def embed_sql(source: str, key: str, text: str) -> str:
    weights = f"SELECT {key}, term, count(*) / max(total) * max(idf) AS w FROM (SELECT {key}, len(t) AS total, unnest(t) AS term FROM (SELECT {key}, {EMBED.format(text)} AS t FROM ({source}))) JOIN vocab USING (term) GROUP BY 1, 2"
    return f"SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM ({weights})"


ELIGIBLE_BODY = f"SELECT b.* FROM ({BODY}) b JOIN conv0 USING (conversation_id) WHERE state IN ('indexed', 'private')"
VECTORS = {"vocab": VOCAB, "vec": embed_sql(ELIGIBLE_BODY, "chunk_id", "body"), "qvec": embed_sql(f"SELECT 0 AS q, '{ASK}' AS text", "q", "text")}
SEMANTIC = "SELECT conversation_id, max(score) AS score FROM (SELECT chunk_id, conversation_id, sum(v.w * q.w) AS score FROM vec v JOIN qvec q USING (term) JOIN chk USING (chunk_id) JOIN conv0 USING (conversation_id) WHERE state = 'indexed' GROUP BY 1, 2 ORDER BY score DESC, chunk_id LIMIT 50) WHERE score >= 0.05 GROUP BY 1"


@query("f18_vocab_idf", "SELECT term, df, round(idf, 6) AS idf FROM vocab", VECTORS)
def _(c: Corpus) -> DataFrame:
    vocab, _ = stored.embeddings(c.base, c.messages, c.chunks)
    return vocab.select("term", "df", F.round("idf", 6).alias("idf"))


@query("f19_embed", "SELECT chunk_id, term, round(w, 6) AS w FROM vec", VECTORS)
def _(c: Corpus) -> DataFrame:
    _, embedded = stored.embeddings(c.base, c.messages, c.chunks)
    return embedded.select("chunk_id", "term", F.round("w", 6).alias("w"))


def _f20(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return vectors.nearest(e, e.where("vec_id % 100 = 0"))


QUERIES["f20_cosine"] = _f20
ORACLE_SQL["f20_cosine"] = """
    SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS cosine
    FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY cosine DESC, e.vec_id) <= 10"""


@query("f10_semantic", f"SELECT conversation_id, round(score, 6) AS score FROM ({SEMANTIC})", VECTORS)
def _(c: Corpus) -> DataFrame:
    return search.semantic_search(c.base, c.messages, c.chunks, ASK).select("conversation_id", F.round("score", 6).alias("score"))


RANKED = "SELECT conversation_id, row_number() OVER (ORDER BY score DESC, conversation_id) - 1 AS rank FROM ({0}) ORDER BY rank LIMIT 25"
FUSED = f"""SELECT conversation_id, coalesce(1e0 / (61 + k.rank), 0) + coalesce(1e0 / (61 + s.rank), 0) AS score,
    CASE WHEN k.rank IS NULL THEN 'semantic' WHEN s.rank IS NULL THEN 'keyword' ELSE 'both' END AS match_type
    FROM ({RANKED.format(KEYWORD)}) k FULL JOIN ({RANKED.format(SEMANTIC)}) s USING (conversation_id)"""


@query("f12_hybrid", f"SELECT conversation_id, round(score, 9) AS score, match_type FROM ({FUSED})", VECTORS)
def _(c: Corpus) -> DataFrame:
    return search.hybrid_search(c.conversations, c.messages, c.chunks, ASK, NOW).withColumn("score", F.round("score", 9))


@query("f17_find_related", "SELECT conversation_id, round(score, 4) AS score FROM (SELECT conversation_id, max(score) AS score FROM (SELECT chunk_id, conversation_id, sum(v.w * q.w) AS score FROM vec v JOIN qvec q USING (term) JOIN chk USING (chunk_id) JOIN conv0 USING (conversation_id) WHERE state = 'indexed' GROUP BY 1, 2) GROUP BY 1 ORDER BY score DESC, conversation_id LIMIT 10) WHERE score >= 0.01", VECTORS)
def _(c: Corpus) -> DataFrame:
    return search.find_related(c.base, c.messages, c.chunks, ASK)


def _f11(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))
    a = vectors.ranked(o.select("o_custkey", F.round("total", 2).alias("score")), "o_custkey", limit=100)
    b = vectors.ranked(o.select("o_custkey", F.col("n").alias("score")), "o_custkey", limit=100)
    return vectors.fuse([a, b], "o_custkey").select("o_custkey", F.round("rrf", 9).alias("rrf"))


QUERIES["f11_rrf"] = _f11
ORACLE_SQL["f11_rrf"] = """WITH o AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1),
    r AS (SELECT o_custkey, row_number() OVER (ORDER BY total DESC, o_custkey) AS k FROM o UNION ALL SELECT o_custkey, row_number() OVER (ORDER BY n DESC, o_custkey) FROM o)
    SELECT o_custkey, round(sum(1e0 / (60 + k)), 9) AS rrf FROM r WHERE k <= 100 GROUP BY 1"""


# ---- unified query


def _run(c: Corpus, text: str) -> DataFrame:
    return querylang.run(text, conversations=c.conversations, messages=c.messages, chunks=c.chunks, objects=c.objects, provenance=c.provenance, register=c.register, now=NOW)


FINAL = "SELECT hit_type, id, title, round(score, 6) AS score FROM ({0}) ORDER BY round(score, 9) DESC, hit_type, id LIMIT 25"


@query(
    "f16_query_text",
    FINAL.format(f"SELECT 'conversation' AS hit_type, conversation_id AS id, title, score FROM ({FUSED}) JOIN conv0 USING (conversation_id) WHERE source = 'claude' UNION ALL SELECT 'chunk', chunk_id, h.title, score FROM ({CHUNK_HITS}) h JOIN conv0 c USING (conversation_id) WHERE c.source = 'claude' UNION ALL SELECT kind, object_id, title, CASE WHEN contains(lower(title), '{ASK}') THEN 2.0e0 ELSE 1.0e0 END FROM obj WHERE (contains(lower(title), '{ASK}') OR contains(lower(description), '{ASK}')) AND object_id IN (SELECT object_id FROM ({VP}))"),
    VECTORS,
)
def _(c: Corpus) -> DataFrame:
    return _run(c, f"source:claude {ASK}").withColumn("score", F.round("score", 6))


@query("f16_query_kind", FINAL.format(f"SELECT kind AS hit_type, object_id AS id, title, 0.5e0 AS score FROM obj WHERE kind IN ('decision', 'project') AND object_id IN (SELECT object_id FROM ({VP}))"))
def _(c: Corpus) -> DataFrame:
    return _run(c, "kind:decision kind:project").withColumn("score", F.round("score", 6))


@query("f16_query_project", FINAL.format(f"SELECT 'conversation' AS hit_type, conversation_id AS id, title, importance_score * 0.1e0 + bonus AS score FROM conv JOIN recency USING (conversation_id) WHERE state = 'indexed' AND conversation_id IN (SELECT conversation_id FROM prov WHERE object_id = '{ATLAS_ID}') AND list_contains(manual_tags, 'backend')"))
def _(c: Corpus) -> DataFrame:
    return _run(c, 'project:"Atlas" tag:backend').withColumn("score", F.round("score", 6))


# ---- changes


def _tables(c: Corpus) -> dict[str, DataFrame]:
    return {"conversations": c.base, "messages": c.messages, "chunks": c.chunks, "objects": c.objects, "provenance": c.provenance}


NEW_STATE = "CASE conv_id % 4 WHEN 0 THEN 'quarantined' WHEN 1 THEN 'private' WHEN 2 THEN 'indexed' ELSE 'deleted' END"


def _requests(c: Corpus) -> DataFrame:
    k = F.substring("conversation_id", 6, 6).cast("int") % 4
    return c.base.select("conversation_id", F.when(k == 0, "quarantined").when(k == 1, "private").when(k == 2, "indexed").otherwise("deleted").alias("new_state"))


OK = f"SELECT conversation_id, state AS old_state, {NEW_STATE} AS new_state FROM conv0 WHERE {NEW_STATE} <> 'deleted' AND {NEW_STATE} <> state"


@query("m01_transition", OK)
def _(c: Corpus) -> DataFrame:
    return lifecycle.transitions(c.base, _requests(c)).select("conversation_id", "old_state", "new_state")


LEFT = f"SELECT * FROM prov WHERE conversation_id NOT IN (SELECT conversation_id FROM ({OK}) WHERE new_state = 'quarantined')"


@query("m01_quarantine_links", f"SELECT link_id, object_id FROM ({LEFT})")
def _(c: Corpus) -> DataFrame:
    return lifecycle.set_states(_tables(c), _requests(c))["provenance"].select("link_id", "object_id")


@query("m02_delete_links", f"SELECT link_id FROM prov WHERE conversation_id NOT IN ({DOOMED})")
def _(c: Corpus) -> DataFrame:
    return lifecycle.delete(_tables(c), _doomed(c))["provenance"].select("link_id")


@query("m02_delete_cascade", f"SELECT object_id, title FROM obj WHERE object_id IN (SELECT object_id FROM prov WHERE conversation_id NOT IN ({DOOMED}))")
def _(c: Corpus) -> DataFrame:
    return lifecycle.delete(_tables(c), _doomed(c))["objects"].select("object_id", "title")


@query("m06_replace_chunks", "SELECT chunk_id, CASE WHEN conv_id % 2 = 0 THEN 'new' ELSE chunk_title END AS chunk_title FROM chk JOIN conv0 USING (conversation_id)")
def _(c: Corpus) -> DataFrame:
    rows = c.chunks.select("conversation_id", "chunk_id", "chunk_title")
    new = rows.where(F.substring("conversation_id", 6, 6).cast("int") % 2 == 0).withColumn("chunk_title", F.lit("new"))
    return lifecycle.replace_rows(rows, new, "conversation_id").select("chunk_id", "chunk_title")


@query("m08_merge", f"SELECT link_id, CASE WHEN object_id IN (SELECT object_id FROM obj WHERE kind = 'project') THEN '{ATLAS_ID}' ELSE object_id END AS object_id FROM prov")
def _(c: Corpus) -> DataFrame:
    pairs = c.objects.where("kind IN ('project', 'decision')").select(F.col("object_id").alias("loser_id"), F.lit(ATLAS_ID).alias("winner_id"))
    return lifecycle.merge_objects(c.objects, c.provenance, pairs)[1].select("link_id", "object_id")


@query("m09_suppress", f"SELECT object_id, CASE WHEN object_id = '{ATLAS_ID}' THEN 'Atlas 2' ELSE title END AS title, CASE WHEN object_id = '{ATLAS_ID}' THEN 'suppressed' ELSE 'active' END AS state FROM obj")
def _(c: Corpus) -> DataFrame:
    return lifecycle.suppress(lifecycle.rename(c.objects, ATLAS_ID, " Atlas 2 "), ATLAS_ID).select("object_id", "title", "state")


@query("m10_tags", "SELECT conversation_id, CASE WHEN conversation_id = 'conv_000001' THEN 'x,y' WHEN conversation_id = 'conv_000002' THEN 'backend' ELSE array_to_string(manual_tags, ',') END AS tags FROM conv0")
def _(c: Corpus) -> DataFrame:
    rows = lifecycle.add_tags(c.base, "conv_000001", [" x", "y", "x ", ""])
    rows = lifecycle.remove_tags(lifecycle.remove_tags(rows, "conv_000001", ["backend"]), "conv_000002", ["architecture", "none"])
    return rows.select("conversation_id", F.array_join("manual_tags", ",").alias("tags"))


@query("m12_partial_update", "SELECT conversation_id, CASE WHEN conv_id % 3 = 0 THEN 'renamed' ELSE title END AS title FROM conv0")
def _(c: Corpus) -> DataFrame:
    changes = c.base.select("conversation_id", F.when(F.substring("conversation_id", 6, 6).cast("int") % 3 == 0, "renamed").alias("title"))
    return lifecycle.update_meta(c.base, changes).select("conversation_id", "title")


@query("m13_replace_rows", "SELECT conversation_id, CASE WHEN conv_id % 3 = 0 THEN 'other' WHEN conv_id % 5 = 0 THEN 'work' WHEN conv_id % 5 = 1 THEN 'research' WHEN conv_id % 5 = 2 THEN 'roleplay' WHEN conv_id % 5 = 4 THEN 'personal' END AS dominant_register FROM conv0")
def _(c: Corpus) -> DataFrame:
    old = c.register.withColumn("at", F.lit(1))
    new = c.register.where(F.substring("conversation_id", 6, 6).cast("int") % 3 == 0).select("conversation_id", F.lit("other").alias("dominant_register"), F.lit(2).alias("at"))
    return lifecycle.upsert_rows(old, new, "conversation_id", "at").select("conversation_id", "dominant_register")


NUMBER = "CAST(substr(prov.conversation_id, 6) AS INT)"


@query("m05_replace_provenance", f"SELECT object_id, kind, count(*) AS links FROM prov JOIN obj USING (object_id) WHERE {NUMBER} % 4 NOT IN (0, 1) OR ({NUMBER} % 4 = 0 AND kind = 'decision') GROUP BY ALL")
def _(c: Corpus) -> DataFrame:
    """Some conversations keep their decisions only, others nothing."""
    digit = F.substring("conversation_id", 6, 6).cast("int") % 4
    decisions = c.objects.where("kind = 'decision'").select("object_id")
    new = c.provenance.where(digit == 0).join(decisions, "object_id", "left_semi")
    objects, links = lifecycle.replace_provenance(c.objects, c.provenance, new, c.base.where(digit < 2).select("conversation_id"))
    return objects.select("object_id", "kind").join(links.groupBy("object_id").agg(F.count(F.lit(1)).alias("links")), "object_id")


def _of_level(c: Corpus, level: str, n: int) -> DataFrame:
    number = F.substring("conversation_id", 6, 6).cast("int") % n
    group = F.concat_ws("_", F.lit(level), F.lit(n), number)
    return c.base.where(in_states("state", SEARCHABLE)).select(group.alias("group_id"), F.lit(level).alias("level"), F.concat(F.lit("k"), number).alias("keyword_label"), "conversation_id")


LEVELS = "SELECT '{0}_{1}_' || (conv_id % {1}) AS group_id, '{0}' AS level, 'k' || (conv_id % {1}) AS keyword_label, conversation_id FROM conv0 WHERE state IN ('indexed', 'private')"


@query("m07_replace_level", f"{LEVELS.format('broad', 5)} UNION ALL {LEVELS.format('fine', 11)}")
def _(c: Corpus) -> DataFrame:
    """Stored whole once, then the broad level is replaced twice."""
    spark = c.base.sparkSession
    store = Store(spark, scratch.new_path(spark, "levels")).init()
    store.commit({"groups": _of_level(c, "broad", 7).unionByName(_of_level(c, "fine", 11))})
    for n in (3, 5):
        store.replace_parts("groups", "level", {"broad": _of_level(c, "broad", n)})
    return store.read("groups")


@query("l02_listed_groups", f"SELECT group_id, level, CASE WHEN group_id = 'broad_7_2' THEN 'Two' ELSE keyword_label END AS label, count(*) AS member_count FROM ({LEVELS.format('broad', 7)}) GROUP BY ALL")
def _(c: Corpus) -> DataFrame:
    groups = _of_level(c, "broad", 7).unionByName(_of_level(c, "fine", 11))
    return views.listed_groups(groups.withColumn("llm_label", F.when(F.col("group_id") == "broad_7_2", F.lit("Two"))), "broad")


@query("m11_link_project", f"SELECT conversation_id, CASE WHEN conv_id = 4 THEN '{ATLAS_ID}' END AS primary_project_id FROM conv0")
def _(c: Corpus) -> DataFrame:
    """One conversation is linked, another linked and unlinked."""
    rows = c.base.withColumn("primary_project_id", F.lit(None).cast("string"))
    first, second = "conv_000004", "conv_000005"
    rows = lifecycle.link_project(lifecycle.link_project(rows, first, ATLAS_ID), second, ATLAS_ID)
    return lifecycle.link_project(rows, second, None).select("conversation_id", "primary_project_id")


RULES = [
    rules.Rule("ssn", "quarantined", (r"\b\d{3}-\d{2}-\d{4}\b",), "regex"),
    rules.Rule("vendor", "private", ("VENDOR", "budget")),
    rules.Rule("redis", "private", ("Redis",), fields=("messages",), ignore_case=False),
]
MATCHED = r"""SELECT conversation_id, CASE WHEN s > 0 THEN 'quarantined' ELSE 'private' END AS rule_state,
    array_to_string(list_filter([CASE WHEN s > 0 THEN 'rule:ssn x' || s END, CASE WHEN v > 0 THEN 'rule:vendor x' || v END, CASE WHEN r > 0 THEN 'rule:redis x' || r END], lambda x: x IS NOT NULL), '; ') AS notes
    FROM (SELECT conversation_id, s + CAST(regexp_matches(title, t1) OR regexp_matches(summary_short, t1) AS BIGINT) AS s, v + CAST(regexp_matches(title, t2) OR regexp_matches(summary_short, t2) AS BIGINT) AS v, r FROM
        (SELECT conversation_id, '\b\d{3}-\d{2}-\d{4}\b' AS t1, '(?i)vendor|budget' AS t2, count(*) FILTER (WHERE regexp_matches(content_text, '\b\d{3}-\d{2}-\d{4}\b')) AS s,
            count(*) FILTER (WHERE regexp_matches(content_text, '(?i)vendor|budget')) AS v, count(*) FILTER (WHERE contains(content_text, 'Redis')) AS r FROM msg GROUP BY 1) JOIN conv USING (conversation_id)) WHERE s + v + r > 0"""


@query("m15_rules", MATCHED)
def _(c: Corpus) -> DataFrame:
    return rules.evaluate(c.conversations, c.messages, RULES)


RESCANNED = f"SELECT conversation_id, state AS old_state, rule_state AS new_state, notes FROM ({MATCHED}) JOIN conv0 USING (conversation_id) WHERE CASE rule_state WHEN 'quarantined' THEN 2 ELSE 1 END > CASE state WHEN 'quarantined' THEN 2 WHEN 'private' THEN 1 ELSE 0 END"


@query("m16_rescan", RESCANNED)
def _(c: Corpus) -> DataFrame:
    return rules.rescan(c.conversations, c.messages, RULES)


@query("a14_rescan_counters", f"SELECT old_state || '->' || new_state AS label, count(*) AS n, array_to_string(list(conversation_id ORDER BY conversation_id)[1:20], ',') AS examples FROM ({RESCANNED}) GROUP BY 1")
def _(c: Corpus) -> DataFrame:
    return rules.counted(rules.rescan(c.conversations, c.messages, RULES)).withColumn("examples", F.array_join("examples", ","))


@query("s14_initial_state", f"SELECT conversation_id, coalesce(rule_state, 'pending_review') AS state FROM conv0 LEFT JOIN ({MATCHED}) USING (conversation_id)")
def _(c: Corpus) -> DataFrame:
    return rules.initial_state(rules.evaluate(c.conversations, c.messages, RULES), c.base.select("conversation_id"))


# ---- views

for _kind in ("decision", "open_loop", "entity", "project"):
    _hide = "AND (dominant_register IS NULL OR dominant_register NOT IN ('roleplay', 'jailbreak_experiment'))" if _kind != "entity" else ""

    @query(f"v01_{_kind}s", f"SELECT object_id, title, description FROM obj WHERE kind = '{_kind}' AND object_id IN (SELECT object_id FROM prov JOIN conv0 USING (conversation_id) JOIN reg USING (conversation_id) WHERE state = 'indexed' {_hide})")
    def _(c: Corpus, kind: str = _kind) -> DataFrame:
        return search.list_objects(kind, c.objects, c.provenance, c.base, c.register)


@query("v01_filtered", f"SELECT object_id, title, description FROM obj WHERE kind = 'decision' AND object_id IN (SELECT object_id FROM prov JOIN conv0 USING (conversation_id) JOIN reg USING (conversation_id) WHERE state = 'indexed' AND dominant_register = 'roleplay' AND source = 'chatgpt' AND {SHOWN_TIME} >= 1704153600)")
def _(c: Corpus) -> DataFrame:
    return search.list_objects("decision", c.objects, c.provenance, c.base, c.register, registers=("roleplay",), after=1704153600.0, sources=("chatgpt",))


@query("v02_project_view", f"SELECT kind, count(*) AS n, string_agg(title, '; ' ORDER BY title) AS titles FROM (WITH v AS (SELECT DISTINCT object_id, conversation_id FROM ({VP})) SELECT DISTINCT object_id, kind, title FROM v JOIN obj USING (object_id) WHERE conversation_id IN (SELECT conversation_id FROM v WHERE object_id = '{ATLAS_ID}') AND v.object_id <> '{ATLAS_ID}') GROUP BY 1")
def _(c: Corpus) -> DataFrame:
    near = search.cooccurring(ATLAS_ID, c.objects, c.provenance, c.base)
    return near.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("title")), "; ").alias("titles"))


@query("v03_timeline", f"SELECT conversation_id, title, created_at AS at FROM conv0 WHERE state = 'indexed' AND conversation_id IN (SELECT conversation_id FROM prov WHERE object_id = '{ATLAS_ID}') ORDER BY created_at")
def _(c: Corpus) -> DataFrame:
    return search.project_timeline(ATLAS_ID, c.provenance, c.base).orderBy("at", "conversation_id")


MEMBERS = "SELECT 'grp_' || (conv_id % 7) AS group_id, conversation_id FROM conv0 WHERE state IN ('indexed', 'private')"


def _members(c: Corpus) -> DataFrame:
    number = F.substring("conversation_id", 6, 6).cast("int") % 7
    return c.base.where(in_states("state", SEARCHABLE)).select(F.concat(F.lit("grp_"), number.cast("string")).alias("group_id"), "conversation_id")


@query("v04_groups_visible", f"SELECT group_id, count(*) FILTER (WHERE state = 'indexed') AS visible FROM ({MEMBERS}) JOIN conv0 USING (conversation_id) GROUP BY 1 HAVING count(*) FILTER (WHERE state = 'indexed') > 0")
def _(c: Corpus) -> DataFrame:
    rows = _members(c).join(c.base, "conversation_id")
    return rows.groupBy("group_id").agg(F.count_if(in_states("state", VISIBLE)).alias("visible")).where("visible > 0")


@query("v06_health", """SELECT 'chunks_of_no_conversation' AS "check", count(*) FILTER (WHERE conversation_id NOT IN (SELECT conversation_id FROM conv0)) AS n FROM chk
    UNION ALL SELECT 'chunks_without_start_message', count(*) FROM chk k WHERE NOT EXISTS (SELECT 1 FROM msg m WHERE m.conversation_id = k.conversation_id AND ordinal = start_message_ordinal)
    UNION ALL SELECT 'conversations_without_messages', count(*) FROM conv0 WHERE conversation_id NOT IN (SELECT conversation_id FROM msg)
    UNION ALL SELECT 'links_of_no_conversation', count(*) FROM prov WHERE conversation_id NOT IN (SELECT conversation_id FROM conv0)
    UNION ALL SELECT 'links_of_no_object', count(*) FROM prov WHERE object_id NOT IN (SELECT object_id FROM obj)
    UNION ALL SELECT 'links_of_no_chunk', count(*) FROM prov WHERE chunk_id NOT IN (SELECT chunk_id FROM chk)
    UNION ALL SELECT 'messages_of_no_conversation', count(*) FROM msg WHERE conversation_id NOT IN (SELECT conversation_id FROM conv0)
    UNION ALL SELECT 'objects_without_link', count(*) FROM obj WHERE object_id NOT IN (SELECT object_id FROM prov)
    UNION ALL SELECT 'quarantined_with_links', count(*) FROM prov JOIN conv0 USING (conversation_id) WHERE state = 'quarantined'""")
def _(c: Corpus) -> DataFrame:
    return views.health(c.base, c.messages, c.chunks, c.objects, c.provenance)


ISO = "strftime(make_timestamp(CAST({0} * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S+00:00')"


@query("v07_conversations", f"SELECT conversation_id, source, title, {ISO.format('created_at')} AS created_at, coalesce({ISO.format('updated_at')}, '') AS updated_at, state, message_count, summary_short, array_to_string(manual_tags, ', ') AS manual_tags, '' AS auto_tags, importance_score, resurfacing_score, CASE WHEN has_open_loops THEN 'yes' ELSE 'no' END AS has_open_loops, '' AS broad_group_label, '' AS fine_group_label FROM conv WHERE state = 'indexed'")
def _(c: Corpus) -> DataFrame:
    return views.sheet_conversations(c.conversations, None, VISIBLE)


@query("v07_chunks", "SELECT chunk_id, k.conversation_id, title AS conversation_title, chunk_index, chunk_title, start_message_ordinal, end_message_ordinal, k.summary_short FROM chk k JOIN conv0 USING (conversation_id) WHERE state = 'indexed'")
def _(c: Corpus) -> DataFrame:
    return views.sheet_chunks(c.base, c.chunks, VISIBLE)


for _kind in KINDS:

    @query(f"v07_{_kind}", f"SELECT object_id, kind, title, description, c AS source_conversation_ids, k AS source_chunk_ids, state AS current_state FROM obj JOIN (SELECT object_id, string_agg(DISTINCT conversation_id, ',' ORDER BY conversation_id) AS c, string_agg(DISTINCT chunk_id, ',' ORDER BY chunk_id) AS k FROM ({VP}) GROUP BY 1) USING (object_id) WHERE kind = '{_kind}'")
    def _(c: Corpus, kind: str = _kind) -> DataFrame:
        return views.sheet_kind(kind, c.objects, c.provenance, c.base, VISIBLE)


@query("v07_provenance", "SELECT link_id, p.object_id, kind AS object_kind, o.title AS object_title, p.conversation_id, c.title AS conversation_title, chunk_id, left(excerpt, 500) AS excerpt FROM prov p JOIN obj o USING (object_id) JOIN conv0 c ON c.conversation_id = p.conversation_id WHERE c.state = 'indexed'")
def _(c: Corpus) -> DataFrame:
    return views.sheet_provenance(c.objects, c.provenance, c.base, VISIBLE)


@query("v07_groups", f"SELECT group_id, 'broad' AS level, group_id AS keyword_label, count(*) AS member_count, string_agg(conversation_id, ',' ORDER BY conversation_id) AS member_ids FROM ({MEMBERS}) GROUP BY 1")
def _(c: Corpus) -> DataFrame:
    return views.sheet_groups(_members(c).select("group_id", F.lit("broad").alias("level"), F.col("group_id").alias("keyword_label"), "conversation_id"))


@query("v07_summaries_review", "SELECT conversation_id, state, source, title, summary_short, CASE WHEN length(u) > 500 THEN left(u, 497) || '...' ELSE u END AS first_user_message, message_count, coalesce(n, 0) AS chunk_count, '' AS operator_decision, '' AS operator_note FROM conv LEFT JOIN (SELECT conversation_id, count(*) AS n FROM chk GROUP BY 1) USING (conversation_id) LEFT JOIN (SELECT conversation_id, replace(coalesce(arg_min(content_text, ordinal), ''), chr(10), ' ') AS u FROM msg WHERE role = 'user' GROUP BY 1) USING (conversation_id) WHERE state IN ('indexed', 'private')")
def _(c: Corpus) -> DataFrame:
    return views.sheet_review(c.conversations, c.messages, c.chunks, SEARCHABLE)


@query("v09_pending", "SELECT conversation_id, title FROM conv0 WHERE state = 'pending_review' ORDER BY coalesce(updated_at, created_at) DESC, conversation_id LIMIT 50")
def _(c: Corpus) -> DataFrame:
    return c.base.where("state = 'pending_review'").orderBy(F.coalesce("updated_at", "created_at").desc(), "conversation_id").limit(50).select("conversation_id", "title")


# ---- clusters

GROUP_TEXT = "SELECT conversation_id, concat_ws(chr(10), title, title, array_to_string(manual_tags, ' '), '', summary_short) AS text FROM conv WHERE {0}"


def tfidf_parts(where: str, min_df: int) -> dict[str, str]:
    text = GROUP_TEXT.format(where)
    toks = words("text", X.TFIDF_WORD, X.TFIDF_STOP)
    return {
        "tf": f"SELECT conversation_id, term, count(*) AS tf FROM (SELECT conversation_id, unnest({toks}) AS term FROM ({text})) GROUP BY 1, 2",
        "tv": f"SELECT term, count(*) AS df, ln(((SELECT count(*) FROM ({text})) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY 1 HAVING count(*) >= {min_df} ORDER BY df DESC, term LIMIT 4000",
        "tw": "SELECT conversation_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY conversation_id)) AS w FROM (SELECT conversation_id, term, tf * idf AS w FROM tf JOIN tv USING (term))",
        "lab": "SELECT DISTINCT conversation_id, CAST(substr(conversation_id, 6) AS INT) % 4 AS cluster FROM tw",
        "cen": "SELECT cluster, term, w / sqrt(sum(w * w) OVER (PARTITION BY cluster)) AS w FROM (SELECT cluster, term, sum(w) AS w FROM tw JOIN lab USING (conversation_id) GROUP BY 1, 2)",
    }


PRIVATE_TOO = tfidf_parts("state IN ('indexed', 'private')", 2)


def _weights(c: Corpus) -> tuple[DataFrame, DataFrame]:
    w = cluster.tfidf(cluster.group_documents(c.conversations.where(in_states("state", SEARCHABLE))))
    return w, w.select("conversation_id").distinct().withColumn("cluster", F.substring("conversation_id", 6, 6).cast("int") % 4)


@query("k02_tfidf", "SELECT conversation_id, term, round(w, 6) AS w FROM tw", PRIVATE_TOO)
def _(c: Corpus) -> DataFrame:
    return _weights(c)[0].withColumn("w", F.round("w", 6))


@query("x19_dense", "SELECT conversation_id, round(coalesce(max(w) FILTER (term = 'redis'), 0), 4) AS redis, round(coalesce(max(w) FILTER (term = 'budget'), 0), 4) AS budget FROM tw GROUP BY 1", PRIVATE_TOO)
def _(c: Corpus) -> DataFrame:
    rows = vectors.dense(_weights(c)[0], "conversation_id", ["redis", "budget", "nosuchterm"])
    return rows.select("conversation_id", *[F.round(F.col("embedding")[k].cast("double"), 4).alias(t) for k, t in enumerate(("redis", "budget"))])


@query("a12_centroid", "SELECT cluster, term, round(w, 6) AS w FROM cen", PRIVATE_TOO)
def _(c: Corpus) -> DataFrame:
    return cluster.centroids(*_weights(c)).withColumn("w", F.round("w", 6))


@query("k04_one_step", "SELECT conversation_id, cluster FROM (SELECT conversation_id, c.cluster, row_number() OVER (PARTITION BY conversation_id ORDER BY round(sum(tw.w * c.w), 12) DESC, c.cluster) AS k FROM tw JOIN cen c USING (term) GROUP BY 1, 2) WHERE k = 1", PRIVATE_TOO)
def _(c: Corpus) -> DataFrame:
    w, labels = _weights(c)
    return cluster.assign(w, cluster.centroids(w, labels))


@query("k05_distinctive", "SELECT * FROM (SELECT cluster, term, round(w - (sum(w) OVER (PARTITION BY term) - w) / 3, 6) AS margin, row_number() OVER (PARTITION BY cluster ORDER BY round(w - (sum(w) OVER (PARTITION BY term) - w) / 3, 9) DESC, term) AS rank FROM (SELECT cluster, term, w, sum(w) OVER (PARTITION BY term) AS s FROM cen)) WHERE rank <= 5".replace("(sum(w) OVER (PARTITION BY term) - w)", "(s - w)"), PRIVATE_TOO)
def _(c: Corpus) -> DataFrame:
    return cluster.distinctive_terms(*_weights(c)).withColumn("margin", F.round("margin", 6))


@query("k09_sparse_cosine", "SELECT b.conversation_id, round(sum(a.w * b.w), 6) AS cosine FROM tw a JOIN tw b USING (term) WHERE a.conversation_id = 'conv_000010' GROUP BY 1", PRIVATE_TOO)
def _(c: Corpus) -> DataFrame:
    w, _ = _weights(c)
    one = w.where("conversation_id = 'conv_000010'").select("term", "w")
    return vectors.similar(w, "conversation_id", one).select("conversation_id", F.round("score", 6).alias("cosine"))


@query("l04_top_members", "SELECT * FROM (SELECT cluster, conversation_id, round(sum(tw.w * cen.w), 6) AS score, row_number() OVER (PARTITION BY cluster ORDER BY round(sum(tw.w * cen.w), 9) DESC, conversation_id) AS rank FROM tw JOIN lab USING (conversation_id) JOIN cen USING (cluster, term) GROUP BY 1, 2) WHERE rank <= 3", PRIVATE_TOO)
def _(c: Corpus) -> DataFrame:
    return cluster.top_members(*_weights(c), 3).withColumn("score", F.round("score", 6))


@query("k04_kmeans")
def _(c: Corpus) -> DataFrame:
    return cluster.kmeans(_weights(c)[0].cache(), 5)


@query("k06_regroup")
def _(c: Corpus) -> DataFrame:
    return cluster.regroup(c.conversations, 6, "broad")


LLOYD_ROUNDS = 3


def lloyd_parts(rounds: int) -> dict[str, str]:
    """Labels l1, l2, ... and centroids c1, c2, ... of Lloyd steps from ``cen``; an empty cluster keeps its centroid."""
    parts, before = {}, "cen"
    for r in range(1, rounds + 1):
        parts[f"l{r}"] = f"SELECT conversation_id, coalesce(cluster, 0) AS cluster FROM (SELECT DISTINCT conversation_id FROM tw) LEFT JOIN (SELECT conversation_id, c.cluster FROM tw JOIN {before} c USING (term) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY round(sum(tw.w * c.w), 12) DESC, c.cluster) = 1) USING (conversation_id)"
        parts[f"c{r}"] = f"SELECT cluster, term, w / sqrt(sum(w * w) OVER (PARTITION BY cluster)) AS w FROM (SELECT cluster, term, sum(w) AS w FROM tw JOIN l{r} USING (conversation_id) GROUP BY 1, 2) UNION ALL SELECT cluster, term, w FROM {before} WHERE cluster NOT IN (SELECT cluster FROM l{r})"
        before = f"c{r}"
    return parts


FULL_RUN = PRIVATE_TOO | lloyd_parts(LLOYD_ROUNDS)


@query("k04_full_run", f"SELECT conversation_id, cluster FROM l{LLOYD_ROUNDS}", FULL_RUN)
def _(c: Corpus) -> DataFrame:
    w, labels = _weights(c)
    return cluster.kmeans(w, 4, rounds=LLOYD_ROUNDS, start=cluster.centroids(w, labels))


LAST = f"l{LLOYD_ROUNDS}"
NAMED = f"SELECT cluster, string_agg(term, ', ' ORDER BY rank) AS keyword_label FROM (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY round(w - CASE WHEN n > 1 THEN (s - w) / (n - 1) ELSE 0 END, 9) DESC, term) AS rank FROM (SELECT cluster, term, w, sum(w) OVER (PARTITION BY term) AS s, (SELECT count(DISTINCT cluster) FROM {LAST}) AS n FROM ends_at)) WHERE rank <= 5 GROUP BY cluster"


@query("k06_regroup_from", f"SELECT 'grp_' || left(sha256('broad|' || cluster), 16) AS group_id, 'broad' AS level, conversation_id, keyword_label FROM {LAST} JOIN ({NAMED}) USING (cluster)", FULL_RUN | {
    "ends_at": f"SELECT cluster, term, w / sqrt(sum(w * w) OVER (PARTITION BY cluster)) AS w FROM (SELECT cluster, term, sum(w) AS w FROM tw JOIN {LAST} USING (conversation_id) GROUP BY 1, 2)",
})
def _(c: Corpus) -> DataFrame:
    return cluster.regroup(c.conversations, 4, "broad", start=cluster.centroids(*_weights(c)), rounds=LLOYD_ROUNDS)


#: Groups against all visible conversations outside them.
SAFE = tfidf_parts("state = 'indexed'", 1) | {
    "mem": f"SELECT m.* FROM ({MEMBERS}) m JOIN conv0 c USING (conversation_id) WHERE c.state = 'indexed'",
    "inside": "SELECT group_id, term, raw, raw / sqrt(sum(raw * raw) OVER (PARTITION BY group_id)) AS w FROM (SELECT group_id, term, sum(w) AS raw FROM tw JOIN mem USING (conversation_id) GROUP BY 1, 2)",
    "whole": "SELECT term, sum(w) AS everything FROM tw GROUP BY 1",
    "outside": "SELECT group_id, sqrt(sum((everything - coalesce(raw, 0)) * (everything - coalesce(raw, 0)))) AS rest FROM (SELECT DISTINCT group_id FROM inside) JOIN whole ON true LEFT JOIN inside USING (group_id, term) GROUP BY 1",
    "margins": "SELECT group_id, term, row_number() OVER (PARTITION BY group_id ORDER BY round(w - CASE WHEN rest > 1e-9 THEN (everything - raw) / rest ELSE 0 END, 9) DESC, term) AS rank FROM inside JOIN whole USING (term) JOIN outside USING (group_id)",
}


@query("k07_safe_labels", f"SELECT group_id, coalesce(n, 0) AS visible_count, CASE WHEN n >= 3 THEN safe_label END AS safe_label FROM (SELECT DISTINCT group_id FROM ({MEMBERS})) LEFT JOIN (SELECT group_id, count(*) AS n FROM mem GROUP BY 1) USING (group_id) LEFT JOIN (SELECT group_id, string_agg(term, ', ' ORDER BY rank) AS safe_label FROM margins WHERE rank <= 5 GROUP BY 1) USING (group_id)", SAFE)
def _(c: Corpus) -> DataFrame:
    return cluster.safe_labels(c.conversations, _members(c))


# ---- register signals and hashes


@query("g05_heuristic_register", "SELECT conversation_id, CASE " + " ".join(f"WHEN list_bool_or(list_transform({quoted(registers.SIGNALS[r])}, lambda s: contains(t, s))) THEN '{r}'" for r in registers.SIGNALS) + " END AS register FROM (SELECT conversation_id, lower(concat_ws(' ', any_value(title), string_agg(left(content_text, 500), ' ' ORDER BY ordinal) FILTER (WHERE k <= 6 AND role = 'user'))) AS t FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal) AS k FROM msg) JOIN conv0 USING (conversation_id) GROUP BY 1)")
def _(c: Corpus) -> DataFrame:
    return registers.heuristic(c.base, c.messages)


@query("s12_fingerprint", "SELECT conversation_id, sha256(source || chr(1) || conversation_id || chr(1) || title || chr(1) || string_agg(message_id || '|' || role || '|' || content_text || chr(10), '' ORDER BY ordinal)) AS fingerprint FROM msg JOIN conv0 USING (conversation_id) GROUP BY conversation_id, source, title")
def _(c: Corpus) -> DataFrame:
    return ingest.fingerprints(c.base.select("conversation_id", "source", F.col("conversation_id").alias("source_conversation_id"), "title"), c.messages, separator="\x01")


@query("s13_dedupe", "SELECT 'imported' AS outcome, count(*) FILTER (WHERE conv_id % 4 <> 0) AS n FROM conv0 UNION ALL SELECT 'duplicate', count(*) FILTER (WHERE conv_id % 4 = 0) FROM conv0")
def _(c: Corpus) -> DataFrame:
    prints = ingest.fingerprints(c.base.select("conversation_id", "source", F.col("conversation_id").alias("source_conversation_id"), "title"), c.messages)
    known = prints.where(F.substring("conversation_id", 6, 6).cast("int") % 4 == 0).select("fingerprint")
    return ingest.outcomes(prints, known).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# ---- audits, screens, the stored index


@query("v05_audit_conversation", "SELECT conversation_id, state, message_count, coalesce(n, 0) AS n_links, coalesce(kinds, '') AS kinds FROM conv0 LEFT JOIN (SELECT conversation_id, count(*) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM prov JOIN obj USING (object_id) GROUP BY 1) USING (conversation_id)")
def _(c: Corpus) -> DataFrame:
    return views.audit_conversations(c.base, c.objects, c.provenance)


@query("v05_audit_object", "SELECT object_id, kind, title, count(*) AS n_links, count(*) FILTER (WHERE c.state = 'indexed') AS n_visible, string_agg(DISTINCT c.state, ',' ORDER BY c.state) AS states FROM obj JOIN prov USING (object_id) JOIN (SELECT conversation_id, state FROM conv0) c USING (conversation_id) GROUP BY 1, 2, 3")
def _(c: Corpus) -> DataFrame:
    return views.audit_objects(c.base, c.objects, c.provenance)


@query("v08_overview", f"SELECT 'state' AS section, state AS name, count(*) AS n FROM conv0 GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM conv0 GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM obj WHERE object_id IN (SELECT object_id FROM ({VP})) GROUP BY 2")
def _(c: Corpus) -> DataFrame:
    return views.overview(c.base, c.objects, c.provenance)


@query("j13_classified_messages", f"SELECT conversation_id, ordinal, register FROM ({CLASSIFIED}) WHERE register IS NOT NULL AND role = 'user'")
def _(c: Corpus) -> DataFrame:
    labels = _classified(c).where("register IS NOT NULL").select("message_id", "register")
    return c.messages.where("role = 'user'").join(labels, "message_id").select("conversation_id", "ordinal", "register")


@query("j16_scalar_subq", "SELECT conversation_id, (SELECT count(*) FROM chk k WHERE k.conversation_id = c.conversation_id) AS chunk_count, (SELECT arg_min(content_text, ordinal) FROM msg m WHERE m.conversation_id = c.conversation_id AND role = 'user') AS first_user FROM conv0 c")
def _(c: Corpus) -> DataFrame:
    sizes = c.chunks.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    first = c.messages.where("role = 'user'").groupBy("conversation_id").agg(F.min_by("content_text", "ordinal").alias("first_user"))
    return c.base.select("conversation_id").join(sizes, "conversation_id", "left").join(first, "conversation_id", "left").select("conversation_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "first_user")


@query("f01_postings", "SELECT message_id, term, count(*) AS tf FROM (SELECT message_id, unnest(list_concat(" + FOLD.format("content_text") + ", " + FOLD.format("role") + ")) AS term FROM emsg) GROUP BY 1, 2")
def _(c: Corpus) -> DataFrame:
    seen = c.messages.join(c.base.where(in_states("state", SEARCHABLE)), "conversation_id", "left_semi")
    return fts.postings(seen, "message_id", "content_text", "role")


@query("f02_indexed_bm25", f"SELECT message_id, round(bm25, 6) AS bm25 FROM ({bm25_sql('SELECT * FROM emsg', 'message_id', ('content_text', 'role'), 'the vendor')})")
def _(c: Corpus) -> DataFrame:
    seen = c.messages.join(c.base.where(in_states("state", SEARCHABLE)), "conversation_id", "left_semi")
    return fts.Index.build(seen, ("message_id",), "content_text", "role").search("the vendor").select("message_id", F.round("bm25", 6).alias("bm25"))


@query("f01_refreshed", "SELECT message_id, len(t) AS len, term, count(*) AS tf FROM (SELECT message_id, t, unnest(t) AS term FROM (SELECT message_id, list_concat(" + FOLD.format("content_text") + ", " + FOLD.format("role") + ") AS t FROM emsg WHERE conv_id % 7 <> 3)) GROUP BY ALL")
def _(c: Corpus) -> DataFrame:
    """An index of stale texts, brought up to date, without some conversations."""
    seen = c.messages.join(c.base.where(in_states("state", SEARCHABLE)), "conversation_id", "left_semi")
    number = F.substring("conversation_id", 6, 6).cast("int")
    stale = seen.withColumn("content_text", F.when(number % 3 == 0, F.lit("stale words")).otherwise(F.col("content_text")))
    index = fts.Index.build(stale, ("message_id", "conversation_id"), "content_text", "role").refreshed(seen.where(number % 3 == 0), "content_text", "role")
    return index.without(c.base.where(number % 7 == 3).select("conversation_id")).postings.select("message_id", "len", "term", "tf")


def _state(c: Corpus) -> stored.SearchState:
    """A stored state that was built over some outdated texts and then brought up to date by a segment."""
    late = F.substring("conversation_id", 6, 6).cast("int") % 10 == 4  # their index is out of date at first
    outdated = lambda df, name: df.withColumn(name, F.when(late, F.lit("revisit the outdated budget")).otherwise(F.col(name)))
    kept = stored.SearchState.build(c.conversations, c.messages, c.chunks)
    vocabulary = scratch.table(kept.vocabulary, "vocabulary")
    first = stored.SearchState.build(outdated(c.conversations, "title"), outdated(c.messages, "content_text"), c.chunks, vocabulary)
    store = Store(c.messages.sparkSession, scratch.new_path(c.messages.sparkSession, "state")).init()
    store.commit(first.tables())
    ids = c.base.where(late).select("conversation_id")
    store.commit(stored.SearchState.load(store.tables()).change(c.conversations, c.messages, c.chunks, ids, 2))
    return stored.SearchState.load(store.tables())


@query("f21_stored_conversations", f"SELECT conversation_id, round(score, 6) AS score FROM ({KEYWORD})")
def _(c: Corpus) -> DataFrame:
    return search.keyword_search(c.conversations, c.messages, ASK, NOW, state=_state(c)).select("conversation_id", F.round("score", 6).alias("score"))


@query("f21_stored_chunks", f"SELECT chunk_id, conversation_id, title, round(score, 6) AS score FROM ({CHUNK_HITS})")
def _(c: Corpus) -> DataFrame:
    return search.chunk_search(c.conversations, c.messages, c.chunks, ASK, state=_state(c)).withColumn("score", F.round("score", 6))


@query("f22_stored_semantic", f"SELECT conversation_id, round(score, 6) AS score FROM ({SEMANTIC})", VECTORS)
def _(c: Corpus) -> DataFrame:
    return search.semantic_search(c.conversations, c.messages, c.chunks, ASK, state=_state(c)).select("conversation_id", F.round("score", 6).alias("score"))


def stretch_sql(key: str, text: str, source: str, terms: list[str]) -> str:
    """Matches of terms in white-space words (place i from 0, term number k) and the smallest stretch with all terms that occur."""
    return f"""WITH w AS (SELECT {key}, i - 1 AS i, ws[i] AS w, len(ws) AS n FROM (SELECT {key}, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT {key}, regexp_split_to_array({text}, '\\s+') AS ws FROM {source}))),
    matched AS (SELECT DISTINCT {key}, i, k FROM (SELECT {key}, i, unnest({FOLD.format('w')}) AS t FROM w) JOIN (SELECT unnest({quoted(terms)}) AS t, unnest(range({len(terms)})) AS k) USING (t)),
    kinds AS (SELECT {key}, count(DISTINCT k) AS kinds FROM matched GROUP BY 1),
    ends AS (SELECT {key}, j, min(i) AS s, count(*) AS got FROM (SELECT a.{key}, a.i AS j, b.k, max(b.i) AS i FROM (SELECT DISTINCT {key}, i FROM matched) a JOIN matched b ON a.{key} = b.{key} AND b.i <= a.i GROUP BY 1, 2, 3) GROUP BY 1, 2),
    best AS (SELECT {key}, s, j - s + 1 AS span FROM ends JOIN kinds USING ({key}) WHERE got = kinds QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY j - s, j) = 1)"""


@query("f05_snippets", stretch_sql("message_id", "content_text", "(SELECT * FROM msg WHERE contains(lower(content_text), 'vendor'))", ["the", "vendor"]) + """,
    begins AS (SELECT message_id, greatest(s - greatest((16 - span) // 2, 0), 0) AS f FROM best)
    SELECT message_id, CASE WHEN any_value(f) > 0 THEN '...' ELSE '' END || string_agg(CASE WHEN EXISTS (SELECT 1 FROM matched h WHERE h.message_id = w.message_id AND h.i = w.i) THEN '[' || w || ']' ELSE w END, ' ' ORDER BY i) || CASE WHEN any_value(f) + 16 < any_value(n) THEN '...' ELSE '' END AS snippet
    FROM w JOIN begins USING (message_id) WHERE i >= f AND i < f + 16 GROUP BY message_id""")
def _(c: Corpus) -> DataFrame:
    return c.messages.where(F.lower("content_text").contains("vendor")).select("message_id", fts.snippet(F.col("content_text"), "the vendor").alias("snippet"))


def _message_index(c: Corpus) -> fts.Index:
    seen = c.messages.join(c.base.where(in_states("state", SEARCHABLE)), "conversation_id", "left_semi")
    return fts.Index.build(seen, ("message_id", "conversation_id"), "content_text", "role")


PLACES = f"WITH t AS (SELECT message_id, i, ts[i] AS t FROM (SELECT message_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT message_id, {FOLD.format('content_text')} AS ts FROM emsg)))"


@query("f09_phrases", PLACES + " SELECT a.message_id, count(*) AS times FROM t a JOIN t b ON a.message_id = b.message_id AND b.i = a.i + 1 JOIN t c ON a.message_id = c.message_id AND c.i = a.i + 2 WHERE a.t = 'need' AND b.t = 'to' AND c.t = 'restart' GROUP BY 1")
def _(c: Corpus) -> DataFrame:
    return _message_index(c).phrase("need to Restart!").select("message_id", F.col("times").cast("long").alias("times"))


@query("f09_windows", PLACES + """, matched AS (SELECT message_id, i, t FROM t WHERE t IN ('the', 'vendor', 'to')),
    ends AS (SELECT message_id, j, min(i) AS s, count(*) AS got FROM (SELECT a.message_id, a.i AS j, b.t, max(b.i) AS i FROM matched a JOIN matched b ON a.message_id = b.message_id AND b.i <= a.i GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT message_id, s - 1 AS start, j - s + 1 AS span FROM ends WHERE got = 3 QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY j - s, j) = 1""")
def _(c: Corpus) -> DataFrame:
    return _message_index(c).windows("the vendor to").select("message_id", F.col("start").cast("long").alias("start"), F.col("span").cast("long").alias("span"))


@query("p09_query_terms", f"SELECT message_id FROM emsg WHERE list_contains({FOLD.format('content_text')}, 'open') AND list_contains({FOLD.format('content_text')}, 'question')")
def _(c: Corpus) -> DataFrame:
    seen = c.messages.join(c.base.where(in_states("state", SEARCHABLE)), "conversation_id", "left_semi")
    return fts.bm25(seen, "message_id", ("content_text",), '"open" -question!').select("message_id")


@query("g13_prompt_lines", "SELECT conversation_id, string_agg(role || ': ' || left(content_text, 800), chr(10) ORDER BY ordinal) FILTER (WHERE role IN ('user', 'assistant')) AS shown FROM msg GROUP BY 1")
def _(c: Corpus) -> DataFrame:
    lists = c.messages.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "role", "content_text"))).alias("m"))
    return lists.select("conversation_id", F.nullif(sampling.transcript(F.col("m")), F.lit("")).alias("shown"))


@query("g15_best_text", "SELECT conversation_id, concat_ws(': ', nullif(trim(title), ''), nullif(trim(summary_short), '')) AS best FROM conv")
def _(c: Corpus) -> DataFrame:
    return c.conversations.select("conversation_id", tasks.best_text(F.col("title"), F.col("summary_short")).alias("best"))


@query("g12_profile", f"SELECT 'conversations' AS section, CAST(count(*) AS VARCHAR) AS line FROM conv0 WHERE state = 'indexed' UNION ALL SELECT 'registers', coalesce(dominant_register, 'other') || ': ' || count(*) FROM conv0 LEFT JOIN reg USING (conversation_id) WHERE state = 'indexed' GROUP BY coalesce(dominant_register, 'other') UNION ALL SELECT kind, title FROM obj WHERE object_id IN (SELECT object_id FROM ({VP})) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY title, object_id) <= 10")
def _(c: Corpus) -> DataFrame:
    return tasks.profile(c.base, c.objects, c.provenance, c.register)
