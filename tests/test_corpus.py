"""Operators on small hand-made corpora, and invariants on the derived one."""

import pathlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from colloquy import corpus as C
from colloquy import schema
from colloquy.operators import chunking, cluster, extraction, fts, lifecycle, rules, search, vectors
from colloquy.operators import query as querylang
from colloquy.operators.store import Store
from colloquy.operators.stored import SearchState

SF = "/root/testdata/sf0.001"


def messages(spark, rows):
    return spark.createDataFrame([(f"m{i}", *r) for i, r in enumerate(rows)], "message_id string, conversation_id string, ordinal int, role string, content_text string")


def base(spark, rows):
    return spark.createDataFrame(rows, "conversation_id string, title string, state string, message_count int, source string")


@pytest.fixture(scope="module")
def corpus(spark):
    return C.derive(spark, SF)


def test_each_kind_is_found_and_negatives_are_not(spark):
    m = messages(spark, [
        ("a", 0, "user", "Project Atlas starts. I will pick option B today."),
        ("a", 1, "assistant", "TODO: revisit staffing. You need to rest. I like that."),
        ("a", 2, "user", "I prefer async standups. Alice Johnson met Alice Johnson. Sure John, thanks. Sure John again."),
        ("a", 3, "assistant", "I prefer nothing. I drafted the spec for billing."),
    ])
    hits = extraction.harvest(base(spark, [("a", "T", "indexed", 4, "chatgpt")]), m).collect()
    kinds = {}
    for h in hits:
        kinds.setdefault(h.kind, []).append(h.title)
    assert kinds["project"] == ["Atlas"]
    assert kinds["decision"] == ["I will pick option B today"]
    assert any(t.startswith("TODO") for t in kinds["open_loop"])
    assert kinds["preference"] == ["I prefer async standups"]
    assert kinds["artifact"] and kinds["entity"] == ["Alice Johnson"]


def test_letters_with_a_mark_end_a_word(spark):
    m = messages(spark, [("a", 0, "user", "SSü achheit SS ößSS. Prüfe éTODO: revisit the budget. Project Atlasé starts."), ("a", 1, "user", "NNü NN.")])
    tokens = {(r.token, r.n, r.ordinal, r.place) for r in extraction.acronyms(m).collect()}
    assert tokens == {("SS", 3, 0, 0)}
    hits = {(h.kind, h.title) for h in extraction.harvest(base(spark, [("a", "T", "indexed", 2, "chatgpt")]), m).collect()}
    assert {("project", "SS"), ("project", "Atlas"), ("open_loop", "TODO: revisit the budget")} <= hits


def test_nothing_is_extracted_from_unreviewed_or_quarantined(spark):
    m = messages(spark, [("a", 0, "user", "We decided to use Redis for it."), ("b", 0, "user", "We decided to use Redis for it.")])
    rows = extraction.harvest(base(spark, [("a", "T", "pending_review", 1, "x"), ("b", "T", "quarantined", 1, "x")]), m)
    assert rows.count() == 0


def test_chunks_partition_and_cut_at_topics(spark):
    long = lambda w: " ".join(f"{w}{i}" for i in range(200))
    rows = []
    for i, w in enumerate(["alpha", "alpha", "alpha", "alpha", "beta", "beta", "beta", "beta"]):
        rows.append(("a", i, "user" if i % 2 == 0 else "assistant", long(w)))
    got = chunking.chunk_ranges(messages(spark, rows)).orderBy("chunk_index").collect()
    assert [(r.start_message_ordinal, r.end_message_ordinal) for r in got] == [(0, 3), (4, 7)]


def test_chunks_cover_every_message_once(corpus):
    placed = chunking.in_chunk(corpus.messages, corpus.chunks)
    assert placed.count() == corpus.messages.count() == placed.select("message_id").distinct().count()


def test_bm25_needs_all_terms_and_counts_private_rows(spark):
    rows = spark.createDataFrame([(1, "red fox"), (2, "red"), (3, "fox red fox"), (4, None)], "id int, text string")
    got = {r.id: r.bm25 for r in fts.bm25(rows, "id", ("text",), "RED fox").collect()}
    assert set(got) == {1, 3} and got[3] > 0
    assert fts.bm25(rows, "id", ("text",), "").count() == 0


def test_private_text_never_shows(spark):
    convs = base(spark, [(s, f"zebra {s}", s, 1, "chatgpt") for s in schema.STATES]).withColumns({
        "created_at": F.lit(1.0), "updated_at": F.lit(1.0), "importance_score": F.lit(0.0), "summary_short": F.lit("zebra"), "has_open_loops": F.lit(False),
        "manual_tags": F.array().cast("array<string>"), "auto_tags": F.array().cast("array<string>"),
    })
    m = messages(spark, [(s, 0, "user", "We decided to use zebra for it.") for s in schema.STATES])
    chunks = chunking.chunk_rows(m)
    hits = extraction.harvest(convs, m)
    reg = convs.select("conversation_id", F.lit(None).cast("string").alias("dominant_register"))
    out = querylang.run("zebra", conversations=convs, messages=m, chunks=chunks, objects=extraction.objects(hits), provenance=extraction.provenance(hits, chunks), register=reg, now=2.0).collect()
    shown = {r.id for r in out if r.hit_type == "conversation"}
    assert shown == {"indexed"}
    assert all("private" not in (r.title or "") and "quarantined" not in (r.title or "") for r in out)


def test_transitions_follow_the_whitelist(spark):
    convs = base(spark, [("a", "", "indexed", 1, ""), ("b", "", "private", 1, ""), ("c", "", "private", 1, "")])
    asked = spark.createDataFrame([("a", "quarantined"), ("b", "deleted"), ("c", "private"), ("d", "indexed")], "conversation_id string, new_state string")
    assert [r.conversation_id for r in lifecycle.transitions(convs, asked).collect()] == ["a"]


def test_delete_does_what_its_plan_says(corpus):
    tables = {"conversations": corpus.base, "messages": corpus.messages, "chunks": corpus.chunks, "objects": corpus.objects, "provenance": corpus.provenance}
    ids = corpus.base.limit(0).select("conversation_id").union(corpus.provenance.orderBy("conversation_id").limit(3).select("conversation_id")).distinct()
    plan = lifecycle.delete_plan(corpus.objects, corpus.provenance, ids)
    gone = {r.object_id for r in plan.where("NOT survives").collect()}
    after = lifecycle.delete(tables, ids)
    left = {r.object_id for r in after["objects"].collect()}
    assert gone == {r.object_id for r in corpus.objects.collect()} - left
    assert after["messages"].join(ids, "conversation_id", "left_semi").count() == 0


def test_upsert_keeps_and_overwrites(spark):
    cols = "object_id string, kind string, canonical_key string, title string, description string, first_seen double, status string"
    old = spark.createDataFrame([("o1", "project", "k", "Old", "d", 1.0, "open"), ("o2", "project", "z", "Z", "d", 1.0, None)], cols)
    new = spark.createDataFrame([("n1", "project", "k", "New1", "e", 5.0, None, 1), ("n1", "project", "k", "New2", "f", 6.0, None, 2), ("n3", "entity", "k", "E", "g", 7.0, "x", 1)], cols + ", seq int")
    got = {(r.kind, r.canonical_key): r for r in lifecycle.upsert_objects(old, new).collect()}
    assert got["project", "k"].title == "New2" and got["project", "k"].object_id == "o1"
    assert got["project", "k"].first_seen == 1.0 and got["project", "k"].status == "open"
    assert got["project", "z"].title == "Z" and got["entity", "k"].object_id == "n3"


def test_merge_only_within_a_kind(spark):
    objects = spark.createDataFrame([("a", "project"), ("b", "project"), ("c", "entity")], "object_id string, kind string")
    links = spark.createDataFrame([("l1", "a"), ("l2", "b"), ("l3", "c")], "link_id string, object_id string")
    pairs = spark.createDataFrame([("a", "b"), ("c", "b"), ("b", "b"), ("x", "b")], "loser_id string, winner_id string")
    left, moved = lifecycle.merge_objects(objects, links, pairs)
    assert {r.object_id for r in left.collect()} == {"b", "c"}
    assert {r.link_id: r.object_id for r in moved.collect()} == {"l1": "b", "l2": "b", "l3": "c"}


def test_rules_most_restrictive_wins_and_never_loosens(spark):
    convs = base(spark, [("a", "therapy notes", "indexed", 1, ""), ("b", "x", "quarantined", 1, ""), ("c", "x", "indexed", 1, "")]).withColumn("summary_short", F.lit(""))
    m = messages(spark, [("a", 0, "user", "SSN 123-45-6789"), ("b", 0, "user", "Therapy"), ("c", 0, "user", "nothing")])
    given = [rules.Rule("t", "private", ("Therapy",)), rules.Rule("s", "quarantined", (r"\d{3}-\d{2}-\d{4}",), "regex")]
    assert {r.conversation_id: r.rule_state for r in rules.evaluate(convs, m, given).collect()} == {"a": "quarantined", "b": "private"}
    assert [r.conversation_id for r in rules.rescan(convs, m, given).collect()] == ["a"]
    assert rules.evaluate(convs, m, []).count() == 0
    with pytest.raises(ValueError):
        rules.Rule("x", "deleted", ("a",))


def test_kmeans_separates_and_is_deterministic(spark):
    docs = spark.createDataFrame([(f"c{i}", "kubernetes cluster nodes kubernetes pods" if i % 2 else "dragon castle story dragon knight") for i in range(8)], "conversation_id string, text string")
    w = cluster.tfidf(docs).cache()
    one = {r.conversation_id: r.cluster for r in cluster.kmeans(w, 2).collect()}
    again = {r.conversation_id: r.cluster for r in cluster.kmeans(w.repartition(7), 2).collect()}
    assert one == again and len({one[f"c{i}"] for i in (0, 2, 4, 6)}) == 1 and one["c0"] != one["c1"]


def test_safe_labels_hide_small_groups_and_private_words(spark):
    rows = [(f"p{i}", "widget engineering", "indexed") for i in range(3)] + [(f"t{i}", "therapy", "private") for i in range(5)]
    convs = spark.createDataFrame(rows, "conversation_id string, title string, state string").withColumns({"manual_tags": F.array().cast("array<string>"), "auto_tags": F.array().cast("array<string>"), "summary_short": F.lit("")})
    members = convs.select(F.lit("g").alias("group_id"), "conversation_id").union(convs.where("conversation_id = 't0' OR conversation_id = 'p0'").select(F.lit("h"), "conversation_id"))
    got = {r.group_id: r.safe_label for r in cluster.safe_labels(convs, members).collect()}
    assert "widget" in got["g"] and "therapy" not in got["g"] and got["h"] is None


def test_rrf_by_hand(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "id string, rank int")
    b = spark.createDataFrame([("y", 0)], "id string, rank int")
    got = {r.id: r.rrf for r in vectors.fuse([a, b], "id").collect()}
    assert got["x"] == pytest.approx(1 / 61) and got["y"] == pytest.approx(1 / 62 + 1 / 61)


def test_tables_of_no_row(spark):
    m = spark.createDataFrame([], "message_id string, conversation_id string, ordinal int, role string, content_text string")
    assert chunking.chunk_rows(m).count() == 0
    assert search.chunk_bodies(m, chunking.chunk_rows(m)).count() == 0


def test_stored_search_state_equals_scans_and_follows_changes(spark, tmp_path):
    convs = base(spark, [(c, f"Budget {c}", state, 2, "chatgpt") for c, state in (("a", "indexed"), ("b", "indexed"), ("p", "private"), ("q", "quarantined"))]).withColumns({
        "created_at": F.lit(1.0), "updated_at": F.lit(1.0), "importance_score": F.lit(0.0), "summary_short": F.lit("two messages"),
    }).coalesce(1)
    said = messages(spark, [(c, k, role, f"The vendor of {c} sent budget number {k} {'again ' * n}") for n, c in enumerate("abpq") for k, role in enumerate(("user", "assistant"))]).coalesce(1)
    chunks = spark.createDataFrame([(f"k{c}", c, 0, 0, 1, f"Chunk {c}", "budget") for c in "abpq"], schema.CHUNK).coalesce(1)
    changed = spark.createDataFrame([("a",), ("q",)], "conversation_id string")
    old = said.withColumn("content_text", F.when(F.col("conversation_id") == "a", F.lit("outdated vendor")).otherwise(F.col("content_text")))
    was = convs.withColumn("state", F.when(F.col("conversation_id") == "q", F.lit("indexed")).otherwise(F.col("state")))
    s = Store(spark, f"file://{tmp_path}/root").init()
    s.commit(SearchState.build(was, old, chunks).tables())
    state = SearchState.load(s.tables())
    assert "PushedFilters: [In(term" in state.messages.postings.where(F.col("term").isin("a", "b"))._jdf.queryExecution().toString()
    now = state.refreshed(convs, said, chunks, changed)
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rows(now.messages.totals)[0][0] == 6 and rows(now.messages.search("outdated")) == []
    assert rows(now.vectors) == rows(SearchState.build(convs, said, chunks, state.vocabulary).vectors)
    assert rows(search.keyword_search(convs, said, "the vendor", 1e9, state=now)) == rows(search.keyword_search(convs, said, "the vendor", 1e9)) != []
    assert rows(search.chunk_search(convs, said, chunks, "budget", state=now)) == rows(search.chunk_search(convs, said, chunks, "budget")) != []
    assert SearchState.load({}) is None and now.titles.search("?!").count() == 0
    assert now.without(convs).vectors.count() == 0


def test_queries_are_listed_without_a_session():
    """The registry is read before a session stands, so no module may build columns when it is imported."""
    root = pathlib.Path(__file__).parents[1]
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
