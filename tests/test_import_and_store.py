"""Import by id, deletion from disk, index segments, phrases and windows."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from colloquy import cli
from colloquy.api import import_exports
from colloquy.assist import ledger, runner, tasks
from colloquy.functions import text as X
from colloquy.operators import fts, lifecycle, rules, stored
from colloquy.operators.store import Store
from colloquy.operators.stored import SearchState
from colloquy.plans import imports
from colloquy.sources import exports, normalized, sinks

from test_sources import LIST, TREE


def export(folder, *conversations):
    folder.mkdir(exist_ok=True)
    (folder / "conversations.json").write_text(json.dumps(conversations))
    return str(folder)


def talk(uuid, *texts, name="Talk", at="2024-01-01T00:00:00Z"):
    return {"uuid": uuid, "name": name, "updated_at": at, "chat_messages": [{"uuid": str(k), "sender": "human", "text": t} for k, t in enumerate(texts)]}


def counted(new):
    return {r.outcome: r.n for r in new.counters.collect()}


def test_a_conversation_that_an_export_repeats_comes_once(spark, tmp_path):
    new = import_exports(spark, export(tmp_path / "a", LIST[0], LIST[0], TREE[0], TREE[0]))
    assert counted(new) == {"imported": 2, "duplicate": 2}
    assert new.tables["conversations"].count() == 2
    said = new.tables["messages"].collect()
    assert len(said) == 4 and len({m.message_id for m in said}) == 4
    assert sorted((m.conversation_id, m.ordinal) for m in said) == sorted({(m.conversation_id, m.ordinal) for m in said})


def test_the_newest_copy_holds_and_keeps_what_a_person_said(spark, tmp_path):
    first = import_exports(spark, export(tmp_path / "a", talk("x", "one", "two"), talk("x", "old", at="2023-01-01T00:00:00Z"), talk("y", "stays")), approve=True, now=1.0)
    assert counted(first) == {"imported": 2, "older": 1}
    tagged = first.tables["conversations"].withColumn("manual_tags", F.when(F.col("source_conversation_id") == "x", F.array(F.lit("mine"))).otherwise(F.col("manual_tags")))
    store = Store(spark, f"file://{tmp_path}/root").init()
    store.commit(first.tables | {"conversations": tagged})
    again = import_exports(spark, export(tmp_path / "b", talk("x", "one", "two", "three", name="New", at="2024-02-01T00:00:00Z"), talk("y", "earlier", at="2022-01-01T00:00:00Z")), store.tables(), now=2.0)
    assert counted(again) == {"updated": 1, "older": 1}
    rows = {r.source_conversation_id: r for r in again.tables["conversations"].collect()}
    assert len(rows) == 2 and rows["x"].title == "New" and rows["x"].state == "indexed" and list(rows["x"].manual_tags) == ["mine"] and rows["x"].message_count == 3
    assert rows["y"].imported_at == 1.0 and rows["x"].imported_at == 2.0
    said = sorted((r.source_conversation_id, m.ordinal, m.content_text) for r in rows.values() for m in again.tables["messages"].collect() if m.conversation_id == r.conversation_id)
    assert said == [("x", 0, "one"), ("x", 1, "two"), ("x", 2, "three"), ("y", 0, "stays")]
    assert counted(import_exports(spark, str(tmp_path / "b"), again.tables)) == {"duplicate": 1, "older": 1}


def test_a_rule_restricts_an_updated_conversation_and_never_frees_one(spark, tmp_path):
    ssn = [rules.Rule("ssn", "quarantined", (r"\d{3}-\d{2}-\d{4}",), "regex")]
    first = import_exports(spark, export(tmp_path / "a", talk("x", "plain"), talk("y", "123-45-6789")), given=ssn, approve=True)
    again = import_exports(spark, export(tmp_path / "b", talk("x", "123-45-6789", at="2025-01-01T00:00:00Z"), talk("y", "harmless", at="2025-01-01T00:00:00Z")), first.tables, given=ssn, approve=True)
    assert counted(again) == {"updated": 2}
    assert {r.source_conversation_id: r.state for r in again.tables["conversations"].collect()} == {"x": "quarantined", "y": "quarantined"}


def test_sources_that_share_an_id_and_copies_without_messages(spark, tmp_path):
    new = import_exports(spark, export(tmp_path / "a", TREE[0] | {"id": "same"}, talk("same", "hello"), talk("none"), talk("none")))
    assert counted(new) == {"imported": 2, "empty": 2}
    assert new.tables["conversations"].select("conversation_id").distinct().count() == 2
    assert import_exports(spark, export(tmp_path / "b")).tables["conversations"].count() == 0


def test_an_update_by_the_command_line_drops_what_came_from_the_old_text(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    corpus = cli.Corpus(spark, root, 5.0)
    corpus.import_(export(tmp_path / "a", talk("x", "We decided to use Redis for caching.", "fine"), talk("y", "We decided to use Kafka for logs.", "ok")), approve=True)
    corpus.process()
    assert corpus.query("redis").count() > 0 and corpus.tables["objects"].where("kind = 'decision'").count() == 2
    corpus.import_(export(tmp_path / "b", talk("x", "We talked of gardens only.", at="2025-01-01T00:00:00Z")))
    t = corpus.tables
    assert t["conversations"].count() == t["conversations"].select("conversation_id").distinct().count() == 2
    assert t["messages"].count() == t["messages"].select("message_id").distinct().count() == 3
    assert [r.title for r in t["objects"].where("kind = 'decision'").collect()] == [r.title for r in t["objects"].where("title LIKE '%Kafka%'").collect()] and t["objects"].where("title LIKE '%Redis%'").count() == 0
    assert corpus.query("redis").count() == 0 and corpus.query("gardens").count() == 1


def files_with(folder, word):
    """Files below a folder that hold a word; Parquet is read, other files are searched."""
    import pyarrow.parquet as pq

    found = []
    for d, _, names in os.walk(folder):
        for n in names:
            path = os.path.join(d, n)
            text = json.dumps(pq.read_table(path).to_pylist(), default=str) if n.endswith(".parquet") else open(path, "rb").read().decode("utf-8", "replace")
            if word in text:
                found.append(path)
    return found


def test_deleted_text_is_nowhere_on_disk(spark, tmp_path):
    root = tmp_path / "root"
    corpus = cli.Corpus(spark, f"file://{root}", 5.0)
    corpus.import_(export(tmp_path / "in", talk("x", "We decided to use the xyzzyword for caching.", name="xyzzyword talk"), talk("y", "plain words of another kind")), approve=True)
    corpus.process()
    ids = {r.source_conversation_id: r.conversation_id for r in corpus.tables["conversations"].collect()}
    corpus.tag(ids["x"], ["one"])  # commits that leave earlier versions behind
    corpus.tag(ids["y"], ["two"])
    corpus.set_state("private", [ids["x"]])
    corpus.normalize(f"file://{root}/json")
    (root / "messages" / "v-broken").mkdir()  # a write that was broken off
    (root / "messages" / "v-broken" / "part").write_text("xyzzyword")
    assert len(files_with(root, "xyzzyword")) > 5
    corpus.delete([ids["x"]], sure=True)
    assert files_with(root, "xyzzyword") == []
    assert corpus.query("plain words").count() > 0 == corpus.query("xyzzyword").count() and normalized.read(spark, f"file://{root}/json", "conversation_id string")[0].count() == 1
    assert [r["value"] for r in spark.read.json(f"file://{root}/log").select(F.col("command").alias("value")).where("value = 'delete'").collect()] == ["delete"]


def test_versions_are_collected_after_a_time_of_grace(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/root").init()
    a = spark.createDataFrame([("a", "secret"), ("b", "open")], "conversation_id string, text string")
    for _ in range(3):
        s.commit({"t": a, "u": spark.range(1)})
    s.commit({"t": a.where("conversation_id = 'b'")})
    assert s.collect() == [] and len(s.unnamed()) == 5
    assert len(s.purge({"conversation_id": a.where("conversation_id = 'a'").select("conversation_id")})) == 5  # those of u have no key
    s.commit({"t": a}, drop=["u"])
    assert set(s.versions()) == {"t"} and len(s.collect(grace=0)) == 2 and s.unnamed() == {} and s.read("t").count() == 2
    keep = spark.createDataFrame([("z",)], "conversation_id string")
    s.commit({"t": a})
    assert s.purge({"conversation_id": keep}) == [] and len(s.unnamed()) == 1


def test_normalised_lines_are_replaced_by_shard(spark, tmp_path):
    path = str(tmp_path / "n")
    c = spark.createDataFrame([(f"c{k}", "T") for k in range(40)], "conversation_id string, title string")
    m = c.select(F.concat(F.lit("m"), "conversation_id").alias("message_id"), "conversation_id", F.lit(0).alias("ordinal"), F.lit("user").alias("role"), F.lit(1.0).alias("timestamp"), F.lit("said").alias("content_text"))
    normalized.write(c, m, path)
    before = {p: os.stat(p).st_mtime_ns for p in (os.path.join(d, n) for d, _, names in os.walk(path) for n in names) if "shard=" in p}
    normalized.remove(spark, path, c.where("conversation_id IN ('c3', 'c7')").select("conversation_id"))
    assert {r.conversation_id for r in normalized.read(spark, path, "conversation_id string")[0].collect()} == {f"c{k}" for k in range(40)} - {"c3", "c7"}
    touched = {normalized.shard_path(path, i) for i in ("c3", "c7")}
    assert all(os.path.exists(p) and os.stat(p).st_mtime_ns == t for p, t in before.items() if os.path.dirname(p) not in touched)
    normalized.write(c.limit(1), m, path)
    assert normalized.read(spark, path, "conversation_id string")[0].count() == 1 and not [n for n in os.listdir(tmp_path) if ".new-" in n]


# ---- segments


def texts(spark, n, seed=1):
    r = random.Random(seed)
    words = ["red", "fox", "Café", "the", "vendor", "runs", "over", "far"]
    convs = spark.createDataFrame([(f"c{k:03}", f"Talk of {r.choice(words)}", "indexed" if k % 5 else "private", "two") for k in range(n)], "conversation_id string, title string, state string, summary_short string")
    said = spark.createDataFrame([(f"m{k:03}-{j}", f"c{k:03}", j, "user", " ".join(r.choice(words) for _ in range(r.randrange(1, 20)))) for k in range(n) for j in range(2)], "message_id string, conversation_id string, ordinal int, role string, content_text string")
    chunks = convs.select(F.concat(F.lit("k"), "conversation_id").alias("chunk_id"), "conversation_id", F.lit(0).alias("chunk_index"), F.lit(0).alias("start_message_ordinal"), F.lit(1).alias("end_message_ordinal"), F.lit("Chunk").alias("chunk_title"), F.lit("short").alias("summary_short"))
    return [df.coalesce(1) for df in (convs, said, chunks)]


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=repr)


def size(folder):
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(folder) for n in names)


def test_segments_equal_a_rebuilt_index_and_are_merged_when_due(spark, tmp_path, monkeypatch):
    convs, said, chunks = texts(spark, 60)
    store = Store(spark, f"file://{tmp_path}/root").init()
    store.commit(SearchState.build(convs, said, chunks).tables())
    whole, vocabulary = size(tmp_path), store.read("search_vocabulary")
    number = 1
    for step, ids in enumerate((["c004", "c010"], ["c004", "c007"])):
        said = said.withColumn("content_text", F.when(F.col("conversation_id").isin(*ids), F.concat("content_text", F.lit(f" step{step} fox"))).otherwise(F.col("content_text")))
        convs = convs.withColumn("state", F.when(F.col("conversation_id") == "c007", F.lit("quarantined")).otherwise(F.col("state"))) if step == 1 else convs
        number += 1
        before = size(tmp_path)
        touched = spark.createDataFrame([(i,) for i in ids], "conversation_id string")
        store.commit(SearchState.load(store.tables()).change(convs, said, chunks, touched, number))
        assert size(tmp_path) - before < whole  # a few rows, whatever the index holds
        got, want = SearchState.load(store.tables()), SearchState.build(convs, said, chunks, vocabulary)
        for a, b in ((got.messages, want.messages), (got.chunks, want.chunks)):
            assert rows(a.postings) == rows(b.postings) and rows(a.totals) == rows(b.totals)
        assert rows(got.messages.search("red fox")) == rows(want.messages.search("red fox"))
        assert rows(got.vectors) == rows(want.vectors)
    plan = got.messages.search("fox")._jdf.queryExecution().toString()
    assert len(re.findall(r"PushedFilters: \[[^\]]*(?:EqualTo\(term,fox\)|In\(term)", plan)) >= 3  # one for each segment
    assert not stored.due(store.tables())
    monkeypatch.setattr(stored, "MOST_SEGMENTS", 2)
    assert stored.due(store.tables())
    store.commit(got.tables(number + 1), drop=stored.segment_tables(store.tables()))
    assert stored.segments(store.tables()) == [number + 1] and rows(SearchState.load(store.tables()).messages.postings) == rows(want.messages.postings)


def test_segments_are_due_when_much_is_hidden_and_purge_what_must_go(spark, tmp_path):
    convs, said, chunks = texts(spark, 20, seed=3)
    store = Store(spark, f"file://{tmp_path}/root").init()
    store.commit(SearchState.build(convs, said, chunks).tables())
    first = store.versions()
    store.commit(SearchState.load(store.tables()).change(convs, said, chunks, convs.limit(2), 2))
    assert not stored.due(store.tables())
    store.commit(SearchState.load(store.tables()).change(convs, said, chunks, convs.limit(9), 3))
    assert stored.due(store.tables())
    last = convs.where("conversation_id = 'c019'")  # only in the first segment
    made = stored.purged(store.tables(), last)
    assert {n.rpartition("@")[2] for n in made if "postings" in n} == {"000001"}
    store.commit(made)
    left = [df.join(last, "conversation_id", "left_anti").select(*df.columns) for df in (convs, said, chunks)]
    got, want = SearchState.load(store.tables()), SearchState.build(*left, store.read("search_vocabulary"))
    assert all(rows(getattr(got, n).postings) == rows(getattr(want, n).postings) and rows(getattr(got, n).totals) == rows(getattr(want, n).totals) for n in stored.KEYS)
    assert store.versions()["search_gone@000002"] != "" and first["search_messages_postings@000001"] != store.versions()["search_messages_postings@000001"]


def brute_window(tokens, terms):
    best = None
    for end in range(len(tokens)):
        last = [max((i for i in range(end + 1) if tokens[i] == t), default=None) for t in terms]
        if None not in last and tokens[end] in terms and (best is None or end - min(last) + 1 < best[1]):
            best = (min(last), end - min(last) + 1)
    return best


def test_phrases_and_windows_match_brute_force(spark):
    _, said, _ = texts(spark, 50, seed=7)
    index = fts.Index.build(said, ("message_id",), "content_text", "role")
    tokens = {r.message_id: re.findall(r"\w+", r.content_text.lower().replace("é", "e")) for r in said.collect()}
    for query in ("red fox", "the the", "café", "the vendor runs", "fox red fox"):
        asked = query.replace("é", "e").split()
        want = {m: k for m, t in tokens.items() if (k := sum(t[i : i + len(asked)] == asked for i in range(len(t))))}
        assert {r.message_id: r.times for r in index.phrase(query).collect()} == want
        terms = list(dict.fromkeys(asked))
        best = {m: w for m, t in tokens.items() if (w := brute_window(t, terms))}
        assert {r.message_id: (r.start, r.span) for r in index.windows(query).collect()} == best
        assert {r.message_id for r in index.near(query, 3).collect()} == {m for m, w in best.items() if w[1] <= 3}
    assert index.phrase("far user").count() == 0  # text and role aren't neighbours
    assert index.phrase("!").count() == index.windows("").count() == 0
    scanned = {r.message_id for r in said.where(fts.holds_phrase(F.col("content_text"), "the vendor")).collect()}
    assert scanned == {r.message_id for r in index.phrase("the vendor").collect()}


def test_texts_of_several_rows_follow_their_order(spark):
    parts = spark.createDataFrame([("a", 2, "runs far"), ("a", -1, "the red"), ("a", 1, "fox"), ("b", 0, None), ("b", 1, "fox")], "id string, at int, text string")
    index = fts.Index.build(parts, ("id",), "text", order="at")
    assert rows(index.lengths) == [("a", 5), ("b", 1)] and index.phrase("red fox").count() == 0
    assert [(r.id, r.start, r.span) for r in index.windows("red fox runs").collect()] == [("a", 1, 5)]


@pytest.mark.parametrize(("text", "query", "want"), [
    ("a b c d", "c", "...b [c] d"),
    ("one two three four five six seven", "two six", "...[two] three four..."),
    ("x x fox x x x red fox x x", "red fox", "...[red] [fox] x..."),
    ("nothing here at all today", "zebra", "nothing here at..."),
    ("only Red, here", "red zebra", "only [Red,] here"),
    (None, "red", ""),
    ("some words stand here", "", "some words stand..."),
])
def test_snippets_show_the_smallest_stretch(spark, text, query, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(fts.snippet(F.col("t"), query, width=3)).first()[0] == want


# ---- tree paths


def tree(parents, current=None, children=None):
    """A tree export; ``parents`` maps id to parent, in the mapping's order."""
    below = {}
    for i, p in parents.items():
        below.setdefault(p, []).append(i)
    mapping = {i: {"id": i, "parent": p, "children": (children or below).get(i, []), "message": {"id": i, "author": {"role": "user"}, "content": {"content_type": "text", "parts": [f"said {i}"]}}} for i, p in parents.items()}
    return {"id": f"t{len(parents)}-{current}", "title": "T", "create_time": 1.0, "current_node": current, "mapping": mapping}


def walk(parents, current, below):
    path, at = [], current if current in parents else next((i for i, p in parents.items() if p not in parents), None)
    while at in parents and at not in path:
        path.append(at)
        at = parents[at] if current in parents else next((c for c in reversed(below.get(at, [])) if c in parents), None)
    return path[::-1] if current in parents else path


def test_paths_by_doubling_are_those_of_a_plain_walk(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    trees = []
    for n in (1, 2, 3, 9, 40):
        parents = {f"n{k}": f"n{r.randrange(k)}" if k and r.random() < 0.95 else None for k in range(n)}
        trees += [(parents, f"n{n - 1}"), (parents, None), (parents, "absent")]
    trees += [({"a": "c", "b": "a", "c": "b"}, "b"), ({"r": None, "x": "gone", "y": "x"}, "y"), ({f"n{k}": f"n{k - 1}" if k else None for k in range(70)}, "n66")]
    made = [tree(p, c) | {"id": f"t{k}"} for k, (p, c) in enumerate(trees)]
    want = {}
    for k, (parents, current) in enumerate(trees):
        below = {}
        for i, p in parents.items():
            below.setdefault(p, []).append(i)
        want[f"t{k}"] = [f"said {i}" for i in walk(parents, current, below)]
    path = export(tmp_path / "a", *made)
    for in_place in (0, 256):
        monkeypatch.setattr(exports.linearised, "__defaults__", (in_place,))
        got = {}
        for m in exports.parse_exports(exports.read_exports(spark, path))[1].orderBy("ordinal").collect():
            got.setdefault(m.source_conversation_id, []).append(m.content_text)
        assert got == {k: v for k, v in want.items() if v}


def test_a_chain_of_ten_thousand_nodes(spark, tmp_path):
    parents = {f"n{k}": f"n{k - 1}" if k else None for k in range(10_000)}
    path = export(tmp_path / "a", tree(parents, "n9999"))
    said = exports.parse_exports(exports.read_exports(spark, path))[1]
    assert said.count() == 10_000 and said.where("content_text <> concat('said n', ordinal)").count() == 0


# ---- gating, counters, reconciliation


def test_gating_asks_again_only_next_to_merges_and_ends_at_a_fixed_point(spark):
    """Against a plain loop over lists: parts are texts, and the scorer says yes where both sides share a letter."""
    r = random.Random(3)
    talks_ = {f"c{k}": [r.choice("abcdef") for _ in range(r.randrange(1, 9))] for k in range(12)}
    said = [(c, 2 * k + j, "user", letter * 3) for c, letters in talks_.items() for k, letter in enumerate(letters) for j in range(2)]
    asked = spark.sparkContext.accumulator(0)

    def scorer(prompts):
        asked.add(len(prompts))
        out = []
        for p in prompts:
            before, after = p.split("\n---\n")
            tail, head = ({x for x in re.findall(r"(?:user): (\w)", side)} for side in (before, after))
            out.append(None if "f" in tail & head else "Yes." if min(tail) <= min(head) <= max(tail) else "no")
        return out

    def plain(letters):
        parts = [[x, x] for x in letters]
        while True:
            same = []
            for a, b in zip(parts, parts[1:]):
                tail, head = set(a[-3:]), set(b[:3])
                same.append("f" not in tail & head and min(tail) <= min(head) <= max(tail))
            if not any(same):
                return [len(p) for p in parts]
            merged = [list(parts[0])]
            for part, s in zip(parts[1:], same, strict=True):
                if s:
                    merged[-1] += part
                else:
                    merged.append(list(part))
            parts = merged

    m = spark.createDataFrame(said, "conversation_id string, ordinal int, role string, content_text string")
    chunks = spark.createDataFrame([(c, k, 2 * k, 2 * k + 1) for c, letters in talks_.items() for k in range(len(letters))], "conversation_id string, chunk_index int, start_message_ordinal int, end_message_ordinal int")
    got = tasks.gate_chunks(m, chunks, scorer, runner.Config(True, ("chunk_gating",))).orderBy("conversation_id", "chunk_index").collect()
    sizes = {}
    for row in got:
        sizes.setdefault(row.conversation_id, []).append(row.end_message_ordinal - row.start_message_ordinal + 1)
    assert sizes == {c: plain(letters) for c, letters in talks_.items()}
    assert len({row.chunk_id for row in got}) == len(got) and asked.value < 2 * chunks.count()
    off = tasks.gate_chunks(m, chunks, scorer, runner.Config(False, ()))
    assert off.count() == chunks.count()


def test_counters_name_the_smallest_ids(spark):
    moved = spark.createDataFrame([(f"c{k:03}", "indexed" if k % 3 else "private", "quarantined") for k in range(90)], "conversation_id string, old_state string, new_state string").repartition(5)
    got = {r.label: (r.n, list(r.examples)) for r in rules.counted(moved).collect()}
    assert got["private->quarantined"] == (30, [f"c{k:03}" for k in range(0, 60, 3)])
    assert got["indexed->quarantined"][0] == 60 and len(got["indexed->quarantined"][1]) == 20 and rules.counted(moved.limit(0)).count() == 0


def test_files_and_rows_are_reconciled(spark, tmp_path):
    path = str(tmp_path / "n")
    c = spark.createDataFrame([(f"c{k}",) for k in range(6)], "conversation_id string")
    m = spark.createDataFrame([], "message_id string, conversation_id string, ordinal int, role string, timestamp double, content_text string")
    normalized.write(c, m, path)
    line = json.dumps({"conversation": {"conversation_id": "c1"}})
    (tmp_path / "n" / "shard=zz").mkdir()
    (tmp_path / "n" / "shard=zz" / "x.json").write_text(line + "\n{broken\n")
    now = c.where("conversation_id <> 'c0'").unionByName(spark.createDataFrame([("new",)], "conversation_id string"))
    got = {(r.conversation_id, r.problem) for r in normalized.reconciled(spark, path, now).collect()}
    assert got == {("c0", "stray"), ("new", "missing"), ("c1", "misplaced"), ("c1", "repeated")}


# ---- ledger


def test_a_second_run_asks_nothing_and_a_change_asks_again(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def scorer(prompts):
        asked.add(len(prompts))
        return ['[{"ordinal": 0, "register": "work"}]' if "[" not in p.split("\n", 1)[0] or "register" in p.split("\n", 1)[0] else '{"items": [{"kind": "decision", "title": "Use  Redis"}]}' for p in prompts]

    books = ledger.Ledger(Store(spark, f"file://{tmp_path}/root").init())
    convs = spark.createDataFrame([(c, f"Neutral {c}", "indexed") for c in "abc"], "conversation_id string, title string, state string").withColumn("summary_short", F.lit(""))
    said = spark.createDataFrame([(f"{c}{k}", c, k, "user" if k % 2 == 0 else "assistant", f"plain words {c} {k}") for c in "abc" for k in range(4)], "message_id string, conversation_id string, ordinal int, role string, content_text string")
    on = runner.Config(True, ("classify", "extract"))
    assert books.classify(convs, said, scorer, on, 1.0) == 3
    first = asked.value
    assert books.store.read("register").count() <= 3 and books.done.count() == 3
    assert books.classify(convs, said, scorer, on, 2.0) == 0 and asked.value == first
    changed = said.withColumn("content_text", F.when(F.col("conversation_id") == "b", F.concat("content_text", F.lit("!"))).otherwise(F.col("content_text")))
    assert books.classify(convs, changed, scorer, on, 3.0) == 1
    assert books.done.count() == 3 and books.done.where("at = 3.0").count() == 1
    prompts = spark.createDataFrame([("one",), ("two",), ("one",), ("fail",)], "prompt string")
    echo = lambda ps: (asked.add(len(ps)), [None if p == "fail" else p.upper() for p in ps])[1]
    assert sorted(str(r.response) for r in books.ask(prompts, "extract", echo, on, 4.0).collect()) == ["None", "ONE", "ONE", "TWO"]
    before = asked.value
    books.ask(prompts, "extract", echo, on, 5.0)
    assert asked.value == before + 1  # only the failure
    assert books.cache.where("last_used = 5.0").count() == 2


def test_the_cap_of_answers_holds_and_keeps_those_used_last(spark):
    cache = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("prompt_key"), F.lit("r").alias("response"), (F.col("id") % 10).cast("double").alias("last_used"))
    for most in (0, 1, 50, 250, 999, 1000):
        kept = ledger.evicted(cache, most)
        n = kept.count()
        assert n <= most and n >= 0.8 * most - 2
        if most >= 250:
            assert kept.where("last_used = 9").count() == 100
    assert ledger.evicted(cache.withColumn("last_used", F.lit(1.0)), 300).count() <= 300


def test_groups_are_replaced_by_level(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/root").init()
    ddl = "group_id string, level string, conversation_id string"
    rows = lambda level, *ids: spark.createDataFrame([(f"{level}_{i}", level, i) for i in ids], ddl)
    held = lambda: sorted((r.level, r.conversation_id) for r in s.read("groups").collect())
    s.commit({"groups": rows("broad", "a", "b").unionByName(rows("fine", "a")).unionByName(spark.createDataFrame([("g", None, "z")], ddl)).where("level IS NOT NULL"), "other": spark.range(2)})
    s.replace_parts("groups", "level", {"broad": rows("broad", "c")})
    assert held() == [("broad", "c"), ("fine", "a")]
    before = s.versions()
    s.replace_parts("groups", "level", {"broad": rows("broad", "d", "e")})
    after = s.versions()
    assert held() == [("broad", "d"), ("broad", "e"), ("fine", "a")]
    assert {n for n in after if after[n] != before[n]} == {"groups+broad"}
    s.replace_parts("groups", "level", {"fine": rows("fine"), "broad": rows("broad", "f")})
    assert held() == [("broad", "f")] and set(s.tables()) == {"groups", "other"}
    with pytest.raises(ValueError):
        s.replace_parts("groups", "level", {"fine": rows("broad", "x")})
    with pytest.raises(ValueError):
        s.replace_parts("groups", "level", {"../x": rows("../x", "x")})
    s.commit({"groups": rows("fine", "y")})  # whole again
    assert held() == [("fine", "y")] and set(s.versions()) == {"groups", "other"}
    s.collect(grace=0)
    assert held() == [("fine", "y")] and s.unnamed() == {}


def test_a_part_keeps_rows_without_a_value(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/root").init()
    s.commit({"t": spark.createDataFrame([("a", None), ("b", "x"), ("c", "y")], "id string, level string")})
    s.replace_parts("t", "level", {"x": spark.createDataFrame([("d", "x", 1)], "id string, level string, extra int")})
    assert sorted((r.id, r.level, r.extra) for r in s.read("t").collect()) == [("a", None, None), ("c", "y", None), ("d", "x", 1)]


def test_deleted_rows_go_from_parts_too(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/root").init()
    rows = spark.createDataFrame([("a", "x", "secretword"), ("b", "x", "plain")], "conversation_id string, level string, label string")
    s.replace_parts("groups", "level", {"x": rows})
    s.replace_parts("groups", "level", {"x": rows})
    s.commit({"groups": s.read("groups").where("conversation_id <> 'a'")})
    s.purge({"conversation_id": rows.where("conversation_id = 'a'").select("conversation_id")})
    assert s.unnamed() == {} and s.read("groups").count() == 1


def test_provenance_gives_way_per_conversation(spark):
    objects = spark.createDataFrame([("o1",), ("o2",), ("o3",)], "object_id string")
    link = lambda *rows: spark.createDataFrame(rows, "object_id string, conversation_id string")
    old = link(("o1", "a"), ("o2", "a"), ("o2", "b"), ("o3", "a"))
    ids = spark.createDataFrame([("a",), ("a",), ("c",)], "conversation_id string")
    left, links = lifecycle.replace_provenance(objects, old, link(("o1", "a")), ids)
    assert sorted(map(tuple, links.collect())) == [("o1", "a"), ("o2", "b")] and sorted(r.object_id for r in left.collect()) == ["o1", "o2"]


def test_cut_texts_and_tables_say_so(spark):
    assert X.shortened("  abc ", 3) == "abc" and X.shortened("abcd", 3) == "ab…" and X.shortened("ab cd", 4) == "ab…"
    page = sinks.report({"t": spark.range(5)}, most=3)
    assert "Only the first 3 of 5 rows" in page and "Only" not in sinks.report({"t": spark.range(3)}, most=3)


def test_every_tree_is_read_where_there_are_more_than_files_were(spark, tmp_path):
    """Two lists in one export file would be read as the first alone."""
    n = imports.TREE_CONVERSATIONS
    said = sorted((tree * n + c, turn, ("user", "assistant")[turn % 2], f"text {tree} {c} {turn}") for tree in range(20) for c in range(2) for turn in range(3))
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = imports.QUERIES["s05_tree_paths"](spark, str(tmp_path)).collect()
    wanted = [(f"t{c // n}", c % n * 3 + turn, role, text) for c, turn, role, text in said]
    assert sorted(map(tuple, found)) == sorted(wanted)
