"""Exports, sinks, snapshots, streams and the tool surface."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from colloquy.api import Api, import_exports, process, rebuild
from colloquy.assist import runner, sampling, tasks
from colloquy.operators import rules
from colloquy.operators.store import Store
from colloquy.sources import exports, ingest, normalized, sinks
from colloquy.streaming import ingest as stream

TREE = [{
    "id": "t1", "title": "Tree", "create_time": 1700000000.5, "update_time": 1700000100000, "current_node": "c",
    "mapping": {
        "root": {"id": "root", "parent": None, "children": ["a"], "message": None},
        "a": {"id": "a", "parent": "root", "children": ["b", "x"], "message": {"id": "a", "author": {"role": "user"}, "create_time": 1.0, "content": {"content_type": "text", "parts": ["hello", {"content_type": "image_asset_pointer"}]}}},
        "b": {"id": "b", "parent": "a", "children": ["c"], "message": {"id": "b", "author": {"role": "system"}, "content": {"content_type": "text", "parts": [""]}}},
        "c": {"id": "c", "parent": "b", "children": [], "message": {"id": "c", "author": {"role": "assistant"}, "content": {"content_type": "code", "language": "python", "text": "x = 1"}}},
        "x": {"id": "x", "parent": "a", "children": [], "message": {"id": "x", "author": {"role": "assistant"}, "content": {"content_type": "text", "parts": ["branch"]}}},
    },
}]
LIST = [{
    "uuid": "u1", "name": "List", "created_at": "2024-01-01T00:00:00.123456789Z", "updated_at": None,
    "chat_messages": [
        {"uuid": "1", "sender": "human", "text": "hi", "content": [{"type": "text", "text": "hi there"}], "attachments": [{"file_name": "f.txt"}], "created_at": "2024-01-01T00:00:01Z"},
        {"uuid": "2", "sender": "assistant", "text": " ", "content": [], "created_at": "2024-01-01T00:00:02Z"},
        {"uuid": "3", "sender": "assistant", "text": "", "content": [{"type": "tool_use", "name": "calc"}, {"type": "tool_result", "content": [{"text": "42"}]}], "created_at": "2024-01-01T00:00:03Z"},
    ],
}]


def test_both_exports(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "conversations.json").write_text("﻿" + json.dumps(TREE))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("deep/conversations.json", json.dumps(LIST))
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    c, m = exports.parse_exports(exports.read_exports(spark, str(tmp_path)))
    convs = {r.source: r for r in c.collect()}
    assert convs["chatgpt"].created_at == 1700000000.5 and convs["chatgpt"].updated_at == 1700000100.0
    assert convs["claude"].title == "List" and abs(convs["claude"].created_at - 1704067200.123456) < 1e-3
    said = {(r.source_conversation_id, r.ordinal): (r.role, r.content_text) for r in m.collect()}
    assert said["t1", 0] == ("user", "hello\n\n[asset:image_asset_pointer]")
    assert said["t1", 1] == ("assistant", "```python\nx = 1\n```")
    assert said["u1", 0] == ("user", "hi there\n\n[attachment:f.txt]")
    assert said["u1", 2] == ("assistant", "[tool_use:calc]\n\n[tool_result] 42")
    assert len(said) == 4


def test_tree_without_current_node_takes_last_children(spark, tmp_path):
    t = json.loads(json.dumps(TREE))
    t[0]["current_node"] = None
    (tmp_path / "conversations.json").write_text(json.dumps(t))
    _, m = exports.parse_exports(exports.read_exports(spark, str(tmp_path / "conversations.json")), "chatgpt")
    assert [r.content_text for r in m.orderBy("ordinal").collect()][-1] == "branch"


def test_import_outcomes(spark):
    found = spark.createDataFrame([("a", "f1"), ("b", "f1"), ("c", "f2")], "conversation_id string, fingerprint string")
    known = spark.createDataFrame([("f2",)], "fingerprint string")
    assert {r.conversation_id: r.outcome for r in ingest.outcomes(found, known).collect()} == {"a": "imported", "b": "duplicate", "c": "duplicate"}


def test_normalised_round_trip_and_broken_lines(spark, tmp_path):
    c = spark.createDataFrame([("a", "T", 1.0)], "conversation_id string, title string, created_at double")
    m = spark.createDataFrame([("m1", "a", 0, "user", 1.0, "hi"), ("m2", "a", 1, "assistant", None, None)], "message_id string, conversation_id string, ordinal int, role string, timestamp double, content_text string")
    path = str(tmp_path / "n")
    normalized.write(c, m, path)
    (tmp_path / "n" / "shard=zz").mkdir()
    (tmp_path / "n" / "shard=zz" / "x.json").write_text("{broken\n")
    c2, m2 = normalized.read(spark, path, "conversation_id string, title string, created_at double")
    assert c2.collect() == c.collect() and m2.count() == 2


def test_import_skips_what_is_known_and_rebuild_gives_the_same(spark, tmp_path):
    (tmp_path / "conversations.json").write_text(json.dumps(LIST + [LIST[0] | {"uuid": "u2", "chat_messages": []}, LIST[0] | {"uuid": "u3", "name": "SSN 123-45-6789"}]))
    path = str(tmp_path / "conversations.json")
    ssn = rules.Rule("ssn", "quarantined", (r"\d{3}-\d{2}-\d{4}",), "regex")
    new = import_exports(spark, path, given=[ssn], approve=True, now=5.0)
    tables = new.tables
    assert {r.outcome: r.n for r in new.counters.collect()} == {"imported": 2, "empty": 1}
    assert {r.source_conversation_id: r.state for r in tables["conversations"].collect()} == {"u1": "indexed", "u3": "quarantined"}
    again = import_exports(spark, path, tables)
    assert {r.outcome: r.n for r in again.counters.collect()} == {"duplicate": 2, "empty": 1}
    normalized.write(tables["conversations"], tables["messages"].withColumn("timestamp", F.col("timestamp")), str(tmp_path / "n"))
    back = rebuild(spark, str(tmp_path / "n"))
    assert sorted(back["conversations"].select("conversation_id", "state", "title").collect()) == sorted(tables["conversations"].select("conversation_id", "state", "title").collect())
    assert back["messages"].count() == tables["messages"].count() and back["chunks"].count() == 2


def test_workbook_and_report(spark, tmp_path):
    df = spark.createDataFrame([("a<b", 1), (None, 2)], "name string, n int")
    path = str(tmp_path / "w.xlsx")
    assert sinks.write_workbook({"one": df, "two": df.limit(0)}, path) == {"one": 2, "two": 0}
    with zipfile.ZipFile(path) as z:
        assert b"a&lt;b" in z.read("xl/worksheets/sheet1.xml") and "xl/workbook.xml" in z.namelist()
    assert "a&lt;b" in sinks.report({"t": df})


def test_store_snapshots(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/root").init()
    df = spark.range(3)
    s.commit({"t": df})
    s.init()
    assert s.read("t").count() == 3
    s.commit({"t": df.limit(1)}, purge=True)
    assert s.read("t").count() == 1 and len([p for p in (tmp_path / "root" / "t").iterdir() if p.is_dir()]) == 1


def test_stream_takes_each_fingerprint_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = {"fingerprint": "f", "conversation_id": "c", "source": "chatgpt", "title": "t", "imported_at": "2024-01-01T00:00:00Z"}
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(row) for _ in range(3)) + "\n" + json.dumps(row | {"fingerprint": "g"}))
    q = stream.start(stream.once(stream.arrivals(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def _messages(spark):
    rows = [("a", i, "user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(40)]
    return spark.createDataFrame(rows, "conversation_id string, ordinal int, role string, content_text string")


def test_sampling_keeps_first_last_and_replies(spark):
    got = [r.ordinal for r in sampling.sampled(_messages(spark)).orderBy("ordinal").collect()]
    assert got[:4] == [0, 1, 2, 3] and got[-2:] == [38, 39] and len(got) <= 13


def test_runner_caches_clips_and_gates(spark):
    calls = spark.createDataFrame([("x" * 50,), ("x" * 50,), ("fail",)], "prompt string")
    fake = lambda prompts: [None if p == "fail" else p.upper() for p in prompts]
    on = runner.Config(True, ("classify",), max_response_chars=5)
    rows, fresh = runner.run(calls, "classify", fake, on)
    assert sorted(str(r.response) for r in rows.collect()) == ["None", "XXXXX", "XXXXX"] and fresh.count() == 1
    off, _ = runner.run(calls, "summarize", fake, on)
    assert off.where("response IS NOT NULL").count() == 0


def test_gated_chunks_merge_on_yes(spark):
    m = _messages(spark)
    chunks = spark.createDataFrame([("a", 0, 0, 9), ("a", 1, 10, 19), ("a", 2, 20, 39)], "conversation_id string, chunk_index int, start_message_ordinal int, end_message_ordinal int")
    fake = lambda prompts: ["yes" if "text 9" in p else "no" for p in prompts]
    got = tasks.gate_chunks(m, chunks, fake, runner.Config(True, ("chunk_gating",))).orderBy("chunk_index").collect()
    assert [(r.start_message_ordinal, r.end_message_ordinal) for r in got] == [(0, 19), (20, 39)]


def test_tools(spark):
    c = spark.createDataFrame([("a", "Atlas plan", "indexed", 2, "chatgpt", 1.0, None), ("b", "Secret", "private", 2, "claude", 1.0, None)], "conversation_id string, title string, state string, message_count int, source string, created_at double, updated_at double")
    c = c.withColumns({"manual_tags": F.array().cast("array<string>"), "auto_tags": F.array().cast("array<string>")})
    m = spark.createDataFrame([(f"{k}{i}", k, i, r, t) for k in "ab" for i, (r, t) in enumerate([("user", "We decided to use Redis for Project Atlas."), ("assistant", "ok")])], "message_id string, conversation_id string, ordinal int, role string, content_text string")
    tables = process({"conversations": c, "messages": m})
    tables["register"] = c.select("conversation_id", F.lit(None).cast("string").alias("dominant_register"))
    tables["groups"] = c.select(F.lit("g").alias("group_id"), F.lit("broad").alias("level"), "conversation_id")
    api = Api(spark, tables, 2.0)
    assert [r["conversation_id"] for r in api.call("search_conversations", {"query": "redis"})] == ["a"]
    assert len(api.call("list_decisions")) == 1 and api.call("get_conversation_messages", {"conversation_id": "a"})[0]["role"] == "user"
    asked = lambda name, **a: api.handle({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})
    assert "error" in asked("get_conversation_messages", conversation_id="b") and "error" in asked("nothing")
    assert "error" in asked("add_tag", conversation_id="a", tags=["x"])
    assert "error" in asked("list_decisions", register="nonsense")
    api.writes = True
    assert "result" in asked("add_tag", conversation_id="a", tags=["x"])
    assert [r.manual_tags for r in api.tables["conversations"].where("conversation_id = 'a'").collect()] == [["x"]]
    out = io.StringIO()
    api.serve([json.dumps({"id": 1, "method": "tools/list"}), json.dumps({"method": "note"})], out)
    assert len(out.getvalue().splitlines()) == 1
