"""The tool surface: named read tools, opt-in write tools, JSON-RPC over stdio, a command line.

A thin adapter: each tool turns arguments into an operator's DataFrame and the
DataFrame into rows. Read tools see indexed conversations only.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .assist import tasks
from .functions import text as X
from .operators import chunking, cluster, extraction, lifecycle, rules, scratch, search, views
from .operators import query as querylang
from .operators.store import Store
from .operators.stored import SearchState
from .schema import CONVERSATION, MESSAGE, REGISTERS, VISIBLE, in_states, migrated
from .sources import exports, ingest, normalized, sinks


class ToolError(ValueError):
    """An argument that can't be used, or something that may not be shown."""


@dataclass
class Api:
    """Tools over the tables of a corpus."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    now: float
    store: Store | None = None
    writes: bool = False
    log: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        t = self.tables
        self._query = {"conversations": t["conversations"], "messages": t["messages"], "chunks": t["chunks"], "objects": t["objects"], "provenance": t["provenance"], "register": t["register"], "now": self.now, "state": SearchState.load(t)}
        stored = {"state": self._query["state"]}
        read: dict[str, Callable[..., DataFrame]] = {
            "query": lambda query="", limit=25: querylang.run(query, limit=int(limit) or 25, **self._query),
            "search_conversations": self._search_conversations,
            "search_chunks": lambda query="", limit=25: search.chunk_search(t["conversations"], t["messages"], t["chunks"], query, **stored).orderBy(F.desc("score"), "chunk_id").limit(int(limit) or 25),
            "get_conversation_summary": lambda conversation_id: self._shown(conversation_id),
            "get_conversation_messages": lambda conversation_id, limit=200: self._of(conversation_id, "messages").orderBy("ordinal").limit(int(limit) or 200).select("ordinal", "role", "content_text"),
            "get_conversation_chunks": lambda conversation_id: self._of(conversation_id, "chunks").orderBy("chunk_index"),
            "get_project": lambda project_id: search.cooccurring(project_id, t["objects"], t["provenance"], t["conversations"]),
            "get_project_timeline": lambda project_id: search.project_timeline(project_id, t["provenance"], t["conversations"]).orderBy("at", "conversation_id"),
            "list_groups": lambda level=None: self._groups(level),
            "get_group": lambda group_id: self._members(group_id),
            "inspect_conversation_storage": lambda conversation_id: views.redacted(t["conversations"].where(F.col("conversation_id") == conversation_id)).join(
                views.storage_counts(t["conversations"].where(F.col("conversation_id") == conversation_id), t["messages"], t["chunks"], t["provenance"]), "conversation_id"
            ),
            "generate_profile": lambda: tasks.profile(t["conversations"], t["objects"], t["provenance"], t["register"]),
            "find_related": lambda context="", limit=10: search.find_related(t["conversations"], t["messages"], t["chunks"], context, int(limit) or 10, **stored),
        }
        for name, kind in (("list_projects", "project"), ("list_open_loops", "open_loop"), ("list_decisions", "decision"), ("list_entities", "entity")):
            read[name] = lambda limit=200, kind=kind, **filters: search.list_objects(kind, t["objects"], t["provenance"], t["conversations"], t["register"], **self._filters(filters)).orderBy("title").limit(int(limit) or 200)
        self.read = read
        self.write: dict[str, Callable[..., None]] = {"set_group_label": self._set_group_label, "add_tag": self._add_tag, "remove_tag": self._remove_tag, "rename_derived_object": self._rename}

    def _filters(self, given: dict[str, Any]) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for name in ("after", "before"):
            if value := given.get(name):
                out[name] = querylang.date_literal(value)
        if (register := given.get("register")) and register != "all":
            names = tuple(register if isinstance(register, list) else [register])
            if unknown := [r for r in names if r not in REGISTERS]:
                raise ToolError(f"unknown register {unknown[0]!r}")
            out["registers"] = names
        if (source := given.get("source")) and source != "all":
            out["sources"] = (source,)
        return out

    def _search_conversations(self, query: str = "", limit: int = 25, **filters) -> DataFrame:
        t = self.tables
        shown = search.filtered(t["conversations"].where(in_states("state", VISIBLE)), register=t["register"], **self._filters(filters))
        found = search.hybrid_search(t["conversations"], t["messages"], t["chunks"], query, self.now, int(limit) or 25, state=self._query["state"])
        return found.join(shown.select("conversation_id", "title", "source"), "conversation_id").orderBy(F.desc("score"), "conversation_id").limit(int(limit) or 25)

    def _shown(self, conversation_id: str) -> DataFrame:
        row = self.tables["conversations"].where((F.col("conversation_id") == conversation_id) & in_states("state", VISIBLE))
        if row.isEmpty():
            raise ToolError("no such conversation")
        return row

    def _of(self, conversation_id: str, table: str) -> DataFrame:
        self._shown(conversation_id)
        return self.tables[table].where(F.col("conversation_id") == conversation_id)

    def _groups(self, level: str | None) -> DataFrame:
        g = self.tables["groups"]
        g = g.where(F.col("level") == level) if level else g
        safe = cluster.safe_labels(self.tables["conversations"], g).where("visible_count > 0")
        return safe.join(g.select("group_id", "level").distinct(), "group_id").orderBy(F.desc("visible_count"), "group_id")

    def _members(self, group_id: str) -> DataFrame:
        mine = self.tables["groups"].where(F.col("group_id") == group_id).select("conversation_id")
        return self.tables["conversations"].where(in_states("state", VISIBLE)).join(mine, "conversation_id", "left_semi").select("conversation_id", "title")

    def _set(self, name: str, df: DataFrame, entry: dict, part: tuple[str, str] | None = None) -> None:
        """``df`` in place of a table; ``part`` is the column and the only value of it whose rows differ."""
        if not self.writes:
            raise ToolError("write tools are off")
        self.tables[name] = df
        if self.store:
            if part:
                self.store.replace_parts(name, part[0], {part[1]: df.where(F.col(part[0]) == part[1])})
            else:
                self.store.commit({name: df})
            self.tables[name] = self.store.read(name)
        self.log.append(entry)
        if self.store:
            sinks.append_log(self.spark, f"{self.store.root}/log", [entry | {"at": self.now}])
        self.__post_init__()

    def _set_group_label(self, group_id: str, label: str) -> None:
        g = self.tables["groups"]
        g = g if "llm_label" in g.columns else g.withColumn("llm_label", F.lit(None).cast("string"))
        mine = g.where(F.col("group_id") == group_id).select("level").first()
        if mine is None:
            raise ToolError("no such group")
        named = g.withColumn("llm_label", F.when(F.col("group_id") == group_id, F.lit(X.shortened(label, 120))).otherwise(F.col("llm_label")))
        self._set("groups", named, {"tool": "set_group_label", "group_id": group_id}, ("level", mine["level"]) if mine["level"] else None)

    def _tags(self, change, name: str, conversation_id: str, tags: list[str]) -> None:
        self._shown(conversation_id)
        self._set("conversations", change(self.tables["conversations"], conversation_id, [X.shortened(t, 60) for t in tags]), {"tool": name, "conversation_id": conversation_id})

    def _add_tag(self, conversation_id: str, tags: list[str]) -> None:
        self._tags(lifecycle.add_tags, "add_tag", conversation_id, tags)

    def _remove_tag(self, conversation_id: str, tags: list[str]) -> None:
        self._tags(lifecycle.remove_tags, "remove_tag", conversation_id, tags)

    def _rename(self, object_id: str, title: str) -> None:
        seen = search.visible_objects(self.tables["objects"], self.tables["provenance"], self.tables["conversations"]).where(F.col("object_id") == object_id)
        if seen.isEmpty():
            raise ToolError("no such object")
        self._set("objects", lifecycle.rename(self.tables["objects"], object_id, X.shortened(title, 120)), {"tool": "rename_derived_object", "object_id": object_id})

    def call(self, tool: str, arguments: dict[str, Any] | None = None) -> list[dict]:
        """Rows of a read tool; nothing of a write tool."""
        if tool in self.read:
            return [r.asDict(recursive=True) for r in self.read[tool](**(arguments or {})).collect()]
        if tool in self.write:
            self.write[tool](**(arguments or {}))
            return []
        raise ToolError(f"no tool {tool!r}")

    def handle(self, request: dict) -> dict | None:
        """A JSON-RPC response; None for notifications."""
        method, number = request.get("method"), request.get("id")
        if number is None:
            return None
        try:
            if method == "initialize":
                result: Any = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "colloquy"}}
            elif method == "tools/list":
                result = {"tools": [{"name": n} for n in [*self.read, *(self.write if self.writes else ())]]}
            elif method == "tools/call":
                p = request.get("params", {})
                rows = self.call(p.get("name", ""), p.get("arguments"))
                result = {"content": [{"type": "text", "text": json.dumps(rows, default=str)}]}
            else:
                return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"no method {method}"}}
        except (ToolError, TypeError) as e:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": -32602, "message": str(e)}}
        return {"jsonrpc": "2.0", "id": number, "result": result}

    def serve(self, lines=sys.stdin, out=sys.stdout) -> None:
        for line in lines:
            if line.strip() and (answer := self.handle(json.loads(line))) is not None:
                out.write(json.dumps(answer) + "\n")
                out.flush()


def process(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Chunks, objects, links and scores of all eligible conversations: one plan each."""
    chunks = chunking.chunk_rows(tables["messages"])
    hits = extraction.harvest(tables["conversations"], tables["messages"])
    scored = extraction.with_scores(tables["conversations"].drop("importance_score", "resurfacing_score", "has_open_loops", "summary_short"), tables["messages"], hits, chunks)
    return tables | {"chunks": chunks, "objects": extraction.objects(hits), "provenance": extraction.provenance(hits, chunks), "conversations": scored}


@dataclass
class Imported:
    """What an import makes of the stored tables."""

    #: conversations and messages after the merge, and what they change among derived tables.
    tables: dict[str, DataFrame]
    #: outcome, n copies.
    counters: DataFrame
    #: conversation_id, outcome of conversations that are new or have a newer text.
    changed: DataFrame


def import_exports(spark: SparkSession, path: str, stored: dict[str, DataFrame] | None = None, given: list[rules.Rule] | None = None, approve: bool = False, parser: str = "auto", now: float | None = None, names: str = exports.NAMES) -> Imported:
    """Merges the conversations of exports into stored tables by conversation_id.

    Each copy of a conversation in the exports gets an outcome (see
    ``ingest.decided``); what is new or newer is written, so ids stay unique
    and messages are those of one copy. Rules set the initial state, else
    approval, else review; an updated conversation keeps its state and tags.
    """
    stored = stored or {}
    old = migrated(stored["conversations"], CONVERSATION) if "conversations" in stored else spark.createDataFrame([], CONVERSATION)
    before = migrated(stored["messages"], MESSAGE) if "messages" in stored else spark.createDataFrame([], MESSAGE)
    parsed = exports.parse_exports(exports.read_exports(spark, path, names), parser)
    conversations, messages = (scratch.table(df, "import-parsed") for df in parsed)  # files are read and parsed once for each
    sizes = messages.groupBy(*ingest.COPY).agg(F.count(F.lit(1)).cast("int").alias("message_count"))
    prints = ingest.fingerprints(conversations, messages, key=ingest.COPY)
    copies = conversations.join(sizes, list(ingest.COPY), "left").join(prints, list(ingest.COPY)).withColumn("message_count", F.coalesce("message_count", F.lit(0)))
    told = scratch.table(ingest.decided(copies, old), "import-copies")
    chosen = told.where("outcome IN ('imported', 'updated')")
    said = scratch.table(migrated(messages.join(chosen.select(*ingest.COPY), list(ingest.COPY), "left_semi"), MESSAGE), "import-messages")
    found = rules.evaluate(chosen.withColumn("summary_short", F.lit("")), said, given or [])
    states = rules.initial_state(found, chosen.select("conversation_id"), approve)
    asked = found.select("conversation_id", F.col("notes").alias("notes_local"), F.col("rule_state").alias("asked_state"))
    rows = chosen.join(states, "conversation_id").join(asked, "conversation_id", "left")
    rows = rows.withColumns({"imported_at": F.lit(now).cast("double"), "manual_tags": F.array().cast("array<string>"), "auto_tags": F.array().cast("array<string>")})
    fresh = migrated(rows, CONVERSATION + ", asked_state string")
    changed = chosen.select("conversation_id", "outcome")
    merged = {"conversations": ingest.merged_conversations(old, fresh), "messages": ingest.replaced(before, said, changed)}
    merged |= ingest.without_derived(stored, changed.where("outcome = 'updated'").select("conversation_id"))
    return Imported(merged, ingest.counters(told), changed)


def rebuild(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables from normalised JSON, derived ones computed anew."""
    conversations, messages = normalized.read(spark, path, CONVERSATION)
    return process({"conversations": migrated(conversations, CONVERSATION), "messages": migrated(messages, MESSAGE)})


def main(arguments: list[str] | None = None) -> int:
    """``python -m colloquy.api ROOT TOOL [JSON]``: a tool's rows, one JSON object a line."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("root")
    parser.add_argument("tool", help="a tool's name, or serve")
    parser.add_argument("arguments", nargs="?", default="{}")
    parser.add_argument("--now", type=float, default=0.0)
    parser.add_argument("--writes", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    store = Store(spark, given.root)
    api = Api(spark, store.tables(), given.now, store, given.writes)
    if given.tool == "serve":
        api.serve()
        return 0
    try:
        for row in api.call(given.tool, json.loads(given.arguments)):
            print(json.dumps(row, default=str))
    except ToolError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
