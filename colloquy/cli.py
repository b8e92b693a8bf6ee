"""``python -m colloquy.cli ROOT COMMAND ...``: a corpus from exports to workbooks.

Every command that changes the corpus writes one snapshot and appends to the
log beside it (command, ids and counts, never texts).
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import import_exports, process, rebuild
from .operators import lifecycle, rules, scratch, search, stored, views
from .operators import query as querylang
from .operators.store import Store
from .operators.stored import SearchState
from .schema import CHUNK, CONVERSATION, MESSAGE, OBJECT, PROVENANCE
from .sources import normalized, sinks, workbooks

EMPTY = {
    "conversations": CONVERSATION,
    "messages": MESSAGE,
    "chunks": CHUNK,
    "objects": OBJECT,
    "provenance": PROVENANCE,
    "register": "conversation_id string, dominant_register string",
    "groups": "group_id string, level string, keyword_label string, conversation_id string",
}
STATE_OF = {"approve": "indexed", "private": "private", "quarantine": "quarantined"}


class Corpus:
    """The commands; those that read return a DataFrame."""

    def __init__(self, spark: SparkSession, root: str, now: float) -> None:
        self.spark, self.now = spark, now
        self.store = Store(spark, root).init()
        self.tables = {name: spark.createDataFrame([], ddl) for name, ddl in EMPTY.items()} | self.store.tables()

    def _commit(self, changed: dict[str, DataFrame], drop: list[str] | tuple[str, ...] = (), **entry) -> None:
        self.store.commit(changed, drop=drop)
        if entry:
            sinks.append_log(self.spark, f"{self.store.root}/log", [entry | {"at": self.now}])
        self.tables = {n: t for n, t in self.tables.items() if n not in drop} | self.store.tables()
        self.store.collect()

    def index(self) -> None:
        """Builds the search state anew, the embedder's vocabulary included."""
        state = SearchState.build(*(self.tables[n] for n in ("conversations", "messages", "chunks"))).tables()
        self._commit(state, [n for n in stored.segment_tables(self.tables) if n not in state], command="index")

    def _changed(self, changed: dict[str, DataFrame], touched: DataFrame, **entry) -> None:
        """Commits ``changed`` and, where there is a search state, a segment with some conversations as they are now."""
        state, now = SearchState.load(self.tables), self.tables | changed
        if state is None:
            return self._commit(changed, **entry)
        number = stored.segments(self.tables)[-1] + 1
        self._commit(changed | state.change(now["conversations"], now["messages"], now["chunks"], touched, number), **entry)
        if stored.due(self.tables):
            self._commit(SearchState.load(self.tables).tables(number + 1), stored.segment_tables(self.tables))
        return None

    def _ids(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "conversation_id string")

    def import_(self, path: str, approve: bool = False, rules_file: str | None = None) -> DataFrame:
        given = rules.load(open(rules_file).read()) if rules_file else None
        new = import_exports(self.spark, path, self.tables, given, approve, now=self.now)
        counted = {r["outcome"]: r["n"] for r in new.counters.collect()}
        if counted.get("imported") or counted.get("updated"):
            self._changed(new.tables, new.changed.select("conversation_id"), command="import", **counted)
        return self.spark.createDataFrame(sorted(counted.items()), "outcome string, n long")

    def process(self) -> None:
        made = process({"conversations": self.tables["conversations"], "messages": self.tables["messages"]})
        self._commit({n: made[n] for n in ("conversations", "chunks", "objects", "provenance")}, command="process")
        self.index()

    def set_state(self, command: str, ids: list[str]) -> None:
        requests = self._ids(ids).withColumn("new_state", F.lit(STATE_OF[command]))
        moved = lifecycle.set_states(self.tables, requests)
        self._changed({n: moved[n] for n in ("conversations", "chunks", "provenance", "objects")}, self._ids(ids), command=command, ids=ids)

    def delete(self, ids: list[str], sure: bool = False) -> DataFrame | None:
        """The plan; deletes only if ``sure``, and then from every stored version and the normalised JSON too."""
        gone = self._ids(ids)
        if not sure:
            return lifecycle.delete_plan(self.tables["objects"], self.tables["provenance"], gone)
        before = self.tables["objects"]
        left = lifecycle.delete({n: t for n, t in self.tables.items() if not n.startswith("search_")}, gone)
        objects = scratch.table(before.select("object_id").join(left["objects"].select("object_id"), "object_id", "left_anti"), "gone-objects")
        self._commit(left | stored.purged(self.tables, gone), command="delete", ids=ids)
        self.store.purge({"conversation_id": gone, "object_id": objects})
        for path in self.store.noted("normalized"):
            normalized.remove(self.spark, path, gone)
        return None

    def tag(self, conversation_id: str, tags: list[str], add: bool = True) -> None:
        change = lifecycle.add_tags if add else lifecycle.remove_tags
        self._commit({"conversations": change(self.tables["conversations"], conversation_id, tags)}, command="tag" if add else "untag", ids=[conversation_id])

    def merge(self, loser: str, winner: str) -> None:
        pairs = self.spark.createDataFrame([(loser, winner)], "loser_id string, winner_id string")
        objects, provenance = lifecycle.merge_objects(self.tables["objects"], self.tables["provenance"], pairs)
        self._commit({"objects": objects, "provenance": provenance}, command="merge", ids=[loser, winner])

    def change_object(self, command: str, object_id: str, title: str = "") -> None:
        old = self.tables["objects"]
        objects = lifecycle.rename(old, object_id, title) if command == "rename" else lifecycle.suppress(old, object_id, command == "suppress")
        self._commit({"objects": objects}, command=command, ids=[object_id])

    def review(self) -> DataFrame:
        return self.tables["conversations"].where("state = 'pending_review'").select("conversation_id", "source", "title", "message_count").orderBy("conversation_id")

    def list(self) -> DataFrame:
        return search.list_conversations(self.tables["conversations"], self.now).select("conversation_id", "title", "score")

    def query(self, text: str, limit: int = 25) -> DataFrame:
        given = {n: self.tables[n] for n in ("conversations", "messages", "chunks", "objects", "provenance", "register")}
        return querylang.run(text, now=self.now, limit=limit, state=SearchState.load(self.tables), **given)

    def check(self) -> DataFrame:
        return views.health(*(self.tables[n] for n in ("conversations", "messages", "chunks", "objects", "provenance")))

    def export(self, path: str, profile: str) -> DataFrame:
        counts = sinks.write_workbook(workbooks.sheets(profile, self.tables), path)
        return self.spark.createDataFrame(list(counts.items()), "sheet string, n long")

    def report(self, path: str) -> None:
        overview = views.overview(self.tables["conversations"], self.tables["objects"], self.tables["provenance"])
        with open(path, "w") as f:
            f.write(sinks.report({"Overview": overview, "Conversations": views.redacted(self.tables["conversations"])}))

    def normalize(self, path: str) -> None:
        normalized.write(self.tables["conversations"], self.tables["messages"], path)
        self.store.note("normalized", path)

    def rebuild(self, path: str) -> None:
        made = rebuild(self.spark, path)
        self._commit({n: made[n] for n in EMPTY if n in made}, command="rebuild")
        self.index()

    def log(self) -> DataFrame:
        return self.spark.read.text(f"{self.store.root}/log")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="colloquy", description=__doc__)
    p.add_argument("root")
    p.add_argument("--now", type=float, default=None, help="POSIX seconds that count as now")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *words: str, **options) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for w in words:
            sub.add_argument(w.rstrip("*"), nargs="+" if w.endswith("*") else None)
        for o, kind in options.items():
            sub.add_argument(f"--{o}", **({"action": "store_true"} if kind is bool else {"type": kind, "default": None}))
        return sub

    for name in ("process", "index", "review", "list", "check", "log"):
        command(name)
    command("import", "path", approve=bool, rules=str)
    for name in STATE_OF:
        command(name, "ids*")
    command("delete", "ids*", sure=bool)
    command("tag", "id", "tags*")
    command("untag", "id", "tags*")
    command("merge", "loser", "winner")
    command("rename", "id", "title")
    command("suppress", "id")
    command("restore", "id")
    command("query", "text", limit=int)
    command("export", "path", profile=str)
    for name in ("report", "normalize", "rebuild"):
        command(name, "path")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a command; rows go to standard output, one JSON object a line."""
    given = _parser().parse_args(arguments)
    corpus = Corpus(spark or SparkSession.builder.getOrCreate(), given.root, time.time() if given.now is None else given.now)
    run = {
        "import": lambda: corpus.import_(given.path, given.approve, given.rules),
        "delete": lambda: corpus.delete(given.ids, given.sure),
        "tag": lambda: corpus.tag(given.id, given.tags),
        "untag": lambda: corpus.tag(given.id, given.tags, add=False),
        "merge": lambda: corpus.merge(given.loser, given.winner),
        "rename": lambda: corpus.change_object("rename", given.id, given.title),
        "suppress": lambda: corpus.change_object("suppress", given.id),
        "restore": lambda: corpus.change_object("restore", given.id),
        "query": lambda: corpus.query(given.text, given.limit or 25),
        "export": lambda: corpus.export(given.path, given.profile or "project_workbook"),
    }
    run |= {name: (lambda name=name: corpus.set_state(name, given.ids)) for name in STATE_OF}
    run |= {name: (lambda name=name: getattr(corpus, name)(given.path)) for name in ("report", "normalize", "rebuild")}
    run |= {name: getattr(corpus, name) for name in ("process", "index", "review", "list", "check", "log")}
    rows = run[given.command]()
    if rows is not None:
        for r in rows.toLocalIterator():
            print(json.dumps(r.asDict(recursive=True), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
