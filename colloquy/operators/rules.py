"""Auto-classification rules over conversations."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SEVERITY, STATES

FIELDS = ("title", "summary", "messages")
MOST_NOTES = 5
#: Conversations that counters name of each change.
MOST_EXAMPLES = 20


@dataclass(frozen=True)
class Rule:
    """A keyword or regular expression that asks for a state."""

    name: str
    target: str
    patterns: tuple[str, ...]
    kind: str = "keyword"
    fields: tuple[str, ...] = FIELDS
    ignore_case: bool = True

    def __post_init__(self) -> None:
        if self.target not in STATES or self.kind not in ("keyword", "regex") or not set(self.fields) <= set(FIELDS):
            raise ValueError(f"rule {self.name!r} isn't valid")

    def expression(self) -> str:
        parts = [re.escape(p) if self.kind == "keyword" else f"(?:{p})" for p in self.patterns]
        return ("(?i)" if self.ignore_case else "") + "|".join(parts)


def load(text: str) -> list[Rule]:
    """Rules from JSON: a list of objects with the fields of Rule."""
    return [Rule(**{**r, "patterns": tuple(r["patterns"]), **({"fields": tuple(r["fields"])} if "fields" in r else {})}) for r in json.loads(text)]


def severity(state: Column) -> Column:
    """How much a state restricts; an unknown or null one not at all."""
    return reduce(lambda c, x: c.when(state == x[0], x[1]), SEVERITY.items(), F.when(F.lit(False), 0)).otherwise(0)


def evaluate(conversations: DataFrame, messages: DataFrame, rules: list[Rule]) -> DataFrame:
    """conversation_id, rule_state, notes of conversations that match a rule.

    Rules are few: each is a predicate of its own on the text in place, so
    texts are scanned once and never joined to patterns. The most restrictive
    state holds, ties by the order of states.
    """
    if not rules:
        return conversations.where(F.lit(False)).select("conversation_id", F.lit("").alias("rule_state"), F.lit("").alias("notes"))
    tests = lambda column, name: [F.col(column).rlike(r.expression()) if name in r.fields else F.lit(False) for r in rules]
    flags = [f"r{k}" for k in range(len(rules))]
    said = messages.select("conversation_id", *[t.cast("int").alias(f) for t, f in zip(tests("content_text", "messages"), flags, strict=True)])
    in_text = said.groupBy("conversation_id").agg(*[F.sum(f).alias(f) for f in flags])
    own = conversations.select("conversation_id", *[(a | b).cast("int").alias("t" + f) for a, b, f in zip(tests("title", "title"), tests("summary_short", "summary"), flags, strict=True)])
    both = own.join(in_text, "conversation_id", "left")
    total = {f: F.coalesce(F.col("t" + f), F.lit(0)) + F.coalesce(F.col(f), F.lit(0)) for f in flags}
    hits = [F.when(total[f] > 0, F.struct(F.lit(SEVERITY[r.target]).alias("severity"), F.lit(r.target).alias("target"), F.lit(r.name).alias("name"), total[f].alias("times"))) for r, f in zip(rules, flags, strict=True)]
    rows = both.select("conversation_id", F.array_compact(F.array(*hits)).alias("hits")).where(F.size("hits") > 0)
    worst = F.array_max(F.transform("hits", lambda h: F.struct(h["severity"], h["target"])))
    told = F.transform(F.slice("hits", 1, MOST_NOTES), lambda h: F.concat(F.lit("rule:"), h["name"], F.lit(" x"), h["times"].cast("string")))
    more = F.when(F.size("hits") > MOST_NOTES, F.format_string(" (+%d more)", F.size("hits") - MOST_NOTES)).otherwise("")
    return rows.select("conversation_id", worst["target"].alias("rule_state"), F.concat(F.array_join(told, "; "), more).alias("notes"))


def initial_state(found: DataFrame, ids: DataFrame, approve: bool = False) -> DataFrame:
    """State at import: that of the rules, else indexed where approved, else pending_review."""
    return ids.join(found.select("conversation_id", "rule_state"), "conversation_id", "left").select(
        "conversation_id", F.coalesce("rule_state", F.lit("indexed" if approve else "pending_review")).alias("state")
    )


def _smallest(most: int):
    """A task's share of the smallest ids of each group, at most ``most`` of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        held: dict[str, list[str]] = {}
        for batch in batches:
            for group, name in zip(batch["label"].to_pylist(), batch["conversation_id"].to_pylist(), strict=True):
                counts[group] = counts.get(group, 0) + 1
                ids = held.setdefault(group, [])
                if len(ids) < most or name < ids[-1]:
                    bisect.insort(ids, name)
                    del ids[most:]
        labels = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array([counts[x] for x in labels], pa.int64()), pa.array([held[x] for x in labels], pa.list_(pa.string()))], ["label", "n", "ids"])

    return run


def counted(moved: DataFrame, most: int = MOST_EXAMPLES) -> DataFrame:
    """label (``from->to``), n, examples (the smallest ids, at most ``most``) of rows with conversation_id, old_state, new_state.

    A group is counted in each task first, which hands on its smallest ids
    only, so no group's ids are gathered.
    """
    rows = moved.select(F.concat_ws("->", "old_state", "new_state").alias("label"), "conversation_id")
    parts = rows.mapInArrow(_smallest(most), "label string, n long, ids array<string>")
    ids = F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, most)
    return parts.groupBy("label").agg(F.sum("n").alias("n"), ids.alias("examples"))


def rescan(conversations: DataFrame, messages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Conversations that rules make more restricted: old and new state, notes. Never less restricted."""
    found = evaluate(conversations, messages, rules)
    rows = conversations.select("conversation_id", "state").join(found, "conversation_id")
    return rows.where(severity(F.col("rule_state")) > severity(F.col("state"))).select("conversation_id", F.col("state").alias("old_state"), F.col("rule_state").alias("new_state"), "notes")
