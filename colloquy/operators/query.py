"""The query language: filter prefixes and free text over three kinds of hits."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KINDS, VISIBLE, in_states
from . import search, stored

FLAGS = ("open_loops", "chunks")
#: name:value, name:"quoted value", or text up to the next of these.
_TOKEN = re.compile(r'(?P<name>[a-z_]+):(?:"(?P<quoted>[^"]*)"|(?P<plain>\S+))|(?:(?![a-z_]+:\S).)+', re.I | re.S)


_DATE = re.compile(r"(\d{4})-(\d\d?)-(\d\d?)(?:T(\d\d?):(\d\d?):(\d\d?))?")


def date_literal(value: str) -> float | None:
    """POSIX seconds of a day or a time in UTC; None where it is neither."""
    found = _DATE.fullmatch(value)
    try:
        return datetime(*(int(part) for part in found.groups(0)), tzinfo=UTC).timestamp() if found else None
    except ValueError:  # no such day or time
        return None


def _one_of(allowed: tuple[str, ...]):
    return lambda value: value.lower() if value.lower() in allowed else None


#: How the value of each prefix is read; None is not a valid value.
_FIELDS = {
    "source": str.lower,
    "tag": str,
    "project": str,
    "register": str.lower,
    "kind": _one_of(KINDS),
    "has": _one_of(FLAGS),
    "after": date_literal,
    "before": date_literal,
}


@dataclass(frozen=True)
class Query:
    """What a query string says: valid values by prefix, in order, and free text."""

    filters: dict[str, tuple] = field(default_factory=dict)
    text: str = ""

    def all(self, prefix: str) -> tuple:
        return self.filters.get(prefix, ())

    def last(self, prefix: str):
        """The value that holds where only one can; None without any."""
        return self.all(prefix)[-1] if self.all(prefix) else None


def parse(raw: str | None) -> Query:
    """The query that a string says; unknown prefixes are text, invalid values are dropped."""
    filters: dict[str, tuple] = {}
    text: list[str] = []
    for t in _TOKEN.finditer((raw or "").strip()):
        prefix = (t["name"] or "").lower()
        if prefix not in _FIELDS:
            text.append(t[0].strip())
        elif (value := _FIELDS[prefix](t["plain"] if t["quoted"] is None else t["quoted"])) is not None:
            filters[prefix] = (*filters.get(prefix, ()), value)
    return Query(filters, " ".join(filter(None, text)))


def in_projects(names: tuple[str, ...], objects: DataFrame, provenance: DataFrame) -> DataFrame:
    """conversation_id of conversations linked to a project by id or title."""
    lowered = [n.lower() for n in names]
    mine = objects.where((F.col("kind") == "project") & (F.col("object_id").isin(*names) | F.lower("title").isin(*lowered)))
    return provenance.join(mine.select("object_id"), "object_id", "left_semi").select("conversation_id").distinct()


def run(query: Query | str, *, conversations: DataFrame, messages: DataFrame, chunks: DataFrame, objects: DataFrame, provenance: DataFrame, register: DataFrame, now: float, limit: int = 25, states: tuple[str, ...] = VISIBLE, state: stored.SearchState | None = None) -> DataFrame:
    """hit_type, id, title, score: one plan over the surfaces that the query asks for.

    Filters come before limits. Kinds restrict a query to derived objects,
    whose surface knows no other filter than kind and project.
    """
    q = parse(query) if isinstance(query, str) else query
    kinds, projects = q.all("kind"), q.all("project")
    shown = search.filtered(conversations.where(in_states("state", states)), after=q.last("after"), before=q.last("before"), sources=q.all("source"), registers=q.all("register") if q.text else (), register=register)
    if tags := q.all("tag"):
        shown = shown.where(search.has_tag(tags))
    if "open_loops" in q.all("has"):
        shown = shown.where("has_open_loops")
    if "chunks" in q.all("has"):
        shown = shown.join(chunks.select("conversation_id"), "conversation_id", "left_semi")
    if projects:
        shown = shown.join(in_projects(projects, objects, provenance), "conversation_id", "left_semi")
    hits: list[DataFrame] = []
    if not kinds and q.text:
        found = search.hybrid_search(conversations, messages, chunks, q.text, now, limit, states, state)
        hits.append(found.join(shown.select("conversation_id", "title"), "conversation_id").select(F.lit("conversation").alias("hit_type"), F.col("conversation_id").alias("id"), "title", "score"))
        parts = search.chunk_search(conversations, messages, chunks, q.text, states, state).join(shown.select("conversation_id"), "conversation_id", "left_semi")
        hits.append(parts.select(F.lit("chunk").alias("hit_type"), F.col("chunk_id").alias("id"), "title", "score"))
    elif not kinds:
        listed = search.list_conversations(conversations, now, states=states).join(shown.select("conversation_id"), "conversation_id", "left_semi")
        hits.append(listed.select(F.lit("conversation").alias("hit_type"), F.col("conversation_id").alias("id"), "title", "score"))
    if kinds or q.text:
        derived = search.derived_search(objects, provenance, conversations, q.text, kinds, states)
        if projects:  # no object belongs to a project by its own column
            derived = derived.where(F.lit(False))
        hits.append(derived.select(F.col("kind").alias("hit_type"), F.col("object_id").alias("id"), "title", "score"))
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.dropDuplicates(["hit_type", "id"]).orderBy(F.desc("score"), "hit_type", "id").limit(limit)


def totals(hits: DataFrame) -> DataFrame:
    """hit_type, n."""
    return hits.groupBy("hit_type").agg(F.count(F.lit(1)).alias("n"))
