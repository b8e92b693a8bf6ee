"""Corpus tables as explicit Spark schemas, and the visibility lattice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: States, and which of them may be shown, indexed or extracted.
STATES = ("pending_review", "indexed", "private", "quarantined")
VISIBLE = ("indexed",)
SEARCHABLE = ("indexed", "private")
#: Restrictiveness of a state, for rules.
SEVERITY = {"pending_review": 0, "indexed": 0, "private": 1, "quarantined": 2}
KINDS = ("project", "entity", "decision", "open_loop", "artifact", "preference")
REGISTERS = ("work", "research", "career_logistics", "creative_writing", "roleplay", "jailbreak_experiment", "puzzle_hobby", "personal", "other")
#: Registers that listings of decisions, open loops and projects leave out by default.
HIDDEN_REGISTERS = ("roleplay", "jailbreak_experiment")
KINDS_THAT_HIDE = ("decision", "open_loop", "project")

CONVERSATION = (
    "conversation_id string, source string, title string, created_at double, updated_at double, imported_at double, state string, "
    "message_count int, summary_short string, summary_long string, summary_source string, manual_tags array<string>, auto_tags array<string>, "
    "primary_project_id string, importance_score double, resurfacing_score double, has_open_loops boolean, schema_version int, "
    "parser_version string, notes_local string, source_conversation_id string, fingerprint string"
)
MESSAGE = "message_id string, conversation_id string, ordinal int, role string, timestamp double, content_text string, source_message_id string"
CHUNK = "chunk_id string, conversation_id string, chunk_index int, start_message_ordinal int, end_message_ordinal int, chunk_title string, summary_short string"
OBJECT = (
    "object_id string, kind string, title string, description string, project_id string, state string, canonical_key string, "
    "created_at double, updated_at double"
)
PROVENANCE = "link_id string, object_id string, conversation_id string, chunk_id string, excerpt string"


def in_states(column: str, states: tuple[str, ...]) -> Column:
    """state IN (...); no state at all admits nothing."""
    return F.col(column).isin(*states) if states else F.lit(False)


def allowed_transition(old: Column, new: Column) -> Column:
    """Any reviewed state to any other of them; same state is no transition."""
    return old.isin(*STATES) & new.isin(*STATES) & (old != new)


def migrated(df: DataFrame, ddl: str) -> DataFrame:
    """A table with every column of a schema: missing ones are null, others are cast."""
    wanted = T._parse_datatype_string(ddl)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields])
