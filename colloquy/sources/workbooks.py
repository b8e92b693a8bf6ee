"""Workbook profiles: which sheets a workbook has, and of which states."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import views

#: Profiles, with the states that each shows and its sheets in order.
PROFILES = {
    "conversations_only": (("pending_review", "indexed", "private", "quarantined"), ("conversations",)),
    "review_workbook": (("pending_review", "indexed", "private"), ("conversations", "chunks")),
    "project_workbook": (("indexed",), ("conversations", "chunks", "projects", "decisions", "open_loops", "entities", "groups", "provenance")),
    "full_analysis": (
        ("pending_review", "indexed", "private", "quarantined"),
        ("conversations", "chunks", "projects", "decisions", "open_loops", "entities", "preferences", "artifacts", "groups", "provenance"),
    ),
    "summaries_review": (("indexed", "private"), ("summaries_review",)),
}
_KIND_OF_SHEET = {"projects": "project", "decisions": "decision", "open_loops": "open_loop", "entities": "entity", "preferences": "preference", "artifacts": "artifact"}


def sheets(profile: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Name and rows of each sheet of a profile; without groups that sheet is left out."""
    states, names = PROFILES[profile]
    c, groups = tables["conversations"], tables.get("groups")
    made = {
        "conversations": lambda: views.sheet_conversations(c, groups, states),
        "chunks": lambda: views.sheet_chunks(c, tables["chunks"], states),
        "provenance": lambda: views.sheet_provenance(tables["objects"], tables["provenance"], c, states),
        "summaries_review": lambda: views.sheet_review(c, tables["messages"], tables["chunks"], states),
        "groups": lambda: views.sheet_groups(groups),
    }
    made |= {name: (lambda kind=kind: views.sheet_kind(kind, tables["objects"], tables["provenance"], c, states)) for name, kind in _KIND_OF_SHEET.items()}
    return {name: made[name]() for name in names if name != "groups" or groups is not None}
