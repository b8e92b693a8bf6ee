"""Runs prompts through a pluggable scorer, with a cache table and limits.

A scorer maps a list of prompts to a list of responses and is called per Arrow
batch on the executors, so that a model is loaded once per worker. Only
prompts that the cache doesn't hold are scored, each distinct prompt once.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that a configuration may enable.
TASKS = ("classify", "extract", "summarize", "chunk_gating", "label_groups", "profile")
Scorer = Callable[[list[str]], list[str | None]]


@dataclass(frozen=True)
class Config:
    """What a model may be used for, and its limits."""

    enabled: bool = False
    used_for: tuple[str, ...] = ()
    max_prompt_chars: int = 12_000
    max_response_chars: int = 4_000
    timeout_s: int = 120
    dry_run: bool = False
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if unknown := set(self.used_for) - set(TASKS):
            raise ValueError(f"unknown tasks: {sorted(unknown)}")

    def allows(self, task: str) -> bool:
        return self.enabled and task in self.used_for


def clip(prompt: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last line end where there is one."""
    head = F.left(prompt, F.lit(most))
    at = F.length(head) - F.instr(F.reverse(head), F.lit("\n"))
    return F.when(F.length(prompt) <= most, prompt).when(F.contains(head, F.lit("\n")), F.left(head, at)).otherwise(head)


def prompt_key(task: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\n", task, prompt), 256)


def render(template: str, **values: Column) -> Column:
    """``<<NAME>>`` tokens of a template replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<<{name.upper()}>>"), F.coalesce(value, F.lit("")))
    return out


def subprocess_scorer(command: list[str], timeout_s: int = 120) -> Scorer:
    """A scorer that runs a command per prompt: prompt on stdin, response on stdout."""

    def score(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            try:
                done = subprocess.run(command, input=p, capture_output=True, text=True, timeout=timeout_s, check=False)
                out.append(done.stdout if done.returncode == 0 else None)
            except (OSError, subprocess.TimeoutExpired):
                out.append(None)
        return out

    return score


def run(rows: DataFrame, task: str, scorer: Scorer, config: Config, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with response and prompt_key, new cache entries prompt_key, response).

    ``rows`` has a prompt column. A task that isn't allowed, and a dry run,
    give null responses; failures give null and aren't cached.
    """
    keyed = rows.withColumn("prompt", clip(F.col("prompt"), config.max_prompt_chars)).withColumn("prompt_key", prompt_key(F.lit(task), F.col("prompt")))
    empty = keyed.where(F.lit(False)).select("prompt_key", F.lit("").alias("response"))
    if not config.allows(task) or config.dry_run:
        return keyed.withColumn("response", F.lit(None).cast("string")), empty
    known = cache.select("prompt_key", "response") if cache is not None else empty
    wanted = keyed.select("prompt_key", "prompt").dropDuplicates(["prompt_key"]).join(known.select("prompt_key"), "prompt_key", "left_anti")
    most = config.max_response_chars

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = scorer(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a[:most] if a is not None else None for a in answers], pa.string())], ["prompt_key", "response"])

    fresh = wanted.mapInArrow(score, "prompt_key string, response string").where("response IS NOT NULL")
    return keyed.join(known.unionByName(fresh), "prompt_key", "left"), fresh


def first_json(response: Column, schema: str) -> Column:
    """The first {...} or [...] of a response parsed by a schema, null where there is none."""
    pattern = r"(?s)\[.*\]" if schema.lower().startswith("array") else r"(?s)\{.*\}"
    return F.from_json(F.nullif(F.regexp_extract(response, pattern, 0), F.lit("")), schema)
