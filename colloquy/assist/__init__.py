"""Tasks for a pluggable text model, with deterministic parts in Spark."""
