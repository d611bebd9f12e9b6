"""Keyed aggregation over a stream: the same plan, kept up to date by Structured Streaming's own state."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from keyfold.functions.registry import Udaf, lookup
from keyfold.operators.keyed import keyed_aggregate
from keyfold.plans.specs import parse


def stream_keyed_aggregate(stream: DataFrame, *specs: str, mode: str = "complete", **options: Any) -> DataStreamWriter:
    """A writer, not started yet, of the groups so far (``complete``) or of those that changed (``update``).

    Python aggregates need the whole input and are refused.
    """
    if not stream.isStreaming:
        raise ValueError("a streaming DataFrame is needed")
    if mode not in ("complete", "update"):
        raise ValueError(f"mode must be complete or update, not {mode!r}")
    for a in parse(specs, stream.schema, tuple(options.get("dims", ()))).aggregates:
        if isinstance(lookup(a.function), Udaf):
            raise ValueError(f"{a.function!r} is a Python aggregate, which streams do not take")
    return keyed_aggregate(stream, *specs, **options).writeStream.outputMode(mode)
