"""The operator: one row per valid group, keys first, aggregates after them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.functions.registry import Udaf, lookup
from keyfold.operators.udaf import udaf_aggregate
from keyfold.operators.validity import quoted, valid_rows
from keyfold.plans.settings import settings
from keyfold.plans.specs import AggCall, parse

LAYOUT = ("instance_id", "value_no")


def keyed_aggregate(df: DataFrame, *specs: str | AggCall, dims: Sequence[str] = (), layout: bool = False, **keywords: Any) -> DataFrame:
    """Aggregate ``df`` by keys: ``keyed_aggregate(df, "sum(x) as total", "count(*)", "a", "i", dims=["i"])``.

    specs: aggregate calls ``function(column) [as alias]`` and key names, in any order; one of each at least.
    dims: integer columns that are dimensions, in array order; as keys they come out as bigint.
    layout: add ``instance_id`` and ``value_no``, the partition a row came out of and its number there (not deterministic).
    keywords: input_sorted, max_table_size, num_hash_buckets, spill_chunk_size (also spill_chuck_size),
    merge_chunk_size, output_chunk_size. They are checked and change no result.

    Rows with NULL or NaN in any key are left out. ``sum`` of no value is 0; other functions give NULL, and the group
    stays. ``count(*)`` counts rows, ``count(x)`` non-null values. NaN among inputs takes part. 0.0 and -0.0 are one key.
    An unnamed aggregate is called ``column_function``, or ``count`` for ``count(*)``. No order of rows is promised.
    """
    dims = tuple(dims)
    call = parse(specs, df.schema, dims)
    settings(call, dims, keywords)
    functions = [(a, lookup(a.function)) for a in call.aggregates]
    for a, f in functions:
        if a.column is None and not getattr(f, "star", False):
            raise ValueError(f"{a.function}(*) has no meaning; name a column")
    if layout and (clash := [n for n in call.outputs if n in LAYOUT]):
        raise ValueError(f"the layout columns clash with {', '.join(clash)}")

    keys = [k.name for k in call.keys]
    inputs = list(dict.fromkeys(a.column for a, _ in functions if a.column is not None))
    rows = valid_rows(df, keys).select(
        *(quoted(k.name).cast("bigint").alias(f"k{i}") if k.is_dimension else quoted(k.name).alias(f"k{i}") for i, k in enumerate(call.keys)),
        *(quoted(c).alias(f"v{i}") for i, c in enumerate(inputs)),
    )
    value = {c: f"v{i}" for i, c in enumerate(inputs)}
    held = [f"k{i}" for i in range(len(keys))]
    plain = [
        (F.count(F.lit(1)) if a.column is None else f.build(F.col(value[a.column]), df.schema[a.column].dataType)).alias(f"a{i}")
        for i, (a, f) in enumerate(functions)
        if not isinstance(f, Udaf)
    ]
    out = rows.groupBy(*held).agg(*plain) if plain else None
    for i, (a, f) in enumerate(functions):
        if isinstance(f, Udaf):
            one = udaf_aggregate(rows, held, value[a.column], f, f"a{i}")
            out = one if out is None else out.join(one, held)  # both hold each valid group once
    out = out.select(
        *(F.col(h).alias(k) for h, k in zip(held, keys, strict=True)),
        *(F.col(f"a{i}").alias(a.output) for i, (a, _) in enumerate(functions)),
    )
    if not layout:
        return out
    # monotonically_increasing_id holds the partition above bit 33 and the row's number there below it
    return out.withColumns({LAYOUT[0]: F.spark_partition_id().cast("bigint"), LAYOUT[1]: F.monotonically_increasing_id().bitwiseAND(2**33 - 1)})


def keyed(*specs: str | AggCall, **options: Any) -> Callable[[DataFrame], DataFrame]:
    """For ``DataFrame.transform``."""
    return lambda df: keyed_aggregate(df, *specs, **options)
