"""Python aggregates with a partial phase: states are made per task, merged per key after the shuffle."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from keyfold.functions.registry import Udaf

#: States that a task holds before it sends them on; a key may then be sent more than once.
HELD_STATES = 100_000


def groups_of(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in order of their group, and where in them each group begins. Keys hold no nulls."""
    ids = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        coded = c.dictionary_encode()
        ids = ids * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
        ids = np.unique(ids, return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    return order, np.flatnonzero(np.diff(ids[order], prepend=-1))


def _reduced(values: pa.Array, starts: np.ndarray, f: Udaf) -> Iterator[tuple | None]:
    """For each group, of which the values lie together, its state as (state,), or None where it has nothing but NULLs."""
    valid = values.is_valid().to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(valid)))
    begin, end = before[starts], before[np.append(starts[1:], len(values))]
    series = values.drop_null().to_pandas()
    if f.reduce_groups is not None:
        some = begin < end
        states = iter(f.reduce_groups(series, begin[some])) if some.any() else iter(())
        yield from ((next(states),) if x else None for x in some.tolist())
        return
    held = series.to_numpy() if isinstance(series.dtype, np.dtype) else series.array
    for i, j in zip(begin.tolist(), end.tolist(), strict=True):
        yield (f.reduce(f.zero(), pd.Series(held[i:j])),) if i < j else None


def udaf_aggregate(rows: DataFrame, keys: list[str], column: str, f: Udaf, output: str) -> DataFrame:
    """One row per key: the keys and ``output``.

    Batches stay Arrow, so that a column keeps its type: a bigint beside a NULL is no double, and NaN is no NULL.
    NULLs are taken out before ``reduce``; a group that has nothing else gives ``finish(zero())``. States are merged
    in order of their key, batch by batch: nothing is set up for a group, of which there may be as many as rows.
    """
    key_fields = [rows.schema[k] for k in keys]
    key_types = [to_arrow_type(x.dataType) for x in key_fields]
    result_type = to_arrow_type(f.returns)
    # adding 0 makes -0.0 and 0.0 one key, which the grouping of Python functions does not do by itself
    one_zero = [(F.col(x.name) + F.lit(0.0).cast(x.dataType)).alias(x.name) if isinstance(x.dataType, (T.FloatType, T.DoubleType)) else F.col(x.name) for x in key_fields]
    partial_schema = T.StructType([*key_fields, T.StructField("state", T.BinaryType())])

    def sent(states: dict) -> pa.RecordBatch:
        held = [pa.array(c, t) for c, t in zip(zip(*states, strict=True), key_types, strict=True)]
        return pa.record_batch([*held, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], names=[*keys, "state"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        for batch in batches:
            *held, values = batch.columns
            order, starts = groups_of(held)
            names = zip(*(c.take(pa.array(order[starts])).to_pylist() for c in held), strict=True)
            for key, state in zip(names, _reduced(values.take(pa.array(order)), starts, f), strict=True):
                if key not in states:
                    states[key] = f.zero() if state is None else state[0]
                elif state is not None:
                    states[key] = f.merge(states[key], state[0])
            if len(states) > HELD_STATES:
                yield sent(states)
                states = {}
        if states:
            yield sent(states)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """States sorted by key; a key's may go on in the next batch, so the last key of each is held."""
        last, total = None, None
        for batch in batches:
            *held, states = (c.to_pylist() for c in batch.columns)
            done = []
            for key, state in zip(zip(*held, strict=True), states, strict=True):
                if key != last:
                    if last is not None:
                        done.append((last, f.finish(total)))
                    last, total = key, f.zero()
                total = f.merge(total, pickle.loads(state))
            if done:
                yield finished(done)
        if last is not None:
            yield finished([(last, f.finish(total))])

    def finished(done: list[tuple]) -> pa.RecordBatch:
        held = [pa.array(c, t) for c, t in zip(zip(*(k for k, _ in done), strict=True), key_types, strict=True)]
        return pa.record_batch([*held, pa.array([v for _, v in done], result_type)], names=[*keys, output])

    states = rows.select(*one_zero, column).mapInArrow(partial, partial_schema)
    by_key = states.repartition(*keys).sortWithinPartitions(*keys)
    return by_key.mapInArrow(merged, T.StructType([*key_fields, T.StructField(output, f.returns)]))
