"""The call's positional arguments: aggregate calls such as ``sum(x) as total`` and group keys, in any order."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

_CALL = re.compile(r"\s*(\w+)\s*\(\s*(\*|[^()]+?)\s*\)\s*(?:\bas\s+(`[^`]+`|\w+)\s*)?", re.IGNORECASE)


@dataclass(frozen=True)
class AggCall:
    """One aggregate call. ``column`` is None for ``count(*)``."""

    function: str
    column: str | None
    alias: str | None = None

    @property
    def output(self) -> str:
        if self.alias:
            return self.alias
        return self.function if self.column is None else f"{self.column}_{self.function}"


@dataclass(frozen=True)
class GroupKey:
    name: str
    is_dimension: bool


@dataclass(frozen=True)
class Call:
    keys: tuple[GroupKey, ...]
    aggregates: tuple[AggCall, ...]

    @property
    def outputs(self) -> list[str]:
        """Keys in call order, then aggregates in call order."""
        return [k.name for k in self.keys] + [a.output for a in self.aggregates]


def _bare(name: str) -> str:
    name = name.strip()
    return name[1:-1] if len(name) > 2 and name[0] == name[-1] == "`" else name


def parse(specs: Sequence[str | AggCall], schema: T.StructType, dims: Sequence[str] = ()) -> Call:
    """Resolve every argument against the schema, or raise ValueError before any plan exists."""
    columns = Counter(f.name for f in schema.fields)

    def known(name: str, what: str) -> str:
        if columns[name] != 1:
            raise ValueError(f"{what} {name!r} " + ("is ambiguous" if columns[name] else f"is not a column; columns: {', '.join(columns)}"))
        return name

    for d in dims:
        known(d, "dimension")
        if not isinstance(schema[d].dataType, T.IntegralType):
            raise ValueError(f"dimension {d!r} must be an integer column, not {schema[d].dataType.simpleString()}")
    keys: list[GroupKey] = []
    aggregates: list[AggCall] = []
    for spec in specs:
        if isinstance(spec, AggCall):
            call = spec
        elif not isinstance(spec, str):
            raise ValueError(f"an argument is a string or an AggCall, not {spec!r}")
        elif (m := _CALL.fullmatch(spec)) and spec not in columns:
            call = AggCall(m[1].lower(), None if m[2] == "*" else _bare(m[2]), m[3] and _bare(m[3]))
        else:
            keys.append(GroupKey(known(_bare(spec), "group key"), _bare(spec) in dims))
            continue
        if call.column is not None:
            known(call.column, "aggregate input")
        aggregates.append(call)
    if not aggregates:
        raise ValueError("at least one aggregate is needed")
    if not keys:
        raise ValueError("at least one group key is needed")
    call = Call(tuple(keys), tuple(aggregates))
    if twice := [n for n, k in Counter(call.outputs).items() if k > 1]:
        raise ValueError(f"output names must differ; repeated: {', '.join(twice)}; use 'as'")
    return call
