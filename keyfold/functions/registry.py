"""Aggregate functions by name: how each builds a Column, and what it gives for a group without values."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class AggFunction:
    """``build(column, type)`` returns the aggregate Column. Order-sensitive functions are refused when a plan is built."""

    name: str
    build: Callable[[Column, T.DataType | None], Column] | None
    order_sensitive: bool = False
    star: bool = False


@dataclass(frozen=True)
class Udaf:
    """A user aggregate in Python, as four steps over a state.

    ``reduce(state, values)`` takes the values of one group in one Arrow batch as a pandas Series of the column's own
    type, without NULLs (NaN takes part) and never empty; states are merged before and after the shuffle, so a hot key
    sends one state per task. A group without values gives ``finish(zero())``.

    ``reduce_groups(values, starts)``, where given, takes the place of ``reduce``: all values of a batch, group after
    group, and where each group begins (none is empty); it returns a state per group. It spares a call per group.
    """

    name: str
    zero: Callable[[], Any]
    reduce: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]
    returns: T.DataType
    reduce_groups: Callable[[Any, Any], Iterable[Any]] | None = None


def _sum(col: Column, kind: T.DataType | None) -> Column:
    """The sum of no value is 0, in the type of the sum."""
    zero = F.make_dt_interval() if isinstance(kind, T.DayTimeIntervalType) else F.lit(0)
    return F.coalesce(F.sum(col), zero)


def _plain(f: Callable[[Column], Column]) -> Callable[[Column, T.DataType | None], Column]:
    return lambda col, _kind: f(col)


_BUILT_IN = {
    "avg": F.avg,
    "max": F.max,
    "min": F.min,
    "var": F.var_samp,
    "var_samp": F.var_samp,
    "var_pop": F.var_pop,
    "stdev": F.stddev_samp,
    "stddev_samp": F.stddev_samp,
    "stddev_pop": F.stddev_pop,
    "product": F.product,
    "approx_count_distinct": F.approx_count_distinct,
    "count_distinct": F.count_distinct,
    "bool_and": F.bool_and,
    "bool_or": F.bool_or,
    "bit_and": F.bit_and,
    "bit_or": F.bit_or,
    "bit_xor": F.bit_xor,
    "skewness": F.skewness,
    "kurtosis": F.kurtosis,
    "median": F.median,
}
_ORDER_SENSITIVE = ("first", "last", "first_value", "last_value", "any_value", "collect_list", "array_agg", "listagg", "string_agg")

_registry: dict[str, AggFunction | Udaf] = {name: AggFunction(name, _plain(f)) for name, f in _BUILT_IN.items()}
_registry["sum"] = AggFunction("sum", _sum)
_registry["count"] = AggFunction("count", _plain(F.count), star=True)
_registry |= {name: AggFunction(name, None, order_sensitive=True) for name in _ORDER_SENSITIVE}


def register(function: AggFunction | Udaf) -> None:
    """Make a function known by its name; a name that exists is replaced."""
    _registry[function.name.lower()] = function


def lookup(name: str) -> AggFunction | Udaf:
    try:
        found = _registry[name.lower()]
    except KeyError:
        raise ValueError(f"unknown aggregate {name!r}; known: {', '.join(sorted(_registry))}") from None
    if isinstance(found, AggFunction) and found.order_sensitive:
        raise ValueError(f"aggregate {name!r} depends on the order of rows, which a group does not have")
    return found
