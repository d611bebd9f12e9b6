"""Which rows take part: those without NULL or NaN in any key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NESTED = (T.ArrayType, T.StructType, T.MapType, T.VariantType)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def check_key_type(name: str, kind: T.DataType) -> None:
    if isinstance(kind, _NESTED):
        raise ValueError(f"group key {name!r} has the nested type {kind.simpleString()}; keys are atomic")


def valid(name: str, kind: T.DataType) -> Column:
    """``isnan`` is asked only of floating types: ANSI mode refuses it elsewhere."""
    present = quoted(name).isNotNull()
    return present & ~F.isnan(quoted(name)) if isinstance(kind, (T.FloatType, T.DoubleType)) else present


def valid_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    for k in keys:
        check_key_type(k, df.schema[k].dataType)
    return df.filter(reduce(Column.__and__, [valid(k, df.schema[k].dataType) for k in keys]))
