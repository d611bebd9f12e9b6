"""The catalogue: each query as a call of the operator, and the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfold.functions.registry import Udaf, register
from keyfold.operators.keyed import keyed_aggregate
from keyfold.sources.tables import DERIVED_CELLS_SQL, derived_cells, table

Query = Callable[[SparkSession, str], DataFrame]
FOO = DERIVED_CELLS_SQL


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Floating results depend on the order of additions in their last digits."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _lineitem(*specs: str, digits: dict[str, int] | None = None, **options) -> Query:
    return lambda spark, d: rounded(keyed_aggregate(table(spark, d, "lineitem"), *specs, **options), **digits or {})


def _cells(*specs: str, digits: dict[str, int] | None = None) -> Query:
    return lambda spark, d: rounded(keyed_aggregate(derived_cells(spark, d), *specs, dims=["i"]), **digits or {})


def _events(*specs: str) -> Query:
    return lambda spark, d: keyed_aggregate(table(spark, d, "events"), *specs)


def _count_rollup(spark: SparkSession, d: str) -> DataFrame:
    per_cell = keyed_aggregate(derived_cells(spark, d), "count(*)", "count(b)", "i", dims=["i"])
    return per_cell.agg(F.sum("count").alias("count_sum"), F.sum("b_count").alias("b_count_sum"))


def _all_null_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("b"), F.when(F.col("l_partkey") % 10 != 0, F.col("l_quantity")).alias("v")
    )
    return rounded(keyed_aggregate(rows, "b", "sum(v)", "avg(v)", "max(v)", "var(v)", "count(v)", "count(*)"), v_avg=6, v_var=6)


def _empty(spark: SparkSession, d: str) -> DataFrame:
    return keyed_aggregate(table(spark, d, "lineitem").filter("l_quantity < 0"), "l_returnflag", "count(*)")


def _udaf(spark: SparkSession, d: str) -> DataFrame:
    register(
        Udaf(
            "range",
            zero=lambda: (float("inf"), float("-inf")),
            reduce=lambda s, v: (min(s[0], v.min()), max(s[1], v.max())),
            merge=lambda s, t: (min(s[0], t[0]), max(s[1], t[1])),
            finish=lambda s: s[1] - s[0],
            returns=T.DoubleType(),
        )
    )
    return keyed_aggregate(table(spark, d, "lineitem"), "l_returnflag", "range(l_quantity)")


#: Values above 2^53, odd ones among them, where a double would round; every tenth is NULL.
_LARGE = "case when l_partkey % 10 = 0 then null else 9007199254740992 + l_orderkey * 10 + l_linenumber end"


def _udaf_large(spark: SparkSession, d: str) -> DataFrame:
    register(
        Udaf(
            "largest",
            zero=lambda: None,
            reduce=lambda s, v: int(v.max()) if s is None else max(s, int(v.max())),
            reduce_groups=lambda v, starts: np.maximum.reduceat(v.to_numpy(), starts).tolist(),
            merge=lambda s, t: t if s is None else s if t is None else max(s, t),
            finish=lambda s: s,
            returns=T.LongType(),
        )
    )
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", F.expr(_LARGE).alias("v"))
    return keyed_aggregate(rows, "largest(v)", "max(v)", "count(v)", "l_returnflag", "l_orderkey", dims=["l_orderkey"])


def _udaf_nan(spark: SparkSession, d: str) -> DataFrame:
    register(
        Udaf(
            "tally",
            zero=lambda: (0, 0),
            reduce=lambda s, v: (s[0] + len(v), s[1] + int(v.isna().sum())),
            reduce_groups=lambda v, starts: zip(np.diff(starts, append=len(v)).tolist(), np.add.reduceat(v.isna().to_numpy().astype(np.int64), starts).tolist(), strict=True),
            merge=lambda s, t: (s[0] + t[0], s[1] + t[1]),
            finish=lambda s: s[0] * 1_000_000 + s[1],
            returns=T.LongType(),
        )
    )
    return keyed_aggregate(derived_cells(spark, d), "tally(c)", "count(c)", "i", dims=["i"])


def _uniq(spark: SparkSession, d: str) -> DataFrame:
    return keyed_aggregate(table(spark, d, "lineitem"), "l_returnflag", "count(*)").select("l_returnflag")


def _indexed(df: DataFrame, column: str, name: str) -> DataFrame:
    """Number the rows of a small list of distinct values."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(column)).cast("bigint"))


def _index_lookup(spark: SparkSession, d: str) -> DataFrame:
    cells = derived_cells(spark, d)
    values = _indexed(keyed_aggregate(cells, "c", "count(*)").select("c"), "c", "n").select("c", (F.col("n") - 1).alias("idx"))
    return rounded(keyed_aggregate(cells.join(values, "c"), "idx", "max(c) as c", "avg(val)"), val_avg=6)


def _positional_join(spark: SparkSession, d: str) -> DataFrame:
    counted = keyed_aggregate(table(spark, d, "lineitem"), "l_returnflag", "count(*) as n")
    left = _indexed(counted.select("l_returnflag"), "l_returnflag", "rn")
    return left.join(_indexed(counted, "l_returnflag", "rn").select("rn", "n"), "rn").select("rn", "l_returnflag", "n")


def _join_then_group(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return keyed_aggregate(joined, "o_orderpriority", "sum(l_linenumber)", "count(*)")


_SUM_BY_FLAG = "select l_returnflag, round(sum(l_quantity),2) total from lineitem group by 1"
_AVG_BY_FLAG_AND_DIM = "select l_returnflag, cast(l_linenumber as bigint) l_linenumber, round(avg(l_quantity),6) l_quantity_avg, count(*) count from lineitem group by 1,2"

CATALOGUE: dict[str, tuple[Query, str]] = {
    "sum_as_alias_by_attr": (_lineitem("sum(l_quantity) as total", "l_returnflag", digits={"total": 2}), _SUM_BY_FLAG),
    "avg_countstar_by_attr_and_dim": (
        _lineitem("avg(l_quantity)", "count(*)", "l_returnflag", "l_linenumber", dims=["l_linenumber"], digits={"l_quantity_avg": 6}),
        _AVG_BY_FLAG_AND_DIM,
    ),
    "spec_order_interleaved": (
        _lineitem("l_returnflag", "avg(l_quantity)", "l_linenumber", "count(*)", dims=["l_linenumber"], digits={"l_quantity_avg": 6}),
        _AVG_BY_FLAG_AND_DIM,
    ),
    "with_all_keywords": (
        _lineitem(
            "sum(l_quantity) as total", "l_returnflag", digits={"total": 2}, input_sorted=True, max_table_size=1, num_hash_buckets=7,
            spill_chuck_size=10, merge_chunk_size=10, output_chunk_size=10,
        ),
        _SUM_BY_FLAG,
    ),
    "var_by_string": (_cells("a", "var(val)", digits={"val_var": 6}), f"select a, round(var_samp(val),6) val_var from {FOO} where a is not null group by 1"),
    "sum_by_nullable_string": (
        _cells("b", "sum(val)", digits={"val_sum": 2}),
        f"select b, round(coalesce(sum(val),0.0),2) val_sum from {FOO} where b is not null group by 1",
    ),
    "avg_by_double_null_nan": (
        _cells("c", "avg(val)", digits={"val_avg": 6}),
        f"select c, round(avg(val),6) val_avg from {FOO} where c is not null and not isnan(c) group by 1",
    ),
    "avg_by_string_and_double": (
        _cells("a", "c", "avg(val)", digits={"val_avg": 6}),
        f"select a, c, round(avg(val),6) val_avg from {FOO} where a is not null and c is not null and not isnan(c) group by 1,2",
    ),
    "max_var_by_two_strings": (
        _cells("a", "b", "max(val)", "var(val)", digits={"val_var": 6}),
        f"select a, b, max(val) val_max, round(var_samp(val),6) val_var from {FOO} where a is not null and b is not null group by 1,2",
    ),
    "count_countattr_by_dim": (_cells("count(*)", "count(b)", "i"), f"select i, count(*) count, count(b) b_count from {FOO} where i is not null group by 1"),
    "count_rollup_of_dim": (
        _count_rollup,
        f"select cast(sum(count) as bigint) count_sum, cast(sum(b_count) as bigint) b_count_sum from (select i, count(*) count, count(b) b_count from {FOO} where i is not null group by 1) t",
    ),
    "single_row_groups_all_null": (
        _all_null_groups,
        "select b, coalesce(sum(v),0.0) v_sum, round(avg(v),6) v_avg, max(v) v_max, round(var_samp(v),6) v_var, count(v) v_count, count(*) count from (select l_orderkey*10+l_linenumber b, case when l_partkey % 10 = 0 then null else l_quantity end v from lineitem) t where b is not null group by 1",
    ),
    "nan_in_input": (
        _cells("a", "sum(c)", "max(c)", "min(c)", "count(c)"),
        f"select a, coalesce(sum(c),0.0) c_sum, max(c) c_max, min(c) c_min, count(c) c_count from {FOO} where a is not null group by 1",
    ),
    "empty_input": (_empty, "select l_returnflag, count(*) count from lineitem where l_quantity < 0 group by 1"),
    "by_timestamp": (
        _lineitem("l_shipdate", "count(*)", "max(l_quantity)"),
        "select l_shipdate, count(*) count, max(l_quantity) l_quantity_max from lineitem where l_shipdate is not null group by 1",
    ),
    "min_string": (
        _events("event_type", "min(props)", "max(props)"),
        "select event_type, min(props) props_min, max(props) props_max from events where event_type is not null group by 1",
    ),
    "stdev": (
        _lineitem("l_linestatus", "stdev(l_quantity)", digits={"l_quantity_stdev": 6}),
        "select l_linestatus, round(stddev_samp(l_quantity),6) l_quantity_stdev from lineitem where l_linestatus is not null group by 1",
    ),
    "sum_int": (
        _lineitem("l_returnflag", "sum(l_linenumber)"),
        "select l_returnflag, cast(coalesce(sum(l_linenumber),0) as bigint) l_linenumber_sum from lineitem where l_returnflag is not null group by 1",
    ),
    "uniq": (_uniq, "select distinct l_returnflag from lineitem where l_returnflag is not null"),
    "index_lookup_redimension": (
        _index_lookup,
        f"select d.idx, max(f.c) c, round(avg(f.val),6) val_avg from (select * from {FOO}) f join (select c, cast(row_number() over (order by c) - 1 as bigint) idx from (select distinct c from {FOO} where c is not null and not isnan(c)) u) d on f.c = d.c group by 1",
    ),
    "sorted_positional_join": (
        _positional_join,
        "select cast(x.rn as bigint) rn, x.l_returnflag, y.n from (select l_returnflag, row_number() over (order by l_returnflag) rn from (select distinct l_returnflag from lineitem) a) x join (select l_returnflag, count(*) n, row_number() over (order by l_returnflag) rn from lineitem group by 1) y on x.rn=y.rn",
    ),
    "by_dims_only_multi": (
        _lineitem("l_orderkey", "l_linenumber", "count(*)", "max(l_tax)", dims=["l_orderkey", "l_linenumber"]),
        "select l_orderkey, cast(l_linenumber as bigint) l_linenumber, count(*) count, max(l_tax) l_tax_max from lineitem group by 1,2",
    ),
    "registered_udaf": (
        _udaf,
        "select l_returnflag, max(l_quantity)-min(l_quantity) l_quantity_range from lineitem where l_returnflag is not null group by 1",
    ),
    "udaf_bigint_with_nulls": (
        _udaf_large,
        f"select l_returnflag, l_orderkey, max(v) v_largest, max(v) v_max, count(v) v_count from (select l_returnflag, l_orderkey, {_LARGE} v from lineitem) t where l_returnflag is not null and l_orderkey is not null group by 1,2",
    ),
    "udaf_double_with_nan": (
        _udaf_nan,
        f"select i, count(c) * 1000000 + count(case when isnan(c) then 1 end) c_tally, count(c) c_count from {FOO} where i is not null group by 1",
    ),
    "group_after_join": (
        _join_then_group,
        "select o_orderpriority, cast(sum(l_linenumber) as bigint) l_linenumber_sum, count(*) count from lineitem join orders on l_orderkey = o_orderkey where o_orderpriority is not null group by 1",
    ),
    "extended_functions": (
        _lineitem(
            "l_returnflag", "var_pop(l_quantity)", "stddev_pop(l_quantity)", "count_distinct(l_suppkey)", "bit_xor(l_partkey)", "median(l_quantity)",
            digits={"l_quantity_var_pop": 6, "l_quantity_stddev_pop": 6},
        ),
        "select l_returnflag, round(var_pop(l_quantity),6) l_quantity_var_pop, round(stddev_pop(l_quantity),6) l_quantity_stddev_pop, count(distinct l_suppkey) l_suppkey_count_distinct, bit_xor(l_partkey) l_partkey_bit_xor, median(l_quantity) l_quantity_median from lineitem where l_returnflag is not null group by 1",
    ),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items()}
