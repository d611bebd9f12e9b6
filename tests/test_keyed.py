import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfold import AggCall, AggFunction, Udaf, keyed, keyed_aggregate, register
from keyfold.plans.settings import settings
from keyfold.plans.specs import parse
from keyfold.streaming.keyed import stream_keyed_aggregate

NAN = float("nan")


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(0.0, 1.0), (-0.0, 2.0), (NAN, 3.0), (None, 4.0), (NAN, None), (2.0, None), (7.0, NAN), (7.0, 1.0)]
    return spark.createDataFrame(rows, "c double, v double").repartition(3)


def test_keys_and_inputs_without_values(edge):
    got = {r[0]: tuple(r)[1:] for r in keyed_aggregate(edge, "c", "sum(v)", "avg(v)", "max(v)", "var(v)", "count(*)", "count(v)").collect()}
    assert set(got) == {0.0, 2.0, 7.0}
    assert got[0.0] == (3.0, 1.5, 2.0, 0.5, 2, 2)
    assert got[2.0] == (0.0, None, None, None, 1, 0)
    assert all(math.isnan(x) for x in got[7.0][:4]) and got[7.0][4:] == (2, 2)


def test_no_valid_row_gives_no_row_and_the_same_schema(spark):
    df = spark.createDataFrame([(None, 1)], "k string, v int")
    out = keyed_aggregate(df, "k", "sum(v)")
    assert out.count() == 0 and out.dtypes == [("k", "string"), ("v_sum", "bigint")]


@pytest.mark.parametrize(
    ("specs", "names"),
    [
        (("avg(a)", "count(*)", "b", "x"), ["b", "x", "a_avg", "count"]),
        (("x", "SUM( a )  AS total", "b", "max(a)"), ["x", "b", "total", "a_max"]),
        (("b", AggCall("min", "a", "low")), ["b", "low"]),
    ],
)
def test_keys_come_first_in_call_order(spark, specs, names):
    df = spark.createDataFrame([(1, 2.0, "z")], "x int, a double, b string")
    assert keyed_aggregate(df, *specs, dims=["x"]).columns == names


@pytest.mark.parametrize(
    ("specs", "options", "says"),
    [
        (("a",), {}, "at least one aggregate"),
        (("count(*)",), {}, "at least one group key"),
        (("nope", "count(*)"), {}, "not a column"),
        (("a", "sum(nope)"), {}, "not a column"),
        (("a", "shout(v)"), {}, "unknown aggregate"),
        (("a", "first(v)"), {}, "order"),
        (("a", "sum(*)"), {}, "no meaning"),
        (("a", "count(*)", "count(*)"), {}, "must differ"),
        (("a", "sum(v) as a"), {}, "must differ"),
        (("m", "count(*)"), {}, "nested"),
        (("l", "count(*)"), {}, "nested"),
        (("a", "count(*)"), {"dims": ["a"]}, "integer"),
        (("a", "count(*)"), {"max_table_size": 0}, "above 0"),
        (("a", "count(*)"), {"num_hash_buckets": True}, "above 0"),
        (("a", "count(*)"), {"input_sorted": 1}, "bool"),
        (("a", "count(*)"), {"speed": 1}, "unknown keyword"),
        (("a", "count(*)"), {"spill_chunk_size": 1, "spill_chuck_size": 1}, "twice"),
        ((3, "count(*)"), {}, "AggCall"),
    ],
)
def test_errors_come_before_a_plan(spark, specs, options, says):
    df = spark.createDataFrame([], "a string, v int, m map<string,int>, l array<int>")
    with pytest.raises(ValueError, match=says):
        keyed_aggregate(df, *specs, **options)


def test_input_sorted_default(spark):
    schema = T.StructType([T.StructField(n, T.LongType()) for n in "xyv"])
    default = lambda *keys: settings(parse([*keys, "count(*)"], schema, ("x", "y")), ("x", "y"), {}).input_sorted
    assert default("x") and not default("y") and not default("x", "y") and not default("v")


def test_names_with_odd_characters_and_clashes(spark):
    df = spark.createDataFrame([("p", 1, 5), ("p", 2, 6)], "`a.b` string, k0 int, v0 int")
    assert [tuple(r) for r in keyed_aggregate(df, "a.b", "sum(v0)", "max(k0)").collect()] == [("p", 11, 2)]


def test_layout(spark):
    out = keyed_aggregate(spark.range(100).withColumn("v", F.lit(1)), "id", "sum(v)", layout=True)
    rows = out.collect()
    assert out.columns == ["id", "v_sum", "instance_id", "value_no"] and len({(r[2], r[3]) for r in rows}) == 100


def test_registered_function_and_python_aggregate_mix(spark):
    register(AggFunction("spread", lambda c, _: F.max(c) - F.min(c)))
    register(Udaf("longest", lambda: 0, lambda s, v: max(s, v.dropna().map(len).max() if v.notna().any() else 0), max, lambda s: s, T.LongType()))
    df = spark.createDataFrame([("a", "xx", 1), ("a", "yyyy", 5), ("b", None, 2), (None, "zzzzz", 3)], "k string, s string, n int").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in keyed_aggregate(df, "k", "longest(s)", "spread(n)", "count(*)").collect()}
    assert got == {"a": (4, 4, 2), "b": (0, 0, 1)}


def test_python_aggregate_keeps_types_and_tells_nan_from_null(spark, edge):
    register(Udaf("tops", lambda: None, lambda s, v: max([int(v.max())] + [s] * (s is not None)), lambda s, t: max([x for x in (s, t) if x is not None], default=None), lambda s: s, T.LongType()))
    big = 2**53
    df = spark.createDataFrame([("a", big + 1), ("a", None), ("b", big + 3), ("c", None)], "k string, v long").coalesce(1)
    assert {r[0]: tuple(r)[1:] for r in keyed_aggregate(df, "k", "tops(v)", "max(v)").collect()} == {"a": (big + 1,) * 2, "b": (big + 3,) * 2, "c": (None, None)}
    register(Udaf("present", lambda: 0, lambda s, v: s + len(v), lambda s, t: s + t, lambda s: s, T.LongType()))
    got = {r[0]: tuple(r)[1:] for r in keyed_aggregate(edge, "c", "present(v)", "count(v)").collect()}
    assert got == {0.0: (2, 2), 2.0: (0, 0), 7.0: (2, 2)}  # 0.0 and -0.0 are one key, NaN is a value
    df = spark.createDataFrame([(NAN,), (None,), (1.0,)], "v double").select(F.lit("k").alias("k"), "v")
    assert [tuple(r) for r in keyed_aggregate(df, "k", "present(v)", "count(v)").collect()] == [("k", 2, 2)]


def test_seeded_cells_keep_the_published_proportions(spark):
    n = 20_000
    i = F.col("i")
    cells = spark.range(1, n + 1).withColumnRenamed("id", "i").select(
        "i",
        F.when(F.rand(1) > 0.1, F.floor(F.rand(2) * 100).cast("double")).alias("val"),
        F.when(F.rand(3) < 0.5, "abc").otherwise("def").alias("a"),
        F.when(i % 5 != 0, F.concat(i.cast("string"), F.lit("0"))).alias("b"),
        F.when(F.rand(4) > 0.1, F.when(F.rand(5) < 1 / 9, NAN).otherwise(F.floor(F.rand(6) * 20).cast("double"))).alias("c"),
    )
    count = lambda *specs: keyed_aggregate(cells, *specs, dims=["i"]).count()
    assert (count("a", "var(val)"), count("c", "avg(val)"), count("a", "c", "avg(val)")) == (2, 20, 40)
    assert count("b", "sum(val)") == count("a", "b", "max(val)", "var(val)") == n * 4 // 5
    assert keyed_aggregate(cells, "b", "sum(val)").filter("val_sum is null").count() == 0
    assert tuple(keyed_aggregate(cells, "count(*)", "count(b)", "i", dims=["i"]).agg(F.sum("count"), F.sum("b_count")).first()) == (n, n * 4 // 5)


def test_plan_has_one_exchange_and_a_partial_phase(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = keyed_aggregate(df, "l_returnflag", "sum(l_quantity)")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2 and "partial_sum" in plan
    assert "IsNotNull(l_returnflag)" in plan and "l_comment" not in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_stream(spark, tmp_path):
    spark.range(10).select((F.col("id") % 2).alias("k"), "id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, id long").parquet(str(tmp_path / "in"))
    q = stream_keyed_aggregate(stream, "k", "sum(id)").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("sums").collect())) == [(0, 20), (1, 25)]
    with pytest.raises(ValueError, match="streaming"):
        stream_keyed_aggregate(spark.range(1), "id", "count(*)")


def test_transform(spark):
    assert spark.range(3).transform(keyed("id", "count(*)")).count() == 3


@pytest.mark.parametrize("by_group", [True, False])
def test_python_aggregate_sets_up_nothing_per_group(spark, by_group):
    many = (lambda v, starts: np.maximum.reduceat(v.to_numpy(), starts).tolist()) if by_group else None
    reduce = lambda s, v: max(int(v.max()), int(v[0]), *([] if s is None else [s]))
    merge = lambda s, t: max((x for x in (s, t) if x is not None), default=None)
    register(Udaf("top_each", lambda: None, reduce, merge, lambda s: s, T.LongType(), reduce_groups=many))
    rows = [(f"k{i % 41}", i % 3, None if i % 41 == 7 or i % 5 == 0 else 2**53 + i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, d int, v long").repartition(3)
    want = {}
    for k, d, v in rows:
        want[k, d] = max((x for x in (want.get((k, d)), v) if x is not None), default=None)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a key's states lie in several batches
    try:
        out = keyed_aggregate(df, "top_each(v) as t", "k", "d", dims=["d"])
        assert sorted(((r["k"], r["d"]), r["t"]) for r in out.collect()) == sorted(want.items())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
