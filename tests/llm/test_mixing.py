import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from keyfold.llm import mixing
from keyfold.llm.queries import op1_mixing

SMALL = "/root/testdata/sf0.001"


def brute_targets(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, held = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in held]
        level = (full - sum(most * sizes[s] for s in held)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in held else weight[s] * level for s in names}
        held |= over


def check(rows, texts, tolerance):
    sizes = defaultdict(int)
    for _, source, text in texts:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(sizes, (1, 2, 3), 3)
    taken = defaultdict(int)
    source_of = {i: s for i, s, _ in texts}
    for r in rows:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= tolerance * max(want[s], 1), (s, taken[s], want[s])


def test_query_against_brute_force(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "text").collect()]
    first, again = op1_mixing(spark, SMALL).collect(), op1_mixing(spark, SMALL).collect()
    assert len(first) == len(texts) and sorted(first) == sorted(again)
    check(first, texts, 0.15)  # ten documents a source here


def test_nulls_bounds_and_a_hot_source(spark):
    rows = [(i, "x " * (i % 7 + 1), "big") for i in range(3000)] + [(9000 + i, "w w w", s) for i, s in enumerate(["a", None, "é", "Z", "a"])]
    rows += [(9100, None, "a"), (9101, "", None), (9102, " ", "Z"), (None, "n n", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("clash"), "_rank": F.lit("mine")})
    out = mixing.mix(df).withColumn("taken", F.col("copies") * F.col("size")).collect()
    assert len(out) == len(rows)
    check([r for r in out if r["doc_id"] is not None], [(i, s, t) for i, t, s in rows], 0.6)
    assert all(r["copies"] == 0 for r in out if r["size"] == 0)
    assert mixing.explode_copies(mixing.mix(df)).count() == sum(r["copies"] for r in out)
    assert mixing.mix(df.limit(0)).count() == 0


def brute_expected(rows, want, most):
    """rows: (id, source, size, measure, key). By source, how often each document is expected, solved by halving."""
    for source in want:
        mine = [r for r in rows if r[1] == source and r[2] > 0]
        words = lambda f, mine=mine: sum(r[2] * min(most, f * r[3]) for r in mine)
        low, high = 0.0, most / min((r[3] for r in mine), default=1.0)
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if words(mid) < want[source] else (low, mid)
        yield source, {r[0]: min(most, high * r[3]) for r in mine}


def test_taken_documents_are_recomputed(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 10, 40, 200])) + f" {i}", rng.choice(["a", "b", "b", "b", None])) for i in range(900)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    keys = {r["doc_id"]: (r["source"], r["size"], r["_measure"], r["_key"] % 2**64) for r in mixing.sized(df, power=0.5, seed=4).collect()}
    out = {r["doc_id"]: r for r in mixing.mix(df, power=0.5, seed=4).collect()}
    repeats = Counter(r[0] for r in rows)
    sizes = Counter()
    for i, n in repeats.items():
        sizes[keys[i][0]] += n * keys[i][1]
    want = brute_targets(sizes, (1, 2, 3), 3)
    everyone = [(i, keys[i][0], n * keys[i][1], keys[i][2], keys[i][3]) for i, n in repeats.items()]
    for source, expected in brute_expected(everyone, want, 3.0):
        for i, c in expected.items():
            assert out[i]["expected"] == pytest.approx(c, rel=0.01)
        # from here with the operator's own expectations: certain copies, then random odds over inclusion odds
        room, ranks, copies, place = want[source], [], {}, {}
        for i, _, size, _, key in (r for r in everyone if r[1] == source and r[2] > 0):
            whole = int(out[i]["expected"] + 1e-9)
            p, u = out[i]["expected"] - whole, ((key >> 11) + 0.5) / 2**53
            room -= whole * size
            copies[i], place[i] = whole, (1, 0.0, key)
            if p > 1e-9:
                place[i] = (0, u / (1 - u) * (1 - p) / p, key)
                ranks.append((place[i], i, size))
        for _, i, size in sorted(ranks):
            if size > room:
                break
            room -= size
            copies[i], place[i] = copies[i] + 1, (1, *place[i][1:])
        classes = {}
        for i, _, size, _, key in (r for r in everyone if r[1] == source and r[2] > 0):
            if size < 2 * room and copies[i] < 3:
                classes[size.bit_length()] = min(classes.get(size.bit_length(), ((9,),)), (place[i], size, i))
        left = sorted(((size, i) for _, size, i in classes.values()), reverse=True)
        for size, i in list(left):
            if size <= room:
                room -= size
                copies[i] += 1
                left.remove((size, i))
        off, i = min(((abs(room - size), i) for size, i in left), default=(room, None))
        if off < room:
            copies[i] += 1
        assert copies == {i: out[i]["copies"] for i in copies} and max(copies.values()) <= 3


def test_inclusion_follows_the_chances(spark):
    """60 sources hold the same 600 documents, each with draws of its own: the share taken of a size is its chance, but for
    the few documents that fill each source's gap."""
    sizes, n = [1, 1, 2, 3, 5, 8, 13, 21, 34, 55] * 60, 60
    rows = [(s * 1000 + k, " ".join(["w"] * size), f"{s:04}") for s in range(n) for k, size in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, power=0.5, weights=(1,), total=0.4 * n * sum(sizes), seed=2).groupBy("size")
    rows = out.agg(F.avg("copies").alias("share"), F.min("expected").alias("low"), F.max("expected").alias("expected"), F.max("copies").alias("most")).collect()
    assert len(rows) == 9 and sum(sizes.count(r["size"]) * r["size"] * r["expected"] for r in rows) == pytest.approx(0.4 * sum(sizes), rel=0.01)
    for r in rows:
        assert r["low"] == pytest.approx(r["expected"]) and r["expected"] == pytest.approx(rows[0]["expected"] * (r["size"] / rows[0]["size"]) ** 0.5)
        assert r["most"] == 1 and abs(r["share"] - r["expected"]) < 0.03, r


def test_measures_that_say_nothing_and_very_long_texts(spark):
    rows = [(i, "x y z", "a", m) for i, m in enumerate([1.0, None, float("nan"), -1.0, 0.0, float("inf"), 1.0, 1.0] * 20)]
    rows += [(1000, "long " * 200_000, "b", 1.0), (1001, "short", "b", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, m double")
    out = mixing.mix(df, measure=F.col("m"), weights=(1, 1), total=240.0 + 100.0)
    a = out.filter("source = 'a'").agg(F.countDistinct(F.round("expected", 9)), F.sum(F.col("copies") * F.col("size"))).first()
    assert a[0] == 1 and abs(a[1] - 170) <= 3
    assert {r["doc_id"]: r["copies"] for r in out.filter("source = 'b'").collect()}[1000] == 0
