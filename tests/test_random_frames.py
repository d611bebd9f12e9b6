"""Random rows with nulls and NaN, against the rules worked out in plain Python."""

import math
import random
from collections import defaultdict

import pytest

from keyfold import keyed_aggregate


def brute(rows):
    groups = defaultdict(list)
    for s, c, i, v in rows:
        if s is not None and c is not None and not math.isnan(c) and i is not None:
            groups[s, c + 0.0, i].append(v)
    out = {}
    for key, values in groups.items():
        there = [v for v in values if v is not None]
        n = len(there)
        mean = sum(there) / n if n else None
        var = sum((v - mean) ** 2 for v in there) / (n - 1) if n > 1 else None
        out[key] = (sum(there), mean, max(there, default=None), min(there, default=None), var, len(values), n)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_python(spark, seed):
    rng = random.Random(seed)
    rows = [
        (rng.choice(["a", "b", "", None]), rng.choice([0.0, -0.0, 1.5, float("nan"), None]), rng.choice([1, 2, None]), rng.choice([None, rng.uniform(-9, 9)]))
        for _ in range(rng.choice([1, 40, 400]))
    ]
    df = spark.createDataFrame(rows, "s string, c double, i int, v double").repartition(rng.randint(1, 5))
    out = keyed_aggregate(df, "sum(v)", "s", "avg(v)", "max(v)", "c", "min(v)", "var(v)", "i", "count(*)", "count(v)", dims=["i"])
    assert out.columns == ["s", "c", "i", "v_sum", "v_avg", "v_max", "v_min", "v_var", "count", "v_count"]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in out.collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-9)
