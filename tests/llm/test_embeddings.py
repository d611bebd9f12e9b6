import duckdb
import numpy as np

from compare import assert_same, canonical
from keyfold.llm import embeddings
from keyfold.llm.queries import op9_embeddings
from test_simhash import brute_components

SMALL = "/root/testdata/sf0.001"


def brute(rows, cosine):
    """rows: (vec_id, embedding, label) with distinct ids."""
    ok = lambda v, lab: lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
    usable = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if ok(v, lab)]
    links = []
    for k, (i, v, lab) in enumerate(usable):
        for j, w, other in usable[:k]:
            if lab == other and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= cosine:
                links.append((i, j))
    component = brute_components([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for i, j in links:
        n[i] += 1
        n[j] += 1
    return sorted((i, n[i], component[i], component[i] == i) for i in n)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, got = brute(rows, 0.98), sorted(map(tuple, op9_embeddings(spark, SMALL).collect()))
    true, found = sum(r[1] for r in want), sum(r[1] for r in got)
    assert len(got) == len(rows) and found >= 0.98 * true
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_query_against_sql(spark, tmp_path):
    assert_same(op9_embeddings(spark, SMALL), embeddings.SQL)
    rng = np.random.default_rng(4)
    hubs = rng.standard_normal((5, 16))
    rows = [(i, (hubs[i % 5] + rng.standard_normal(16) * 0.08).tolist(), i % 3) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    (part,) = (tmp_path / "embeddings.parquet").glob("*.parquet")
    part.rename(tmp_path / "flat")
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), tables=embeddings.Tables(tables=40, projections=4))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path / 'flat'}')")
    found = con.execute(embeddings.SQL)
    names = [d[0] for d in found.description]
    assert canonical(out.columns, [tuple(r) for r in out.collect()]) == canonical(names, found.fetchall())


def test_dense_groups_copies_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    rng = np.random.default_rng(1)
    hub = rng.standard_normal(16)
    rows = [(i, (hub + rng.standard_normal(16) * 0.1).tolist(), i % 2) for i in range(150)]
    rows += [(200 + i, rows[i % 3][1], rows[i % 3][2]) for i in range(40)]
    rows += [(300 + i, rng.standard_normal(16).tolist(), 0) for i in range(60)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [None] * 16, 0), (404, rows[0][1], None)]
    rows += [(405, [], 0), (406, [float("inf")] + [1.0] * 15, 0), (407, [1.0, 0.0], 0), (408, [2.0, 0.0], 0), (409, [1e200] * 16, 1), (410, [1e-200] * 16, 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, n_links int").repartition(3)
    many = embeddings.Tables(tables=40, projections=4)
    got = sorted(map(tuple, embeddings.near_duplicates(df, cosine=0.95, tables=many).collect()))
    want = brute([r for r in rows if r[0] < 409], 0.95)
    assert [g for g in got if g[0] < 409] == want
    assert [g for g in got if g[0] >= 409] == [(409, 1, 409, True), (410, 1, 409, False)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (None, [0.0, 1.0], 0)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True)], key=str)


def test_chance_of_meeting():
    t = embeddings.Tables()
    assert t.chance_of_meeting(0.98) > 0.998 > 0.9 and t.chance_of_meeting(0.0) < 0.01
