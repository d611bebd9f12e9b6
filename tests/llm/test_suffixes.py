import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from compare import assert_same
from keyfold.llm import suffixes
from keyfold.llm.queries import op6_suffix_dedup

SMALL = "/root/testdata/sf0.001"


def brute(texts, length):
    """texts: list of bytes. Per text the bytes removed, the runs and the rest."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone.tolist(), strict=True) if not g)))
    return out


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, *b[:3], hashlib.sha256(b[3]).hexdigest()) for (i, _), b in zip(docs, brute([t.encode() for _, t in docs], 400), strict=True))
    rows = op6_suffix_dedup(spark, SMALL).collect()
    assert sorted(tuple(r)[:5] for r in rows) == want and sum(w[2] for w in want) > 0
    old = dict(docs)
    for r in rows:
        assert r["text"] == old[r["doc_id"]] if not r["n_removed"] else len(r["text"].encode()) <= r["n_bytes"] - r["n_removed"]


def test_query_against_sql(spark):
    assert_same(op6_suffix_dedup(spark, SMALL), suffixes.SQL)


def tangled(rng, n):
    """Texts that share passages with changes, repeat themselves, and hold runs of short periods."""
    word = lambda: "".join(rng.choice("abé\0") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(60))
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.randint(0, 4)
            a = rng.randint(0, 200)
            cut = passage[a : a + rng.randint(20, 200)]
            if kind == 0:
                cut = cut[:40] + rng.choice("xyz") + cut[41:]
            elif kind == 1:
                cut = rng.choice(["ab", "abc", "é", "aab" * 7]) * rng.randint(1, 60)
            elif kind == 2:
                cut = " ".join(word() for _ in range(20))
            parts.append(cut)
        out.append("|".join(parts) if i % 9 else rng.choice(["", "a", "a" * 40, passage]))
    return out


@pytest.mark.parametrize(("length", "shard", "hot", "starts"), [(40, 8, (1 << 30, 1 << 30), 1 << 20), (64, 1 << 14, (1, 1), 333), (32, 50, (20, 20), 1 << 20)])
def test_tangled_texts(spark, monkeypatch, length, shard, hot, starts):
    for name, value in (("SHARD", shard), ("HOT", hot), ("STARTS", starts)):
        monkeypatch.setattr(suffixes, name, value)
    texts = tangled(random.Random(length), 150)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = suffixes.remove_repeats(df, length=length).collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in rows)
    assert got == [(i, *b) for i, b in enumerate(brute([t.encode() for t in texts], length))]
    for r in rows:
        raw, whole, at = texts[r["doc_id"]].encode(), [], 0
        for a, b in [*((s["start"], s["end"]) for s in r["spans"]), (len(raw), len(raw))]:
            whole.append(raw[at:a].decode(errors="ignore"))
            at = b
        assert r["text"] == "".join(whole)


def test_starts_inside_documents():
    rng = np.random.default_rng(3)
    for _ in range(200):
        offsets = np.concatenate(([0], np.cumsum(rng.integers(0, 60, 8))))
        n, length = int(offsets[-1]), int(rng.integers(1, 40))
        want = np.zeros(n, bool)
        for a, b in zip(offsets, offsets[1:], strict=False):
            want[a : max(a, b - length + 1)] = True
        lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
        assert (suffixes._starts_inside(offsets, lo, hi, length) == want[lo:hi]).all()


def test_rows_repeated_very_often(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(200))
    df = spark.range(3000).selectExpr("1L as doc_id", f"'{text}' as text")
    got = suffixes.remove_repeats(df).groupBy("n_removed", "text").count().collect()
    assert [tuple(r) for r in got] == [(len(text), "", 3000)]


def test_a_very_long_text(spark):
    rng = random.Random(5)
    part = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    text = part + "".join(rng.choice("ijk") for _ in range(300_000)) + part
    (row,) = suffixes.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row["n_bytes"], row["n_removed"], len(row["spans"]), row["text"]) == (700_000, 400_000, 2, text[200_000:500_000])


def test_induced_order():
    rng = random.Random(0)
    anchor = bytes(rng.randrange(256) for _ in range(32))
    items = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) + anchor + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    items = list(dict.fromkeys(items))
    places = [c.index(anchor) for c in items]
    item, d = suffixes.induced(places, items, 40)
    got = set(zip(item.tolist(), d.tolist(), strict=True))
    strings = [(c[p - k : p - k + 40], i, k) for i, (c, p) in enumerate(zip(items, places, strict=True)) for k in range(p + 1) if len(c) - p + k >= 40]
    seen = Counter(s for s, _, _ in strings)
    assert got == {(i, k) for s, i, k in strings if seen[s] > 1} and got


def test_nulls_repeated_rows_and_empty(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(200))
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, "x" + text[:500]), (4, "short")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in suffixes.remove_repeats(df).collect()), key=str)
    assert got == sorted([(1, len(text)), (1, len(text)), (2, 0), (3, 0), (None, 500), (4, 0)], key=str)
    assert suffixes.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="at least"):
        suffixes.remove_repeats(df, length=10)
