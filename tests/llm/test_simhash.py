import random

import numpy as np
import xxhash

from keyfold.llm import simhash
from keyfold.llm.queries import op2_simhash
from keyfold.llm.shared import components

SMALL = "/root/testdata/sf0.001"


def brute_print(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute_groups(prints, distance):
    fp = np.array([p for _, p in prints], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
    ids = [i for i, _ in prints]
    return brute_components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True) if a < b])


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    prints = [(i, brute_print(t, 4)) for i, t in docs]
    group = brute_groups(prints, 4)
    want = sorted((i, f"{p:016x}", group[i]) for i, p in prints)
    assert sorted(tuple(r) for r in op2_simhash(spark, SMALL).collect()) == want


def test_dense_and_chained_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(5)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    fps = [rng.getrandbits(64) for _ in range(600)]
    hub = rng.getrandbits(64)
    fps += [flip(hub, rng.randint(1, 4)) for _ in range(300)]
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(8):
            x = flip(x, rng.randint(3, 6))
            fps.append(x)
    fps = list(dict.fromkeys(fps)) + [0, 2**64 - 1]
    nodes = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) * 2 for p in fps], "fp long, node long")
    for distance in (4, 7):
        parts = simhash.plan(nodes, distance)
        assert sum(t + 1 for t in parts.thresholds) == distance + 1
        assert sum(parts.masks) == 2**64 - 1
        found = {r[0]: r[1] for r in components(simhash.links(nodes, parts, distance).select("a", "b")).collect()}
        want = brute_groups([(p, p) for p in fps], distance)
        got = {p: found.get(p - 2**64 if p >> 63 else p, p - 2**64 if p >> 63 else p) for p in fps}
        classes = lambda m: sorted(sorted(p for p in fps if m[p] == c) for c in set(m.values()))
        assert classes(got) == classes(want)


def test_nulls_ties_and_empty(spark):
    rows = [(3, "a b c d e", 1), (1, "A B C D E", 1), (1, "A B C D E", 1), (7, None, 1), (5, " \t", 1), (None, "zz yy", 1), (9, " x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df, shingle=4, prints=1, distance=4).collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (1, 1), (7, 5), (5, 5), (None, None), (9, 9)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.near_duplicates(df.limit(0), prints=1).count() == 0


def test_long_text_is_counted_in_pieces(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5000)).encode()
    whole = simhash.fingerprint(text, 4, 3).tolist()
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text, 4, 3).tolist() == whole and whole[0] == brute_print(text.decode(), 4) not in whole[1:]


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 499), (7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(201)}, 499: 499, 500: 499, 501: 499}


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_similarity_is_checked_on_texts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(30)]
    texts = list(base)
    for i, t in enumerate(base):
        for changes in (1, 2, 6):
            w = t.split()
            for _ in range(changes):
                w[rng.randrange(len(w))] = f"new{i}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    prints = {i: simhash.fingerprint(t.encode(), 5, 3) for i, t in enumerate(texts)}
    far = lambda i, j: int(np.bitwise_count(prints[i] ^ prints[j]).min())
    links = [(i, j) for i in prints for j in range(i) if far(i, j) <= simhash.SURE or far(i, j) <= 10 and jaccard(texts[i], texts[j]) >= 0.8]
    # a link that is not in the forest of least distances may be missed only where no chain of nearer links passes
    want = brute_components(list(prints), links)
    assert {i: rows[i]["component_id"] for i in prints} == want
    light = [i for i in range(30, 120) if (i - 30) % 3 < 2]  # one or two words of 120 are new
    assert sum(rows[i]["component_id"] != i for i in light) > 55


def test_one_of_each_group_keeps_columns_and_repeats_once(spark):
    text = "some words that make up a text of a certain length so that shingles exist"
    rows = [(4, text, "x"), (2, text + " and", "y"), (2, text + " and", "y"), (9, None, "n"), (8, "", "e"), (None, "quite another text with other words in it", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _n string")
    out = simhash.one_of_each_group(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["_n"]) for r in out.collect()), key=str)
    assert got in (sorted([(2, "y"), (8, "e"), (None, "z")], key=str), sorted([(2, "y"), (4, "x"), (8, "e"), (None, "z")], key=str))
    assert simhash.one_of_each_group(df.limit(0)).count() == 0


def family(rng, n, most, name):
    """Distinct texts, some from others of the family, with a few new words each; similarities lie about 0.8."""
    texts = [[f"{name}{rng.randrange(900)}" for _ in range(240)]]
    while len(texts) < n:
        w = list(texts[0] if rng.random() < 0.8 else rng.choice(texts))
        for _ in range(rng.randint(2, most)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts.append(w)
    return [" ".join(w) for w in texts[1:]]


def similar_components(texts, distance=10):
    prints = np.array([simhash.fingerprint(t.encode(), 5, 3) for t in texts])
    far = np.bitwise_count(prints[:, None] ^ prints[None]).min(axis=2)
    sure = [(int(i), int(j)) for i, j in zip(*np.nonzero(far <= distance), strict=True) if j < i and (far[i, j] <= simhash.SURE or jaccard(texts[i], texts[j]) >= 0.8)]
    return brute_components(range(len(texts)), sure)


def test_large_families_against_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    texts = [t for k in range(5) for t in family(rng, 90, 5 + k, "abcde"[k])]
    want = similar_components(texts)
    assert 100 < len(set(want.values())) < len(texts) - 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == want
    monkeypatch.setattr(simhash, "MANY", 0)  # forests in turns, before all pairs left are looked at
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == want


def test_equal_prints_are_checked_on_texts(spark):
    rng = random.Random(2)
    often = " ".join(["one two three four five"] * 400)
    other = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    texts = [f"{often} {other()}" for _ in range(12)]
    texts += [texts[0].upper(), texts[3] + " end", texts[3]]
    prints = np.array([simhash.fingerprint(t.encode(), 5, 3) for t in texts])
    assert (np.bitwise_count(prints[:, None] ^ prints[None]).min(axis=2) <= 4).all()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["component_id"] for r in simhash.near_duplicates(df).orderBy("doc_id").collect()]
    assert got == [*range(12), 0, 3, 3]


def test_rows_a_print_stay_few_in_a_large_corpus(spark, monkeypatch):
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**63, 500) * 2 + rng.integers(0, 2, 500)
    fps = spark.createDataFrame([(int(np.int64(x)), i) for i, x in enumerate(fp)], "fp long, node long")
    n, both = simhash.bit_counts(fps)
    rows = {}
    for times in (100, 5000):
        monkeypatch.setattr(simhash, "bit_counts", lambda _, k=times: (n * k, both * k))
        parts = simhash.node_links(fps.withColumnRenamed("fp", "fp0"), "fp0", 10)[1]
        rows[times] = sum(simhash.variants(m.bit_count(), t) for m, t in zip(parts.masks, parts.thresholds, strict=True) if t >= 0)
    assert rows[5000] <= 2 * rows[100] < 80


def test_parity_leaves_out_no_similar_pair():
    rng = np.random.default_rng(6)
    base = rng.choice(2**31, 300, replace=False)
    sets = [set(base.tolist())]
    for k in range(1, 120):
        s = set(base[k % 40 :].tolist()) if k % 2 else set(base.tolist())
        sets.append(s ^ set(rng.choice(base, k % 60, replace=False).tolist()) | set(range(k)))
    sets += [set(), set()]
    size = np.array([len(s) for s in sets])
    odd = np.array([np.packbits(np.bincount(np.fromiter(s, np.int64, len(s)) % simhash.PARITY, minlength=simhash.PARITY) & 1) for s in sets], np.uint8)
    a, b = np.triu_indices(len(sets), 1)
    may = simhash.may_be_similar(size, odd.view(np.uint64), a, b, 0.8)
    like = np.array([len(sets[i] & sets[j]) / max(len(sets[i] | sets[j]), 1) if sets[i] | sets[j] else 1.0 for i, j in zip(a, b, strict=True)])
    assert may[like >= 0.8].all() and 10 < (like >= 0.8).sum() < len(a) / 2
    assert not may[like < 0.65].any()
    assert simhash.bit_rows(simhash.bit_column(odd.view(np.uint64))).tolist() == odd.view(np.uint64).tolist()
