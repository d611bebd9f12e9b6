import re

import numpy as np
from pyspark.sql import functions as F

from keyfold.llm import quality
from keyfold.llm.queries import op10_quality

SMALL = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_against_brute_force():
    edge = ["", " ", "a", "a b\tc\vd\fe\rf g h " * 2, "x\n\n \nx\nx", "  　é ñ|<>\x00", "for " * 30, "a b c d e f g h i " * 3 + "a b c d e f g h", "w\n" * 40]
    for text in edge:
        assert quality.count(text.encode())[:5] == brute(text)


def test_query(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect() if len(r[1]) < 6000}
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect()}
    rows = {r["doc_id"]: r for r in op10_quality(spark, SMALL).collect()}
    for i, text in texts.items():
        want = brute(text)
        assert tuple(rows[i][c] for c in quality.BASE) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert rows[i]["base_failed"] == failed and rows[i]["kept"] == (not failed and rows[i]["rule"] is None)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rules = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    held = quality.judged(docs, rules).join(labels.filter("doc_id % 2 = 1"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r[0], r[1]): r[2] for r in held}
    assert rules and n.get((1, False), 0) <= 0.03 * (n[1, True] + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.2 * (n[0, False] + n.get((0, True), 0))


def test_learner_finds_a_conjunction():
    rng = np.random.default_rng(0)
    x = {"chars_per_word": rng.uniform(0, 10, 3000), "upper_share": rng.uniform(0, 1, 3000)}
    bad = (x["chars_per_word"] > 7) & (x["upper_share"] <= 0.5) | (x["chars_per_word"] <= 1)
    rules = quality.learn(x, bad)
    hit = np.any([quality._covered(r, x, 3000) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.98 and any(len(r) == 2 for r in rules)
    assert quality.learn(x, np.zeros(3000, bool)) == []


def test_nulls_clashes_and_empty(spark):
    good = "these are some plain words that go on for a while and then they end after more than twenty of them all"
    df = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (2, good, "x"), (2, good, "x")], "doc_id long, text string, kept string")
    rules = [(quality.Condition("upper_share", True, 0.5),)]
    rows = quality.judged(df, rules).select("doc_id", "base_failed", "kept").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(None, True, False), (1, True, False), (2, False, True), (2, False, True)], key=str)
    assert quality.judged(df.limit(0), rules).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(df, none) == []
    shout = df.limit(1).withColumn("text", F.lit(good.upper()))
    assert quality.judged(shout, rules).first()["rule"] == "upper_share > 0.5"


def test_verdicts_are_those_of_the_rules_worked_out_in_python(spark):
    source, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    rules = quality.fit(source, labels)
    assert rules
    texts = {r[0]: r[1] for r in source.select("doc_id", "text").collect()}
    rows = {r["doc_id"]: r for r in op10_quality(spark, SMALL).collect()}
    assert set(rows) == set(texts)
    for i, text in texts.items():
        c = dict(zip(quality.COUNTS, quality.count(text.encode()), strict=True))
        value = {f: c[top] / max(c[bottom], 1) for f, (top, bottom) in quality.RATIOS.items()}
        hits = [r for r in rules if all((value[x.feature] > x.threshold) == x.above for x in r)]
        failed = c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]
        assert rows[i]["rule"] == (" and ".join(map(str, hits[0])) if hits else None)
        assert (rows[i]["base_failed"], rows[i]["kept"]) == (failed, not failed and not hits)


def test_further_counts_and_a_very_long_text():
    text = "Ab 12! cd. " * 50 + "\n" + " ".join(f"w{i}" for i in range(400_000))
    c = dict(zip(quality.COUNTS, quality.count(text.encode()), strict=True))
    assert c["n_words"] == 400_150 and c["n_upper"] == 50 and c["n_marks"] == 50 and c["n_stops"] == 50 and c["n_lines"] == 2
    assert c["n_digits"] == 100 + sum(len(str(i)) for i in range(400_000)) and c["n_repeat_words"] == 150 and c["n_block_distinct"] == 3 + 53 + 400_000 - 50
