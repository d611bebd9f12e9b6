import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from keyfold.llm import quality

SMALL = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held[name] = docs.cache()
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    bad = quality.judged(source, quality.fit(source, spark.read.parquet(f"{SMALL}/labels.parquet"))).filter("not kept").select("doc_id")
    assert held["quality_rules"].join(bad, "doc_id").count() == 0
    assert held["quality_rules"].count() == source.count() - bad.count() > 0.7 * source.count()
    assert held["line_dedup"].count() == held["quality_rules"].count()
    assert held["line_dedup"].filter("n_chars <> length(text)").count() == 0

    windows = Counter()
    for r in held["line_dedup"].collect():
        lines = r["text"].split("\n")
        windows.update("\n".join(lines[i : i + 3]) for i in range(len(lines) - 2) if "".join(lines[i : i + 3]).strip())
    original = Counter()
    for r in held["quality_rules"].collect():
        lines = r["text"].split("\n")
        original.update("\n".join(lines[i : i + 3]) for i in range(len(lines) - 2))
    assert not [w for w, n in windows.items() if n > 1 and original[w] > 1]

    texts = [r["text"] for r in held["simhash_near_dedup"].select("text").collect()]
    assert len(texts) == len(set(texts)) < held["line_dedup"].count()
    known = {r["doc_id"]: r["text"] for r in held["simhash_near_dedup"].collect()}
    mixed = Counter(r["doc_id"] for r in held["mixing"].collect())
    assert max(mixed.values()) <= 3 and set(mixed) <= set(known)
    assert held["sentencepiece"].count() == sum(mixed.values()) and held["sentencepiece"].filter("not lossless").count() == 0


def test_registered_and_whole(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"].__wrapped__ is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SMALL).filter(F.col("n_tokens") > 0).count() > 100


def test_clashing_columns_nulls_and_an_empty_table(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, copies int, row string, counts int, _n int, n_removed int"
    text = "a few more than twenty words are needed here so that the base rules let this short text pass them and it goes on"
    rows = [(1, text, "en", "a", 5, "k", 1, 1, "r", 1, 1, 1), (2, None, None, None, None, None, 1, 1, None, 1, 1, 1), (None, text + " and on", "en", None, 5, None, 1, 1, None, 1, 1, 1), (4, "", "en", "b", 0, "k", 1, 1, "r", 1, 1, 1)]
    for docs in (spark.createDataFrame(rows, names), spark.createDataFrame([], names)):
        empty = docs.isEmpty()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SMALL)
            assert k == 4 or docs.columns == [c.split(" ")[0] for c in names.split(", ")]
            assert (docs.count() == 0) == empty


def test_repeated_rows_and_very_long_texts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(12)) for _ in range(n))
    rows = [(i, prose(10), "en", f"s{i % 3}", 0) for i in range(30)] + [(100, prose(20_000), "en", "s0", 0)]
    rows += [rows[3]] * 40 + [(200 + i, rows[3][1], "en", "s1", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL)
        ids = [r[0] for r in docs.select("doc_id").collect()]
        if k == 2:
            assert sorted(ids) == [*range(30), 100]
        assert k > 2 or 100 in ids
    assert docs.filter("not lossless").count() == 0 and max(Counter(ids).values()) <= 3
