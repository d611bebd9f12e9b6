from compare import SMALL, assert_same
from keyfold.llm import linededup
from keyfold.llm.queries import op8_line_dedup


def test_query_against_sql(spark):
    assert_same(op8_line_dedup(spark, SMALL), linededup.SQL)


def test_overlaps_nulls_ties_and_empty(spark):
    rows = [
        (1, "a\nb\nc\nd\nz"),
        (2, "x\na\nb\nc\nd"),
        (3, "b\nc"),
        (4, "p\nq\nr\np\nq\nr\np"),
        (5, None),
        (6, ""),
        (7, "\n\n\n\n"),
        (8, "\n\n\n\n"),
        (9, "b\nc\nd"),
        (9, "b\nc\nd"),
        (None, "m\nn\no"),
        (10, "m\nn\no"),
    ]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, n_lines string, at int").repartition(3)
    out = linededup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "at", "n_lines", "n_removed"]
    got = sorted([(r["doc_id"], r["text"], r["n_removed"]) for r in out.collect()], key=str)
    want = [(1, rows[0][1], 0), (2, "x", 4), (3, "b\nc", 0), (4, "p\nq\nr", 4), (5, None, 0), (6, "", 0), (7, "\n\n\n\n", 0), (8, "\n\n\n\n", 0), (9, "", 3), (9, "", 3), (None, "", 3), (10, "m\nn\no", 0)]
    assert got == sorted(want, key=str)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_very_long_texts_and_windows_of_very_many_rows(spark):
    lines = [f"line {i}" for i in range(60_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[100:50_000] + ["own"])), *((10 + i, "often\nthe same\nlines") for i in range(3000)), (5000, "x" * 2_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.dedup_lines(df).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("own", 49_900) and got[10] == (rows[2][1], 0) and got[5000] == (rows[-1][1], 0)
    assert {got[10 + i] for i in range(1, 3000)} == {("", 3)}
