"""Line dedup by overlapping windows of three consecutive lines.

A window that occurs more than once in the corpus stays where it occurs first; every line that a later occurrence
covers goes. Windows overlap, so a repeated run of lines goes as a whole, and a single line that happens to recur stays.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.shared import WORD, last_staged, staged, staged_folders, wrapped

WINDOW = 3


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, t, pos, h, g): each window's place and 96 bits of hash. Windows without a word are left out."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("t"), F.split("text", "\n", -1).alias("lines"))
    n = F.greatest(F.size("lines") - (WINDOW - 1), F.lit(0))
    side_by_side = F.arrays_zip(*(F.slice("lines", k + 1, n).alias(f"l{k}") for k in range(WINDOW)))
    each = lines.select("doc_id", "t", F.posexplode(side_by_side).alias("pos", "w"))
    each = each.select("doc_id", "t", "pos", F.concat_ws("\n", *(F.col("w")[f"l{k}"] for k in range(WINDOW))).alias("w"))
    return each.filter(F.col("w").rlike(WORD)).select("doc_id", "t", "pos", F.xxhash64("w").alias("h"), F.hash("w").alias("g"))


def later_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, t, at): per document that has any, the positions of windows that occur earlier too."""
    each = staged(windows(docs), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t", "pos")
    repeated = each.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = each.join(staged(repeated, "repeated"), ["h", "g"]).filter(place != F.col("first"))
    return later.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("at"))


def _cut(texts: pa.Array, places: pa.Array) -> pa.Array:
    out = []
    for text, at in zip(texts, places, strict=True):
        if not text.is_valid:
            out.append({"text": None, "n_removed": 0})
            continue
        lines, gone = text.as_py().split("\n"), {p + k for p in at.as_py() for k in range(WINDOW)}
        out.append({"text": "\n".join(x for i, x in enumerate(lines) if i not in gone), "n_removed": len(gone)})
    return pa.array(out, pa.struct([("text", pa.string()), ("n_removed", pa.int64())]))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Documents with ``text`` cut, and ``n_lines`` (before) and ``n_removed`` added.

    docs: doc_id, text and any other columns; columns named n_lines and n_removed are replaced. Occurrences are
    ordered by doc_id (null last), then text, then place. Rows equal in id and text are one document and get equal
    results. A text of fewer than three lines has no window and stays, as does a null text; a text all of whose lines
    go is empty. Windows without a word (three blank or white-space lines) are exempt: they stay however often they
    occur. An empty table gives an empty result.
    """
    before = staged_folders()
    cut = last_staged(later_windows(docs), "cuts", before).withColumnRenamed("doc_id", "id")
    # a merge join at any size: cuts grow with the corpus, and the plan should not change on the way
    keyed = wrapped(docs, "doc_id", F.xxhash64("text").alias("own"))
    both = keyed.join(cut.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("t")), "left")
    old = F.col("row").getField("text")
    touched = F.col("at").isNotNull()
    new = F.arrow_udf(_cut, "struct<text:string,n_removed:bigint>").asNondeterministic()(F.when(touched, old), F.col("at"))
    both = both.withColumn("new", new)
    names = docs.columns
    text = F.when(touched, F.col("new.text")).otherwise(old).alias("text")
    kept = dict(zip(names, [F.col("row").getField(c).alias(c) for c in names], strict=True)) | {"text": text}
    n_lines = F.coalesce(F.size(F.split(old, "\n", -1)), F.lit(0)).cast("bigint").alias("n_lines")
    return both.select(*(kept[c] for c in names if c not in ("n_lines", "n_removed")), n_lines, F.col("new.n_removed").alias("n_removed"))


SQL = """
with d as (select doc_id, string_split(text, chr(10)) l from documents),
w as (select doc_id, l, unnest(generate_series(1, len(l) - 2)) i from d),
k as (select doc_id, i, l[i] || chr(10) || l[i+1] || chr(10) || l[i+2] w from w),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by w order by doc_id, i) n from k where regexp_matches(w, '[^\\x20\\x09-\\x0D]')) where n > 1),
gone as (select distinct doc_id, i + j i from later, (values (0), (1), (2)) t(j)),
a as (select doc_id, l, unnest(generate_series(1, len(l))) i from d),
kept as (select a.doc_id, string_agg(a.l[a.i], chr(10) order by a.i) text from a left join gone g on a.doc_id = g.doc_id and a.i = g.i where g.i is null group by 1)
select d.doc_id, coalesce(kept.text, '') text, cast(len(d.l) as bigint) n_lines, cast(coalesce(x.n, 0) as bigint) n_removed
from d left join kept on d.doc_id = kept.doc_id left join (select doc_id, count(*) n from gone group by 1) x on d.doc_id = x.doc_id
"""
