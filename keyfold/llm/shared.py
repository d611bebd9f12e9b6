"""What the operators share: the shared folder, staged tables, links and their connected components."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets one of its
    own; anything else is an error, as each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="keyfold-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


_here = threading.local()
_everywhere: dict[str, SparkSession] = {}


def _made() -> list[str]:
    """Folders of this thread: what one thread drops, another never reads."""
    if not hasattr(_here, "made"):
        _here.made = []
    return _here.made


def new_folder(spark: SparkSession, what: str) -> str:
    folder = f"{shared_folder(spark)}/keyfold-{what}-{uuid.uuid4().hex}"
    _made().append(folder)
    _everywhere[folder] = spark
    return folder


def staged_folders() -> list[str]:
    """What this thread has staged and not dropped."""
    return list(_made())


def drop_staged(spark: SparkSession, folders: list[str]) -> None:
    """Delete staged folders; only when no result still reads from there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        _everywhere.pop(folder, None)
        if folder in _made():
            _made().remove(folder)


@atexit.register
def _drop_all() -> None:
    """What results still read from goes with the process."""
    for folder, spark in list(_everywhere.items()):
        with contextlib.suppress(Exception):  # the session may have ended before
            if spark.sparkContext._jsc is not None:
                drop_staged(spark, [folder])


#: With this setting a query's shuffle files go when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, what: str, *, instead_of: Sequence[str] | None = None) -> DataFrame:
    """Written once to the shared folder and read from there: lineage ends, and no executor's loss undoes it.

    Shuffle files of the step go with its end, so that disk holds those of one step. instead_of: folders that have
    then served; they are dropped.
    """
    folder = new_folder(df.sparkSession, what)
    with _own_shuffles(df.sparkSession):
        df.write.parquet(folder)
    if instead_of is not None:
        drop_staged(df.sparkSession, list(instead_of))
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def last_staged(df: DataFrame, what: str, before: Sequence[str]) -> DataFrame:
    """As ``staged``, when nothing that was staged since ``before`` is needed any more."""
    return staged(df, what, instead_of=[f for f in staged_folders() if f not in before])


def columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def utf8(texts: pa.Array) -> Iterator[bytes]:
    """Each text's UTF-8 bytes; null gives no bytes."""
    for value in texts.cast(pa.binary()):
        yield value.as_py() or b""


def wrapped(docs: DataFrame, *beside: str | Column) -> DataFrame:
    """All columns as one struct ``row``, and some beside it: what an operator adds then clashes with none of them.

    What stands beside is moved a second time where rows are shuffled, so texts stay inside.
    """
    return docs.select(F.struct("*").alias("row"), *beside)


def unwrapped(docs: DataFrame, *but: str) -> list[Column]:
    """The columns of ``row`` again, in order, without those named."""
    names = docs.schema["row"].dataType.names
    return [F.col("row").getField(c).alias(c) for c in names if c not in but]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def splitmix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_blocks(rows: DataFrame, member: str, block: int) -> DataFrame:
    """Rows with a ``key``, dealt out so that rows of equal key meet, sorted by (key, i, j).

    A key with more than ``block`` rows is cut into blocks by a hash of ``member``, and every pair of blocks (i, j) is
    work of its own. ``side`` is 2 where i = j, else 0 or 1 by block: rows of the same side meet elsewhere. Where rows
    have a column ``n``, it says how many rows their key has; else they are counted first.
    """
    if "n" in rows.columns:
        rows = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    else:
        size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
        large = staged(size.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "buckets")
        rows = rows.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    side = F.when(F.col("i") == F.col("j"), 2).otherwise((F.col("own") == F.col("i")).cast("int")).cast("byte")
    return rows.withColumn("side", side).drop("own", "other", "blocks").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Batches of sorted rows as tables of whole buckets, with each bucket's start and size."""
    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        starts = _starts(held)
        if len(starts) > 1:
            yield held.slice(0, starts[-1]), starts[:-1], np.diff(starts)
            held = held.slice(starts[-1]).combine_chunks()
    if held is not None and len(held):
        starts = _starts(held)
        yield held, starts, np.diff(np.append(starts, len(held)))


def _starts(held: pa.Table) -> np.ndarray:
    new = np.zeros(len(held), bool)
    new[:1] = True
    for c in ("key", "i", "j"):
        x = held.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """From a symmetric matrix of links, (first index, other) for all others of each component."""
    left, found = np.ones(len(near), bool), []
    for i in np.flatnonzero(near.any(axis=1)):
        if not left[i]:
            continue
        left[i] = False
        front = np.array([i])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & left)
            left[front] = False
            found += [(i, j) for j in front.tolist()]
    return found


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: bigint) to (node, component: bigint), component being the smallest node that links reach.

    Two kinds of star are formed in turn until nothing changes: each node's larger neighbours move to its smallest
    neighbour, then each node's smaller neighbours do. Rounds grow with the logarithm of the longest chain. Minima are
    aggregated, so a node with many links sends one row a task; the joins on it can be split as they have one row on
    the other side. Links with a null end and links of a node to itself say nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct()
    before, own, edges = None, staged_folders(), staged(edges, "links")
    while True:
        if (now := _digest(edges)) == before or not now[0]:
            return _labels(edges)
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = last_staged(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct(), "links", own)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _labels(edges: DataFrame) -> DataFrame:
    """At the end every edge points from a node to its component's smallest one."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()
