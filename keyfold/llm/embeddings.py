"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks.

Normalised vectors are projected on Gaussian directions, shifted and cut into steps of equal width; the steps of
``projections`` directions name a bucket of one table. Vectors near each other share a bucket of some table with high
probability (``chance_of_meeting``). Every pair that meets is checked by its cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erf, exp, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.shared import columns, components, forest, in_blocks, last_staged, splitmix, staged, staged_folders, whole_buckets

#: Rows of a bucket that meet in one task; larger buckets are cut into blocks, and each pair of blocks is a task's work.
BLOCK = 512


@dataclass(frozen=True)
class Tables:
    """16 tables of 6 projections with steps as wide as 1.0 miss a pair of cosine 0.98 once in a thousand times."""

    tables: int = 16
    projections: int = 6
    width: float = 1.0
    seed: int = 7

    def directions(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([self.seed, dim])
        n = self.tables * self.projections
        return rng.standard_normal((dim, n)), rng.uniform(0, self.width, n)

    def chance_of_meeting(self, cosine: float) -> float:
        """For one pair, over the choice of directions."""
        w = self.width / sqrt(max(2 - 2 * cosine, 1e-12))
        one = erf(w / sqrt(2)) - 2 / (sqrt(2 * pi) * w) * (1 - exp(-w * w / 2))
        return 1 - (1 - one**self.projections) ** self.tables


def normalised(flat: np.ndarray) -> np.ndarray:
    """Rows of length 1; divided by their largest component first, so that squares stay in range."""
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None]


def _codes(x: np.ndarray, label: np.ndarray, t: Tables) -> np.ndarray:
    """A 32-bit bucket per row and table; label and dimension are part of it."""
    directions, shift = t.directions(x.shape[1])
    steps = np.floor((x @ directions + shift) / t.width).astype(np.int64).view(np.uint64).reshape(len(x), t.tables, t.projections)
    code = splitmix(label.view(np.uint64) + np.uint64(x.shape[1]))[:, None] + np.arange(t.tables, dtype=np.uint64)
    for k in range(t.projections):
        code = splitmix(code * np.uint64(31) + steps[:, :, k])
    return (code >> np.uint64(32)).astype(np.uint32)


def _pieces(at: np.ndarray, n: int = 1024) -> list[np.ndarray]:
    return [at[k : k + n] for k in range(0, len(at), n)]


def _hashed(nodes: DataFrame, t: Tables) -> DataFrame:
    """(node, codes, keys): a vector's code in each table, as 4 bytes each, and as keys that name table and code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, vectors = columns(batch, "node", "label", "vector")
            offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(offsets)
            for at in (part for dim in np.unique(sizes) for part in _pieces(np.flatnonzero(sizes == dim))):
                x = flat[offsets[at][:, None] + np.arange(sizes[at[0]])].astype(np.float64)
                codes = _codes(normalised(x), label.to_numpy()[at], t)
                keys = (np.arange(t.tables, dtype=np.int64) << np.int64(32)) | codes.astype(np.int64)
                held = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), t.tables).cast(pa.list_(pa.int64()))
                yield pa.record_batch([node.take(pa.array(at)), pa.array([r.tobytes() for r in codes], pa.binary()), held], names=["node", "codes", "keys"])

    return nodes.mapInArrow(run, "node long, codes binary, keys array<long>")


def _members(nodes: DataFrame, t: Tables) -> DataFrame:
    """A row per vector and bucket that it shares with others: key, node, n (rows of the bucket), label, weight, the codes
    of the tables before this one, and the vector. Buckets are counted before any vector is moved."""
    coded = staged(_hashed(nodes.select("node", "label", "vector"), t), "codes")
    each = coded.select("node", F.explode("keys").alias("key"))
    sizes = staged(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    whole = nodes.select("node", "label", "weight", "vector").join(coded.select("node", "codes"), "node")
    earlier = F.substring("codes", F.lit(1), (F.shiftright("key", 32) * 4).cast("int"))
    return each.join(sizes, "key").join(whole, "node").withColumn("codes", earlier)


def _meet(rows: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): links a-b as a forest per bucket, and with b null the number of vectors that a links to.

    A pair counts in the first table in which it meets; so counts add up, and no pair is ever sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, starts, sizes in whole_buckets(batches):
            node, label, weight, side = (found.column(c).to_numpy() for c in ("node", "label", "weight", "side"))
            codes, vectors = found.column("codes").to_pylist(), found.column("vector").combine_chunks()
            offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            dims = np.diff(offsets)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for g in np.flatnonzero(sizes > 1):
                s = slice(starts[g], starts[g] + sizes[g])
                near = np.zeros((sizes[g], sizes[g]), bool)
                for dim in np.unique(dims[s]):
                    at = np.flatnonzero(dims[s] == dim)
                    x = normalised(flat[offsets[s][at][:, None] + np.arange(dim)].astype(np.float64))
                    near[np.ix_(at, at)] = x @ x.T >= cosine
                near &= label[s][:, None] == label[s][None, :]
                if side[s][0] != 2:
                    near &= side[s][:, None] != side[s][None, :]
                a, b = np.nonzero(np.triu(near, 1))
                if not len(a):
                    continue
                if codes[starts[g]]:
                    earlier = np.frombuffer(b"".join(codes[s]), np.uint32).reshape(sizes[g], -1)
                    before = (earlier[a] == earlier[b]).any(axis=1)
                    a, b = a[~before], b[~before]
                n = np.bincount(a, weight[s][b], sizes[g]) + np.bincount(b, weight[s][a], sizes[g])
                has = np.flatnonzero(n)
                out.append((node[s][has], np.full(len(has), -1), n[has].astype(np.int64)))
                linked = np.zeros_like(near)
                linked[a, b] = linked[b, a] = True
                if pairs := forest(linked):
                    pairs = np.array(pairs)
                    out.append((node[s][pairs[:, 0]], node[s][pairs[:, 1]], np.zeros(len(pairs), np.int64)))
            if out:
                a, b, n = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.record_batch([pa.array(a), pa.array(b, mask=b < 0), pa.array(n)], names=["a", "b", "n"])

    return in_blocks(rows, "node", BLOCK).mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.98, tables: Tables | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row per vector, in no order.

    vectors: vec_id, embedding (array of float or double) and label; other columns are not looked at. Vectors are
    compared where labels are equal and not null and dimensions agree. Vectors that are null, empty or zero or that
    hold a null or a non-finite component link with nothing. Equal vectors are one node with a weight, so copies cost
    a count. A null vec_id is never the smallest; it is kept if nothing it links to has an id. Repeated rows are
    copies of each other. An empty table gives an empty result.
    """
    t, before = tables or Tables(), staged_folders()
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(
        "vec_id",
        F.coalesce(usable & F.col("label").isNotNull(), F.lit(False)).alias("usable"),
        F.xxhash64(F.col("label")).alias("label"),
        F.col("embedding").alias("vector"),
        F.xxhash64("embedding").alias("h"),
        F.hash("embedding").alias("g"),
    )
    classes = rows.filter("usable").groupBy("label", "h", "g").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low"))
    nodes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = staged(_meet(_members(nodes, t), cosine), "meetings")
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    label = components(found.filter("b is not null").select("a", "b"))
    named = nodes.select("node", "label", "h", "g", "weight", "low").join(counts, "node", "left").join(label, "node", "left")
    named = staged(named.withColumn("component", F.coalesce("component", "node")), "labels")
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(low, "component").select(
        F.lit(True).alias("usable"), "label", "h", "g", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    named = last_staged(named, "components", before)
    out = rows.select("vec_id", "usable", "label", "h", "g").join(named, ["usable", "label", "h", "g"], "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )


#: All pairs of equal label, at cosine 0.98; for tables on which hashing misses none.
SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings where label is not null and embedding is not null),
u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) n from v where list_dot_product(e, e) > 0),
l as (select a.vec_id x, b.vec_id y from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach as (select vec_id x, vec_id y from embeddings union select reach.x, l.y from reach join l on reach.y = l.x),
c as (select x, min(y) component_id from reach group by x)
select vec_id, cast((select count(*) from l where l.x = vec_id) as bigint) n_links, component_id, vec_id = component_id kept
from embeddings join c on vec_id = c.x
"""
