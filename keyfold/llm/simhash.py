"""SimHash near-duplicates, linked through the generalised pigeonhole principle.

The 64 bits are divided into parts. If two fingerprints differ in at most t bits, some part i differs in at most t_i
bits, for any thresholds of which the sum of (t_i + 1) is t + 1; a part with threshold -1 is not looked at. Correlated
bits share a part, so that parts differ in how selective they are, and thresholds are then allocated to parts by
dynamic programming on the numbers of candidates they are estimated to give. Candidates are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyfold.llm.shared import columns, components, in_blocks, last_staged, splitmix, staged, staged_folders, unwrapped, utf8, whole_buckets, wrapped

BITS = 64
#: Shingles counted at a time, so that a very long text needs no more memory than a short one.
CHUNK = 1 << 15
#: Rows of a bucket that meet in one task; a larger bucket is cut into blocks, and each pair of blocks is a task's work.
BLOCK = 2048
#: Buckets of up to so many rows are compared side by side.
SMALL = 8
#: Time to make and move one probe row over the time to compare two fingerprints and to bring them to each other.
ROW_COST = 64.0
#: The same where disk is short: a row of every print lies in the shuffle before anything is compared.
LEAN_ROW_COST = 1024.0
#: Cells of the matrix by which a bucket is compared, at a time.
CELLS = 1 << 18


def fingerprint(text: bytes, shingle: int, prints: int = 1) -> np.ndarray:
    """Bit b is 1 if it is set in over half the XXH64 values of the shingles; 0 for a text without words.

    Further prints are of the same values, spread anew: near texts that one print parts, another may not.
    """
    words = text.lower().split()  # of bytes: A-Z only, and the six white-space characters
    if not words:
        return np.zeros(prints, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    ones = np.zeros((prints, BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : min(n, k + CHUNK)].tolist(), last[k : k + CHUNK].tolist(), strict=False)], np.uint64)
        for r in range(prints):
            x = splitmix(h + np.uint64(r)) if r else h
            ones[r] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, *, shingle: int = 5, prints: int = 1) -> DataFrame:
    """(doc_id, t, fp: bigint, fp1 ...), t being a hash of the text. Null texts count as texts without words."""
    names = ["doc_id", "t", "fp", *(f"fp{r}" for r in range(1, prints))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t, texts = columns(batch, "doc_id", "t", "text")
            fps = np.array([fingerprint(x, shingle, prints) for x in utf8(texts)], np.uint64).reshape(-1, prints).view(np.int64)
            yield pa.record_batch([ids, t, *(pa.array(c.copy()) for c in fps.T)], names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("t"), "text")
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


@dataclass(frozen=True)
class Parts:
    """Bit masks and the threshold of each part; rows that a bucket may have before it is cut."""

    masks: tuple[int, ...]
    thresholds: tuple[int, ...]
    block: int = 0


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how often bits i and j are both set; summed in tasks, 4,097 numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        yield pa.record_batch([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n))], names=["i", "v"])

    found = np.zeros(BITS * BITS + 1)
    for i, v in fps.select("fp").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v")).collect():
        found[i] = v
    return int(found[-1]), found[:-1].reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of nearly equal size; each begins with the strongest pair left and takes the bit that fits best."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(strength, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        first = max(left, key=lambda i: strength[i, left].max())
        group = [first]
        left.remove(first)
        while len(group) < size:
            group.append(max(left, key=lambda i: strength[i, group].sum()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def variants(width: int, threshold: int) -> int:
    """Rows that a fingerprint sends for a part: its own value, and half of all values at a distance up to the threshold."""
    return 1 + sum(comb(width, e) for e in range(1, threshold + 1)) // 2


def near_share(agree: list[float], threshold: int) -> float:
    """Pairs that differ in at most ``threshold`` bits over those that differ in none, were bits independent."""
    poly = [1.0] + [0.0] * threshold
    for a in agree:
        poly = [poly[e] * a + (poly[e - 1] * (1 - a) if e else 0.0) for e in range(threshold + 1)]
    return sum(poly) / max(poly[0], 1e-300)


def allocate(cost: list[list[float]], distance: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds of least cost whose (t_i + 1) sum to distance + 1; ``cost[i][s]`` is part i's cost at t_i = s - 1."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for part in cost:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (c, ts) in best.items():
            for s, more in enumerate(part):
                if used + s <= distance + 1 and (used + s not in step or c + more < step[used + s][0]):
                    step[used + s] = (c + more, (*ts, s - 1))
        best = step
    return best[distance + 1]


def plan(fps: DataFrame, distance: int, choices: tuple[int, ...] = (2, 3, 4, 5, 6, 8), row_cost: float = ROW_COST) -> Parts:
    """Parts and thresholds from counts over all fingerprints: pairs equal in a part, and how far bits agree.

    A block takes four buckets of mean size: as the corpus grows buckets do, and rows of a bucket that is cut are sent
    once for each of its blocks.
    """
    n, both = bit_counts(fps)
    choices = tuple(m for m in choices if m <= distance + 1 <= m * (min(distance, 3) + 1))
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    groups = {(m, k): g for m in choices for k, g in enumerate(correlated_groups(n, both, m))}
    masks = {mk: sum(1 << b for b in g) for mk, g in groups.items()}
    signed = {mk: m - (1 << 64) if m >> 63 else m for mk, m in masks.items()}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(v)).alias("v")) for (m, k), v in signed.items()))).alias("e")
    counted = fps.select(each).groupBy("e.m", "e.k", "e.v").agg(F.count(F.lit(1)).alias("c"))
    equal = {(r[0], r[1]): float(r[2]) for r in counted.groupBy("m", "k").agg(F.sum(F.col("c") * (F.col("c") - 1.0) / 2)).collect()}
    best = None
    for m in choices:
        cost = []
        for k in range(m):
            g = groups[m, k]
            each_t = [row_cost * n * variants(len(g), t) + max(equal.get((m, k), 0.0), n * n / 2.0 ** (len(g) + 1)) * near_share([agree[b] for b in g], t) for t in range(min(distance, 3) + 1)]
            cost.append([0.0, *each_t])
        found = allocate(cost, distance)
        if best is None or found[0] < best[0]:
            best = (*found, tuple(masks[m, k] for k in range(m)))
    mean = max(n * variants(w, t) / 2.0**w for w, t in ((m.bit_count(), t) for m, t in zip(best[2], best[1], strict=True)) if t >= 0)
    return Parts(best[2], best[1], int(4 * mean))


def probes(fps: DataFrame, parts: Parts) -> DataFrame:
    """(key, fp, node, probe): each fingerprint under its own value of each part, and under values near it.

    Of two values that differ, the one with the lowest differing bit unset probes; so each pair meets once per part.
    Columns ``of``, ``size`` and ``bits`` come along.
    """
    more = [c for c in ("of", "size", "bits") if c in fps.columns]
    work = [(i, m, t) for i, (m, t) in enumerate(zip(parts.masks, parts.thresholds, strict=True)) if t >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, *along = (bit_rows(c) if pa.types.is_binary(c.type) else c.to_numpy() for c in batch.columns)
            fp = fp.view(np.uint64)
            for i, mask, threshold in work:
                salt = np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)
                own = fp & np.uint64(mask)
                bits = [b for b in range(BITS) if mask >> b & 1]
                sets = [s for e in range(threshold + 1) for s in combinations(bits, e)]
                for s in sets:
                    who = own >> np.uint64(s[0]) & np.uint64(1) == 0 if s else slice(None)
                    key = splitmix((own[who] ^ np.uint64(sum(1 << b for b in s))) + salt)
                    values = (key.view(np.int64), fp[who].view(np.int64), *(c[who] for c in along), np.full(len(key), bool(s)))
                    yield pa.record_batch([bit_column(v) if v.ndim == 2 else pa.array(v) for v in values], names=["key", "fp", "node", *more, "probe"])

    kinds = ", ".join(f"{c} {'binary' if c == 'bits' else 'long'}" for c in ("key", "fp", "node", *more))
    return fps.select("fp", "node", *more).mapInArrow(run, f"{kinds}, probe boolean")


def nearest_forest(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> list[int]:
    """Pairs (by number) of a spanning forest of least distances: at any threshold it connects what all pairs connect."""
    root, found = np.arange(n), []
    for distance in np.unique(far):
        at = np.flatnonzero((far == distance) & (root[a] != root[b]))
        parent = {}

        def top(i: int, parent: dict[int, int] = parent) -> int:
            while i in parent:
                if parent[i] in parent:
                    parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for k, i, j in zip(at.tolist(), root[a[at]].tolist(), root[b[at]].tolist(), strict=True):
            i, j = top(i), top(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
                found.append(k)
        if parent:
            moved = np.array(list(parent))
            to = np.arange(n)
            to[moved] = [top(i) for i in parent]
            root = to[root]
    return found


def bit_rows(column: pa.Array) -> np.ndarray:
    """A column of bitmaps of equal length, a row each."""
    held = b"".join(column.to_pylist())
    return np.frombuffer(held, np.uint64).reshape(len(column), -1)


def bit_column(rows: np.ndarray) -> pa.Array:
    """The inverse of ``bit_rows``."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def may_be_similar(size: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """False only for pairs whose sets can't have the similarity: an element of one set alone turns one parity bit at most."""
    found = np.empty(len(a), bool)
    for k in range(0, len(a), CELLS // 8):
        i, j = a[k : k + CELLS // 8], b[k : k + CELLS // 8]
        alone = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        total = size[i] + size[j]
        found[k : k + len(i)] = np.maximum(alone, np.abs(size[i] - size[j])) <= total * ((1 - similarity) / (1 + similarity) + 1e-9)
    return found


def _bucket_pairs(fp: np.ndarray, probe: np.ndarray, side: np.ndarray, distance: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in one bucket and their bits; with ``of``, those of different groups. Own values meet all, some rows of the matrix at a time."""
    own, pairs = np.flatnonzero(~probe), []
    step = max(1, CELLS // len(fp))
    for k in range(0, len(own), step):
        rows = own[k : k + step]
        far = np.bitwise_count(fp[rows][:, None] ^ fp[None, :])
        i, b = np.nonzero(far <= distance)
        a = rows[i]
        use = (probe[b] | (a < b)) & ((side[0] == 2) | (side[a] != side[b]))
        if of is not None:
            use &= of[a] != of[b]
        pairs.append((a[use], b[use], far[i[use], b[use]]))
    a, b, far = (np.concatenate(x) for x in zip(*pairs, strict=True))
    return a, b, far


def _bucket_links(fp: np.ndarray, probe: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in one bucket as a forest: fewer than its members."""
    a, b, far = _bucket_pairs(fp, probe, side, distance)
    chosen = nearest_forest(len(fp), a, b, far)
    return a[chosen], b[chosen]


def links(fps: DataFrame, parts: Parts, distance: int) -> DataFrame:
    """(a, b, far): nodes a < b that connect (fp, node) rows just as all pairs within ``distance`` bits do; far: their bits.

    Fingerprints are distinct.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, sizes in whole_buckets(batches):
            yield _linked(rows, starts, sizes, distance)

    return in_blocks(probes(fps, parts), "fp", max(BLOCK, parts.block)).mapInArrow(run, "a long, b long, far int").distinct()


def _side_by_side(fp: np.ndarray, probe: np.ndarray, side: np.ndarray, sizes: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """All pairs in the buckets of up to SMALL rows."""
    left, right = [], []
    group = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.repeat(sizes <= SMALL, sizes)
    for k in range(1, min(SMALL, len(fp))):
        here = np.flatnonzero(inside[:-k] & (group[:-k] == group[k:]))
        there = here + k
        ok = (np.bitwise_count(fp[here] ^ fp[there]) <= distance) & ~(probe[here] & probe[there])
        ok &= (side[here] == 2) | (side[here] != side[there])
        left.append(here[ok])
        right.append(there[ok])
    return left, right


def _linked(rows: pa.Table, starts: np.ndarray, sizes: np.ndarray, distance: int) -> pa.RecordBatch:
    """Small buckets are compared side by side for a whole batch, larger ones each by a matrix."""
    fp, side = rows.column("fp").to_numpy().view(np.uint64), rows.column("side").to_numpy()
    probe, node = rows.column("probe").to_numpy(), rows.column("node").to_numpy()
    left, right = _side_by_side(fp, probe, side, sizes, distance)
    for g in np.flatnonzero(sizes > SMALL):
        s = slice(starts[g], starts[g] + sizes[g])
        if not probe[s].all():
            a, b = _bucket_links(fp[s], probe[s], side[s], distance)
            left.append(a + starts[g])
            right.append(b + starts[g])
    i, j = (np.concatenate(x or [np.empty(0, np.int64)]).astype(np.int64) for x in (left, right))
    a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    return pa.record_batch([pa.array(a), pa.array(b), pa.array(np.bitwise_count(fp[i] ^ fp[j]).astype(np.int32))], names=["a", "b", "far"])


def links_between(fps: DataFrame, parts: Parts, distance: int, turn: int | None, similarity: float) -> DataFrame:
    """(a, b, of_a, of_b, partly): nodes a < b within ``distance`` bits that are of different groups, ``of``.

    fps: (fp, node, of, size, bits), the last two of the shingle set; pairs whose sets can't be similar are left out.
    All other pairs where ``turn`` is None. Else a bucket with more than MANY pairs a row sends a forest over its groups,
    another one each turn, and these links are ``partly`` what there is. Fingerprints may repeat.
    """
    many = MANY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, sizes in whole_buckets(batches):
            yield _linked_between(rows, starts, sizes, distance, turn, many, similarity)

    return in_blocks(probes(fps, parts), "node", max(BLOCK, parts.block)).mapInArrow(run, "a long, b long, of_a long, of_b long, partly boolean")


def _linked_between(rows: pa.Table, starts: np.ndarray, sizes: np.ndarray, distance: int, turn: int | None, many: int, similarity: float) -> pa.RecordBatch:
    fp, side = rows.column("fp").to_numpy().view(np.uint64), rows.column("side").to_numpy()
    probe, node, of, size = (rows.column(c).to_numpy() for c in ("probe", "node", "of", "size"))
    bits = bit_rows(rows.column("bits"))
    left, right = [], []
    for a, b in zip(*_side_by_side(fp, probe, side, sizes, distance), strict=True):
        use = of[a] != of[b]
        a, b = a[use], b[use]
        use = may_be_similar(size, bits, a, b, similarity)
        left.append(a[use])
        right.append(b[use])
    partly = [np.zeros(len(x), bool) for x in left]
    for g in np.flatnonzero(sizes > SMALL):
        s = slice(starts[g], starts[g] + sizes[g])
        if probe[s].all():
            continue
        a, b, _ = _bucket_pairs(fp[s], probe[s], side[s], distance, of[s])
        use = may_be_similar(size[s], bits[s], a, b, similarity)
        a, b = a[use], b[use]
        if cut := turn is not None and len(a) > many * sizes[g]:
            names, group = np.unique(of[s], return_inverse=True)
            mixed = splitmix(np.minimum(node[s][a], node[s][b]).view(np.uint64) * np.uint64(31) + np.maximum(node[s][a], node[s][b]).view(np.uint64) + np.uint64(turn))
            chosen = nearest_forest(len(names), group[a], group[b], mixed % np.uint64(64))
            a, b = a[chosen], b[chosen]
        left.append(a + starts[g])
        right.append(b + starts[g])
        partly.append(np.full(len(a), cut))
    i, j = (np.concatenate(x or [np.empty(0, np.int64)]).astype(np.int64) for x in (left, right))
    partly = np.concatenate(partly or [np.empty(0, bool)])
    turned = node[i] > node[j]
    i, j = np.where(turned, j, i), np.where(turned, i, j)
    return pa.record_batch([pa.array(x) for x in (node[i], node[j], of[i], of[j], partly)], names=["a", "b", "of_a", "of_b", "partly"])


#: Parity bits of a shingle set.
PARITY = 1024
#: Pairs a row from which on a bucket's pairs between groups are not all sent at once.
MANY = 4
#: Share of a turn's links that hold, below which all pairs left are looked at.
WORTH = 0.1
#: Links of up to so many bits are taken as they are where texts are compared: none, as prints may be equal where texts are not.
SURE = -1
#: Links of up to so many bits are followed first; of the others, only those between groups are looked at.
NEARER = 6


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, s, size, bits): the set of 32-bit hashes of a text's shingles, their number and the parity of those of each low PARITY bits."""

    def shingles(text: bytes) -> np.ndarray:
        words = text.lower().split()
        n = max(1, len(words) - shingle + 1) if words else 0
        return np.unique(np.fromiter((xxhash.xxh32_intdigest(b" ".join(words[i : i + shingle])) for i in range(n)), np.uint32, n)).view(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = columns(batch, "node", "text")
            sets = [shingles(t) for t in utf8(texts)]
            odd = np.array([np.packbits(np.bincount(s & (PARITY - 1), minlength=PARITY) & 1) for s in sets], np.uint8).reshape(len(sets), PARITY // 8)
            size = pa.array([len(s) for s in sets], pa.int64())
            yield pa.record_batch([nodes, pa.array(sets, pa.list_(pa.int32())), size, bit_column(odd.view(np.uint64))], names=["node", "s", "size", "bits"])

    return docs.select("node", "text").mapInArrow(run, "node long, s array<int>, size long, bits binary")


def node_links(nodes: DataFrame, fp: str, distance: int) -> tuple[DataFrame, Parts]:
    """(a, b, far): nodes whose fingerprints in column ``fp`` are near, connected as in ``links``; equal ones meet at one. And the parts."""
    before = staged_folders()
    own = staged(nodes.groupBy(F.col(fp).alias("fp")).agg(F.min("node").alias("node")), "prints")
    parts = plan(own, distance, row_cost=LEAN_ROW_COST)
    found = links(own, parts, distance)
    equal = nodes.select(F.col(fp).alias("fp"), F.col("node").alias("b")).join(own, "fp").filter("node <> b")
    # written for each print, so that the rows of one print at a time lie in the shuffle
    return last_staged(found.unionByName(equal.select(F.col("node").alias("a"), "b", F.lit(0).alias("far"))), "near", before), parts


def texts_of(edges: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, s): shingle sets of nodes with a link; a node has one text, and its first document stands for it."""
    needed = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    needed = staged(needed.select("node", F.col("first.doc_id").alias("_id"), F.col("first.t").alias("_t")), "needed")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.coalesce(F.xxhash64("text"), F.lit(0)) == F.col("_t"))
    texts = docs.select("doc_id", "text").join(needed.hint("merge"), same)
    return staged(_shingle_sets(texts.select("node", "text"), shingle).dropDuplicates(["node"]), "shingles")


def similar_links(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those links, a and b, whose texts' shingle sets have ``similarity`` of their union in common."""
    x, y = (sets.select(F.col("node").alias(end), F.col("s").alias(s)) for end, s in (("a", "x"), ("b", "y")))
    both = edges.join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("x", "y"))
    kept = both.filter(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common))
    return staged(kept.select(*edges.columns), "similar")


def open_nodes(reach: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, of): nodes, and their groups, where what links reach is more than one group."""
    held = reach.withColumnRenamed("component", "reach").join(groups, "node", "left").select("node", "reach", F.coalesce("component", "node").alias("of"))
    several = held.groupBy("reach").agg(F.min("of").alias("least"), F.max("of").alias("most")).filter("least <> most")
    return held.join(several.select("reach"), "reach", "left_semi").select("node", "of")


def between(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges whose ends are of different groups, with these as ``of_a`` and ``of_b``; a node without a group is its own."""
    for end in ("a", "b"):
        edges = edges.join(groups.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    return edges.filter("of_a <> of_b")


def regrouped(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Groups (node, component) after ``pairs`` (of_a, of_b) of them have been joined: only pairs of groups are followed."""
    label = components(pairs.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    moved = groups.join(label.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    alone = label.join(groups, "node", "left_anti").select("node", "component")
    return staged(moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(alone), "groups")


def similar_groups(edges: DataFrame, nodes: DataFrame, docs: DataFrame, *, parts: dict[str, Parts], distance: int, shingle: int, similarity: float) -> DataFrame:
    """(node, component) under all pairs within ``distance`` bits in a print whose texts have the similarity.

    The forest of nearest links is checked first; in a large group most long links join what short ones have joined.
    A link that fails may have stood for one that holds, so pairs between groups are then sent until all are checked.
    """
    edges = staged(edges.groupBy("a", "b").agg(F.min("far").alias("far")), "links")
    sets = texts_of(edges, nodes, docs, shingle)
    near = edges.filter(F.col("far") <= NEARER)
    held = similar_links(near, sets, similarity)
    groups = staged(components(held.select("a", "b")), "groups")
    failed = near.join(held.select("a", "b"), ["a", "b"], "left_anti")
    tried = staged(between(failed.unionByName(edges.filter(F.col("far") > NEARER)), groups), "across")
    groups = regrouped(groups, similar_links(tried.filter(F.col("far") > NEARER), sets, similarity))
    open_ = staged(between(tried.select("a", "b"), groups).select("of_a", "of_b").distinct(), "open")
    if open_.isEmpty():
        return groups
    reach = components(open_.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).select(F.col("node").alias("of"), F.col("component").alias("reach"))
    own = nodes.select("node").join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("of"))
    reach = staged(own.join(reach, "of").select("node", F.col("reach").alias("component")), "reach")
    checked, turn = edges.select("a", "b"), 0
    while True:
        left = nodes.join(open_nodes(reach, groups), "node").join(sets.select("node", "size", "bits"), "node")
        left = staged(left.select("node", "of", "size", "bits", *parts), "open")
        if left.isEmpty():
            return groups
        found = None
        for fp, p in parts.items():
            more = staged(links_between(left.select(F.col(fp).alias("fp"), "node", "of", "size", "bits"), p, distance, turn, similarity).groupBy("a", "b", "of_a", "of_b").agg(F.max("partly").alias("partly")), "between")
            found = more if found is None else found.unionByName(more)
        found = staged(found.groupBy("a", "b", "of_a", "of_b").agg(F.max("partly").alias("partly")), "between")
        new = staged(found.drop("partly").join(checked, ["a", "b"], "left_anti"), "unchecked")
        held = similar_links(new, sets, similarity)
        n_new, n_held = new.count(), held.count()
        if n_held:
            groups = regrouped(groups, held)
        if found.filter("partly").isEmpty():
            return groups
        checked = checked.unionByName(new.select("a", "b"))
        turn = turn + 1 if turn is not None and n_held > WORTH * n_new else None


def near_duplicates(docs: DataFrame, *, shingle: int = 5, distance: int = 10, prints: int = 3, similarity: float | None = 0.8) -> DataFrame:
    """(doc_id, t, fp, component_id, kept): a row per document; component_id is the smallest doc_id that links reach.

    docs: doc_id and text; other columns are not looked at. t: a hash of the text. Texts are linked if any of their
    ``prints`` fingerprints are at ``distance`` bits or fewer; with ``similarity``, links are then checked on the
    texts' shingle sets, whatever their bits. Equal texts are one node of the graph (without ``similarity``, texts with
    equal fingerprints are), so copies cost a count. Texts that are null, empty or without words have fingerprint 0 and
    are linked like any other; no shingles are as similar as can be to no shingles. kept: true for a group's first
    row by doc_id (null last), then text; rows equal in both are first together. A null doc_id is never the smallest; a
    group with no other has a null component_id. Rows repeat as given. An empty table gives an empty result.
    """
    rows = staged(fingerprints(docs, shingle=shingle, prints=prints), "fingerprints")
    before = staged_folders()
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")
    fps = ["fp", *(f"fp{r}" for r in range(1, prints))]
    same = fps if similarity is None else [*fps, "t"]
    nodes = rows.groupBy(*same).agg(F.min(place).alias("first"))
    nodes = staged(nodes.withColumn("node", F.col("fp") if same == ["fp"] else F.monotonically_increasing_id()), "nodes")
    if nodes.isEmpty():
        return rows.select("doc_id", "t", "fp", F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept"))
    if same == ["fp"]:
        parts = {"fp": plan(nodes, distance)}
        found = links(nodes, parts["fp"], distance)
    else:
        found, parts = None, {}
        for fp in fps:
            more, parts[fp] = node_links(nodes, fp, distance)
            found = more if found is None else found.unionByName(more)
    if similarity is None:
        label = components(found.select("a", "b"))
    else:
        label = similar_groups(found, nodes, docs, parts=parts, distance=distance, shingle=shingle, similarity=similarity)
    label = label.withColumnRenamed("node", "of")
    named = staged(nodes.join(label, F.col("node") == F.col("of"), "left").select(*same, "first", F.coalesce("component", "node").alias("component")), "labels")
    first = named.groupBy("component").agg(F.min("first").alias("first"))
    named = last_staged(named.drop("first").join(first, "component").select(*same, "first"), "components", before)
    return rows.join(named, same).select("doc_id", "t", "fp", F.col("first.doc_id").alias("component_id"), (place == F.col("first")).alias("kept"))


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, all columns as they are."""
    before = staged_folders()
    kept = near_duplicates(docs, **options).filter("kept").select("doc_id", "t").distinct()
    key = lambda t: (F.xxhash64(F.lit(1), F.col("doc_id").cast("bigint"), t).alias("k"), F.hash(F.lit(1), F.col("doc_id").cast("bigint"), t).alias("g"))
    kept = last_staged(kept.select(*key(F.col("t"))), "kept", before)
    keyed = wrapped(docs, "doc_id", "text").select("row", *key(F.coalesce(F.xxhash64("text"), F.lit(0))))
    first = F.row_number().over(Window.partitionBy("k", "g").orderBy(F.lit(1)))  # of rows equal in id and text
    out = keyed.join(kept.hint("merge"), ["k", "g"], "left_semi").withColumn("n", first).filter("n = 1")
    return out.select(*unwrapped(out))
