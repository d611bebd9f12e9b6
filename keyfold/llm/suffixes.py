"""Suffix-array dedup: every byte covered by a string of ``length`` bytes that also starts elsewhere is removed.

Sampled suffixes are sorted with their common prefixes, and the order of the suffixes before them is induced from
theirs, as in external induced sorting. What is sampled depends on content alone: of all places where a string of
``length`` bytes may hold an anchor (the hash of ANCHOR bytes), the smallest anchor is taken. Equal strings so have
equal anchors at equal places, and each string belongs to exactly one anchor.

1. Each anchor's context (the bytes of all strings that belong to it) is counted over the corpus. A context found
   twice is repeated as a whole; an anchor found once repeats nothing. Most of the corpus is settled here.
2. Where one anchor has several contexts, Spark's external sort brings them to shards by anchor, sorted on disk. A shard
   is read anchor by anchor; its anchors' suffixes are sorted, and suffix tuples with their common prefixes are carried
   backwards one byte at a time: sorted by that byte and by the order so far, which is the queue's next content. Two
   strings are equal where neighbours share ``length`` bytes.
3. An anchor with more contexts than a shard should hold is split by its strings: digests of what CELL neighbouring
   strings have in common, and of all they hold, are counted, and single strings only where these leave it open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.shared import columns, last_staged, splitmix, staged, staged_folders, utf8

#: Bytes in an anchor; string starts looked at together (they fit a cache); contexts sorted together; contexts that one
#: anchor may bring to a shard (twice the fair share of a shuffle partition, but inside these bounds); strings of an
#: anchor with more that are counted together.
ANCHOR, STARTS, SHARD, HOT = 32, 1 << 16, 16_384, (512, 32_768)
CELL = 16
#: Documents whose remaining texts are made together.
ROWS = 512
_PLACE = (1 << 24) - 1


def anchors_of(text: np.ndarray) -> np.ndarray:
    """Spread hashes of the ANCHOR bytes at each place."""
    h, factor = text.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15
    step = 1
    while step < ANCHOR:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor % 2**64
        step *= 2
    return splitmix(h)


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each place, where in the ``width`` places from it the least hash (its upper 40 bits) is first."""
    n = len(h) - width + 1
    key = (h & ~np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[: len(key)] = key
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(_PLACE)).astype(np.int64)


def runs_of(text: np.ndarray, offsets: np.ndarray, length: int) -> list[np.ndarray]:
    """(document, first start, last start, anchor's place, anchor): strings of ``length`` bytes by document and anchor.

    ``offsets`` bounds the documents inside ``text``; places count from their beginning of ``text``.
    """
    width, found = length - ANCHOR + 1, [[np.empty(0, t)] for t in (np.int64, np.int64, np.int64, np.int64, np.uint64)]
    for c in range(0, max(0, len(text) - length + 1), STARTS):
        here = _starts_inside(offsets, c, min(c + STARTS, len(text) - length + 1), length)
        if not here.any():
            continue
        part = text[c : c + len(here) + length - 1]
        h = anchors_of(part)
        place = least_places(h, width)
        starts = np.flatnonzero(here)
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(starts) > 1) | (place[starts[1:]] != place[starts[:-1]])  # documents are apart by length - 1
        lo = starts[new]
        hi = starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]
        p = place[lo]
        for column, more in zip(found, (np.searchsorted(offsets, lo + c, side="right") - 1, lo + c, hi + c, p + c, h[p]), strict=True):
            column.append(more)
    return [np.concatenate(column) for column in found]


def _starts_inside(offsets: np.ndarray, lo: int, hi: int, length: int) -> np.ndarray:
    """For places lo to hi, whether a string of ``length`` bytes starts there and ends in the same document."""
    first, last = int(np.searchsorted(offsets, lo, side="right")) - 1, int(np.searchsorted(offsets, hi, side="left"))
    begin = np.clip(offsets[first:last], lo, hi) - lo
    end = np.clip(offsets[first + 1 : last + 1] - length + 1, lo, hi) - lo
    use, steps = end > begin, np.zeros(hi - lo + 1, np.int8)
    np.add.at(steps, begin[use], 1)
    np.add.at(steps, end[use], -1)
    return np.cumsum(steps[:-1], dtype=np.int8) > 0


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch one after the other, and their bounds; null is empty."""
    texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()).fill_null(b"")
    _, bounds, data = texts.buffers()
    offsets = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _digest(raw: memoryview, lo: int, hi: int, place: int) -> bytes:
    """Of the context's bytes and of where in it the anchor is."""
    return xxhash.xxh3_128_digest(raw[lo:hi], seed=place)


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """(k, g, lo, hi, p, h, x, y, n): per document and context its first and last string, anchor, digest and count.

    A context found more than once in a document is repeated; it comes once with its count, and what its occurrences
    cover comes in rows without an anchor.
    """
    names = ["k", "g", "lo", "hi", "p", "h", "x", "y", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, offsets = _texts(batch)
            k, g = (c.to_numpy() for c in columns(batch, "k", "g"))
            raw = memoryview(text)
            doc, lo, hi, place, h = runs_of(text, offsets, length)
            marks = [_digest(raw, a, b + length, p - a) for a, b, p in zip(lo.tolist(), hi.tolist(), place.tolist(), strict=True)]
            xy = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
            order = np.lexsort((lo, xy[:, 1], xy[:, 0], doc))
            same = np.zeros(len(order), bool)
            same[1:] = (doc[order][1:] == doc[order][:-1]) & (xy[order][1:] == xy[order][:-1]).all(axis=1)
            head = np.flatnonzero(~same)
            n = np.diff(np.append(head, len(order)))
            at = order[head]
            base = offsets[doc]
            yield _rows(names, k[doc[at]], g[doc[at]], (lo - base)[at], (hi - base)[at], (place - base)[at], h[at].view(np.int64), xy[at, 0], xy[at, 1], n)
            twice = np.sort(order[np.repeat(n > 1, n)])
            if len(twice):
                end, begin = (hi - base)[twice], (lo - base)[twice]
                new = np.ones(len(twice), bool)
                new[1:] = (doc[twice][1:] != doc[twice][:-1]) | (begin[1:] > end[:-1] + length)
                last = np.append(np.flatnonzero(new)[1:], len(twice)) - 1
                none = np.zeros(new.sum(), np.int64)
                yield _rows(names, k[doc[twice]][new], g[doc[twice]][new], begin[new], end[last], none, none, none, none, none)

    return docs.select("k", "g", "text").mapInArrow(run, "k long, g int, lo long, hi long, p long, h long, x long, y long, n long")


def _rows(names: list[str], *values: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.ascontiguousarray(v)) for v in values], names=names)


def contexts(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(h, x, y, place of the anchor, hot, context): the bytes of contexts found at ``places`` (k, g, lo, hi, p, h, x, y, hot)."""
    kinds = {"h": pa.int64(), "x": pa.int64(), "y": pa.int64(), "place": pa.int64(), "hot": pa.bool_(), "context": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, at in zip(utf8(batch.column(batch.schema.get_field_index("text"))), columns(batch, "at")[0], strict=True):
                lo, hi, p, h, x, y, hot = (at.values.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "p", "h", "x", "y", "hot"))
                for k in range(0, len(lo), 4096):
                    s = slice(k, k + 4096)
                    body = [text[a : b + length] for a, b in zip(lo[s].tolist(), hi[s].tolist(), strict=True)]
                    yield pa.record_batch([pa.array(v, t) for v, t in zip((h[s], x[s], y[s], (p - lo)[s], hot[s], body), kinds.values(), strict=True)], names=list(kinds))

    per_doc = places.groupBy("k", "g").agg(F.collect_list(F.struct("lo", "hi", "p", "h", "x", "y", "hot")).alias("at"))
    found = docs.join(per_doc.hint("merge"), ["k", "g"]).select("text", "at")
    return found.mapInArrow(run, "h long, x long, y long, place long, hot boolean, context binary")


_CONTEXT = ["h", "x", "y", "place", "context"]


def induced(place: list[int], context: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(item, d): strings that start d bytes before an item's anchor and that another item has too.

    Suffixes that begin at anchors are sorted, with the bytes that neighbours share. Then, byte by byte backwards,
    suffixes are sorted by their first byte and the order of what follows it; neighbours that begin alike share one
    byte more than the least of what was shared between them. Items that share no anchor with a neighbour are done.
    """
    n = len(context)
    right = [c[p:] for c, p in zip(context, place, strict=True)]
    order = np.array(sorted(range(n), key=right.__getitem__), np.int64)
    width = max(map(len, right))
    matrix = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in right), np.uint8).reshape(n, width)[order]
    sizes = np.fromiter(map(len, right), np.int64, n)[order]
    shared = np.zeros(n, np.int64)
    if n > 1:
        differ = matrix[1:] != matrix[:-1]
        shared[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), np.minimum(sizes[1:], sizes[:-1]))
    most = max(place)
    left = np.zeros((n, most), np.uint8)  # column d - 1: the byte d places before the anchor
    for i, (c, p) in enumerate(zip(context, place, strict=True)):
        left[i, :p] = np.frombuffer(c, np.uint8, p)[::-1]
    reach = np.array(place)
    items, depths = [], []
    for d in range(most + 1):
        near = np.maximum(shared, np.append(shared[1:], 0))
        found = order[near >= length]
        items.append(found)
        depths.append(np.full(len(found), d))
        at = np.flatnonzero((near >= ANCHOR + d) & (reach[order] > d))
        if d == most or len(at) < 2:
            break
        byte = left[order[at], d]
        at = at[np.argsort(byte, kind="stable")]
        byte = left[order[at], d]
        alike = byte[1:] == byte[:-1]
        shared = np.append(0, np.where(alike, 1 + _least_between(shared, at), 0))
        order = order[at]
    return np.concatenate(items), np.concatenate(depths)


def _least_between(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least of values[i + 1 .. j] for neighbours i < j in ``at``; where i >= j, anything."""
    lo, hi = at[:-1] + 1, at[1:] + 1
    span = np.maximum(hi - lo, 1)
    level = np.frexp(span.astype(np.float64))[1] - 1  # the largest power of two that is not above the span
    out = np.empty(len(span), np.int64)
    table = values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        here = np.flatnonzero(level == k)
        if len(here):
            a = np.minimum(lo[here], len(table) - 1)
            out[here] = np.minimum(table[a], table[np.clip(hi[here] - (1 << k), 0, len(table) - 1)])
    return out


def _sorted_shards(found: DataFrame, length: int) -> DataFrame:
    """(h, x, y, near, far): runs of repeated strings of contexts, by how far before the anchor they start."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[int], list[bytes]]]:
        keys, places, bodies = [], [], []
        for batch in batches:
            for h, x, y, place, body in zip(*(c.to_pylist() for c in columns(batch, "h", "x", "y", "place", "context")), strict=True):
                if keys and keys[-1] == (h, x, y):
                    continue  # the same context from another task
                if len(keys) >= SHARD and keys[-1][0] != h:
                    yield keys, places, bodies
                    keys, places, bodies = [], [], []
                keys.append((h, x, y))
                places.append(place)
                bodies.append(body)
        if keys:
            yield keys, places, bodies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, places, bodies in shards(batches):
            item, d = induced(places, bodies, length)
            order = np.lexsort((d, item))
            item, d = item[order], d[order]
            new = np.ones(len(item), bool)
            new[1:] = (item[1:] != item[:-1]) | (d[1:] != d[:-1] + 1)
            last = np.append(np.flatnonzero(new)[1:], len(item))[: new.sum()] - 1
            table = np.array(keys, np.int64).reshape(-1, 3)[item[new]]
            yield _rows(["h", "x", "y", "near", "far"], *table.T, d[new], d[last])

    return found.repartition("h").sortWithinPartitions("h", "x", "y").mapInArrow(run, "h long, x long, y long, near long, far long")


def _cells(found: DataFrame, length: int) -> DataFrame:
    """(h, x, y, cell, common, whole): digests of what the strings of a cell have in common, and of all they hold.

    Cell c has the strings that start c * CELL to c * CELL + CELL - 1 bytes before the anchor. ``whole`` is null where
    the context has not all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, x, y, place, body in zip(*(c.to_pylist() for c in columns(batch, *_CONTEXT)), strict=True):
                least = place - (len(body) - length)
                for cell in range(least // CELL, place // CELL + 1):
                    near, far = cell * CELL, cell * CELL + CELL - 1
                    common = xxhash.xxh3_128_digest(body[place - near : place - far + length], seed=cell)
                    whole = xxhash.xxh3_128_digest(body[place - far : place - near + length], seed=cell) if near >= least and far <= place else None
                    out.append((h, x, y, cell, common, whole))
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["h", "x", "y", "cell", "common", "whole"])

    return found.mapInArrow(run, "h long, x long, y long, cell long, common binary, whole binary")


def _strings(found: DataFrame, length: int) -> DataFrame:
    """(h, x, y, d, digest): the strings of the cells named in ``cells``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, x, y, place, body, cells in zip(*(c.to_pylist() for c in columns(batch, *_CONTEXT, "cells")), strict=True):
                least = place - (len(body) - length)
                for cell in cells:
                    for d in range(max(least, cell * CELL), min(place, cell * CELL + CELL - 1) + 1):
                        out.append((h, x, y, d, xxhash.xxh3_128_digest(body[place - d : place - d + length])))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["h", "x", "y", "d", "digest"])

    return found.mapInArrow(run, "h long, x long, y long, d long, digest binary")


def _of_several(rows: DataFrame, digest: str) -> DataFrame:
    """(digest, first): digests that more than one context has, with the first context."""
    owner = F.struct("h", "x", "y")
    both = rows.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(owner).alias("first"), F.max(owner).alias("last"))
    return both.filter("first <> last").select(digest, "first")


def _counted_strings(found: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts, by counting digests.

    A string that two contexts have lies in cells whose common part both have. A cell that another context has as a
    whole is settled; of such equal cells the first still stands for its strings.
    """
    found = staged(found.dropDuplicates(["h", "x", "y"]), "hot")
    cells = staged(_cells(found, length), "cells")
    whole = cells.join(staged(_of_several(cells, "whole"), "whole"), "whole").withColumn("stands", F.struct("h", "x", "y") == F.col("first"))
    settled = staged(whole.select("h", "x", "y", "cell", "stands"), "settled")
    maybe = cells.join(staged(_of_several(cells, "common").select("common"), "common"), "common").select("h", "x", "y", "cell")
    open_ = maybe.join(settled.filter("not stands"), ["h", "x", "y", "cell"], "left_anti").groupBy("h", "x", "y").agg(F.collect_list("cell").alias("cells"))
    strings = staged(_strings(found.join(open_, ["h", "x", "y"]), length), "strings")
    single = strings.join(staged(_of_several(strings, "digest").select("digest"), "digests"), "digest")
    runs = settled.select("h", "x", "y", (F.col("cell") * CELL).alias("near"), (F.col("cell") * CELL + CELL - 1).alias("far"))
    return runs.unionByName(single.select("h", "x", "y", F.col("d").alias("near"), F.col("d").alias("far")))


def _most_in_a_shard(several: DataFrame) -> int:
    total = several.agg(F.sum("contexts")).first()[0] or 0
    return min(HOT[1], max(HOT[0], 2 * total // int(several.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def repeated_parts(docs: DataFrame, length: int) -> DataFrame:
    """(k, g, lo, hi): per document key, bytes lo to hi that repeated strings cover; parts overlap, in no order.

    A context with an anchor that no other context has, found once in the corpus, is dropped as soon as contexts and
    anchors are counted; texts are then read once more for the contexts that are left, one place of each.
    """
    found = staged(occurrences(docs, length), "anchors")
    keyed = found.filter("n > 0").select("k", "g", "lo", "hi", "p", "h", "x", "y", "n")
    per_context = staged(keyed.groupBy("h", "x", "y").agg(F.sum("n").alias("total")), "contexts")
    several = staged(per_context.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1"), "several")
    left = staged(per_context.join(several.hint("merge"), "h", "left").filter("total > 1 or contexts > 1"), "left")
    places = staged(keyed.drop("n").join(left.hint("merge"), ["h", "x", "y"]), "places")
    parts = [found.filter("n = 0").select("k", "g", "lo", (F.col("hi") + length).alias("hi"))]
    parts.append(places.filter("total > 1").select("k", "g", "lo", (F.col("hi") + length).alias("hi")))
    hot = F.col("contexts") > _most_in_a_shard(several)
    one = places.filter("contexts > 1").withColumn("hot", hot).drop("total", "contexts").dropDuplicates(["h", "x", "y"])
    bodies = staged(contexts(docs, staged(one, "one"), length), "bodies")
    some = _sorted_shards(bodies.filter("not hot"), length)
    if not several.filter(hot).isEmpty():
        some = some.unionByName(_counted_strings(bodies.filter("hot"), length))
    some = staged(some, "repeated")
    parts.append(places.join(some.hint("merge"), ["h", "x", "y"]).select("k", "g", (F.col("p") - F.col("far")).alias("lo"), (F.col("p") - F.col("near") + length).alias("hi")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _left(text: bytes, spans: np.ndarray) -> list[bytes]:
    """What stands before, between and after the spans."""
    out, at = [], 0
    for a, b in spans.tolist():
        out.append(text[at:a])
        at = b
    return [*out, text[at:]]


def merged(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Maximal runs of [lo, hi) as rows; runs that touch are one."""
    if not len(lo):
        return np.empty((0, 2), np.int64)
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > end[:-1]
    return np.column_stack((lo[new], end[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]))


def remove_repeats(docs: DataFrame, *, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept, text): a row per document.

    docs: doc_id and text; other columns are not looked at. spans: the maximal runs [start, end) of bytes removed from
    the UTF-8 text; kept: the bytes left, joined (a run may begin or end inside a character); text: the same as
    characters, without those that a run cuts in two. Strings are judged on the input, overlaps and a document's own
    repeats count, and matches never cross documents. A null text is empty (its ``text`` stays null); one shorter than
    ``length`` stays. A very long text is looked at STARTS places at a time and needs memory in proportion to its
    bytes. Rows repeated with equal id and text repeat each other. An empty table gives an empty result. ``length`` is
    at least 32, an anchor.
    """
    if length < ANCHOR:
        raise ValueError(f"length must be at least {ANCHOR}, not {length}")
    before = staged_folders()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("k"), F.hash("doc_id", "text").alias("g"))
    # as a set: rows repeated with equal id and text bring equal parts, which then cost one
    parts = repeated_parts(rows, length).groupBy("k", "g").agg(F.collect_set(F.struct("lo", "hi")).alias("parts"))
    both = rows.join(last_staged(parts, "parts", before).hint("merge"), ["k", "g"], "left").select("doc_id", "text", "parts")
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                doc_ids, texts, parts = columns(batch.slice(k, ROWS), "doc_id", "text", "parts")
                spans, kept, whole, sizes = [], [], [], []
                for given, text, part in zip(texts, utf8(texts), parts, strict=True):
                    runs = merged(*(part.values.field(end).to_numpy() for end in ("lo", "hi"))) if part.is_valid else np.empty((0, 2), np.int64)
                    left = _left(text, runs)
                    spans.append([{"start": a, "end": b} for a, b in runs.tolist()])
                    kept.append(b"".join(left))
                    whole.append("".join(x.decode(errors="ignore") for x in left) if given.is_valid else None)
                    sizes.append(len(text))
                n = np.array(sizes, np.int64)
                gone = n - np.fromiter(map(len, kept), np.int64, len(kept))
                values = [doc_ids, pa.array(n), pa.array(gone), pa.array(spans, spans_type), pa.array(kept, pa.binary()), pa.array(whole, pa.string())]
                yield pa.record_batch(values, names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "text"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary, text string")


#: The same for strings of 400 bytes; spans as their number, kept as its digest. What a run leaves of a character that it
#: cuts is taken off the ends of the pieces kept, in hexadecimal, before they become text.
SQL = """
with d as (select doc_id, text, encode(coalesce(text, '')) b, octet_length(encode(coalesce(text, ''))) n from documents),
w as (select doc_id, i, md5(array_slice(b, i, i + 399)) h from (select doc_id, b, unnest(generate_series(1, n - 399)) i from d where n >= 400)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by h) c from w) where c > 1),
o as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 400 then 0 else 1 end new from r),
g as (select doc_id, i, sum(new) over (partition by doc_id order by i) k from o),
s as (select doc_id, k, min(i) a, max(i) + 399 z from g group by doc_id, k),
f as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) + 1 a, a - 1 z from s
 union all select s.doc_id, max(z) + 1, any_value(n) from s join d on s.doc_id = d.doc_id group by s.doc_id),
piece as (select f.doc_id, f.a, hex(array_slice(b, f.a, f.z)) x from f join d on f.doc_id = d.doc_id where f.z >= f.a),
kept as (select doc_id, string_agg(x, '' order by a) x,
 string_agg(regexp_replace(regexp_replace(x, '^([89AB].)+', ''), '([CD].|E.([89AB].)?|F.([89AB].){0,2})$', ''), '' order by a) t from piece group by doc_id),
cut as (select doc_id, count(*) spans, sum(z - a + 1) bytes from s group by doc_id)
select d.doc_id, cast(n as bigint) n_bytes, cast(coalesce(bytes, 0) as bigint) n_removed, cast(coalesce(spans, 0) as bigint) n_spans,
 case when spans is null then sha256(b) else sha256(unhex(coalesce(x, ''))) end kept_sha256,
 case when spans is null then text else decode(unhex(coalesce(t, ''))) end text
from d left join cut on d.doc_id = cut.doc_id left join kept on d.doc_id = kept.doc_id
"""
