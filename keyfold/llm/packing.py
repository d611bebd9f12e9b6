"""Token ids packed into rows of fixed length by best-fit decreasing, and written as binary matrices.

Each task packs what it reads, some millions of tokens at a time: nothing is shuffled, and a shard of that size fills
its rows as well as a larger one would.
"""

from __future__ import annotations

import base64
import contextlib
import json
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.shared import columns, staged

#: How byte-level BPE vocabularies of this kind cut a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Tokens that a task packs together.
SHARD_TOKENS = 1 << 22
SCHEMA = "shard long, row int, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """From the contents of a rank file; built once in each Python worker."""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, ranks.splitlines()))}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=table, special_tokens={})


class CapacityTree:
    """How many rows are open at each capacity, as a segment tree of sums; finds the least capacity that suffices."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.sums[at] += n
            at >>= 1

    def at_least(self, capacity: int) -> int | None:
        sums, at = self.sums, capacity + self.leaves
        if sums[at]:
            return capacity
        while at > 1:  # up to the first right-hand sibling that holds a row, then down to its least leaf
            if not at & 1 and sums[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if sums[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Indices of pieces, by row. Each piece, longest first, goes to the open row whose room it fills best."""
    tree = CapacityTree(length)
    open_rows: dict[int, list[int]] = {}
    rows: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = tree.at_least(n)
        if room is None:
            row, left = len(rows), length - n
            rows.append([i])
        else:
            row, left = open_rows[room].pop(), room - n
            tree.add(room, -1)
            rows[row].append(i)
        if left:
            open_rows.setdefault(left, []).append(row)
            tree.add(left, 1)
    return rows


def _packed(ids: list[np.ndarray], docs: list[int | None], starts: list[int], length: int, pad: int, shard: int) -> Iterator[pa.RecordBatch]:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    narrow = np.dtype("<u2") if pad < 1 << 16 else np.dtype("<u4")
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    rows = best_fit_decreasing(lengths, length)
    for k in range(0, len(rows), 512):
        out: list[list] = [[] for _ in names]
        for r, row in enumerate(rows[k : k + 512], k):
            sizes = lengths[row]
            used = int(sizes.sum())
            matrix_row = np.full(length, pad, narrow)
            matrix_row[:used] = np.concatenate([ids[i] for i in row])
            ends = np.cumsum(sizes)
            position = np.arange(length, dtype=np.int64)
            position[:used] -= np.repeat(ends - sizes, sizes)
            position[used:] -= used
            values = (shard, r, used, [docs[i] for i in row], [starts[i] for i in row], [0, *ends.tolist()], matrix_row.tobytes(), position.astype("<u4").tobytes())
            for column, v in zip(out, values, strict=True):
                column.append(v)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)


def pack(docs: DataFrame, *, vocabulary: str, eos: int, length: int = 2048, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Packed rows: shard, row, n_tokens (without padding), doc_ids and starts by piece, cu_seqlens, input_ids, position_ids.

    docs: doc_id and text; other columns are not looked at. Every document's ids end in ``eos``; one of more than
    ``length`` ids is cut into pieces, ``starts`` telling where in the document each piece begins. input_ids holds
    ``length`` little-endian numbers of 2 bytes (4 if eos needs them), padded by eos; position_ids 4-byte numbers that
    begin anew with every piece and with the padding; cu_seqlens the ends of the pieces, from 0.
    A null or empty text is eos alone; a very long one is as many pieces as it needs, and none of its ids is lost.
    Repeated rows are packed as often as they come. An empty table gives no rows.
    ``vocabulary``: a rank file, read on the driver.
    """
    ranks = Path(vocabulary).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = encoder(ranks).encode_to_numpy, TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        owners: list[int | None] = []
        starts: list[int] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(*columns(batch, "doc_id", "text"), strict=True):
                all_ids = np.append(encode(text.as_py() or "", disallowed_special=()), eos).astype(np.uint32)
                for at in range(0, len(all_ids), length):
                    ids.append(all_ids[at : at + length])
                    owners.append(doc_id.as_py())
                    starts.append(at)
                held += len(all_ids)
                if held >= shard_tokens:
                    yield from _packed(ids, owners, starts, length, eos, part << 32 | shard)
                    ids, owners, starts, held, shard = [], [], [], 0, shard + 1
        if ids:
            yield from _packed(ids, owners, starts, length, eos, part << 32 | shard)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def unpack(rows: Iterable, *, vocabulary: str, eos: int) -> dict[int, str]:
    """Texts by doc_id from packed rows; for checks on small results."""
    decode = encoder(Path(vocabulary).read_bytes()).decode_bytes
    pieces: dict[int, dict[int, np.ndarray]] = {}
    for r in rows:
        ids = np.frombuffer(r["input_ids"], "<u2" if eos < 1 << 16 else "<u4")
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            pieces.setdefault(doc, {})[start] = ids[a:b]
    whole = {doc: np.concatenate([p[s] for s in sorted(p)]) for doc, p in pieces.items()}
    return {doc: decode(ids[:-1].tolist()).decode() for doc, ids in whole.items()}


#: Rows that are read back together.
ROWS = 1024
MANIFEST = "name string, first long, rows long, piece_at long, pieces long"


def write_binary(packed: DataFrame, folder: str, *, positions: str = "matrix") -> DataFrame:
    """Per task NAME.ids.bin (the matrix of ids by row), NAME.cu.bin (ends of the pieces from 0, 4-byte numbers, rows one after
    the other), NAME.pieces.bin (by piece three 8-byte numbers: 1 if there is a doc_id, doc_id, start), NAME.json, and

    - positions="matrix": NAME.pos.bin, position ids by row, 4-byte numbers
    - positions="resets": NAME.reset.bin, in the order of NAME.cu.bin the places at which positions begin anew, the padding's
      last (``length`` where there is none): all that a reader needs, in a fraction of the bytes

    Returns the manifest: by name and up to ROWS rows the first row, their number, the first piece and the number of
    pieces. Files that it does not name are of lost tasks. A row of p pieces has p + 1 numbers in NAME.cu.bin.
    """
    if positions not in ("matrix", "resets"):
        raise ValueError(f"positions are written as matrix or resets, not {positions!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return
        fs, top = FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        name, lengths, chunks, done = uuid.uuid4().hex, [], [], 0
        ends = {"ids": "ids", "cu": "cu", "pieces": "pieces", "pos": "pos" if positions == "matrix" else "reset"}
        with contextlib.ExitStack() as stack:
            out = {k: stack.enter_context(fs.open_output_stream(f"{top}/{name}.{end}.bin")) for k, end in ends.items()}
            while batch is not None:
                for ids, pos, cu, docs, starts in zip(*columns(batch, "input_ids", "position_ids", "cu_seqlens", "doc_ids", "starts"), strict=True):
                    bounds, owners = np.array(cu.as_py(), "<u4"), docs.as_py()
                    raw = ids.as_py()
                    out["ids"].write(raw)
                    out["cu"].write(bounds.tobytes())
                    out["pieces"].write(np.array([(d is not None, d or 0, s) for d, s in zip(owners, starts.as_py(), strict=True)], "<i8").tobytes())
                    out["pos"].write(pos.as_py() if positions == "matrix" else bounds.tobytes())
                    if len(lengths) % ROWS == 0:
                        chunks.append([len(lengths), 0, done, 0])
                    lengths.append(len(bounds))
                    done += len(owners)
                    chunks[-1][1] += 1
                    chunks[-1][3] += len(owners)
                batch = next(batches, None)
        with fs.open_output_stream(f"{top}/{name}.json") as about:
            about.write(json.dumps({"rows": len(lengths), "cu_lengths": lengths}).encode())
        columns_ = zip(*chunks, strict=True)
        yield pa.record_batch([pa.array([name] * len(chunks)), *(pa.array(c, pa.int64()) for c in columns_)], names=[f.split(" ")[0] for f in MANIFEST.split(", ")])

    return staged(packed.mapInArrow(run, MANIFEST), "matrices")


def read_binary(manifest: DataFrame, folder: str, *, length: int, eos: int) -> DataFrame:
    """(name, row, n_tokens, doc_ids, starts, cu_seqlens, input_ids, position_ids) from what ``write_binary`` wrote.

    Every row of the manifest is read by ranges, so that a large file is many tasks' work.
    """
    width = 2 if eos < 1 << 16 else 4
    schema = "name string, row long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = FileSystem.from_uri(folder)

        def at(name: str, end: str, first: int, n: int, size: int) -> bytes:
            with fs.open_input_file(f"{top}/{name}.{end}.bin") as source:
                return source.read_at(n * size, first * size)

        for name, first, rows, piece_at, n in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            ids = at(name, "ids", first, rows, length * width)
            cu = np.frombuffer(at(name, "cu", piece_at + first, n + rows, 4), "<u4").astype(np.int64)
            pieces = np.frombuffer(at(name, "pieces", piece_at, n, 24), "<i8").reshape(-1, 3)
            edges = np.append(np.flatnonzero(cu == 0), len(cu))  # a row's first number is its only 0
            out: list[list] = [[] for _ in kinds]
            for k in range(rows):
                ends = cu[edges[k] : edges[k + 1]]
                own = pieces[edges[k] - k : edges[k + 1] - k - 1]
                begins = ends[:-1] if ends[-1] == length else ends
                position = np.arange(length) - np.repeat(begins, np.diff(np.append(begins, length)))
                values = (name, first + k, int(ends[-1]), [d if has else None for has, d, _ in own.tolist()], own[:, 2].tolist(), ends.tolist(), ids[k * length * width : (k + 1) * length * width], position.astype("<u4").tobytes())
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[f.split(" ")[0] for f in schema.split(", ")])

    return manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(run, schema)
