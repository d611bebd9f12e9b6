"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each byte the automaton's state names the longest piece that ends there, and output links name the shorter ones;
each of them relaxes the best score at that place. Pieces hold the word mark only at their beginning, so a text falls
into chunks (word marks and what follows) that are encoded on their own; many chunks move through the automaton side by
side, a few wide ones a byte at a time, and chunks met before are looked up.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.shared import columns, utf8

MARK = "▁".encode()
#: A mark that stands in the text itself: bytes that no UTF-8 text holds, so that no piece matches them.
LITERAL = b"\xff\xfe\xfd"
_REAL = {0xFF: MARK[0], 0xFE: MARK[1], 0xFD: MARK[2]}
#: Chunks remembered by a worker; it forgets all beyond that.
REMEMBERED = 300_000
#: Places (chunks times width) that move through the automaton at once.
PLACES = 1 << 21
#: What a character without a piece costs, below the worst piece.
UNKNOWN = 10.0
#: Chunks of similar width that are worth moving side by side; fewer are walked one by one, which takes less time.
TOGETHER = 48
#: Chunks of over so many bytes are not remembered.
LONGEST_KNOWN = 1 << 12
#: Where scores are merge ranks, a piece of rank r counts as the logarithm of 1 / (r + this), as in the law of Zipf and Mandelbrot.
RANK_SHIFT = 2.7
_CHUNK = re.compile(rb" +[^ ]*")


class Pieces:
    """The automaton. States are prefixes of pieces; state 0 is the empty one."""

    def __init__(self, model: bytes, ranks: bool = False):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.raw: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        pieces: list[tuple[bytes, int, float]] = []
        for i in range(n):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.raw[i] = bytes([int(text[3:5], 16)])
                self.byte_id[self.raw[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.raw[i] = text.encode().replace(MARK, b" ")
                pieces.append((text.encode(), i, -np.log(RANK_SHIFT - sp.get_score(i)) if ranks else sp.get_score(i)))
        if not self.byte_id.any():
            raise ValueError("the model has no byte pieces, without which not every text can be encoded")
        self.by_chunk = not any(MARK in re.sub(rb"^(?:%s)+" % MARK, b"", p) for p, _, _ in pieces)
        self.unknown = min(s for _, _, s in pieces) - UNKNOWN
        self._build(pieces)
        self.known: dict[bytes, bytes] = {}

    def _build(self, pieces: list[tuple[bytes, int, float]]) -> None:
        states: dict[bytes, int] = {b"": 0}
        levels: list[list[tuple[int, int, int]]] = []  # by depth: parent, byte, state
        for text, _, _ in sorted(pieces):
            for k in range(1, len(text) + 1):
                if text[:k] not in states:
                    states[text[:k]] = len(states)
                    while len(levels) < k:
                        levels.append([])
                    levels[k - 1].append((states[text[: k - 1]], text[k - 1], states[text[:k]]))
        n = len(states)
        self.next = np.zeros((n, 256), np.int32)
        self.length, self.score, self.piece = np.zeros(n, np.int32), np.full(n, -np.inf), np.full(n, -1, np.int32)
        for text, i, score in pieces:
            s = states[text]
            self.length[s], self.score[s], self.piece[s] = len(text), score, i
        fail, self.link = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for depth, level in enumerate(levels):  # breadth first: what a state falls back to is finished before it
            parent, byte, state = (np.array(x) for x in zip(*level, strict=True))
            if depth:
                fail[state] = self.next[fail[parent], byte]
            self.next[parent, byte] = state
            # rows of this depth start as those they fall back to; the next depth writes its own steps into them
            self.next[state] = self.next[fail[state]]
            self.link[state] = np.where(self.piece[fail[state]] >= 0, fail[state], self.link[fail[state]])

    def _viterbi(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks of similar length, each as 4-byte numbers. Equal scores: the longest piece wins."""
        n, width = len(chunks), max(map(len, chunks))
        text = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in chunks), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, chunks), np.int64, n)
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        back, which = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        state, char_from, rows = np.zeros(n, np.int32), np.zeros(n, np.int64), np.arange(n)
        for j in range(1, width + 1):
            byte = text[:, j - 1]
            state = self.next[state, byte]
            begins = (byte & 0xC0 != 0x80) & (byte != LITERAL[1]) & (byte != LITERAL[2])
            char_from = np.where(begins, j - 1, char_from)
            out = np.where(self.piece[state] >= 0, state, self.link[state])
            at = np.flatnonzero(out)
            while len(at):
                o = out[at]
                score = best[j - self.length[o], at] + self.score[o]
                better = score > best[j, at]
                w = at[better]
                best[j, w], back[j, w], which[j, w] = score[better], self.length[o[better]], self.piece[o[better]]
                out[at] = self.link[o]
                at = at[self.link[o] > 0]
            after = text[:, j] if j < width else np.zeros(n, np.uint8)
            ends = ((after & 0xC0 != 0x80) & (after != LITERAL[1]) & (after != LITERAL[2])) | (size == j)
            score = best[char_from, rows] + self.unknown
            w = np.flatnonzero(ends & (score > best[j]))
            best[j, w], back[j, w], which[j, w] = score[w], j - char_from[w], -1
        return self._walk(text, size, back, which)

    def _walk(self, text: np.ndarray, size: np.ndarray, back: np.ndarray, which: np.ndarray) -> list[bytes]:
        """Back along the best path, all chunks a step at a time; a character without a piece gives its bytes."""
        n, width = text.shape
        ids, used = np.zeros((n, width), np.int32), np.full(n, width)
        at, rows = size.copy(), np.arange(n)
        while len(rows := rows[at[rows] > 0]):
            j = at[rows]
            piece, step = which[j, rows], back[j, rows]
            plain = piece >= 0
            r = rows[plain]
            used[r] -= 1
            ids[r, used[r]] = piece[plain]
            for r, j_end, k in zip(rows[~plain].tolist(), j[~plain].tolist(), step[~plain].tolist(), strict=True):
                used[r] -= k
                ids[r, used[r] : used[r] + k] = [self.byte_id[_REAL.get(b, b)] for b in text[r, j_end - k : j_end].tolist()]
            at[rows] -= step
        return [ids[r, used[r] :].tobytes() for r in range(n)]

    @cached_property
    def _plain(self) -> tuple[memoryview, list[int], list[int], list[int], list[float]]:
        """The tables for one step at a time; ``first`` is the state or output link at which a piece ends."""
        first = np.where(self.piece >= 0, np.arange(len(self.piece)), self.link)
        return memoryview(self.next.ravel()), first.tolist(), self.link.tolist(), self.length.tolist(), self.score.tolist()

    def _viterbi_alone(self, text: bytes) -> bytes:
        """The same for one chunk. Best scores are kept only as far back as pieces reach."""
        step, first, link, length, score = self._plain
        ring = 1 << int(max(self.length.max(), 4)).bit_length()
        mask, best = ring - 1, [0.0] * ring
        back, which = array("i", bytes(4 * (len(text) + 1))), array("i", bytes(4 * (len(text) + 1)))
        state, char_from, unknown, none = 0, 0, self.unknown, -np.inf
        for j, byte in enumerate(text, 1):
            state = step[state << 8 | byte]
            if byte & 0xC0 != 0x80 and byte != 0xFE and byte != 0xFD:
                char_from = j - 1
            top, far, end, o = none, 0, 0, first[state]
            while o:
                s = best[(j - length[o]) & mask] + score[o]
                if s > top:
                    top, far, end = s, length[o], o
                o = link[o]
            after = text[j] if j < len(text) else 0
            if after & 0xC0 != 0x80 and after != 0xFE and after != 0xFD:
                s = best[char_from & mask] + unknown
                if s > top:
                    top, far, end = s, j - char_from, 0
            best[j & mask], back[j], which[j] = top, far, end
        out, j, piece = array("i"), len(text), self.piece.tolist()
        while j:
            if which[j]:
                out.append(piece[which[j]])
            else:
                out.extend(int(self.byte_id[_REAL.get(b, b)]) for b in reversed(text[j - back[j] : j]))
            j -= back[j]
        out.reverse()
        return out.tobytes()

    def _learn(self, chunks: set[bytes]) -> None:
        todo = sorted(chunks, key=len)
        at = 0
        while at < len(todo):
            few, width = at, 0
            while few < len(todo) and (few == at or (few + 1 - at) * len(todo[few]) <= PLACES and len(todo[few]) <= 2 * width + 8):
                width = len(todo[few]) if few == at else width
                few += 1
            batch = todo[at:few]
            marked = [c.replace(MARK, LITERAL).replace(b" ", MARK) for c in batch]
            self.known.update(zip(batch, self._viterbi(marked) if len(batch) >= TOGETHER else map(self._viterbi_alone, marked), strict=True))
            at = few

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text. An empty text has none; others begin as if a space stood before them."""
        parts = [(_CHUNK.findall(b" " + t) if self.by_chunk else [b" " + t]) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = {c for p in parts for c in p} - self.known.keys()
        self._learn(new)
        known = self.known
        ids = [np.frombuffer(b"".join([known[c] for c in p]), np.int32) for p in parts]
        for c in new:
            if len(c) > LONGEST_KNOWN:
                del known[c]
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()])[1:]


@lru_cache(maxsize=1)
def load(model: bytes, ranks: bool = False) -> Pieces:
    """Built once in each Python worker."""
    return Pieces(model, ranks)


#: Texts that are encoded together.
TEXTS = 256


def encode(docs: DataFrame, *, model: str, ranks: bool = False, check: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids: array<int>, lossless): a row per document.

    docs: doc_id and text; other columns are not looked at. ``model``: a SentencePiece model with byte pieces and no
    normalisation, read on the driver. Of a unigram model the ids are those of the SentencePiece library. A BPE model's
    scores are merge ranks, whose sum says nothing; with ``ranks`` they count as logarithms of chances by rank
    (RANK_SHIFT), and ids are the likeliest pieces, not those of merging. Of equal sums the one that ends in the longer
    piece wins. A null text has null ids and 0 tokens, an empty one no ids. Characters without a piece become their
    bytes, so ``decode`` gives every text back; with ``check``, lossless says that it did (null text: true). A very long
    text takes time and memory in proportion to its bytes, with or without spaces. Rows repeat as given, extra columns
    are not looked at; an empty table gives an empty result.
    """
    raw = Path(model).read_bytes()
    names = ["doc_id", "n_tokens", "ids", "lossless"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(raw, ranks)
        for whole in batches:
            for k in range(0, len(whole), TEXTS):
                doc_ids, texts = columns(whole.slice(k, TEXTS), "doc_id", "text")
                given = list(utf8(texts))
                ids = pieces.encode(given)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)), mask=texts.is_null())
                same = [pieces.decode(x) == t for x, t in zip(ids, given, strict=True)] if check else [None] * len(ids)
                yield pa.record_batch([doc_ids, pa.array(np.diff(offsets).astype(np.int64)), lists, pa.array(same, pa.bool_())], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, *, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    raw = Path(model).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(raw)
        for batch in batches:
            doc_ids, ids = columns(batch, "doc_id", "ids")
            texts = [pieces.decode(x.values.to_numpy()).decode() if x.is_valid else None for x in ids]
            yield pa.record_batch([doc_ids, pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
