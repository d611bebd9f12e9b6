import random
import struct
import time
from pathlib import Path

import numpy as np
import pytest
import sentencepiece

from keyfold.llm import pieces
from keyfold.llm.queries import op5_sentencepiece

SMALL = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def automaton():
    return pieces.Pieces(Path(MODEL).read_bytes(), ranks=True)


@pytest.fixture(scope="module")
def brute():
    """Best segmentation by trying every piece at every place of the whole text."""
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = {sp.id_to_piece(i): (i, -np.log(2.7 - sp.get_score(i))) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
    longest, unknown = max(map(len, plain)), min(s for _, s in plain.values()) - pieces.UNKNOWN

    def run(text):
        if not text:
            return 0.0, []
        marked = " " + text
        best = [(0.0, None, None)]
        for j in range(1, len(marked) + 1):
            found = (-np.inf, None, None)
            for k in range(max(0, j - longest), j):
                raw = marked[k:j]
                if "▁" in raw:
                    continue
                if (p := plain.get(raw.replace(" ", "▁"))) and best[k][0] + p[1] > found[0]:
                    found = (best[k][0] + p[1], k, [p[0]])
            if best[j - 1][0] + unknown > found[0]:
                found = (best[j - 1][0] + unknown, j - 1, [byte[b] for b in marked[j - 1].encode()])
            best.append(found)
        ids, j = [], len(marked)
        while j:
            _, k, here = best[j]
            ids = here + ids
            j = k
        return best[-1][0], ids

    return run


EDGE = ["", " ", "  a", "▁", "a▁ ▁b  c ", "日本語😀 \n\t x", "\x00\x01", "x" * 300, "é" * 50, "the quick brown fox", "\n\n", "a\n b"]


def test_against_brute_force(automaton, brute):
    rng = random.Random(2)
    texts = EDGE + ["".join(rng.choice("theandingor  é▁日.\n") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    got = automaton.encode([t.encode() for t in texts])
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == brute(text)[1], text
        assert automaton.decode(ids) == text.encode()


def test_whole_texts_and_chunks_agree(automaton, monkeypatch):
    texts = [t.encode() for t in EDGE] + [b"some words and a longer text with many of them " * 20]
    by_chunk = [x.tolist() for x in automaton.encode(texts)]
    automaton.known.clear()
    monkeypatch.setattr(automaton, "by_chunk", False)
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "PLACES", 50)
    assert [x.tolist() for x in automaton.encode(texts)] == by_chunk


def field(number, value):
    """One field of a protocol buffer: text, number or 4-byte float."""
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def unigram_model(pieces_and_scores):
    """A unigram model written by hand, not trained: <unk>, <s>, </s>, 256 bytes and the pieces given; no normalisation."""
    rows = [(b"<unk>", 0.0, 2), (b"<s>", 0.0, 3), (b"</s>", 0.0, 3), *((b"<0x%02X>" % i, 0.0, 6) for i in range(256))]
    rows += [(p.encode(), s, 1) for p, s in pieces_and_scores]
    body = b"".join(field(1, field(1, p) + field(2, s) + field(3, kind)) for p, s, kind in rows)
    return body + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


def test_ids_are_the_librarys_on_a_unigram_model(spark):
    texts = [r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect() if len(r[0]) < 20_000]
    rng = random.Random(1)
    found = {}
    for t in texts[:60]:
        marked = "▁" + t.replace(" ", "▁")
        for _ in range(60):
            k = rng.randrange(len(marked))
            p = marked[k] + marked[k + 1 : k + rng.randint(1, 9)].split("▁")[0]
            found[p] = -float(rng.randint(8, 200)) / 16 - len(p) / 4  # sixteenths: sums are exact, in the library's floats too
    model = unigram_model(sorted(found.items()))
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Pieces(model)
    texts = [*texts, "日本語" * 50, "x" * 500, "ab" * 300, "ñandú😀é" * 20]
    assert all(library.decode(library.encode(t)) == t for t in texts[-4:])
    same = total = 0
    for t, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        want = library.encode(t)
        score = lambda ids: sum(library.get_score(int(i)) for i in ids)
        assert len(ids) and own.decode(ids) == t.encode()
        same, total = same + (ids.tolist() == want), total + 1
        assert ids.tolist() == want or score(ids) == score(want)  # what differs is a tie
    assert same >= 0.97 * total


def test_long_texts_without_spaces(automaton):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdeé日本語xyz") for _ in range(400_000)).encode()
    began = time.perf_counter()
    (ids,) = automaton.encode([text])
    assert time.perf_counter() - began < 20 and automaton.decode(ids) == text
    assert not [c for c in automaton.known if len(c) > pieces.LONGEST_KNOWN]


def test_walked_alone_or_side_by_side(automaton):
    rng = random.Random(9)
    chunks = [b" " + "".join(rng.choice("theandingor▁日é\0") for _ in range(rng.randint(1, 80))).encode() for _ in range(300)]
    marked = [c.replace(pieces.MARK, pieces.LITERAL).replace(b" ", pieces.MARK) for c in chunks]
    assert [automaton._viterbi_alone(c) for c in marked] == automaton._viterbi(marked)


def test_query(spark, brute):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = op5_sentencepiece(spark, SMALL).collect()
    assert len(rows) == len(texts) and all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    for r in [r for r in rows if len(texts[r["doc_id"]]) < 900][:25]:
        assert r["ids"] == brute(texts[r["doc_id"]])[1]


def test_nulls_repeats_and_decoding(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a  b", 0), (3, "a  b", 0), (None, "ü", 0)], "doc_id long, text string, ids int")
    out = pieces.encode(df, model=MODEL)
    got = {(r["doc_id"], r["n_tokens"], r["ids"] is None, r["lossless"]) for r in out.collect()}
    assert (1, 0, True, True) in got and (2, 0, False, True) in got and out.count() == 5
    back = sorted(((r[0], r[1]) for r in pieces.decode(out, model=MODEL).collect()), key=str)
    assert back == sorted([(1, None), (2, ""), (3, "a  b"), (3, "a  b"), (None, "ü")], key=str)
    assert pieces.encode(df.limit(0), model=MODEL).count() == 0
