import json
import random

import numpy as np
import pytest

from keyfold.llm import packing
from keyfold.llm.queries import op4_packing

SMALL = "/root/testdata/sf0.001"
VOCABULARY, EOS = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256


def brute_rows(lengths, length):
    """Best fit decreasing by looking at every row."""
    rooms, rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [(room, r) for r, room in enumerate(rooms) if room >= lengths[i]]
        if fits:
            r = min(fits)[1]
        else:
            r = len(rooms)
            rooms.append(length)
            rows.append([])
        rooms[r] -= lengths[i]
        rows[r].append(lengths[i])
    return sorted(rooms), len(rows)


@pytest.mark.parametrize("length", [1, 7, 64, 100])
def test_rows_are_as_full_as_by_brute_force(length):
    rng = random.Random(length)
    lengths = np.array([rng.randint(1, length) for _ in range(400)])
    rows = packing.best_fit_decreasing(lengths, length)
    assert sorted(i for r in rows for i in r) == list(range(400))
    rooms = sorted(length - int(lengths[r].sum()) for r in rows)
    assert (rooms, len(rows)) == brute_rows(lengths.tolist(), length) and rooms[0] >= 0


def test_capacity_tree():
    tree = packing.CapacityTree(10)
    for c in (2, 5, 5, 9):
        tree.add(c, 1)
    assert [tree.at_least(c) for c in range(1, 11)] == [2, 2, 5, 5, 5, 9, 9, 9, 9, None]
    tree.add(5, -1)
    tree.add(5, -1)
    assert tree.at_least(3) == 9


def rows_are_sound(rows, length):
    for r in rows:
        ids, pos, cu = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u4"), r["cu_seqlens"]
        assert len(ids) == len(pos) == length and cu[0] == 0 and cu[-1] == r["n_tokens"] <= length
        assert len(cu) == len(r["doc_ids"]) + 1 == len(r["starts"]) + 1
        want = np.concatenate([np.arange(b - a) for a, b in zip(cu, cu[1:], strict=False)] + [np.arange(length - cu[-1])])
        assert (pos == want).all() and (ids[cu[-1] :] == EOS).all()


def test_query_is_a_round_trip(spark):
    rows = op4_packing(spark, SMALL).collect()
    rows_are_sound(rows, 2048)
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    assert packing.unpack(rows, vocabulary=VOCABULARY, eos=EOS) == texts
    assert sum(r["n_tokens"] for r in rows) > 0.9 * 2048 * (len(rows) - 2)


def test_shards_long_texts_nulls_and_files(spark, tmp_path):
    texts = {1: None, 2: "", 3: "word " * 500, 4: "<|endoftext|> é😀", **{10 + i: "a b c " * i for i in range(40)}}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    packed = packing.pack(df, vocabulary=VOCABULARY, eos=EOS, length=64, shard_tokens=300)
    rows = packed.collect()
    rows_are_sound(rows, 64)
    assert len({(r["shard"], r["row"]) for r in rows}) == len(rows) and len({r["shard"] for r in rows}) > 4
    assert packing.unpack(rows, vocabulary=VOCABULARY, eos=EOS) == {k: v or "" for k, v in texts.items()}
    files = packing.write_binary(packed, f"file://{tmp_path}/m").collect()
    ids = b"".join((tmp_path / "m" / f"{f['name']}.ids.bin").read_bytes() for f in files)
    assert len(ids) == len(rows) * 64 * 2 and sorted(ids[k : k + 128] for k in range(0, len(ids), 128)) == sorted(bytes(r["input_ids"]) for r in rows)
    about = [json.loads((tmp_path / "m" / f"{f['name']}.json").read_text()) for f in files]
    assert sum(a["rows"] for a in about) == sum(f["rows"] for f in files) == len(rows)
    assert packing.pack(df.limit(0), vocabulary=VOCABULARY, eos=EOS).count() == 0


@pytest.mark.parametrize("positions", ["matrix", "resets"])
def test_written_rows_come_back(spark, tmp_path, monkeypatch, positions):
    monkeypatch.setattr(packing, "ROWS", 7)
    rows = [(1, "word " * 500), (1, "word " * 500), (None, "no id"), (3, None), *((10 + i, "a b c " * i) for i in range(40))]
    df = spark.createDataFrame([(*r, "x", 0, 0) for r in rows], "doc_id int, text string, shard string, row int, input_ids int").repartition(2)
    packed = packing.pack(df, vocabulary=VOCABULARY, eos=EOS, length=64).cache()
    folder = f"file://{tmp_path}/m"
    manifest = packing.write_binary(packed, folder, positions=positions)
    got = packing.read_binary(manifest, folder, length=64, eos=EOS).collect()
    rows_are_sound(got, 64)
    same = ("n_tokens", "doc_ids", "starts", "cu_seqlens", "input_ids", "position_ids")
    key = lambda r: str([r[c] for c in same])
    assert sorted(map(key, got)) == sorted(map(key, packed.collect())) and len({(r["name"], r["row"]) for r in got}) == len(got)
    assert manifest.filter("rows > 7").count() == 0 and manifest.count() > 4
    with pytest.raises(ValueError, match="matrix"):
        packing.write_binary(packed, folder, positions="none")


def test_a_very_long_text_loses_nothing(spark):
    text = "".join(f"w{i * i % 7919} " for i in range(300_000))
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, vocabulary=VOCABULARY, eos=EOS).collect()
    assert packing.unpack(rows, vocabulary=VOCABULARY, eos=EOS) == {1: text, 2: "short"}
