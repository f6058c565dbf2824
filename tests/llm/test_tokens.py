"""Token ids, token files and packing: exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluiceway.llm import bpe, packing, token_file
from sluiceway.llm.bpe import encoder

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
LETTERS = " \n\t\r  \x0b\x1c\x85\xa0 　'sdtrevmlSTABCzé1²ªßİıÀ́ΣςIł#$%<|>.,-_endoftext日本\U0001f600̈"


def exact(path, text):
    if path not in exact.held:
        exact.held[path] = Tokenizer.from_file(path)
        exact.held[path].encode_special_tokens = True
    return exact.held[path].encode(text, add_special_tokens=False).ids


exact.held = {}


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(alphabet=LETTERS, max_size=60), st.text(max_size=40).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s))))
def test_ids_equal_the_tokenizers(path, text):
    got = np.frombuffer(encoder(path).encode_many([text], 7)[0], "<u4").tolist()
    assert got == [*exact(path, text), 7]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=400), st.sampled_from([0, 7, 40, 2**20]))
def test_blocks_round_trip(values, low):
    x = np.array([min(v, 2**32 - 1) if v % 5 == 0 else low + v % 97 for v in values], np.uint32)
    if len(x):
        raw, sizes = token_file.encode_blocks(x)
        assert (token_file.decode_blocks(raw, np.cumsum(sizes) - sizes)[: len(x)] == x).all()


def test_blocks_hold_outliers_as_exceptions():
    x = np.full(128, 5, np.uint32)
    x[3] = 2**31
    raw, sizes = token_file.encode_blocks(x)
    assert sizes.tolist() == [6 + 5] and raw[4] == 0 and raw[5] == 1


DOCS = [(3, "Hello, wörld " * 3000), (1, None), (2, ""), (1, "same id"), (None, "no id"), (9, "x")]


def test_token_files(spark, tmp_path):
    path = f"file://{tmp_path}/tok"
    token_file.write_tokens(spark.createDataFrame(DOCS, "doc_id long, text string"), path, tokenizer=WORD, partitions=3)
    got = token_file.read_tokens(spark, path).toPandas().sort_values("start")
    order = sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for (i, t), r in zip(order, got.itertuples(), strict=True):
        ids = [*exact(WORD, t or ""), 2]
        assert (None if r.doc_id != r.doc_id else int(r.doc_id)) == i and r.start == start and r.n_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)


def test_token_files_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    token_file.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, tokenizer=WORD)
    assert token_file.read_tokens(spark, path).count() == 0


def check_packing(pieces, ids, length):
    at, filled = {}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == at.get(p["doc_id"], 0) and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert zlib.crc32(np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
        at[p["doc_id"]] = p["start"] + p["length"]
    assert at == {i: len(x) for i, x in ids.items()}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == filled.get(p["sequence_id"], 0)
        filled[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(filled.values()) <= length and all(n == length or n & (n - 1) == 0 for n in filled.values())


def test_packing(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta", "γάμμα", "x1"]) for _ in range(rnd.choice([0, 1, 5, 60, 900])))) for i in range(120)] + [(500, None), (501, "long " * 20_000)]
    made = packing.digest(packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), tokenizer=BYTE, length=256))
    check_packing([r.asDict() for r in made.collect()], {i: [*exact(BYTE, t or ""), 1] for i, t in docs}, 256)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer=BYTE).count() == 0


def test_a_piece_is_cut_only_where_no_sequence_has_room():
    piece = lambda i, n: packing.Piece(i, 0, n, memoryview(bytes(4 * n)))
    # Twenty short sequences of the lowest cost, and one with room.
    got, left = packing.balance([piece(0, 100), piece(1, 50)], [10] * 20 + [200])
    assert [len(p) for p in got[20]] == [100, 50] and not left and not any(got[:20])
    for seed in range(200):
        rnd = random.Random(seed)
        pieces, rooms = [piece(i, rnd.randrange(1, 60)) for i in range(rnd.randrange(60))], [rnd.choice([16, 64, 64]) for _ in range(rnd.randrange(1, 40))]
        todo, room, cost, want = sorted(pieces, key=lambda p: (-len(p), p.doc_id, p.start)), rooms[:], [0.0] * len(rooms), [[] for _ in rooms]
        while todo and any(room):
            p = todo.pop(0)
            fits = [k for k in range(len(room)) if room[k] >= len(p)]
            k = min(fits or [k for k in range(len(room)) if room[k]], key=lambda k: (cost[k], k))
            if not fits:
                p, rest = p.split(room[k])
                todo = sorted([*todo, rest], key=lambda p: (-len(p), p.doc_id, p.start))
            want[k].append(p)
            room[k] -= len(p)
            cost[k] += packing.LINEAR * len(p) + packing.QUADRATIC * len(p) ** 2
        got, left = packing.balance(pieces, rooms)
        place = lambda x: [(p.doc_id, p.start, len(p)) for p in x]
        assert list(map(place, got)) == list(map(place, want)) and sorted(place(left)) == sorted(place(todo))


def test_costs_are_balanced():
    rnd = random.Random(4)
    pieces = [packing.Piece(i, 0, n, memoryview(bytes(4 * n))) for i, n in enumerate(rnd.randrange(20, 1500) for _ in range(400))]
    rooms = [2048] * (sum(map(len, pieces)) // 2048)
    got, left = packing.balance(pieces, rooms)
    cost = [sum(packing.LINEAR * len(p) + packing.QUADRATIC * len(p) ** 2 for p in s) for s in got]
    assert all(sum(map(len, s)) == 2048 for s in got) and sum(map(len, left)) < 2048
    first_fit, at = [[]], 0
    for p in pieces:
        if at + len(p) > 2048:
            first_fit.append([])
            at = 0
        first_fit[-1].append(p)
        at += len(p)
    plain = [sum(packing.LINEAR * len(p) + packing.QUADRATIC * len(p) ** 2 for p in s) for s in first_fit]
    assert np.std(cost) < 0.5 * np.std(plain)


def test_other_vocabularies_encode_whole_texts(tmp_path):
    import json

    with open(BYTE, encoding="utf-8") as f:
        made = json.load(f)
    made["pre_tokenizer"]["add_prefix_space"] = True
    other = f"{tmp_path}/other.json"
    with open(other, "w", encoding="utf-8") as f:
        json.dump(made, f)
    assert (bpe.kind_of(WORD), bpe.kind_of(BYTE), bpe.kind_of(other)) == ("drops", "keeps", None)
    for text in ("", "plain words here", " <|endoftext|> é  x"):
        assert np.frombuffer(encoder(other).encode_many([text], 7)[0], "<u4").tolist() == [*exact(other, text), 7]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cache_is_bounded_by_bytes(monkeypatch, path):
    monkeypatch.setattr(bpe, "CACHED", 20_000)
    made, rnd = bpe.Encoder(path), random.Random(1)
    for _ in range(30):
        texts = [" ".join("".join(rnd.choices("abcdeé日", k=rnd.randrange(1, 6))) for _ in range(50)), "a" * 30_000]
        for t, ids in zip(texts, made.encode_many(texts, 7), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == [*exact(path, t), 7]
        assert made.held <= 20_000 and sum(bpe.ENTRY + len(k) + len(v) for k, v in made.known.items()) == made.held


def test_any_vocabulary_goes_into_files_and_sequences(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    token_file.write_tokens(docs, f"file://{tmp_path}/b", tokenizer=BYTE, partitions=2)
    got = {(r.doc_id, r.n_tokens) for r in token_file.read_tokens(spark, f"file://{tmp_path}/b").collect()}
    assert got == {(i, len(exact(BYTE, t or "")) + 1) for i, t in DOCS}
    pieces = packing.pack(docs.where("doc_id IN (3, 9)"), tokenizer=WORD).collect()
    assert sum(p.length for p in pieces) == sum(len(exact(WORD, t)) + 1 for i, t in DOCS if i in (3, 9))


@pytest.mark.parametrize("name", ["op2_token_file", "op9_packing"])
def test_registered_queries_equal_the_tokenizers(spark, name):
    from sluiceway.llm import QUERIES

    from ..conftest import SMALL

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = [r.asDict() for r in QUERIES[name](spark, SMALL).collect()]
    if name == "op9_packing":
        check_packing(got, {i: [*exact(BYTE, t), 1] for i, t in docs.items()}, 2048)
        return
    start = 0
    by = {r["doc_id"]: r for r in got}
    assert len(by) == len(got) == len(docs)
    for i in sorted(docs):
        ids = np.array([*exact(WORD, docs[i]), 2], "<u4")
        assert (by[i]["start"], by[i]["n_tokens"], by[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from sluiceway.llm import common

    remote = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.work_dir(remote)


def test_scratch_is_removed(spark):
    import os

    from sluiceway.llm import common

    kept, common._scratch[:] = common._scratch[:], []
    path = common.scratch(spark, "x")
    spark.range(3).write.parquet(path)
    at = path.split("file:")[-1].replace("//", "/")
    assert os.path.exists(at)
    common.clear()
    assert not os.path.exists(at)
    common._scratch.extend(kept)
