"""Sharding laws and packing against their definitions."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from paneltide.llm.packing import best_fit, pack_documents
from paneltide.llm.queries import TOKENIZER
from paneltide.llm.sharding import assign_shards, shard_documents

SCHEMA = "doc_id long, text string, shard string"
TEXTS = ["", "word", "Größe ñ 漢字 😀", "a b c", "x" * 5000]


def documents(spark, n=400):
    rows = [(i, TEXTS[i % 5] + str(i // 9), "clash") for i in range(n)]
    return spark.createDataFrame([*rows, (None, None, None), (3, None, "c"), *rows[:2], rows[0]],
                                 SCHEMA)


def test_shards_hold_their_law(spark):
    docs = documents(spark)
    got = shard_documents(docs, [1.0] * 7, 1.0).collect()
    assert len(got) == 405 and {r.law for r in got} == {"key"}
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    for r in got:
        assert any(len(t.encode()) + 16 == r["size"] and zlib.crc32(t.encode()) == r.text_crc32
                   for t in texts[r.doc_id])
        assert r.grown_shard in (r.shard, 7)
    for s in range(7):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.shard, r.grown_shard))
    assert all(len(v) == 1 for v in by_id.values())
    moved = sum(r.grown_shard == 7 for r in got)
    assert 20 < moved < 90
    again = shard_documents(docs.repartition(5), [1.0] * 8).collect()
    assert {(r.doc_id, r.shard) for r in again} == {(r.doc_id, r.grown_shard) for r in got}


def test_weights_and_empty_table(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    n = dict(assign_shards(rows, "k", [1.0, 3.0]).groupBy("shard").count().collect())
    assert abs(n[1] / 20_000 - 0.75) < 0.02
    assert shard_documents(documents(spark).limit(0), [1.0] * 3, 1.0).collect() == []


def test_best_fit_is_bounded_and_full():
    random.seed(1)
    lengths = [random.randint(1, 100) for _ in range(5000)]
    where, offsets = best_fit(lengths, 100, 16)
    used = {}
    for s, o, n in zip(where, offsets, lengths):
        assert used.get(s, 0) == o
        used[s] = o + n
    assert max(used.values()) <= 100
    assert len(used) < 1.05 * sum(lengths) / 100
    assert best_fit([100, 60, 40, 50], 100, 1) == ([0, 1, 1, 2], [0, 0, 60, 0])


def test_pieces_and_places(spark):
    long = " ".join(str(i) for i in range(3000))
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, long), (None, "null id"), (1, "Hello world"),
            (5, "a" + " " * 30_000 + "b"), (6, "<|endoftext|> Größe 漢字 😀 \x85 it's"), (7, "a <|endoftext|><|endoftext|>b <|endoftext"),
            (8, "x" + "\n" * 25_000 + "<|endoftext|> y")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, 64).collect()
    coder = Tokenizer.from_file(TOKENIZER.tokenizer)
    expected = []
    for doc_id, text in rows:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        expected += [(doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                     for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(expected, key=key)
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 64
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(empty, TOKENIZER).collect() == []
