"""The exact Jaccard join against every pair compared."""

import random

import numpy as np
from brute import components

from paneltide.llm import set_join, shingles
from paneltide.llm.set_join import _packed, _unpacked, jaccard_components
from paneltide.llm.shingles import bitmap, unequal_bits

SCHEMA = "doc_id long, text string, component_id string"


def near_copies(r, n_groups=3, n=70):
    """Groups of edited copies, cuts of one text, texts with a common passage, and odd ones."""
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    passage = text(30)
    out = []
    for g in range(n_groups):
        base = text(80)
        for _ in range(n):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 2, 3, 5])):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(copy)
            cut = r.randrange(0, 14)
            out.append(base[cut:cut + 68])
        out += [[*text(r.randrange(3, 60)), *passage] for _ in range(20)]
    out += [passage, passage[:-1], ["one"], ["one", "two"], ["ONE", "two"], [], ["  \t"]]
    return [" ".join(t) for t in out]


def test_all_components_are_found(spark, monkeypatch):
    rows = [(10 * i + 3, t, "clash") for i, t in enumerate(near_copies(random.Random(5)))]
    r = random.Random(1)
    rows += [(1, "w1\x0bw2  W3\x0c w4", "c"), (2, "w1 w2 w3 w4", "c"), (4, "w1 w2\x85 w3 w4", "c"), (5, None, "c")]
    r.shuffle(rows)
    want = components([(i, t) for i, t, _ in rows], 90)
    extra = [(None, rows[0][1], "c"), (None, None, "c"), rows[1], rows[1]]
    table = spark.createDataFrame([*rows, *extra], SCHEMA).repartition(6)
    # Long lists, several blocks and hot keys at any size; then the usual limits.
    for leader, block, hot in ((3, 16, 20), (set_join.LEADER_FROM, set_join.BLOCK, shingles.HOT)):
        monkeypatch.setattr(set_join, "LEADER_FROM", leader)
        monkeypatch.setattr(set_join, "BLOCK", block)
        monkeypatch.setattr(shingles, "HOT", hot)
        got = jaccard_components(table).collect()
        assert len(got) == len(rows) + len(extra)
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {
            (i, n, c) for i, (n, c) in want.items()}
        assert all(r.component_id is None for r in got if r.doc_id is None)


def test_one_id_with_several_texts_and_empty_table(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(5, a, ""), (5, b, ""), (9, a, ""), (7, b + " more", ""), (8, "else where now", "")]
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (9, 5), (7, 5), (8, 8)} and len(got) == 5
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
    assert len(jaccard_components(spark.createDataFrame([(1, None, ""), (2, "", "")], SCHEMA)).collect()) == 2


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    for n_x, n_y, both in ((10, 12, 9), (100, 90, 85), (1000, 1024, 990), (70, 200, 60), (1, 1, 0)):
        pool = rng.integers(0, 2 ** 63, n_x + n_y - both, dtype=np.uint64)
        x, y = pool[:n_x], pool[n_x - both:]
        assert unequal_bits(bitmap(x), bitmap(y)) <= n_x + n_y - 2 * both
    assert unequal_bits(bitmap(pool[:1]), bitmap(pool[:1])) == 0


def test_packed_slots_come_back():
    rng = np.random.default_rng(3)
    for n in (1, 50, 10_000):
        slots = np.sort(rng.integers(0, 2 ** 32, n, dtype=np.uint32))
        assert (_unpacked(_packed(slots)) == slots).all()
