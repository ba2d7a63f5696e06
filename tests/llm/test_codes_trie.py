"""Vector codes and the prefix trie against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from paneltide.llm.prefix_trie import find_close, prefix_trie
from paneltide.llm.vector_codes import PARTS, encode, nearest, slices


def test_nearest_is_the_first_of_the_nearest():
    rng = np.random.default_rng(4)
    for k, width, spread in ((64, 4, 20), (64, 3, 2), (5, 1, 300), (1, 2, 9)):
        book = rng.integers(-spread, spread + 1, (k, width))
        x = rng.integers(-2 * spread, 2 * spread + 1, (400, width))
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        index, best = nearest(x, slices(book))
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def expected_codes(rows, rounds=2):
    whole = [(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    picked = sorted((i, v) for i, _, v in whole if i is not None)
    whole = [(i, label, v) for i, label, v in whole if len(v) == len(picked[0][1])]
    picked = [(i, v) for i, v in picked if len(v) == len(picked[0][1])][:64]
    width = len(picked[0][1]) // PARTS
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v in picked] for p in range(PARTS)]

    def best(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(PARTS):
            own = {}
            for _, _, v in whole:
                own.setdefault(best(v, p)[1], []).append(cut(v, p))
            new.append([tuple(sum(x) // len(own[e]) for x in zip(*own[e])) if e in own else c
                        for e, c in enumerate(books[p])])
        books = new
    out, sums = [], {}
    for i, label, v in whole:
        found = [best(v, p) for p in range(PARTS)]
        error = sum(d for d, _ in found)
        sums[label] = sums.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, code, error, sums[label], sha) for i, code, error, label in out]


def vectors(n, size):
    r = random.Random(n)
    rows = [(i, [r.choice([-0.5, 0.1, 0.25, r.uniform(-1, 1)]) for _ in range(size)], r.choice([None, 1, 2]))
            for i in range(n)]
    nan, inf = float("nan"), float("inf")
    return [*rows, rows[3], (3, rows[4][1], 2), (n, None, 1), (n + 1, [nan] * size, 1), (n + 2, [inf] * size, None),
            (n + 3, [None] + [0.0] * (size - 1), 1), (None, rows[5][1], None), (n + 4, [0.5] * 8, 1),
            (n + 5, [], 1)]


KEY = lambda row: tuple((x is None, x) if x is not None else (True, 0) for x in row)


def test_codes_of_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, label int, code string"
    for n in (90, 20):
        rows = vectors(n, 32)
        table = spark.createDataFrame([(*r, "clash") for r in rows], schema).repartition(5)
        got = [tuple(r) for r in encode(table).collect()]
        assert sorted(got, key=KEY) == sorted(expected_codes(rows), key=KEY)
    empty = encode(table.where("vec_id is null"))
    assert empty.collect() == [] and empty.columns == encode(table).columns
    with pytest.raises(ValueError):
        encode(table.where("size(embedding) = 8"))


def test_find_close_on_random_trees():
    r = random.Random(2)
    for n in (1, 2, 40, 3000):
        bits, depth = [1], 1
        opened = 1
        while depth:
            if opened < n and (depth == 1 or r.random() < 0.55):
                bits.append(1)
                depth, opened = depth + 1, opened + 1
            else:
                bits.append(0)
                depth -= 1
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        assert find_close(np.array(bits, dtype=np.uint8)).tolist() == [close[i] for i in sorted(close)]
    deep = np.array([1] * 5000 + [0] * 5000, dtype=np.uint8)
    assert find_close(deep).tolist() == list(range(9999, 4999, -1))


def expected_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{role}\0{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t[2] for t in sorted(v)] for c, v in own.items()}
    members = {}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(built[c]) + 1):
            members.setdefault(built[c][:d], []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[:len(path)] == path]
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[:-1] == p for q in members)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(convs) if built[c] == path)
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
                    sum(len(p) == len(path) + 1 for p in below), sum(leaf(p) for p in below), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_trie_over_many_shards(spark):
    r = random.Random(9)
    rows = []
    for c in [*range(-12, 60), 10 ** 12, 10 ** 12 + 3]:
        for turn in range(r.randrange(1, 12)):
            rows.append((c, turn, r.choice(["user", "assistant", None]), r.choice(["", "hé", "yes", None])))
    rows += [(c, t, "user", f"the same {t}") for c in range(100, 160) for t in range(4)]
    rows += [(7, None, "user", "first"), (7, None, "user", "also first"), (None, 1, "user", "nobody"), rows[0]]
    table = spark.createDataFrame([(*x, "clash") for x in rows],
                                  "conv_id long, turn long, role string, text string, depth string")
    want = sorted(expected_trie(rows), key=KEY)
    for shard_turns in (10 ** 6, 40, 5):
        got = [tuple(x) for x in prefix_trie(table.repartition(4), shard_turns).collect()]
        assert sorted(got, key=KEY) == want
    assert prefix_trie(table.limit(0)).collect() == []
