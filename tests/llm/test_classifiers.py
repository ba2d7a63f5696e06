"""Classifiers on planted texts: held-out accuracy and edges."""

import random
import zlib

import numpy as np

from paneltide.llm import quality, toxicity

COMMON = "the of and to in that is with for on as at by this from".split()


def corpus(spark, bad):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        words = [r.choice(COMMON) + r.choice(["", "", "ly", "er"]) for _ in range(r.randrange(20, 80))]
        marked = i % 4 == 0
        rows.append((i, bad(r, words) if marked else " ".join(words), 1.0))
        if i % 5:
            labels.append((i, int(marked)))
    odd = [(1000, "", 0.0), (1001, None, 0.0), (None, "the of", 0.0), (4, rows[4][1], 0.0),
           (1002, "word " * 30_000, 0.0)]
    return (spark.createDataFrame(rows + odd, "doc_id long, text string, score double"), labels)


def accuracy(got, marked_label, held_out):
    rows = [r for r in got if r.held_out == held_out and r.doc_id is not None and r.doc_id < 600]
    return np.mean([r.predicted == (marked_label if r.doc_id % 4 == 0 else 1 - marked_label)
                    for r in rows])


def test_toxicity_on_held_out_texts(spark):
    def insult(r, words):
        for _ in range(1 + len(words) // 20):
            words[r.randrange(len(words))] = r.choice(["idiot", "scum", "grobble", "you moron"])
        return " ".join(words)

    docs, labels = corpus(spark, insult)
    extra = [(0, 0), (None, 1), (1, None)]
    table = spark.createDataFrame(labels + extra, "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, table).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
               for r in got if r.doc_id is not None)
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    assert accuracy(got, 1, True) > 0.97 and accuracy(got, 1, False) > 0.97
    assert {r.predicted for r in got if r.doc_id in (1000, 1001, 1002)} == {0}
    none = toxicity.score_toxicity(docs, table.limit(0)).collect()
    assert len(none) == 605 and {r.score for r in none} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), table).collect() == []


def test_quality_on_held_out_texts(spark):
    docs, labels = corpus(spark, lambda r, words: " ".join(w.upper() + "###" for w in words))
    table = spark.createDataFrame([(i, 1 - y) for i, y in labels], "doc_id long, quality int")
    got = quality.score_quality(docs, table).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 for r in got)
    assert accuracy(got, 0, True) > 0.97
    none = quality.score_quality(docs, table.where("quality = 1")).collect()
    assert {r.score for r in none} == {1.0}
    assert quality.score_quality(docs.limit(0), table).collect() == []


def test_linear_time_score_equals_all_pairs():
    rng = np.random.default_rng(0)
    n = len(quality.STRUCTURE)
    size = n + quality.WORD_BUCKETS
    machine = quality.Machine(np.zeros(n), np.ones(n), 0.1, rng.normal(size=size) * 0.1,
                              rng.normal(size=(size, 3)) * 0.1)
    values, buckets, weights = next(quality.inputs(["some words and some words"]))
    x = {i: v for i, v in enumerate(quality._scaled(np.array(values), machine.mean, machine.deviation))}
    x |= {n + b: w for b, w in zip(buckets, weights)}
    keys = sorted(x)
    margin = 0.1 + sum(machine.linear[i] * x[i] for i in keys)
    margin += sum(machine.factors[i] @ machine.factors[j] * x[i] * x[j]
                  for a, i in enumerate(keys) for j in keys[a + 1:])
    assert abs(quality.machine_score(machine, values, buckets, weights)
               - 1 / (1 + np.exp(-margin))) < 1e-12


def test_quality_with_a_constant_structure_value(spark):
    rows = [(i, ("good words here " if i % 2 else "bad noise there ") * (3 + i % 5)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


def test_disguised_words_take_linear_time():
    import time

    start = time.perf_counter()
    toxicity.text_features("a" * 1_000_000 + " id1ot " + "a1" * 200_000, frozenset())
    assert time.perf_counter() - start < 5


def test_quality_inputs_equal_plain_counts_and_make_no_series(monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("a series of pandas for each text")

    texts = ["", " \n\t", "one", "Ab ab AB!\n\n ab AB ab\nab\x1cq $5.00", "x# y# z\x0b#\r\nx# y#\r\n",
             "é è Éé 名前 ¡!\nq\u2028w\n \u3000\nq w", "a b " * 700 + "\n" + "c" * 5000 + "~"]
    monkeypatch.setattr(quality.pd, "Series", refused)
    found = list(quality.inputs(texts))
    alone = [next(quality.inputs([t])) for t in texts]
    assert len(found) == len(texts)
    for text, (values, buckets, weights), one in zip(texts, found, alone, strict=True):
        assert values == one[0] and all((a == b).all() for a, b in zip((buckets, weights), one[1:], strict=True))
        raw, words = text.encode(), text.encode().lower().split()
        lines = [line for line in text.split("\n") if line.strip()]
        n, size = max(len(words), 1), max(len(raw), 1)
        got = dict(zip(quality.STRUCTURE, values, strict=True))
        share = {"capitals": sum(c in range(65, 91) for c in raw) / max(sum(bytes([c]).isalpha() for c in raw), 1),
                 "digits": sum(c in b"0123456789" for c in raw) / size,
                 "punctuation": sum(c in range(33, 48) or c in range(58, 65) for c in raw) / size,
                 "signs": sum(c in b"#$%&*@|~^_<>=+\\{}[]/" for c in raw) / size,
                 "exclamations": raw.count(b"!") / size,
                 "white": sum(c == 32 or 9 <= c < 14 for c in raw) / size,
                 "other_bytes": sum(c >= 128 for c in raw) / size,
                 "word_length": size / n, "word_kinds": len(set(words)) / n,
                 "top_word": max(map(words.count, words), default=0) / n,
                 "pair_kinds": len(set(zip(words, words[1:])) if len(words) > 1 else words) / n,
                 "line_kinds": max(len(set(lines)), 1) / max(len(lines), 1),
                 "top_line": max(map(lines.count, lines), default=1) / max(len(lines), 1),
                 "sign_ends": sum(w[-1:] in b"#$%&*@|~^!" for w in words) / n,
                 "chars": np.log1p(len(text)), "words": np.log1p(len(words)), "lines": np.log1p(len(lines))}
        assert got == share
        assert abs(np.linalg.norm(weights) - bool(words)) < 1e-12 and len(buckets) <= len(set(words))
