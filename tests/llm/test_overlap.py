"""Near duplicates, decontamination and personal data against brute force."""

import hashlib
import random

import pytest
from brute import base_spans, components, contamination

from paneltide.llm import minhash_dedup
from paneltide.llm.components import connected_components, extended_components
from paneltide.llm.decontaminate import decontaminate
from paneltide.llm.minhash_dedup import near_duplicates
from paneltide.llm.pii import find_pii, redact

DOCS = "doc_id long, text string, node string, row string, component string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "n", "r", "c") for i, t in rows], DOCS)


def family(seed, n, edits, length=120):
    """One text and copies with a few words changed."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randrange(edits + 1)):
            copy[r.randrange(length)] = f"x{r.randrange(10 ** 6)}"
        out.append(" ".join(copy))
    return out


def cuts(seed, n, length=150):
    """One text, its beginnings and ends, some with a few words put in or left out."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(length)]
    out = [base]
    for _ in range(n):
        copy = base[r.randrange(length // 4):length - r.randrange(length // 4)]
        for _ in range(r.randrange(4)):
            at = r.randrange(len(copy))
            copy = copy[:at] + [f"x{r.randrange(9)}"] * r.randrange(2) + copy[at + r.randrange(3):]
        out.append(copy)
    return [" ".join(ws) for ws in out]


def near_cases():
    texts = [*cuts(5, 40), *cuts(6, 40, 80), *family(7, 60, 12, 150), *family(1, 30, 2), *family(2, 40, 6), *family(3, 3, 0), *family(4, 25, 10, 300),
             "", None, "one", "ONE", "one two", "one  two\n", "a b c", "É b c", "é b c", " \t\n"]
    ids = random.Random(0).sample(range(1000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("block", [minhash_dedup.BLOCK, 8])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)      # a small one: pairs of blocks
    rows = near_cases()
    docs = documents(spark, [*rows, rows[0], (None, "a b c"), (None, None)])
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows) + 3
    expected = components(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_one_id_with_several_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    got = near_duplicates(documents(spark, [(5, a), (5, b), (9, a), (7, b + " more"), (8, "else where")])).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {
        (5, 5, True), (9, 5, False), (7, 5, False), (8, 8, True)}


def test_no_documents(spark):
    assert near_duplicates(documents(spark, [(1, "")]).limit(0)).collect() == []
    assert near_duplicates(documents(spark, [(7, None)])).first().component_id == 7


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(i, 5) for i in range(20, 60)] + [(3, 3)]
    got = dict(connected_components(spark.createDataFrame(links, "u long, v long")).collect())
    assert all(got[i] == 100 for i in range(100, 161))
    assert all(got[i] == 5 for i in (5, *range(20, 60))) and 3 not in got


def test_decontamination_equals_brute_force(spark):
    r = random.Random(4)
    text = lambda n, k: " ".join(r.choice("ab cd é1 Z9 x y7".split()[:k]) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 9, 10, 11, 25]), 6)) for i in range(12)]
    items += [(50, None), (51, "..."), (52, items[0][1]), (None, "ab"), (53, items[4][1].upper())]
    docs = [(i, text(r.choice([0, 2, 12, 60]), 3 + i % 4)) for i in range(30)]
    docs += [(100, "q " + items[5][1] + ". " + items[3][1]), (101, None), (102, "-- ,"),
             (103, "w " * 3000 + items[5][1]), docs[0], (None, items[5][1])]
    got = decontaminate(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted((tuple(x)[:6] for x in got.collect()), key=key) == sorted(
        contamination(docs, items), key=key)
    none = decontaminate(documents(spark, docs), spark.createDataFrame([], "item_id long, text string"))
    assert not none.where("contaminated or n_hit > 0").count() and none.count() == len(docs)


PII_TEXTS = [
    "mail a.b@c.de and x@y.z_x@d.com, a@b, @b.c", "1.2.3.4.5 300.1.1.1 0255.1.1.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 5 4 3, 41111111111111111111111",
    "+1 (555) 123-4567. +49 30 12 +1  ", "", None, "é😀 x@y.zz é +1 555 000 1111", "1 2, 3-4" * 50,
    "4111111111111111@x.de", "." * 2000 + "@a.b", "9" * 3000]


def test_base_spans_equal_the_patterns(spark):
    rows = [(i, t) for i, t in enumerate(PII_TEXTS)] + [(0, PII_TEXTS[0]), (None, PII_TEXTS[1])]
    got = find_pii(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = base_spans(PII_TEXTS[r.doc_id if r.doc_id is not None else 1])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(k == kind for k, _, _ in spans) for kind in ("email", "ip", "card", "phone")]
    assert find_pii(documents(spark, rows).limit(0)).collect() == []


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(i, f"please call number +1 555 010 {1000 + i} now") for i in range(20)]
    seeds += [(40, "please call number 0555-0110-77 now"), (41, "room code 0555-0110-99 is free")]
    got = {r.doc_id: r for r in find_pii(documents(spark, seeds)).collect()}
    assert got[40].n_phone == 0 and got[40].spans == "phone:19:31"
    assert got[41].spans == ""
    hidden = {r.doc_id: r.text for r in redact(documents(spark, seeds)).collect()}
    assert hidden[0] == "please call number [PHONE] now" == hidden[40]
    assert hidden[41] == seeds[21][1]


def test_components_grow_by_later_links(spark):
    first = spark.createDataFrame([(1, 2), (5, 6), (8, 9)], "u long, v long")
    parts = spark.createDataFrame(connected_components(first).collect(), "node long, component long")
    more = spark.createDataFrame([(2, 6), (9, 8), (20, 5), (30, 31)], "u long, v long")
    got = dict(extended_components(parts, more).collect())
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 20: 1, 8: 8, 9: 8, 30: 30, 31: 30}
    assert dict(extended_components(parts, more.limit(0)).collect()) == dict(parts.collect())
