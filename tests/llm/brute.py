"""Plain-Python answers to compare the operators with."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
       "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+",
       "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def windows(item):
    w = words(item)
    n = min(10, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def contamination(docs, items):
    """[(doc_id, n_words, n_hit, n_items, sha256, contaminated)] of (id, text) rows."""
    out = []
    by_item = [(i, windows(t)) for i, t in items if i is not None]
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, own in by_item:
            for window in own:
                for at in range(len(w) - len(window) + 1):
                    if tuple(w[at:at + len(window)]) == window:
                        hit.update(range(at, at + len(window)))
                        found.add(str(item_id))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, bool(hit)))
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def components(docs, percent=85):
    """{doc_id: (n_shingles, component)} with every pair compared."""
    sets = {i: shingles(t) for i, t in docs if i is not None}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            both, one = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and both and both * 100 >= percent * one:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return True


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PII.items()
            for m in re.finditer(p, text or "") if _valid(k, m.group())]
