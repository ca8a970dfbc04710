"""What the operators must return, the slow and plain way."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x] = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def targets(sizes):
    """Target words of sources in order: shares by weight 3, 1, 2, the excess over twice a size shared again."""
    w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), 1.5 * sum(sizes)
    while open_:
        total = sum(w[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if left * w[i] / total > 2 * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = 2.0 * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def substring(rows):
    """(n_words, n_removed, kept_sha256) of each (doc_id, text)."""
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w, gone = words(text), set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def near(rows):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) with distinct ids."""
    sets = {}
    for i, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    lists, union = defaultdict(list), Union(sets)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in lists[x] if j < i).items():
            if 100 * k >= 85 * (len(s) + len(sets[j]) - k):
                union.join(i, j)
    return {i: (len(s), union.find(i)) for i, s in sets.items()}


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def top(rows, k=10):
    """{query_id: [(vec_id, score)]}"""
    good = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            scored = [(-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def links(rows, least=0.95):
    """{vec_id: (n_links, component_id)} for distinct ids."""
    good = {i: np.array(v, float) for i, v in rows if usable(v) and any(v)}
    good = {i: v / np.abs(v).max() for i, v in good.items()}
    good = {i: v / np.linalg.norm(v) for i, v in good.items()}
    n, union = Counter(), Union([i for i, _ in rows])
    items = list(good.items())
    for a, (i, x) in enumerate(items):
        for j, y in items[:a]:
            if len(x) == len(y) and x @ y >= least:
                n[i] += 1
                n[j] += 1
                union.join(i, j)
    return {i: (n[i], union.find(i)) for i, _ in rows}


def secrets(text):
    """The base kinds, character by character."""
    out, n = [], len(text)
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def run(at, chars):
        while at < n and text[at] in chars:
            at += 1
        return at

    def assigned(at, name):
        """(where the value begins, where it ends) of an assignment to the name at a place."""
        k = at + len(name)
        k += k < n and text[k] in "\"'"
        k = run(k, " ")
        if k >= n or text[k] not in ":=":
            return None
        k = run(k + 1, " ")
        k += k < n and text[k] in "\"'"
        z = run(k, value)
        return (k, z) if z > k else None

    at = 0
    while at < n:
        names = [x for x in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(x, at)]
        got = assigned(at, names[0]) if names else None
        if got:
            if got[1] - got[0] >= 8:
                out.append(("assign", at, got[1]))
            at = got[1]
        else:
            at += 1
    for kind, lead, chars, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 16), ("hex", "", set("0123456789abcdef"), 32)):
        at = 0
        while at < n:
            z = run(at + len(lead), chars) if text.startswith(lead, at) else at
            if z > at + len(lead):
                if z - at >= least:
                    out.append((kind, at, z))
                at = z
            else:
                at += 1
    return out
