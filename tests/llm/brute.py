"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality(text):
    w = words(text)
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i:i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return {
        "n_words": len(w), "word_chars": sum(len(x.decode()) for x in w),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": dup, "n_repeat_words": len(covered),
        "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w),
    }


def substrings(rows, n=13):
    """rows: (doc_id, text); in the order of rows: n_words, n_removed, kept_sha256."""
    last = float("inf")
    first = {}
    for i, t in rows:
        w = words(t)
        i = last if i is None else i
        for k in range(len(w) - n + 1):
            key = tuple(w[k:k + n])
            first[key] = min(first.get(key, last), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < (last if i is None else i):
                gone.update(range(k, k + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near(rows):
    """rows: (doc_id, text) with distinct ids -> {doc_id: (n_shingles, component_id)}."""
    sets = {i: shingles(t) for i, t in rows}
    holders, union = defaultdict(list), Union()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = Counter()
    for ids in holders.values():
        ids.sort()
        for k, a in enumerate(ids):
            for b in ids[k + 1:]:
                pairs[a, b] += 1
    for (a, b), common in pairs.items():
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            union.join(a, b)
    return {i: (len(s), union.find(i)) for i, s in sets.items()}


def mixing_targets(sizes):
    """sizes: {source: words} -> {source: target}, by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}
