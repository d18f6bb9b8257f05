"""Brute-force versions of the operators, for small tables."""

import hashlib
from collections import defaultdict

SPACE = b" \t\n\r\x0b\x0c"
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def substring_dedup(docs, width):
    """docs: (doc_id, text). doc_id -> n_words, n_removed, digest."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, k):
    words = (text or "").encode().translate(UPPER).split()
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def jaccard_groups(docs, k, percent):
    """doc_id -> n_shingles, component_id."""
    sets = {d: shingles(t, k) for d, t in docs}
    lists = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            lists[x].append(d)
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            up[d] = up[up[d]]
            d = up[d]
        return d

    both = defaultdict(int)
    for own in lists.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                both[min(a, b), max(a, b)] += 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}
