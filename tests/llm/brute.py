"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def near_duplicates(rows, percent=85):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) with distinct ids."""
    sets, index = {}, defaultdict(list)
    for doc, text in rows:
        words = WORD.findall((text or "").encode().lower())
        if len(words) >= 5:
            sets[doc] = set(zip(*(words[i:] for i in range(5)), strict=False))
        else:
            sets[doc] = {tuple(words)} if words else set()
        for shingle in sets[doc]:
            index[shingle].append(doc)
    shared = Counter()
    for docs in index.values():
        docs = sorted(docs)
        shared.update((a, b) for i, a in enumerate(docs) for b in docs[i + 1 :])
    links = [
        (a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)
    ]
    found = components(sets, links)
    return {d: (len(s), found[d]) for d, s in sets.items()}


def substring_dedup(rows, window=35):
    """[(doc_id, n_words, n_removed, kept_sha256)] of (doc_id, text)."""
    texts = [(d, WORD.findall((t or "").encode())) for d, t in rows]
    counts = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for doc, words in texts:
        gone = set()
        for i in range(len(words) - window + 1):
            if counts[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
