"""Slow and plain versions of what operators do, for small fixtures."""

import re

_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def word_list(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(_UPPER))


def shingle_set(text, n):
    w = word_list(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_components(rows, n, percent):
    """{doc_id: (n_shingles, component)} by all pairs."""
    sets = {i: shingle_set(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                r, s = sorted((root(a), root(b)))
                parent[s] = r
    return {i: (len(sets[i]), root(i)) for i in ids}
