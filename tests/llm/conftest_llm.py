"""Plain versions that tests compare with."""

import re

ASCII_LOWER = {c: chr(c + 32) for c in range(65, 91)}


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))


def plain_shingles(text, size):
    w = plain_words(text)
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def smallest(ids, links):
    """The smallest id reachable from each row."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(least.get(root(i), x), x)
    return [least.get(root(i)) for i in range(len(ids))]
