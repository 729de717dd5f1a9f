"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

The CGK random walk reads a word sequence with a pointer: at each step it writes the word
under the pointer and a random bit of (walk, step, word) decides whether the pointer moves on.
Sequences at a small edit distance give outputs at a small Hamming distance, so windows and
items that agree at a few sampled steps are candidates.  For each length class, ``plan`` tries
edited random passages at the full edit budget (words left out, put in, exchanged, and one cut
of neighbours) and takes the first walks and sampled steps that find ``TARGET`` of each kind.
A class for which none does, as all of longer items, is searched without the walk: every window
and item that share as many word n-grams as an item must keep are candidates, so none is lost.
Every candidate is then checked by the exact edit distance in words between the item and the
window's best ending.

Windows start at every word and have the size of the items of their length class.  A window is
embedded only if enough of its word trigrams occur in the benchmark (with at most k edits an
item of n words keeps n - 2 - 3k of its trigrams) and it begins with one of the first k + 1
words of an item (an edit at the front can be read as words left out), so none is lost.

Items go to the tasks in blocks of at most ``BLOCK_ITEMS`` items of bounded length; every block
is one pass over the documents, whatever the size of the benchmark.

Defined cases: words are maximal runs of letters and digits, compared in lower case; items
without words match nothing; null and empty texts hold no window; the best window counts for
each row and item; empty tables give no rows; other columns are ignored by ``find_passages``
and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import identified, mix, prefix_hash, slices, span_hash, table
from tidegate.llm.registry import query

SIMILARITY = 0.8
TARGET, TRIALS = 0.99, 400
PLANS = ((6, 3), (6, 2), (12, 2))  # walks and sampled steps, cheapest first; one step would meet every common word
SAMPLES = 10
EDIT_KINDS = ("out", "in", "other", "cut")
POSTINGS = 2_000_000  # shared grams held at once
CLASS_RATIO = 1.25
GRAM = 3
BLOCK_ITEMS = 20_000

# letters, digits and all bytes beyond ASCII are kept, everything else parts words
_KEEP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints of all texts and the first word of each (n + 1)."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer((b" " + b" ".join(parts) + b" ").translate(_KEEP), np.uint8)
    space = data == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    first = 1 + np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)])
    return span_hash(prefix_hash(data), start, end), np.searchsorted(start, first)


def edits(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of the ``size`` words from each word on; shorter at the end of the array."""
    out = h[: max(0, len(h) - size + 1)].copy()
    for k in range(1, size):
        out = mix(out * np.uint64(3)) + h[k: k + len(out)]
    return out


def embed(rows: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """CGK outputs of word rows (one sequence a row, 0 beyond its end): one column a step."""
    n, width = rows.shape
    pointer, line = np.zeros(n, np.int64), np.arange(n)
    out = np.empty((n, steps), np.uint64)
    for j in range(steps):
        word = np.where(pointer < width, rows[line, np.minimum(pointer, width - 1)], np.uint64(0))
        out[:, j] = word
        salt = np.uint64(((walk * 4096 + j + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        pointer += (((word ^ salt) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)).astype(np.int64)
    return out


def walk_steps(width: int) -> int:
    """Steps of a walk: later ones mostly write the end and tell nothing apart."""
    return width + (width + 1) // 2


def signatures(out: np.ndarray, walk: int, width: int, sampled: int) -> Iterator[np.ndarray]:
    """Keys from sampled steps."""
    r = np.random.default_rng([walk, width])
    for s in range(SAMPLES):
        at = np.sort(r.choice(out.shape[1], min(sampled, out.shape[1]), replace=False))
        key = np.full(len(out), s + SAMPLES * walk, np.uint64)
        for a in at:
            key = mix(key * np.uint64(3) + out[:, a])
        yield key


def edited(item: np.ndarray, k: int, kind: str, r: np.random.Generator) -> np.ndarray:
    """The item after k edits of one kind at random places, from its first kept word on."""
    n = len(item)
    fresh = lambda: r.integers(1, 1 << 63, k).astype(np.uint64)
    if kind == "in":
        return np.insert(item, r.integers(1, n + 1, k), fresh())
    at = r.integers(0, n - k + 1) + np.arange(k) if kind == "cut" else r.choice(n, k, replace=False)
    if kind != "other":
        return np.delete(item, at)
    out = item.copy()
    out[at] = fresh()
    return out[np.flatnonzero(out == item)[0]:]


@lru_cache(maxsize=None)
def plan(low: int, high: int, similarity: float) -> tuple[int, int] | None:
    """The first of PLANS that finds TARGET of the passages of every kind of edit in a class, or None."""
    cases = [(n, kind) for n in {low, high} for kind in EDIT_KINDS if edits(n, similarity)]
    left = list(PLANS)
    for n, kind in cases:
        r = np.random.default_rng([n, low])
        items, windows = np.zeros((2, TRIALS, low), np.uint64)
        for a, b in zip(items, windows):
            item = r.integers(1, 1 << 63, n).astype(np.uint64)
            a[:] = item[:low]
            text = edited(item, edits(n, similarity), kind, r)[:low]
            b[:] = r.integers(1, 1 << 63, low).astype(np.uint64)  # the text goes on after the passage
            b[: len(text)] = text
        while left:
            walks, sampled = left[0]
            found = np.zeros(TRIALS, bool)
            for walk in range(walks):
                pair = [signatures(embed(x, walk, walk_steps(low)), walk, low, sampled) for x in (items, windows)]
                for x, y in zip(*pair):
                    found |= x == y
            if found.mean() >= TARGET:
                break
            left.pop(0)
        if not left:
            return None
    return left[0] if left else PLANS[0]


def distances(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of the item to a beginning of each window, and that beginning's length."""
    n, width = windows.shape
    column = np.arange(width + 1, dtype=np.int16)
    d = np.repeat(column[None], n, 0)
    for i, word in enumerate(item):
        new = np.empty_like(d)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(d[:, 1:] + 1, d[:, :-1] + (windows != word))
        d = np.minimum.accumulate(new - column, axis=1) + column
    end = d.argmin(1)
    return d[np.arange(n), end], end


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n following places from each start on."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


class Benchmark:
    """The signatures of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float = SIMILARITY):
        h, first = sequences([t for _, t in items]) if items else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self.items = [(i, h[a:b]) for (i, _), a, b in zip(items, first, first[1:]) if b > a]
        self.similarity, self.classes, self.grams = similarity, [], {}
        by_size = sorted(self.items, key=lambda x: len(x[1]))
        self.items = by_size
        at = 0
        while at < len(by_size):
            low = len(by_size[at][1])
            end = at
            while end < len(by_size) and len(by_size[end][1]) <= max(low, int(low * CLASS_RATIO)):
                end += 1
            self.classes.append(self.group(at, end))
            at = end
        for c in self.classes:
            sets = [grams(w, c["gram"]) for _, w in by_size[c["from"]:c["to"]]]
            self.grams.setdefault(c["gram"], []).extend(sets)
        self.grams = {g: np.sort(np.concatenate(x)) for g, x in self.grams.items()}

    def group(self, at: int, end: int) -> dict:
        sizes = [len(w) for _, w in self.items[at:end]]
        low, high = sizes[0], sizes[-1]
        keep = {g: min(n - g + 1 - edits(n, self.similarity) * g for n in sizes) for g in range(1, GRAM + 1)}
        gram = max((g for g in keep if keep[g] >= 1), default=1)
        rows = np.zeros((end - at, low), np.uint64)
        for r, (_, w) in zip(rows, self.items[at:end]):
            r[:] = w[:low]
        heads = [w[: edits(len(w), self.similarity) + 1] for _, w in self.items[at:end]]
        out = {"from": at, "to": end, "low": low, "reach": high + edits(high, self.similarity), "gram": gram,
               "least": max(1, keep[gram]), "heads": np.sort(np.concatenate(heads)), "plan": plan(low, high, self.similarity)}
        if out["plan"] is None:
            return out | self.shared(at, heads, gram)
        keys, owner = [], []
        for walk in range(out["plan"][0]):
            for key in signatures(embed(rows, walk, walk_steps(low)), walk, low, out["plan"][1]):
                keys.append(key)
                owner.append(np.arange(at, end))
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(keys, kind="stable")
        return out | {"keys": keys[order], "owner": owner[order]}

    def shared(self, at: int, heads: list[np.ndarray], gram: int) -> dict:
        """Which items hold each gram and how often, how many grams an item keeps, and what it can begin with."""
        lists = [np.unique(grams(w, gram), return_counts=True) for _, w in self.items[at: at + len(heads)]]
        keys, times = (np.concatenate(x) for x in zip(*lists))
        owner = np.repeat(np.arange(len(lists)), [len(k) for k, _ in lists])
        order = np.argsort(keys, kind="stable")
        need = [max(1, len(w) - gram + 1 - edits(len(w), self.similarity) * gram) for _, w in self.items[at: at + len(heads)]]
        begin = [mix(h + np.uint64(i)) for i, h in enumerate(heads)]
        return {"keys": keys[order], "owner": owner[order], "times": times[order], "need": np.array(need), "begin": np.sort(np.concatenate(begin))}

    def find(self, texts: list[str]) -> list[tuple[int, int | None, int, int, int]]:
        """(text, item, first word, words, distance) of the best window of every text and item."""
        h, first = sequences(texts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not len(h) or not self.items:
            return []
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        stop = first[1:][doc]
        hits = {}
        for size, known in self.grams.items():
            g = grams(h, size)
            seen = np.zeros(len(h) + 1, np.int64)
            inside = doc[: len(g)] == doc[size - 1:] if len(g) else np.zeros(0, bool)
            found = inside & (known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g)
            seen[1: len(g) + 1] = found
            np.cumsum(seen, out=seen)
            seen[len(g) + 1:] = seen[len(g)]
            hits[size] = seen
        for c in self.classes:
            seen = hits[c["gram"]]
            end = np.minimum(np.arange(len(h)) + c["reach"], stop)
            starts = np.flatnonzero(seen[end] - seen[:-1] >= c["least"])
            heads = c["heads"]
            starts = starts[heads[np.minimum(np.searchsorted(heads, h[starts]), len(heads) - 1)] == h[starts]]
            for at in range(0, len(starts), 8192):
                self.compare(c, h, stop, starts[at: at + 8192], doc, first, best)
        return [(d, self.items[i][0], s, n, k) for (d, i), (k, s, n) in sorted(best.items())]

    def near(self, c, h, starts, rows) -> np.ndarray:
        """Pairs (item, line) that agree at the sampled steps of a walk."""
        pairs = []
        walks, sampled = c["plan"]
        for walk in range(walks):
            for key in signatures(embed(rows[:, : c["low"]], walk, walk_steps(c["low"])), walk, c["low"], sampled):
                left, right = np.searchsorted(c["keys"], key, "left"), np.searchsorted(c["keys"], key, "right")
                hit = np.flatnonzero(right > left)
                n = (right - left)[hit]
                item = c["owner"][spread(left[hit], n)]
                pairs.append(item * np.int64(len(starts)) + np.repeat(hit, n))
        return np.unique(np.concatenate(pairs))

    def sharing(self, c, h, starts, rows) -> np.ndarray:
        """Pairs (item, line) that share the grams an item must keep, the window beginning with a first word of the item."""
        size, out = c["gram"], []
        g = grams(rows.ravel(), size)
        g = np.concatenate([g, np.zeros(rows.size - len(g), np.uint64)]).reshape(rows.shape)[:, : rows.shape[1] - size + 1]
        g = np.sort(g, axis=1)
        new = np.ones(g.shape, bool)
        new[:, 1:] = g[:, 1:] != g[:, :-1]  # a gram counts once a window
        line, _ = place = np.nonzero(new)
        key = g[place]
        left, right = np.searchsorted(c["keys"], key, "left"), np.searchsorted(c["keys"], key, "right")
        hit = np.flatnonzero(right > left)
        line, left, n = line[hit], left[hit], (right - left)[hit]
        total = np.bincount(line, n, len(starts)).cumsum()
        part = (total // POSTINGS).astype(np.int64)  # runs of windows of bounded work; one window is never cut
        for p in np.unique(part[line]):
            own = part[line] == p
            at = spread(left[own], n[own])
            pair = c["owner"][at] * np.int64(len(starts)) + np.repeat(line[own], n[own])
            pair, back = np.unique(pair, return_inverse=True)
            held = np.bincount(back, c["times"][at], len(pair))
            item = pair // len(starts)
            pair = pair[held >= c["need"][item]]
            item, first = pair // len(starts), pair % len(starts)
            begin = mix(h[starts[first]] + item.astype(np.uint64))
            known = c["begin"]
            pair = pair[known[np.minimum(np.searchsorted(known, begin), len(known) - 1)] == begin]
            out.append(pair + c["from"] * np.int64(len(starts)))
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def compare(self, c, h, stop, starts, doc, first, best) -> None:
        place = starts[:, None] + np.arange(c["reach"])
        rows = np.where(place < stop[starts][:, None], h[np.minimum(place, len(h) - 1)], np.uint64(0))
        pairs = (self.sharing if c["plan"] is None else self.near)(c, h, starts, rows)
        item, line = pairs // max(1, len(starts)), pairs % max(1, len(starts))
        edge = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else []
        for a, b in zip(edge, [*edge[1:], len(item)]):
            words = self.items[item[a]][1]
            k = edits(len(words), self.similarity)
            at = line[a:b]
            d, n = distances(words, rows[at][:, : len(words) + k])
            for x in np.flatnonzero(d <= k):
                s = int(starts[at[x]])
                key = (int(doc[s]), int(item[a]))
                value = (int(d[x]), s - int(first[doc[s]]), int(n[x]))
                if key not in best or value < best[key]:
                    best[key] = value


def blocks(benchmark: DataFrame, similarity: float = SIMILARITY) -> Iterator[Benchmark]:
    """The items in blocks of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    n = -(-items.count() // BLOCK_ITEMS)
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield Benchmark([(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()], similarity)


RESULT = "doc_id long, item_id long, first_word long, words long, distance long"


def find_passages(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document row and item it holds: where, and the edit distance in words."""
    texts, out = identified(docs), None
    for block in blocks(benchmark, similarity):
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch, parts in slices(batches):
                found = block.find([t.decode("utf-8", "surrogatepass") for t in parts])
                ids = batch.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[x[0]] for x in found], pa.int64()), *[pa.array([x[k] for x in found], pa.int64()) for k in range(1, 5)]],
                    [c.split()[0] for c in RESULT.split(", ")])

        part = texts.mapInArrow(run, RESULT)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows, with all their columns, that hold no passage of the benchmark."""
    for block in blocks(benchmark, similarity):
        @F.pandas_udf("boolean")
        def holds(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in texts:
                out = np.zeros(len(part), bool)
                at = 0
                for run, data in slices(iter([pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["text"])])):
                    for x in block.find([t.decode("utf-8", "surrogatepass") for t in data]):
                        out[at + x[0]] = True
                    at += len(data)
                yield pd.Series(out)

        docs = docs.where(~holds(F.coalesce("text", F.lit(""))))
    return docs


@query("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    """Benchmark passages in all documents."""
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
