"""Personal data by a semi-Markov conditional random field.

Plain patterns give the base spans.  A semi-Markov model then reads every region of a text
that holds digits or an at sign: each candidate segment (at most ``LONGEST`` tokens, with a
digit or at sign inside) is scored as a whole from its shape, checks and surroundings, and
dynamic programming chooses boundaries and types jointly.  Tokens outside regions can only
be outside any entity, so the chain factorises there exactly.

The model is fitted on at most ``FIT_REGIONS`` whole regions of at most ``FIT_TOKENS`` tokens,
taken in the order of a hash of document and place, with the base spans as labels (a silver
standard: no labelled table exists).  The fit runs on the driver on that bounded sample; the scan covers all texts.

Defined cases: null text is empty; offsets are code points, end exclusive; repeated rows give
repeated results; without any region, or on an empty table, nothing is added to the base.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import identified, table
from tidegate.llm.registry import query
from tidegate.llm.spans import SPAN, digest, ordered

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
LONGEST = 18
AROUND = 3        # tokens of context on either side of a region, at least
FIT_REGIONS = 600
FIT_TOKENS = 256  # fitted regions have at most so many tokens; scanned ones any number
EPOCHS = 6
BUCKETS = 1 << 14

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PIECE = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
CORE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; every candidate ends its local part at an at sign, so only those are visited."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *m) for m in emails(text)]
    out += [("ip", *m.span()) for m in ADDRESS.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens (start, end) around digits and at signs, with AROUND tokens on either side.

    Where the text goes on without a blank (the rest of an address), up to LONGEST tokens belong to the run.
    """
    held: list[tuple[int, int]] = []
    first = last = -1  # places in held of the first and the last token with a digit or at sign

    def edges() -> tuple[int, int]:
        i, j = first, last + 1
        while i > 0 and first - i < LONGEST and (first - i < AROUND or held[i - 1][1] == held[i][0]):
            i -= 1
        while j < len(held) and j - last <= LONGEST and (j - last <= AROUND or held[j - 1][1] == held[j][0]):
            j += 1
        return i, j

    for m in PIECE.finditer(text):
        held.append(m.span())
        c = text[m.start()]
        if c == "@" or "0" <= c <= "9":
            last = len(held) - 1
            first = last if first < 0 else first
        elif first < 0:
            if len(held) > LONGEST:
                held.pop(0)
        elif len(held) - last > LONGEST + AROUND:
            i, j = edges()
            yield held[i:j]
            held, first, last = held[j:][-LONGEST:], -1, -1
    if first >= 0:
        i, j = edges()
        yield held[i:j]


def shape(s: str) -> str:
    return "9" if "0" <= s[0] <= "9" else "a" if s[0].isalpha() else s[0]


def feature(name: str) -> int:
    """A hashed feature; independent of the process."""
    h = 2166136261
    for b in name.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h % BUCKETS


_features: dict[str, int] = {}


def known(name: str) -> int:
    x = _features.get(name)
    if x is None:
        x = feature(name)
        if len(_features) < 100_000:
            _features[name] = x
    return x


def describe(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Features of the whole segment tokens[i:j]."""
    start, end = tokens[i][0], tokens[j - 1][1]
    s = text[start:end]
    groups = re.findall(r"[0-9]+", s)
    d = "".join(groups)
    marks = "".join(sorted({c for c in s if not c.isalnum()}))
    before, after = text[start - 1:start], text[end:end + 1]
    left = "^" if not before else " " if before.isspace() else shape(before)
    right = "$" if not after else " " if after.isspace() else shape(after)
    names = [
        f"n{min(len(d), 20)}", f"g{min(len(groups), 6)}", f"m{marks}", f"f{shape(s)}", f"l{shape(s[-1])}",
        f"b{left}", f"e{right}", f"fb{shape(s)}{left}", f"le{shape(s[-1])}{right}", f"a{any(c.isalpha() for c in s)}",
        f"w{max(map(len, groups), default=0)}", f"mn{marks}{len(d)}",
    ]
    if 12 <= len(d) <= 19:
        names.append(f"luhn{luhn(d)}{marks}")
    if s.count(".") == 3 and len(groups) == 4:
        names.append(f"octets{all(map(octet, groups))}")
    if "@" in s:
        names.append(f"at{s.count('@')}{'.' in s[s.index('@'):]}{any(c.isspace() for c in s)}")
    return [known(x) for x in names]


def segments(text: str, tokens: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Candidate entities (first token, token after the last) and their features."""
    core = [0]
    for s, _ in tokens:
        core.append(core[-1] + (text[s] == "@" or "0" <= text[s] <= "9"))
    where, what = [], []
    for j in range(1, len(tokens) + 1):
        for i in range(max(0, j - LONGEST), j):
            if core[j] > core[i] and "\n" not in text[tokens[i][0]:tokens[j - 1][1]]:
                first, last = text[tokens[i][0]], text[tokens[j - 1][0]]
                if (first.isalnum() or first in "+(") and last.isalnum():
                    where.append((i, j))
                    what.append(describe(text, tokens, i, j))
    return where, what


class Model:
    """Weights of segment features by kind and of the kind before; a token outside scores zero."""

    def __init__(self, weights: np.ndarray | None = None, follow: np.ndarray | None = None):
        self.weights = np.zeros((BUCKETS, OUTSIDE)) if weights is None else weights
        self.follow = np.zeros((OUTSIDE + 1, OUTSIDE + 1)) if follow is None else follow

    def scores(self, what: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((x for f in what for x in f), np.int64)
        first = np.concatenate([[0], np.cumsum([len(f) for f in what])])[:-1].astype(np.int64)
        return np.add.reduceat(self.weights[flat], first, axis=0)

    def decode(self, n: int, where, scores) -> list[tuple[int, int, int]]:
        """The best segmentation: (first token, token after the last, kind)."""
        ending: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(where):
            ending.setdefault(j, []).append(k)
        best, back = np.full((n + 1, OUTSIDE + 1), -np.inf), {}
        best[0, OUTSIDE] = 0.0
        for j in range(1, n + 1):
            step = best[j - 1] + self.follow[:, OUTSIDE]
            p = int(step.argmax())
            best[j, OUTSIDE], back[j, OUTSIDE] = step[p], (j - 1, p)
            for k in ending.get(j, ()):
                i = where[k][0]
                before = best[i][:, None] + self.follow[:, :OUTSIDE]
                p = before.argmax(0)
                total = before[p, range(OUTSIDE)] + scores[k]
                for y in np.flatnonzero(total > best[j, :OUTSIDE]):
                    best[j, y], back[j, int(y)] = total[y], (i, int(p[y]))
        out, j, y = [], n, int(best[n].argmax())
        while j > 0:
            i, p = back[j, y]
            if y != OUTSIDE:
                out.append((i, j, y))
            j, y = i, p
        return out[::-1]

    def expectations(self, n: int, where, scores):
        """Log partition, the probability of every (segment, kind), and of every pair of neighbours."""
        starting: dict[int, list[int]] = {}
        ending: dict[int, list[int]] = {}
        for k, (i, j) in enumerate(where):
            starting.setdefault(i, []).append(k)
            ending.setdefault(j, []).append(k)
        alpha, beta = np.full((n + 1, OUTSIDE + 1), -np.inf), np.full((n + 1, OUTSIDE + 1), -np.inf)
        alpha[0, OUTSIDE], beta[n] = 0.0, 0.0
        lse = np.logaddexp.reduce
        for j in range(1, n + 1):
            alpha[j, OUTSIDE] = lse(alpha[j - 1] + self.follow[:, OUTSIDE])
            for k in ending.get(j, ()):
                into = lse(alpha[where[k][0]][:, None] + self.follow[:, :OUTSIDE], axis=0) + scores[k]
                alpha[j, :OUTSIDE] = np.logaddexp(alpha[j, :OUTSIDE], into)
        for i in range(n - 1, -1, -1):
            beta[i] = self.follow[:, OUTSIDE] + beta[i + 1, OUTSIDE]
            for k in starting.get(i, ()):
                out = self.follow[:, :OUTSIDE] + scores[k] + beta[where[k][1], :OUTSIDE]
                beta[i] = np.logaddexp(beta[i], lse(out, axis=1))
        z = lse(alpha[n])
        seen, pairs = np.zeros((len(where), OUTSIDE)), np.zeros_like(self.follow)
        for j in range(1, n + 1):
            pairs[:, OUTSIDE] += np.exp(alpha[j - 1] + self.follow[:, OUTSIDE] + beta[j, OUTSIDE] - z)
        for k, (i, j) in enumerate(where):
            p = np.exp(alpha[i][:, None] + self.follow[:, :OUTSIDE] + scores[k] + beta[j, :OUTSIDE] - z)
            pairs[:, :OUTSIDE] += p
            seen[k] = p.sum(0)
        return z, seen, pairs

    def find(self, text: str) -> list[tuple[str, int, int]]:
        out = []
        for tokens in regions(text):
            where, what = segments(text, tokens)
            if where:
                out += [(KINDS[y], tokens[i][0], tokens[j - 1][1])
                        for i, j, y in self.decode(len(tokens), where, self.scores(what))]
        return out


def target(text: str, tokens, spans) -> list[tuple[int, int, int]]:
    """Base spans that begin and end with tokens, longer ones first where they overlap."""
    start, end, taken, out = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}, set(), []
    for kind, s, e in sorted(spans, key=lambda x: (x[1] - x[2], x)):
        if s in start and e in end and end[e] - start[s] <= LONGEST:
            i, j = start[s], end[e]
            if not taken & set(range(i, j)):
                taken |= set(range(i, j))
                out.append((i, j, KINDS.index(kind)))
    return sorted(out)


def fit(sample: list[str], epochs: int = EPOCHS, rate: float = 0.2, decay: float = 1e-3) -> Model:
    """Maximum conditional likelihood with L2 decay by adaptive gradient steps, in a fixed order."""
    model, seen = Model(), []
    for text in sample:
        spans = base_spans(text)
        for tokens in regions(text):
            where, what = segments(text, tokens)
            gold = target(text, tokens, spans)
            if where and {(i, j) for i, j, _ in gold} <= set(where):
                rows, inverse = np.unique(np.fromiter((x for f in what for x in f), np.int64), return_inverse=True)
                size = np.array([len(f) for f in what])
                seen.append((len(tokens), where, gold, rows, inverse, size, np.concatenate([[0], np.cumsum(size)[:-1]])))
    gw, gf = np.full_like(model.weights, 1e-8), np.full_like(model.follow, 1e-8)
    for _ in range(epochs):
        for n, where, gold, rows, inverse, size, first in seen:
            scores = np.add.reduceat(model.weights[rows][inverse], first, axis=0)
            _, p, pairs = model.expectations(n, where, scores)
            p, at, last = -p, {s: k for k, s in enumerate(where)}, OUTSIDE
            pairs, inside = -pairs, {i: (j, y) for i, j, y in gold}
            i = 0
            while i < n:
                j, y = inside.get(i, (i + 1, OUTSIDE))
                if y != OUTSIDE:
                    p[at[i, j], y] += 1
                pairs[last, y] += 1
                i, last = j, y
            grad = np.zeros((len(rows), OUTSIDE))
            np.add.at(grad, inverse, np.repeat(p, size, axis=0))
            grad -= decay * model.weights[rows]
            gw[rows] += grad ** 2
            model.weights[rows] += rate * grad / np.sqrt(gw[rows])
            gf += pairs ** 2
            model.follow += rate * pairs / np.sqrt(gf)
    return model


def sample_regions(docs: DataFrame, limit: int = FIT_REGIONS) -> list[str]:
    """Snippets of at most ``limit`` whole regions of at most FIT_TOKENS tokens, first by hash of document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, out = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if CORE.search(text):
                    for tokens in regions(text):
                        if len(tokens) <= FIT_TOKENS:
                            ids.append(doc_id)
                            at.append(tokens[0][0])
                            out.append(text[max(0, tokens[0][0] - 1): tokens[-1][1] + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(out, pa.string())], ["doc_id", "at", "snippet"])

    found = identified(docs).mapInArrow(run, "doc_id long, at long, snippet string")
    first = found.withColumn("h", F.xxhash64("doc_id", "at", "snippet")).orderBy("h", "snippet").limit(limit)
    return [r.snippet for r in first.select("snippet").collect()]


def find_personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, base spans, and all spans: base plus what the model adds outside them."""
    model = model or fit(sample_regions(docs))
    used = np.flatnonzero(np.abs(model.weights).sum(1))
    weights, follow = model.weights[used], model.follow  # at most BUCKETS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros((BUCKETS, OUTSIDE))
        full[used] = weights
        crf = Model(full, follow)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            base, every = [], []
            for text in batch.column("text").to_pylist():
                plain, more = [], []
                if CORE.search(text):
                    plain = base_spans(text)
                    taken = merged(plain)
                    more = [x for x in crf.find(text) if not overlaps(taken, x[1], x[2])]
                base.append(ordered(plain, KINDS))
                every.append(ordered(plain + more, KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(base, kind), pa.array(every, kind)], ["doc_id", "base", "spans"])

    return identified(docs).mapInArrow(run, f"doc_id long, base {SPAN}, spans {SPAN}")


def merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the text that spans cover, ascending."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def overlaps(taken: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether the span meets covered text: the last cover that starts before its end decides."""
    k = bisect.bisect_left(taken[0], end) - 1
    return k >= 0 and taken[1][k] > start


@query("op4_pii")
def op4_pii(spark, sf_dir):
    """Personal data of all documents."""
    return digest(find_personal_data(table(spark, sf_dir, "documents")), KINDS)
