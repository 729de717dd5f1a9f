"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c lie at squared distance T = 2 - 2c.  After a fixed random rotation the
coordinates are split into blocks of few dimensions, and a block is cut at the mean of each of its
coordinates, one after another: a vector's sides of the cuts are the code of its cell.  Where two
vectors lie on different sides of a cut, their distance there is at least the sum of both distances
to the cut.  Each vector x shares T / 2 among the blocks, h_b(x) in block b.  A pair within T is within
h_b(x) + h_b(y) in at least one block, and there the squared distances to the cuts between the two add up
to h_b at most for one of them.  So each vector probes the cells that it reaches with h_b, walking
down the cuts, and every pair within T is found.  It is counted only in the first block it is
within, from the vector whose sum exceeds its h_b least (of equal ones: the smaller id).  Any shares find the
same pairs; a vector spends less in blocks where it is near many cuts and would reach many cells.

Vectors are written once and never copied to cells.  A task takes the vectors in a range of cells
of one block as targets (``RANGE_BYTES`` at most; fuller cells are dealt over tasks) and reads
the written vectors past them.  Blocks are compared by matrix products, what passes by all blocks'
distances; a pair closer to the limit than these are exact is judged by the cosine of the given
vectors in double precision.  A task returns one row per linked node (how many vectors it links
there, and a node it hangs together with), never pairs.  Equal vectors are one node.

Defined cases: vectors that are null, zero, or hold null or non-finite numbers link with nothing
and are returned with themselves as component; vectors link only among their own length; repeated
rows are vectors of their own and link with each other; a null id is no smallest id; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import groupby
from math import ceil, log2
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.llm.common import release, table
from tidegate.llm.components import components
from tidegate.llm.registry import query
from tidegate.llm.tokenfile import opened
from tidegate.session import scratch, stage_table

COSINE = 0.95
DIMENSIONS = 16          # of a block
CELL_ROWS = 256          # targets that are compared without a further cut
RANGES, RANGE_ROWS = 16, 4096
RANGE_BYTES = 3 << 25    # of the targets of a task
PROBE_BYTES = 1 << 25    # of the probes that walk down together
PENDING_BYTES = 1 << 25
WRITE_BYTES = 1 << 22    # of the coordinates in a batch of a file
MEET = 1 << 18           # pairs in a matrix product
PAIRS = 1 << 13          # pairs looked at together
DENSE = 1 << 12          # probes times targets from which many close pairs are counted by matrix products
SLACK = 4e-6             # of a squared distance in a block: more than the written coordinates are off
ROUGH = 2e-5             # of a squared distance from 32-bit sums
NEAR = 2e-6              # of the limit: closer pairs are judged by the given vectors
FOUND = "id long, links long, root long"
LAID = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("turned", pa.binary()), ("reach", pa.binary()), ("raw", pa.binary())])


def rotation(n: int, seed: int = 11) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, n]).normal(size=(n, n)))
    return q * np.sign(np.diag(r))


def spans(n: int) -> list[tuple[int, int]]:
    """Blocks of coordinates."""
    count = max(1, round(n / DIMENSIONS))
    edge = [round(i * n / count) for i in range(count + 1)]
    return list(zip(edge, edge[1:]))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array, kind: str, n: int) -> np.ndarray:
    """Rows of a binary column that hold n numbers each, without a copy."""
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32, 1, 4 * column.offset)[0]
    return np.frombuffer(data, kind, len(column) * n, first).reshape(-1, n)


def binary(x: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix."""
    offsets = np.arange(0, x.nbytes + 1, x.nbytes // len(x), dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def numbers(vectors: DataFrame) -> tuple[DataFrame, str]:
    """Rows with the bytes of their vector (null where it cannot link), and the number format of these."""
    double = not isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind = "<f8" if double else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), kind)  # a null number is NaN
            start, raw = np.cumsum(size) - size, [None] * len(size)
            for n in sorted(set(size.tolist()) - {0}):
                at = np.flatnonzero(size == n)
                x = flat[start[at][:, None] + np.arange(n)]
                with np.errstate(all="ignore"):
                    norm = np.linalg.norm(x.astype(np.float64), axis=1)
                for i, row in zip(at.tolist(), x + 0.0):  # -0.0 is 0.0
                    raw[i] = row
                for i in at[~(np.isfinite(norm) & (norm > 0))].tolist():
                    raw[i] = None
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([None if r is None else r.tobytes() for r in raw], pa.binary())], ["vec_id", "raw"])

    element = "double" if double else "float"
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    return out.mapInArrow(run, "vec_id long, raw binary"), kind


class Layout:
    """Blocks of the vectors of one length, where they are cut, and how far a vector reaches in each."""

    def __init__(self, n: int, count: float, centre: np.ndarray, spread: np.ndarray, cosine: float):
        self.n, self.cosine, self.limit = n, cosine, 2 - 2 * cosine
        self.edges = spans(n)
        self.order = np.concatenate([a + np.argsort(-spread[a:b], kind="stable") for a, b in self.edges])  # the widest first
        self.centre = centre[self.order]
        self.cuts = ceil(log2(max(2, count / CELL_ROWS)))
        self.share = np.array([self.limit / 2 * (b - a) / n for a, b in self.edges])
        self.scale = max(1e-12, min(0.6 * spread.mean(), 0.75 * self.share.mean()))
        self.top = min(16, *(b - a for a, b in self.edges))  # bits of a code that are counted

    def place(self, units: np.ndarray) -> np.ndarray:
        """Rotated coordinates around the cuts, block by block, in the order of their cuts."""
        return ((units @ rotation(self.n))[:, self.order] - self.centre).astype("<f4")

    def reach(self, x: np.ndarray) -> np.ndarray:
        """Squared distance that a vector reaches in each block: less where it is near many cuts, so that it reaches as many cells in each."""
        x = x.astype(np.float64)
        near = np.stack([np.log1p(np.exp(-x[:, a: min(b, a + self.cuts)] ** 2 / self.scale)).sum(1) for a, b in self.edges], 1)
        return (self.share + self.scale * (near.mean(1, keepdims=True) - near)).astype("<f4")

    def code(self, x: np.ndarray, block: int, bits: int) -> np.ndarray:
        """Sides of the first cuts of a block."""
        a, _ = self.edges[block]
        return ((x[:, a: a + bits] >= 0) @ (2.0 ** np.arange(bits)[::-1])).astype(np.int64)


def by_length(column: pa.Array, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and numbers of the rows of each length."""
    size = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)) // np.dtype(kind).itemsize
    for n in sorted(set(size.tolist())):
        at = np.flatnonzero(size == n)
        yield n, at, matrix(column if len(at) == len(size) else column.take(pa.array(at)), kind, n)


def layouts(raws: DataFrame, kind: str, cosine: float) -> dict[int, Layout]:
    """The layout of each length, from number, sum and sum of squares of every coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, _, x in by_length(batch.column("raw"), kind):
                x = unit(x) @ rotation(n)
                sums[n] = sums.get(n, 0) + np.stack([np.full(n, len(x)), x.sum(0), (x * x).sum(0)])
        for n, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, n, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, x)], ["size", "dim", "n", "s", "q"])

    rows: dict[int, dict[int, tuple]] = {}
    sums = raws.where("raw IS NOT NULL").select("raw").mapInArrow(run, "size int, dim int, n double, s double, q double")
    for r in sums.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect():
        rows.setdefault(r["size"], {})[r.dim] = (r.n, r.s, r.q)  # as many rows as a vector has coordinates, for each length
    out = {}
    for n, own in sorted(rows.items()):
        count, s, q = np.array([own[i] for i in range(n)]).T
        out[n] = Layout(n, count[0], s / count, np.maximum(0, q / count - (s / count) ** 2), cosine)
    return out


def written(classes: DataFrame, kind: str, plan: dict[int, Layout], folder: str) -> DataFrame:
    """Writes the vectors to files that tasks read in part; a row for each says where it is, and the sides of its first cuts in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        name, count, parts = f"{uuid4().hex}.arrow", TaskContext.get().partitionId() << 33, 0  # a task that is run again writes another file; only rows name files
        held: dict[int, list] = {}

        def put(n: int) -> pa.RecordBatch:
            nonlocal count, parts
            raw, many, least = (pa.concat_arrays(z) for z in zip(*held.pop(n)))
            layout, given = plan[n], matrix(raw, kind, n)
            x = layout.place(unit(given))
            ids = pa.array(np.arange(count, count + len(x)))
            file.write_batch(pa.RecordBatch.from_arrays([ids, many, binary(x), binary(layout.reach(x)), raw], schema=LAID))
            sides = np.stack([layout.code(x, k, layout.top) for k in range(len(layout.edges))], 1).astype(np.int32)
            out = pa.RecordBatch.from_arrays([
                ids, pa.array([md5(r).digest() for r in given], pa.binary()), many, least, pa.array([name] * len(x)), pa.array(np.full(len(x), parts, np.int32)),
                pa.array(np.full(len(x), n, np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, sides.size + 1, sides.shape[1], dtype=np.int32)), pa.array(sides.ravel()))],
                ["id", "node", "n", "least", "file", "part", "size", "sides"])
            count, parts = count + len(x), parts + 1
            return out

        with store.open_output_stream(f"{root}/{name}") as sink, pa.ipc.new_file(sink, LAID) as file:
            for batch in batches:
                for n, at, _ in by_length(batch.column("raw"), kind):
                    own = batch.take(pa.array(at))
                    held.setdefault(n, []).append([own.column(c) for c in ("raw", "n", "least")])
                    if sum(len(z[0]) for z in held[n]) * 4 * n >= WRITE_BYTES:
                        yield put(n)
                if sum(len(z[0]) * 4 * n for n, y in held.items() for z in y) >= 8 * WRITE_BYTES:
                    yield from [put(n) for n in sorted(held)]
            yield from [put(n) for n in sorted(held)]
        release()

    return classes.select("raw", "n", "least").mapInArrow(run, "id long, node binary, n long, least long, file string, part int, size int, sides array<int>")


def ranges(classes: DataFrame, plan: dict[int, Layout]) -> list[tuple]:
    """What each task does: length, block, bits of the prefix, prefix, part, parts."""
    rows = {r["size"]: r.n for r in classes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    bits, most = {}, {}
    for n, count in rows.items():
        most[n] = min(max(CELL_ROWS, RANGE_BYTES // (4 * n + 4 * DIMENSIONS + 64)), max(RANGE_ROWS, ceil(count / RANGES)))
        if count > most[n]:
            bits[n] = min(plan[n].top, max(4, ceil(log2(count / most[n])) + 3))
    counts = {n: np.zeros((len(plan[n].edges), 1 << b), np.int64) for n, b in bits.items()}
    if bits:
        cut = F.create_map(*(F.lit(x) for n, b in bits.items() for x in (n, 1 << plan[n].top - b)))
        sides = classes.where(F.col("size").isin(list(bits))).select("size", F.posexplode("sides").alias("block", "side"))
        for r in sides.groupBy("size", "block", F.floor(F.col("side") / cut[F.col("size")]).alias("prefix")).agg(F.count("*").alias("n")).collect():
            counts[r["size"]][r.block, r.prefix] = r.n

    def cut_up(n: int, k: int, depth: int, prefix: int) -> Iterator[tuple]:
        left = bits[n] - depth
        count = int(counts[n][k, prefix << left: (prefix + 1) << left].sum())
        if count > most[n] and left:
            yield from cut_up(n, k, depth + 1, 2 * prefix)
            yield from cut_up(n, k, depth + 1, 2 * prefix + 1)
        elif count:
            parts = ceil(count / most[n])
            yield from ((n, k, depth, prefix, part, parts) for part in range(parts))

    return [x for n in rows for k in range(len(plan[n].edges)) for x in (cut_up(n, k, 0, 0) if n in bits else [(n, k, 0, 0, 0, 1)])]


def matched(classes: DataFrame, kind: str, plan: dict[int, Layout], folder: str) -> DataFrame:
    """(id, links, root) per task and linked node."""
    work, leaf = ranges(classes, plan), CELL_ROWS
    files: dict[int, list[tuple]] = {}
    for r in classes.groupBy("size", "file", "part").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("size", "lo").collect():  # a row for WRITE_BYTES of vectors
        files.setdefault(r["size"], []).append((r.file, r.part, r.lo, r.hi))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("id").to_pylist():
                n, *what = work[at]
                yield from Range(plan[n], *what, folder, files[n], kind, leaf).found()
                release()

    return classes.sparkSession.range(0, len(work), 1, max(1, len(work))).mapInArrow(run, FOUND)


class Probes:
    """Rows that walk down the cuts together."""

    def __init__(self, rows: list[tuple], a: int, b: int, block: int):
        self.all, self.reach, self.id, self.n = (np.concatenate(z) for z in zip(*rows))
        x = self.all[:, a:b]
        self.sides = np.ascontiguousarray(x.T)
        self.x = np.column_stack([x, np.ones(len(x), np.float32), (self.reach[:, block] - (x ** 2).sum(1)) / 2])
        self.links, self.first = np.zeros(len(self.id), np.int64), np.full(len(self.id), -1)


class Range:
    """The vectors in a range of cells of one block, and all that reach them."""

    def __init__(self, plan: Layout, block: int, depth: int, prefix: int, part: int, parts: int, folder: str, files: list[tuple], kind: str, leaf: int):
        self.plan, self.block, self.part, self.parts = plan, block, part, parts
        self.a, self.b = plan.edges[block]
        self.side = [bool(prefix >> (depth - 1 - i) & 1) for i in range(depth)]
        self.folder, self.files, self.kind, self.leaf = folder, files, kind, leaf
        self.pending: list[tuple] = []
        self.hits: list[tuple] = []
        self.held = 0
        self.product = np.empty(MEET, np.float32)

    def read(self, columns: list[str], wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """Batches of the vectors; of those that hold any of the ids (sorted), if given."""
        options = pa.ipc.IpcReadOptions(included_fields=[LAID.get_field_index(c) for c in columns], use_threads=False)
        for name, own in groupby(self.files, key=lambda z: z[0]):
            if wanted is not None:
                own = [z for z in own if np.searchsorted(wanted, z[2]) < np.searchsorted(wanted, z[3], "right")]
            if own := [z[1] for z in own]:
                store, root = opened(self.folder)
                with store.open_input_file(f"{root}/{name}") as f:
                    file = pa.ipc.open_file(f, options=options)
                    yield from map(file.get_batch, own)

    def rows(self) -> Iterator[tuple]:
        for batch in self.read(["id", "n", "turned", "reach"]):
            yield matrix(batch.column("turned"), "<f4", self.plan.n), matrix(batch.column("reach"), "<f4", len(self.plan.edges)), batch.column("id").to_numpy(), batch.column("n").to_numpy()

    def load(self) -> None:
        kept = []
        for rows in self.rows():
            every, _, ids, _ = rows
            at = np.arange(len(ids)) if self.parts == 1 else np.flatnonzero(ids % self.parts == self.part)
            for i, side in enumerate(self.side, self.a):
                at = at[(every[at, i] >= 0) == side]
            kept.append([z[at] for z in rows])
        self.all, self.reach, self.id, self.n = (np.concatenate([z.pop(0) for z in kept]) for _ in range(4))
        code = self.plan.code(self.all, self.block, self.b - self.a)
        order = np.argsort(code, kind="stable")
        self.code = code[order]
        for name in ("all", "reach", "id", "n"):
            setattr(self, name, getattr(self, name)[order])
        x = self.all[:, self.a: self.b]
        self.x = np.column_stack([x, (self.reach[:, self.block] - (x ** 2).sum(1)) / 2, np.ones(len(x), np.float32)])
        self.links, self.parent = np.zeros(len(self.id), np.int64), np.arange(len(self.id))

    def found(self) -> Iterator[pa.RecordBatch]:
        self.load()
        if not len(self.id):
            return
        held, size, most = [], 0, max(1, PROBE_BYTES // (4 * self.plan.n + 8 * (self.b - self.a) + 64))
        for rows in self.rows():
            left = rows[1][:, self.block]
            at = np.flatnonzero(left >= -ROUGH)
            left = left[at]
            for i, side in enumerate(self.side, self.a):
                z = rows[0][at, i]
                left = np.where((z >= 0) == side, left, left - z * z)
                keep = left >= -ROUGH
                at, left = at[keep], left[keep]
            if len(at):
                held.append([z[at] for z in rows])
                size += len(at)
            if size >= most:
                yield from self.probe(Probes(held, self.a, self.b, self.block))
                held, size = [], 0
        if held:
            yield from self.probe(Probes(held, self.a, self.b, self.block))
        yield from self.flush()
        at = np.flatnonzero(self.links)
        yield from self.batch(self.id[at], self.links[at], self.id[self.roots(at)])

    def batch(self, ids: np.ndarray, links: np.ndarray, roots: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(roots)], ["id", "links", "root"])

    def probe(self, p: Probes) -> Iterator[pa.RecordBatch]:
        bits = self.b - self.a
        stack = [(0, len(self.id), 0, np.arange(len(p.id)), p.reach[:, self.block])]
        while stack:
            lo, hi, level, at, left = stack.pop()
            if not len(at):
                continue
            if hi - lo <= self.leaf or level == bits:
                self.meet(p, at, lo, hi)
                if sum(len(z[0]) for z in self.pending) * self.plan.n * 16 > PENDING_BYTES:
                    yield from self.flush()
                continue
            low = bits - level - 1
            mid = lo + int(np.searchsorted(self.code[lo:hi], (self.code[lo] >> (low + 1) << (low + 1)) + (1 << low)))
            z = p.sides[level].take(at)
            above, less = z >= 0, left - z * z
            for c, d, off in ((lo, mid, above), (mid, hi, ~above)):
                if c < d:
                    there = np.where(off, less, left)
                    keep = np.flatnonzero(there >= -ROUGH)
                    stack.append((c, d, level + 1, at.take(keep), there.take(keep)))
        self.verify(p)
        at = np.flatnonzero(p.links)
        yield from self.batch(p.id[at], p.links[at], self.id[p.first[at]])

    def meet(self, p: Probes, at: np.ndarray, lo: int, hi: int) -> None:
        """Pairs that are in reach in this block."""
        least, wide = np.float32(-ROUGH), min(1024, MEET)
        for c in range(lo, hi, wide):
            d = min(hi, c + wide)
            others, step = self.x[c:d], max(1, MEET // (d - c))
            for k in range(0, len(at), step):
                own = at[k: k + step]
                product = np.matmul(others, p.x.take(own, 0).T, out=self.product[: len(own) * (d - c)].reshape(d - c, len(own)))
                some = np.flatnonzero(product.max(0) >= least)
                if len(some):
                    close, own = product.take(some, 1) >= least, own[some]
                    rows = np.flatnonzero(close.any(1))
                    if len(rows) * len(own) >= DENSE and np.count_nonzero(close) >= 0.2 * len(rows) * len(own):
                        i, j = self.crowd(p, own, c + rows)
                    else:
                        j, i = np.nonzero(close)
                        i, j = own[i], c + j
                    self.hits.append((i, j))
                    self.held += len(i)
                    if self.held >= PAIRS:
                        self.verify(p)

    def crowd(self, p: Probes, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts the pairs of many probes and targets that 32-bit sums decide; returns the others."""
        k, x, y, hx, hy = self.block, p.all[i], self.all[j], p.reach[i], self.reach[j]
        out, open_, total = np.zeros((len(i), len(j)), bool), np.zeros((len(i), len(j)), bool), np.float32(-self.plan.limit)

        def judge(far: np.ndarray, sign: int = 1) -> None:
            nonlocal out, open_
            out |= far > ROUGH if sign > 0 else far < -ROUGH
            open_ |= np.abs(far, out=far) <= ROUGH

        for at, (a, b) in enumerate(self.plan.edges):
            u, v = x[:, a:b], y[:, a:b]
            far = u @ (-2 * v).T
            far += (u * u).sum(1)[:, None]
            far += (v * v).sum(1)
            total = total + far
            if at <= k:  # within no earlier block, and within this one
                far -= hx[:, at, None]
                far -= hy[:, at]
                judge(far, 1 if at == k else -1)
        judge(total)
        a, b = self.plan.edges[k]
        u, v = x[:, a:b], y[:, a:b]
        up, over = (u >= 0).astype(np.float32), (v >= 0).astype(np.float32)
        apart = np.hstack([u * u * up, u * u * (1 - up), up, 1 - up]) @ np.hstack([1 - over, over, v * v * (over - 1), -v * v * over]).T
        apart -= hx[:, k, None]
        apart += hy[:, k]
        judge(apart)
        open_ &= ~out
        sure = ~(out | open_)
        some = np.flatnonzero(sure.any(1))
        if len(some):
            weight = sure.astype(np.float64)
            p.links[i] += (weight @ self.n[j]).astype(np.int64)
            self.links[j] += (p.n[i] @ weight).astype(np.int64)
            first, own = j[sure[some].argmax(1)], i[some]
            p.first[own] = np.where(p.first[own] < 0, first, p.first[own])
            self.join(p.first[own], first)
            roots = self.roots(j[sure.any(0)])
            if (roots != roots[0]).any():
                r, c = np.nonzero(sure)
                self.join(p.first[i[r]], j[c])
        r, c = np.nonzero(open_)
        return i[r], j[c]

    def verify(self, p: Probes) -> None:
        if not self.hits:
            return
        i, j = (np.concatenate(z) for z in zip(*self.hits))
        self.hits, self.held = [], 0
        other = p.id[i] != self.id[j]
        i, j = i[other], j[other]
        for k in range(0, len(i), PAIRS):
            self.decide(p, i[k: k + PAIRS], j[k: k + PAIRS])

    def decide(self, p: Probes, i: np.ndarray, j: np.ndarray) -> None:
        """Counts the pairs that belong to this block and side; keeps those near the limit."""
        m = self.b - self.a
        x, y = p.x[i, :m].astype(np.float64), self.x[j, :m].astype(np.float64)
        apart = (x >= 0) != (y >= 0)
        own = (x * x * apart).sum(1) - p.reach[i, self.block]
        other = (y * y * apart).sum(1) - self.reach[j, self.block]
        keep = (own < other) | (own == other) & (p.id[i] < self.id[j])
        i, j = i[keep], j[keep]
        gap = (p.all[i].astype(np.float64) - self.all[j]) ** 2
        reach = p.reach[i].astype(np.float64) + self.reach[j] + SLACK
        inside = np.stack([gap[:, a:b].sum(1) for a, b in self.plan.edges], 1) <= reach
        first = inside.any(1) & (inside.argmax(1) == self.block)
        over = gap.sum(1) - self.plan.limit
        near = first & (np.abs(over) <= NEAR)
        if near.any():
            self.pending.append((p.id[i[near]], p.n[i[near]], j[near]))
        sure = first & (over < -NEAR)
        i, j = i[sure], j[sure]
        np.add.at(p.links, i, self.n[j])
        np.add.at(self.links, j, p.n[i])
        p.first[i] = np.where(p.first[i] < 0, j, p.first[i])
        self.join(p.first[i], j)

    def join(self, first: np.ndarray, j: np.ndarray) -> None:
        """Targets j hang together with the targets first."""
        while True:
            a, b = self.roots(first), self.roots(j)
            apart = a != b
            if not apart.any():
                return
            first, j, a, b = first[apart], j[apart], a[apart], b[apart]
            self.parent[np.maximum(a, b)] = np.minimum(a, b)

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while ((further := self.parent[up]) != up).any():
            up = further
        self.parent[at] = up
        return up

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Judges the pairs near the limit by the given vectors."""
        if not self.pending:
            return
        ids, n, j = (np.concatenate(z) for z in zip(*self.pending))
        self.pending = []
        wanted = np.unique(np.concatenate([ids, self.id[j]]))
        x = np.zeros((len(wanted), self.plan.n))
        for batch in self.read(["id", "raw"], wanted):
            own = batch.column("id").to_numpy()
            at = np.searchsorted(wanted, own)
            has = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == own)
            if len(has):
                x[at[has]] = unit(matrix(batch.column("raw"), self.kind, self.plan.n)[has])
        near = np.concatenate([np.zeros(0, bool), *(
            np.einsum("ij,ij->i", x[np.searchsorted(wanted, ids[k: k + 65536])], x[np.searchsorted(wanted, self.id[j[k: k + 65536]])]) >= self.plan.cosine
            for k in range(0, len(ids), 65536))])
        ids, n, j = ids[near], n[near], j[near]
        if not len(ids):
            return
        own, back = np.unique(ids, return_inverse=True)
        links, first = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        np.add.at(links, back, self.n[j])
        np.add.at(self.links, j, n)
        first[back] = j
        self.join(first[back], j)
        yield from self.batch(own, links, self.id[first])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    raws, kind = numbers(vectors)
    folder = scratch(vectors.sparkSession, "laid")
    rows = stage_table(raws.select("vec_id", F.unhex(F.md5("raw")).alias("node")), "vectors")
    plan = layouts(raws, kind, cosine)
    classes = raws.where("raw IS NOT NULL").groupBy("raw").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = stage_table(written(classes, kind, plan, folder), "classes")
    found = stage_table(matched(classes, kind, plan, folder), "matches")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    # a vector without copies and links needs no more than its own row
    members = classes.select("id", "node", "n", "least").join(roots.withColumnRenamed("node", "id"), "id", "left").where(
        "root IS NOT NULL OR n > 1").withColumn("root", F.coalesce("root", "id"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    per_node = members.join(least, "root").join(counts, "id", "left").select(
        "node", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.join(per_node, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))


@query("op7_neardup")
def op7_neardup(spark, sf_dir):
    """All vectors."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
