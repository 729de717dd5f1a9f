"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of ``WIDTH`` bytes slide with step ``STEP`` over the whole
text; their responses are max-pooled inside overlapping chunks of two blocks (a block is
``BLOCK`` bytes, chunks advance by one block, so every byte lies in two chunks); a dense layer
turns a chunk's pooled responses into units, which are max-pooled over all chunks and combined
with their mean into one probability.

The network is fitted on the driver on a bounded sample of labelled rows: at most
``FIT_ROWS`` rows, half of each label as far as there are, first by a hash of the id, and of those,
in that order, the rows whose texts fit in ``FIT_BYTES`` together.  A row is taken with its whole
text or not at all.  Losses are weighted back to the true share of the labels, so the score is a
probability.  Scoring reads every byte of every document.  Filter responses are computed for
``RUN`` blocks at a time, in fitting and in scoring, so a long text takes little memory.

Defined cases: null and empty texts are scored like a block of padding; a document id with
several labels counts as good if most of them are; without usable labels every score is 0.5;
with labels of one kind only it is their smoothed share; repeated rows are scored alike; an
empty table gives no rows; other columns never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import fold, identified, slices, table
from tidegate.llm.registry import query
from tidegate.session import stage_table

WIDTH, STEP, BLOCK = 8, 4, 128
EMBED, FILTERS, UNITS = 8, 32, 24
PAD = 256
FIT_ROWS = 1200
FIT_BYTES = 32 << 20
RUN = 1024
EPOCHS = 14
THRESHOLD = 0.3
PER_BLOCK = BLOCK // STEP


def blocks_of(text: bytes) -> int:
    return max(1, -(-len(text) // BLOCK))


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded to whole blocks, and the number of blocks of each."""
    count = np.array([blocks_of(t) for t in texts])
    out = np.full(int(count.sum()) * BLOCK + WIDTH, PAD, np.int16)
    at = 0
    for t, n in zip(texts, count):
        out[at: at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * BLOCK
    return out, count


class Network:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (PAD + 1, EMBED)), "filters": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS), "dense": r.normal(0, FILTERS ** -0.5, (FILTERS, UNITS)), "unit": np.zeros(UNITS),
            "top": r.normal(0, UNITS ** -0.5, 2 * UNITS), "out": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Embedded bytes of every filter position."""
        e = self.p["embed"][x].reshape(-1)
        n = (len(x) - WIDTH) // STEP
        return np.lib.stride_tricks.as_strided(e, (n, WIDTH * EMBED), (STEP * EMBED * 4, 4))

    def blocks(self, x: np.ndarray, last: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Pooled responses of every block; with ``keep`` also the winning position in it.

        ``last`` are the last blocks of texts: their last position would read the next text and does not count.
        """
        n = (len(x) - WIDTH) // BLOCK
        block = np.empty((n, FILTERS), self.p["filters"].dtype)
        arg = np.empty((n, FILTERS), np.int8) if keep else None
        for at in range(0, n, RUN):
            end = min(n, at + RUN)
            h = (self.windows(x[at * BLOCK: end * BLOCK + WIDTH]) @ self.p["filters"]).reshape(-1, PER_BLOCK, FILTERS)
            h[last[(last >= at) & (last < end)] - at, -1] = -np.inf
            block[at:end] = np.maximum(h.max(1) + self.p["bias"], 0)
            if keep:
                arg[at:end] = h.argmax(1)
        return block, arg

    def forward(self, x: np.ndarray, count: np.ndarray, keep: bool = False):
        """Log-odds of each text; with ``keep`` also what the gradient needs."""
        last = np.cumsum(count) - 1
        first = np.concatenate([[0], last[:-1] + 1])
        block, arg = self.blocks(x, last, keep)
        after = np.minimum(np.arange(len(block)) + 1, np.repeat(last, count))
        chunk = np.maximum(block, block[after])
        unit = np.maximum(chunk @ self.p["dense"] + self.p["unit"], 0)
        top = np.maximum.reduceat(unit, first, axis=0)
        mean = np.add.reduceat(unit, first, axis=0) / count[:, None]
        z = np.concatenate([top, mean], 1) @ self.p["top"] + self.p["out"][0]
        return (z, arg, block, after, chunk, unit, top, mean, first) if keep else z

    def gradient(self, x, count, y, weight):
        z, arg, block, after, chunk, unit, top, mean, first = self.forward(x, count, True)
        p = self.p
        dz = (weight * (1 / (1 + np.exp(-z)) - y)).astype(np.float32)
        g = {"out": dz.sum(keepdims=True), "top": np.concatenate([top, mean], 1).T @ dz}
        dtop, dmean = dz[:, None] * p["top"][:UNITS], dz[:, None] * p["top"][UNITS:]
        owner = np.repeat(np.arange(len(count)), count)
        hit = unit == top[owner]
        ties = np.add.reduceat(hit, first, axis=0, dtype=np.float32)
        dunit = (dtop / ties)[owner] * hit + (dmean / count[:, None])[owner]
        dunit = (dunit * (unit > 0)).astype(np.float32)
        g["dense"], g["unit"] = chunk.T @ dunit, dunit.sum(0)
        dchunk = dunit @ p["dense"].T
        own = block >= block[after]
        dblock = dchunk * own
        np.add.at(dblock, after, dchunk * ~own)
        dblock *= block > 0
        g["bias"] = dblock.sum(0)
        g["filters"], g["embed"] = np.zeros_like(p["filters"]), np.zeros_like(p["embed"])
        for at in range(0, len(block), RUN):
            # only the winning position of each block and filter passes the gradient on
            d = dblock[at: at + RUN]
            position = (np.arange(at, at + len(d))[:, None] * PER_BLOCK + arg[at: at + RUN]) * STEP
            byte = x[position[..., None] + np.arange(WIDTH)]
            e = p["embed"][byte].reshape(len(d), FILTERS, WIDTH * EMBED)
            g["filters"] += np.einsum("bfk,bf->kf", e, d, optimize=True)
            de = (d[..., None] * p["filters"].T[None]).reshape(-1, EMBED)
            flat = byte.reshape(-1)
            g["embed"] += np.stack([np.bincount(flat, de[:, k], PAD + 1) for k in range(EMBED)], 1).astype(p["embed"].dtype)
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, batch: int = 24, rate: float = 4e-3):
        """Adam over shuffled batches, with a falling rate."""
        r = np.random.default_rng(2)
        m, v, t = {k: 0 * x for k, x in self.p.items()}, {k: 0 * x for k, x in self.p.items()}, 0
        steps = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for i in range(0, len(order), batch):
                k = order[i: i + batch]
                x, count = symbols([texts[j] for j in k])
                g = self.gradient(x, count, y[k], weight[k] / len(k))
                t += 1
                now = rate * (1 - t / (steps + 1))
                for name, value in self.p.items():
                    d = g[name] + 1e-4 * value
                    m[name] = 0.9 * m[name] + 0.1 * d
                    v[name] = 0.999 * v[name] + 0.001 * d * d
                    value -= (now * (m[name] / (1 - 0.9 ** t)) / (np.sqrt(v[name] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities."""
        return 1 / (1 + np.exp(-self.forward(*symbols(texts)).astype(np.float64)))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, limit: int = FIT_BYTES, seed: int = 0):
    """(whole text, label) of at most ``rows`` rows of ``limit`` bytes outside the held-out fold, and the number of usable rows by label."""
    usable = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
              .where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold() % 5 != 0)
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality")))
    share = {r.quality: r.n for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    picked = None
    for label in sorted(share):
        part = usable.where(F.col("quality") == label).orderBy(F.xxhash64(F.col("doc_id") + seed), "doc_id").limit(rows // 2)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return [], share
    # at most ``rows`` ids, so the side is small whatever the size of the tables
    found = stage_table(
        identified(docs).select("doc_id", F.encode("text", "utf-8").alias("body")).join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "quality").agg(F.max("body").alias("body")), "labelled")
    sizes = found.select("doc_id", "quality", F.length("body").alias("size")).orderBy(F.xxhash64(F.col("doc_id") + seed), "doc_id").collect()
    chosen, held = [], 0
    for r in sizes:
        if held + r.size <= limit:
            chosen.append(r.doc_id)
            held += r.size
    rows_ = found.where(F.col("doc_id").isin(chosen)).orderBy("quality", F.md5("body"), "doc_id").collect()
    return [(bytes(r.body), r.quality) for r in rows_], share


def fit(docs: DataFrame, labels: DataFrame) -> Network | float:
    """The network, or a constant score where the labels do not allow one."""
    sample, share = labelled_sample(docs, labels)
    kinds = {y for _, y in sample}
    if len(kinds) < 2:
        n = sum(share.values())
        return (share.get(1, 0) + 1) / (n + 2) if kinds else 0.5
    y = np.array([y for _, y in sample], np.float32)
    drawn = {k: float((y == k).mean()) for k in kinds}
    true = {k: share[k] / sum(share.values()) for k in kinds}
    weight = np.array([true[int(k)] / drawn[int(k)] for k in y], np.float32)
    return Network().fit([t for t, _ in sample], y, weight)


def score_documents(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id and score of every row."""
    weights = model.p if isinstance(model, Network) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network()
        net.p = weights
        for batch, texts in slices(batches):
            p = net.score(texts) if weights else np.full(len(texts), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return identified(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""
    model = fit(docs, labels)
    weights = model.p if isinstance(model, Network) else None

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = Network()
        net.p = weights
        for part in texts:
            batch = pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["text"])
            p = [net.score(run) if weights else np.full(len(run), model) for _, run in slices(iter([batch]))]
            yield pd.Series(np.concatenate(p) if p else np.zeros(0))

    return docs.where(score(F.coalesce("text", F.lit(""))) >= threshold)


@query("op1_quality")
def op1_quality(spark, sf_dir):
    """Quality of all documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", (fold() % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
