"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants: one per previous word, whose parent is the restaurant of that word's class (20
classes by ending, length and alphabet), whose parent is one root; its base measure is uniform
over the V training words and one unknown word.  The start of a text is a word and class of its
own.  Seating is sampled by Gibbs: a sweep takes all customers of a dish out of a restaurant and
seats them again one after another, given everybody else and the parent's current predictive,
dish by dish; every table is a customer of the parent.  Customers are kept as table counts,
which is all that the predictive needs.  Predictive probabilities are averaged over samples.

Scale: words are dealt over blocks by fingerprint, and all contexts of a word lie in its block.
A sweep needs from other blocks only the sizes of restaurants, taken between rounds: a fixed
number of sums for the classes, and for the previous words sums that each block gets for its own
contexts (``context_sizes``); the previous words themselves travel once (``numbered_contexts``).
Blocks are written in buckets, so rounds shuffle sizes only.  No task sees the vocabulary: the corpus
is read in chunks of rows, every chunk sends its distinct (previous word, word) pairs and training
counts to the blocks, and gets back the scores of exactly those pairs, in their order and without
their fingerprints: where its texts are scored, the same pairs are found in them again.

Learning uses the documents whose crc32(id) mod 10 is not 0; all are scored.

Defined cases: null and empty texts are one end token; repeated rows are learned from and
scored each; without training rows all scores are 0; an empty table gives no rows; other
columns are ignored.  Words are told apart by 59-bit fingerprints, previous words and pairs by 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import LOWER, SPACE, fold, identified, prefix_hash, release, slices, span_hash, table
from tidegate.llm.registry import query
from tidegate.session import stage_buckets, stage_table

CHUNK_ROWS = 4096
BLOCK_BYTES = 4 << 20
CONTEXTS = 22
SHIFT = np.uint64(5)
LOW = np.uint64(31)
END_WORD = np.uint64(0x6A09E667F3BCC908)
BEGIN_WORD = np.uint64(0xBB67AE8584CAA73B)
ROUNDS, SWEEPS, BURN, SAMPLES = 2, 2, 2, 4
STRENGTH = 1.0
PENDING = 4_000_000

_ending = np.full(256, 3, np.int64)  # other signs
_ending[list(b".!?")] = 1
_ending[list(b",;:")] = 2
_ending[list(b"0123456789")] = 4
_ending[list(b"abcdefghijklmnopqrstuvwxyz")] = 5
_ending[128:] = 5
_length = np.array([0, 0, 1, 2, 3, 3, 4, 4, 4, 5])


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (word fingerprint, class of the word before in the low bits) of all texts with their end tokens, the words before, and the first of each text."""
    data = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(LOWER), np.uint8)
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    first = 1 + np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    count = np.diff(np.searchsorted(start, first))
    h = span_hash(prefix_hash(data), start, end)
    n = len(texts)
    at = np.concatenate([[0], np.cumsum(count + 1)])
    where = np.arange(len(h)) + np.repeat(np.arange(n), count)  # one end token after every text before
    words, shape = np.full(len(h) + n, END_WORD), np.zeros(len(h) + n + 1, np.int64)
    words[where] = h
    if len(h):
        wide = np.maximum.reduceat(data, start) >= 128
        last = _ending[data[end - 1]]
        kind = np.where(last == 5, 5 + _length[np.minimum(end - start, 9)], last)
        shape[where + 1] = 2 * kind + wide - 1
    shape[at[:-1]] = 0  # a text begins
    before = np.empty_like(words)
    before[1:], before[at[:-1]] = words[:-1], BEGIN_WORD
    return (words & ~LOW) | shape[:-1].astype(np.uint64), before, at[:-1]


def packed(x: np.ndarray) -> bytes:
    """Numbers compressed, after their length in bytes."""
    data = np.ascontiguousarray(x).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), kind)


def steps(x: np.ndarray) -> np.ndarray:
    """Ascending numbers as the first and the steps between them, which compress."""
    return np.diff(x, prepend=x.dtype.type(0))


def numbered(keys: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in the order of ``summed_pairs``, and the number of every given pair among them."""
    order = np.lexsort((before, keys))
    k, b = keys[order], before[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (b[1:] != b[:-1])])
    place = np.empty(len(order), np.int32)
    place[order] = np.cumsum(new) - 1
    return k[new], b[new], place


def word_starts(keys: np.ndarray) -> np.ndarray:
    """Whether a pair, in order, is the first of its word."""
    word = keys >> SHIFT
    return np.concatenate([[True], word[1:] != word[:-1]]) if len(word) else np.zeros(0, bool)


def summed_pairs(keys: np.ndarray, before: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in the order of key and word before, and the sum of each."""
    if not len(keys):
        return keys, before, counts
    order = np.lexsort((before, keys))
    keys, before, counts = keys[order], before[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (before[1:] != before[:-1])]))
    return keys[first], before[first], np.add.reduceat(counts, first)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, text, fold and the chunk of rows of the file that a row lies in, the same whoever reads it."""
    try:
        docs.select(docs.metadataColumn("_metadata"))
    except AnalysisException:  # not a plain scan of files: write it first
        docs = stage_table(identified(docs), "texts")
    place = docs.metadataColumn("_metadata")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        (fold() % 10 == 0).alias("held_out"),
        F.xxhash64(place["file_path"], F.floor(place["row_index"] / CHUNK_ROWS)).alias("chunk"))


def chunk_counts(docs: DataFrame, bits: int) -> DataFrame:
    """Distinct keys of every chunk with their training counts, by block of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, pending = None, [], 0

        def compact():
            nonlocal parts, pending
            parts = [summed_pairs(*map(np.concatenate, zip(*parts)))]
            pending = len(parts[0][0])

        def rows():
            compact()
            k, p, c = parts[0]
            block = (k >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(k), np.int64)
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            last = np.append(first[1:], len(k))
            yield pa.RecordBatch.from_arrays([
                pa.array(block[first]), pa.array(np.full(len(first), chunk)),
                *[pa.array([made(x[a:b]) for a, b in zip(first, last)], pa.binary())
                  for x, made in ((k, lambda x: packed(steps(x))), (p, np.ndarray.tobytes), (c, packed))],
            ], ["block", "chunk", "keys", "before", "counts"])

        for batch, texts in slices(batches):
            owner = batch.column("chunk").to_numpy()
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            for a, b in runs(owner):
                if owner[a] != chunk:
                    if parts:
                        yield from rows()
                    chunk, parts, pending = owner[a], [], 0
                key, before, at = tokens(texts[a:b])
                n = np.diff(np.append(at, len(key)))
                parts.append(summed_pairs(key, before, np.repeat(train[a:b].astype(np.int64), n)))
                pending += len(parts[-1][0])
                if pending > PENDING:
                    compact()
        if parts:
            yield from rows()

    return docs.select("text", "chunk", "held_out").mapInArrow(
        run, "block long, chunk long, keys binary, before binary, counts binary")


def runs(owner: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    return list(zip([0, *edge], [*edge, len(owner)])) if len(owner) else []


def gathered(counts: DataFrame) -> DataFrame:
    """One row a block: its distinct keys, their training counts, and which chunk holds which key."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        chunks = t.column("chunk").to_numpy()
        keys = [np.cumsum(unpacked(x, "<u8")) for x in t.column("keys").to_pylist()]
        before = [np.frombuffer(x, "<u8") for x in t.column("before").to_pylist()]
        n = [unpacked(x, "<i8") for x in t.column("counts").to_pylist()]
        sizes = list(map(len, keys))
        keys, before, n = map(np.concatenate, (keys, before, n))
        every, prev, place = numbered(keys, before)
        total = np.bincount(place, n, len(every)).astype(np.int64)
        lists: dict[int, np.ndarray] = {}
        for chunk, x in zip(chunks.tolist(), np.split(place, np.cumsum(sizes)[:-1])):
            # a chunk that several tasks read is one list
            lists[chunk] = np.union1d(lists[chunk], x) if chunk in lists else x
        held = [packed(steps(x)) for x in lists.values()]
        return pa.table({
            "block": pa.array([t.column("block")[0].as_py()], pa.int64()), "keys": pa.array([packed(steps(every))], pa.binary()),
            "before": pa.array([prev.tobytes()], pa.binary()), "counts": pa.array([packed(total)], pa.binary()),
            "chunks": pa.array([list(lists)], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.binary()))})

    return counts.groupBy("block").applyInArrow(
        run, "block long, keys binary, before binary, counts binary, chunks array<long>, held array<binary>")


def seat(count: np.ndarray, mass: np.ndarray, discount: float, r: np.random.Generator) -> np.ndarray:
    """Tables of one dish after its customers sit down one after another.

    A newcomer to n customers at t tables opens a table with odds mass : n - discount * t.  Until
    that happens the customers are draws of an urn, so the wait for the next table is geometric
    with a chance from a beta distribution.
    """
    tables = np.minimum(count, 1).astype(np.float64)
    live = np.flatnonzero(count > 1)
    n = np.ones(len(live))
    while len(live):
        chance = r.beta(mass[live], n - discount * tables[live])
        with np.errstate(divide="ignore"):
            n += np.floor(np.log1p(-r.random(len(live))) / np.log1p(-np.maximum(chance, 1e-300))) + 1
        on = n <= count[live]
        live, n = live[on], n[on]
        tables[live] += 1
    return tables


class Block:
    """The restaurants of one block of words."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, sizes: dict):
        self.word, self.kind, self.count, self.sizes = keys >> SHIFT, (keys & LOW).astype(np.int64), counts, sizes
        self.first = np.flatnonzero(np.concatenate([[True], self.word[1:] != self.word[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(keys))))
        self.total = np.add.reduceat(counts, self.first) if len(keys) else counts
        self.tables = np.minimum(counts, 1).astype(np.float64)
        self.served = np.add.reduceat(self.tables, self.first) if len(keys) else self.tables
        self.root_tables = np.minimum(self.served, 1)

    def root(self) -> np.ndarray:
        s = self.sizes
        new = (STRENGTH + s["d0"] * s["t0"]) / (s["words"] + 1)
        return (self.served - s["d0"] * self.root_tables + new) / (STRENGTH + s["c0"])

    def sweep(self, r: np.random.Generator) -> None:
        s = self.sizes
        mass = (STRENGTH + s["d1"] * s["t"][self.kind]) * self.root()[self.owner]
        self.tables = seat(self.count, mass, s["d1"], r)
        self.served = np.add.reduceat(self.tables, self.first)
        new = (STRENGTH + s["d0"] * s["t0"]) / (s["words"] + 1)
        self.root_tables = seat(self.served.astype(np.int64), np.full(len(self.served), new), s["d0"], r)

    def predictive(self) -> np.ndarray:
        s = self.sizes
        own = self.count - s["d1"] * self.tables
        return (own + (STRENGTH + s["d1"] * s["t"][self.kind]) * self.root()[self.owner]) / (STRENGTH + s["c"][self.kind])


class Contexts:
    """The restaurants of previous words over those of a block; sizes are customers and tables of each pair's restaurant."""

    def __init__(self, keys: np.ndarray, before: np.ndarray, counts: np.ndarray, sizes: dict, customers=0, tables=0):
        self.before, self.count, self.sizes, self.customers, self.seated = before, counts, sizes, customers, tables
        self.first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(keys))))
        self.tables, self.many = np.minimum(counts, 1).astype(np.float64), np.flatnonzero(counts > 1)
        self.parent = Block(keys[self.first], np.add.reduceat(counts, self.first) if len(keys) else counts, sizes)
        self.seen = self.parent.total[self.parent.owner][self.owner]  # training count of each pair's word
        self.parent = Block(keys[self.first], self.served(), sizes)

    def served(self) -> np.ndarray:
        return np.add.reduceat(self.tables, self.first).astype(np.int64) if len(self.first) else self.count

    def weight(self) -> np.ndarray:
        return STRENGTH + self.sizes["d2"] * self.seated

    def sweep(self, r: np.random.Generator) -> None:
        # a single customer has one table whatever the mass
        many = self.many
        weight = STRENGTH + self.sizes["d2"] * (self.seated[many] if np.ndim(self.seated) else self.seated)
        self.tables[many] = seat(self.count[many], weight * self.parent.predictive()[self.owner[many]], self.sizes["d2"], r)
        self.parent.count = self.served()
        self.parent.sweep(r)

    def predictive(self) -> np.ndarray:
        return self.mixed(self.tables, self.parent.predictive())

    def mixed(self, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Linear in the tables and the parent's predictive, so those of samples may be averaged first."""
        own = self.count - self.sizes["d2"] * tables
        return (own + self.weight() * parent[self.owner]) / (STRENGTH + self.customers)


def totals(rows: DataFrame) -> dict[str, float]:
    """Sums by name over all blocks: a fixed number of rows for any input."""
    return {x.name: float(x.value) for x in rows.groupBy("name").agg(F.sum("value").alias("value")).collect()}


def block_rows(batches: Iterator[pa.RecordBatch], sizes: dict):
    """Rows with the restaurants of their block; sizes of contexts lie in the order of the distinct previous words."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            keys, before, counts = np.cumsum(unpacked(row["keys"], "<u8")), np.frombuffer(row["before"], "<u8"), unpacked(row["counts"], "<i8")
            known = {}
            if "customers" in row:
                which = np.unique(before, return_inverse=True)[1]
                known = {c: np.concatenate([unpacked(x, "<f8") for x in row[c]])[which] for c in ("customers", "tables")}
            yield row, keys, Contexts(keys, before, counts, sizes, **known)


SUMS = "name string, value double, block long, home long, customers binary, tables binary"


def homes(word: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """The tasks that add up distinct previous words, and the range of words of each."""
    home = (word >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(word), np.int64)
    return [(int(home[i]), i, j) for i, j in runs(home)]


def numbered_contexts(state: DataFrame, bits: int) -> DataFrame:
    """For every block and home, the numbers that the block's previous words have there."""

    def send(batches):
        for batch in batches:
            for block, before in zip(batch.column("block").to_pylist(), batch.column("before")):
                word = np.unique(np.frombuffer(before.as_buffer(), "<u8"))
                for home, i, j in homes(word, bits):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([home]), pa.array([block]), pa.array([word[i:j].tobytes()], pa.binary())], ["home", "block", "before"])

    def number(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        parts = [np.frombuffer(x, "<u8") for x in t.column("before").to_pylist()]
        which = np.unique(np.concatenate(parts), return_inverse=True)[1].astype("<i4")
        cuts = np.split(which, np.cumsum(list(map(len, parts)))[:-1])
        return pa.table({"home": t.column("home"), "block": t.column("block"), "which": pa.array([packed(steps(x)) for x in cuts], pa.binary())})

    sent = state.select("block", "before").mapInArrow(send, "home long, block long, before binary")
    return stage_table(sent.groupBy("home").applyInArrow(number, "home long, block long, which binary"), "numbers")


def sums(values: dict[str, float], block: int, b: Contexts, bits: int) -> Iterator[pa.RecordBatch]:
    """Named sums of a block, and the customers and tables of its previous words by the task that adds them up."""
    names = [c.split()[0] for c in SUMS.split(", ")]
    kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), *[pa.binary()] * 2]
    made = lambda n, **c: pa.RecordBatch.from_arrays([pa.array(c.get(x, [None] * n), t) for x, t in zip(names, kinds)], names)
    yield made(len(values), name=list(values), value=[float(v) for v in values.values()])
    word, which = np.unique(b.before, return_inverse=True)
    cuts = homes(word, bits)
    columns = np.bincount(which, b.count, len(word)), np.bincount(which, b.tables, len(word))
    customers, tables = ([packed(x[i:j]) for _, i, j in cuts] for x in columns)
    yield made(len(cuts), block=[block] * len(cuts), home=[h for h, _, _ in cuts], customers=customers, tables=tables)


def context_sizes(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """For every block, customers and tables of its previous words over all blocks, in the order of their fingerprints."""

    def add(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        which = {r["block"]: np.cumsum(unpacked(r["which"], "<i4"), dtype=np.int64) for r in t.to_pylist() if r["which"] is not None}
        t = t.filter(pc.is_valid(t.column("tables")))
        at = [which[b] for b in t.column("block").to_pylist()]
        every, cuts = np.concatenate(at), np.cumsum(list(map(len, at)))[:-1]
        out = {"block": t.column("block"), "home": t.column("home")}
        for c in ("customers", "tables"):
            total = np.bincount(every, np.concatenate([unpacked(x, "<f8") for x in t.column(c).to_pylist()]))[every]
            out[c] = pa.array([packed(x) for x in np.split(total, cuts)], pa.binary())
        return pa.table(out)

    def line_up(t: pa.Table) -> pa.Table:
        t = t.sort_by("home")
        whole = {c: pa.array([t.column(c).to_pylist()], pa.list_(pa.binary())) for c in ("customers", "tables")}
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int64()), **whole})

    met = rows.where("home IS NOT NULL").select("block", "home", "customers", "tables").unionByName(numbers, allowMissingColumns=True)
    added = met.groupBy("home").applyInArrow(add, "block long, home long, customers binary, tables binary")
    return stage_table(added.groupBy("block").applyInArrow(line_up, "block long, customers array<binary>, tables array<binary>"), "contexts")


def class_sizes(got: dict[str, float]) -> dict:
    per = lambda x: np.array([got.get(f"{x}{k}", 0.0) for k in range(CONTEXTS)])
    return {"c": per("kc"), "t": per("kt"), "c0": got.get("c0", 0.0), "t0": got.get("t0", 0.0)}


def seated(b: Contexts) -> dict[str, float]:
    p = b.parent
    out = {"c0": p.served.sum(), "t0": p.root_tables.sum()}
    for name, w in (("kc", p.count), ("kt", p.tables)):
        out |= {f"{name}{k}": v for k, v in enumerate(np.bincount(p.kind, w, CONTEXTS)) if v}
    return out


def corpus_sizes(state: DataFrame, numbers: DataFrame, bits: int) -> tuple[dict, DataFrame]:
    """Customers and tables at first, words, discounts from the counts of counts, and the sizes of contexts."""

    def run(batches):
        for row, _, b in block_rows(batches, {}):
            p = b.parent
            out = {"words": (p.total > 0).sum(), "train": b.count.sum()}
            for name, n in (("pair", b.count), ("class", p.count), ("root", p.served)):
                out |= {f"{name}_once": (n == 1).sum(), f"{name}_twice": (n == 2).sum()}
            yield from sums(out | seated(b), row["block"], b, bits)

    rows = stage_table(state.select("block", "keys", "before", "counts").mapInArrow(run, SUMS), "sums")
    got = totals(rows.where("name IS NOT NULL"))
    once = lambda x: got.get(f"{x}_once", 0.0)
    share = lambda x: float(np.clip(once(x) / max(once(x) + 2 * got.get(f"{x}_twice", 0.0), 1), 0.05, 0.95))
    return class_sizes(got) | {"words": got.get("words", 0.0), "train": got.get("train", 0.0),
                               "d2": share("pair"), "d1": share("class"), "d0": share("root")}, context_sizes(rows, numbers)


def gibbs_round(state: DataFrame, numbers: DataFrame, contexts: DataFrame, sizes: dict, seed: int, bits: int) -> tuple[dict, DataFrame]:
    """Sweep all blocks with the given restaurant sizes and give the sizes afterwards."""

    def run(batches):
        for row, _, b in block_rows(batches, sizes):
            r = np.random.default_rng([seed, row["block"]])
            for _ in range(SWEEPS):
                b.sweep(r)
            yield from sums(seated(b), row["block"], b, bits)

    met = state.select("block", "keys", "before", "counts").join(contexts, "block")
    rows = stage_table(met.mapInArrow(run, SUMS), "sums")
    return sizes | class_sizes(totals(rows.where("name IS NOT NULL"))), context_sizes(rows, numbers)


def dictionaries(state: DataFrame, contexts: DataFrame, sizes: dict, seed: int) -> DataFrame:
    """For every chunk and block, in the order of the chunk's pairs, averaged log10 probabilities, and the counts of their words."""

    def run(batches):
        for row, keys, b in block_rows(batches, sizes):
            r = np.random.default_rng([seed, row["block"]])
            tables, parent = np.zeros(len(keys)), np.zeros(len(b.first))
            for k in range(BURN + SAMPLES):
                b.sweep(r)
                if k >= BURN:
                    tables += b.tables / SAMPLES
                    parent += b.parent.predictive() / SAMPLES
            score, seen = np.log10(b.mixed(tables, parent)).astype("<f4"), b.seen.astype("<i8")
            for chunk, held in zip(row["chunks"], row["held"]):
                at = np.cumsum(unpacked(held, "<i4"), dtype=np.int64)
                new = at[word_starts(keys[at])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([score[at].tobytes()], pa.binary()),
                     pa.array([packed(seen[new])], pa.binary())], ["chunk", "block", "score", "seen"])

    return state.join(contexts, "block").mapInArrow(run, "chunk long, block long, score binary, seen binary")


def packed_texts(rows: DataFrame) -> DataFrame:
    """Rows of a chunk as compressed batches: texts are the larger part of what scoring shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in slices(batches):
            owner = batch.column("chunk").to_numpy()
            for a, b in runs(owner):
                out = pa.BufferOutputStream()
                part = batch.slice(a, b - a).select(["doc_id", "held_out", "text"])
                with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([owner[a]], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["chunk", "texts"])

    return rows.mapInArrow(run, "chunk long, texts binary")


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_corpus(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Base and model scores of every text, learned from the training fold of the same table."""
    rows = chunked(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / BLOCK_BYTES)))))
    # a table with fewer buckets than the session has shuffle partitions would be shuffled in every round
    buckets = max(1 << bits, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    state = stage_buckets(gathered(chunk_counts(rows, bits)), "restaurants", buckets, "block")
    home = max(0, bits - 2)  # fewer tasks add up contexts than there are blocks
    numbers = numbered_contexts(state, home)
    sizes, contexts = corpus_sizes(state, numbers, home)
    for k in range(ROUNDS):
        sizes, contexts = gibbs_round(state, numbers, contexts, sizes, seed + k, home)
    entries = dictionaries(state, contexts, sizes, seed + ROUNDS)
    train, words = int(sizes["train"]), sizes["words"]
    met = packed_texts(rows).unionByName(entries, allowMissingColumns=True).select("chunk", "block", "texts", "score", "seen")
    # the texts of a chunk come before its entries, and these in the order of blocks, which is that of its pairs
    met = met.repartition("chunk").sortWithinPartitions("chunk", F.asc_nulls_first("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, texts, score, seen = None, [], [], []
        for batch in batches:
            for k, owner in enumerate(batch.column("chunk").to_pylist()):
                if owner != chunk:
                    yield from scored(texts, score, seen)
                    chunk, texts, score, seen = owner, [], [], []
                if batch.column("texts")[k].is_valid:
                    part = pa.ipc.open_stream(batch.column("texts")[k].as_buffer()).read_all().combine_chunks().to_batches()[0]
                    key, before, at = tokens([t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()])
                    key, before, which = numbered(key, before)
                    texts.append((part.select(["doc_id", "held_out"]), key, before, which, at))
                else:
                    score.append(np.frombuffer(batch.column("score")[k].as_py(), "<f4"))
                    seen.append(unpacked(batch.column("seen")[k].as_py(), "<i8"))
        yield from scored(texts, score, seen)
        release()

    def scored(texts, score, seen):
        if not texts:
            return
        # the pairs of the chunk again, and where those of each batch are among them
        keys, _, place = numbered(*(np.concatenate([t[c] for t in texts]) for c in (1, 2)))
        score, seen = np.concatenate(score).astype(np.float64), np.concatenate(seen)[np.cumsum(word_starts(keys)) - 1]
        if len(score) != len(keys):
            raise RuntimeError("a chunk was read with other rows than before")
        base = np.log10((seen + 0.1) / (train + 0.1 * (words + 1)))
        known, start = (seen > 0).astype(np.int64), 0
        for rows_, key, _, which, at in texts:
            i = place[start:start + len(key)][which]
            start += len(key)
            n = np.diff(np.append(at, len(which)))
            yield pa.RecordBatch.from_arrays([
                rows_.column("doc_id"), rows_.column("held_out"), pa.array(n, pa.int64()),
                pa.array(np.add.reduceat(known[i], at), pa.int64()), pa.array(np.full(len(n), train), pa.int64()),
                pa.array(np.add.reduceat(base[i], at), pa.float64()), pa.array(np.add.reduceat(score[i], at), pa.float64()),
            ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return met.mapInArrow(run, RESULT)


@query("op9_pitman_yor")
def op9_pitman_yor(spark, sf_dir):
    """Scores of all documents."""
    return score_corpus(table(spark, sf_dir, "documents"))
