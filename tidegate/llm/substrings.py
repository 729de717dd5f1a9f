"""Exact removal of repeated byte strings by bucket-pointer refinement.

A suffix that repeats ``LENGTH`` bytes lies in the same q-gram bucket as its repetition, for
q-grams at any fixed offset.  Suffixes are kept by their bucket's leader: of the q-grams that
begin in a string of ``LENGTH`` bytes, the one with the least identifier (leftmost) leads it,
so equal strings have the same leader at the same offset, and one row stands for all suffixes,
about 50, that one leader leads in a row.

1. Initial buckets are the leaders' q-gram identifiers; buckets of one row are unique.
2. Buckets are refined by the identifier of the whole block of suffixes a row stands for.
   Rows alone in the refined bucket but not in the first go on, beside one row of every other
   class of their bucket.
3. Those are refined suffix by suffix with the pair of bucket identifiers at the suffix and
   q bytes later, which is the identifier of all ``LENGTH`` bytes; the q-gram identifiers are
   those of step 1.  Suffixes still not alone are repeated.

Identifiers are fingerprints; two strings count as equal if 128 bits agree (leader and block, or
leader with offset and pair).  Buckets are sorted runs that are read with one row of memory, so
a bucket of any size needs no room; rows equal within a task are merged before the shuffle.

Defined cases: null text is empty; texts below ``LENGTH`` bytes are kept whole; repeated rows
repeat each other's strings, so all of their long strings go; matches never cross rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import identified, mix, prefix_hash, slices, span_hash, table
from tidegate.llm.registry import query
from tidegate.session import stage_table

LENGTH = 200
GRAM = 100
FLUSH_ROWS = 200_000
PIECE = 1 << 19          # a longer text is read in pieces that overlap by a string
PLACE_BITS = np.uint64(20)
_PLACE = np.uint64((1 << 20) - 1)
_RESOLVED, _MIXED = 0, 1


def least_in_window(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys, from running minima inside blocks of that width."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1: n])


def gram_ids(sums: np.ndarray, gram: int) -> np.ndarray:
    at = np.arange(len(sums) - gram)
    return span_hash(sums, at, at + gram)


def leaders(data: np.ndarray, first: np.ndarray, length: int, gram: int):
    """For all texts in ``data`` (text i from first[i]): text, first and last suffix led, leader, its bucket, the block's identifier."""
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    if len(data) < length:
        return none
    sums = prefix_hash(data)
    g = gram_ids(sums, gram)
    keys = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
    lead = (least_in_window(keys, length - gram + 1) & _PLACE).astype(np.int64)
    owner = np.searchsorted(first, np.arange(len(lead)), "right") - 1
    end = np.append(first[1:], len(data))
    valid = np.flatnonzero(np.arange(len(lead)) + length <= end[owner])
    if not len(valid):
        return none
    lead, owner = lead[valid], owner[valid]
    new = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (owner[1:] != owner[:-1])]))
    lo, hi = valid[new], valid[np.append(new[1:], len(valid)) - 1]
    lead, owner = lead[new], owner[new]
    block = mix(span_hash(sums, lo, hi + length) ^ ((lead - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return owner, lo - first[owner], hi - first[owner], lead - first[owner], g[lead], block


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts with their number and start; one longer than PIECE comes in overlapping pieces."""
    if len(texts) > 1 or len(texts[0]) <= PIECE:
        yield list(range(len(texts))), [0] * len(texts), texts
        return
    for at in range(0, len(texts[0]), PIECE):
        yield [0], [at], [texts[0][at: at + PIECE + length - 1]]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row's key; equal rows share a key."""
    return identified(docs).withColumn("key", F.xxhash64("doc_id", "text"))


ROW = "bucket long, block long, key long, doc_id long, lo int, hi int, lead int, n int"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def led_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows of step 1.  n = 0 marks suffixes already known to be repeated, which need no bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch, texts in slices(batches):
            key, doc = batch.column("key").to_numpy(), batch.column("doc_id")
            known = doc.is_valid().to_numpy(zero_copy_only=False)
            ids = doc.fill_null(0).to_numpy()
            for number, start, parts in pieces(texts, length):
                first = np.concatenate([[0], np.cumsum([len(t) for t in parts])[:-1]]).astype(np.int64)
                owner, lo, hi, lead, bucket, block = leaders(np.frombuffer(b"".join(parts), np.uint8), first, length, gram)
                if len(owner):
                    at, text = np.asarray(start)[owner], np.asarray(number)[owner]
                    held.append((bucket, block, key[text], ids[text], known[text], lo + at, hi + at, lead + at))
                    size += len(owner)
            if size >= FLUSH_ROWS:
                yield merged(held)
                held, size = [], 0
        if held:
            yield merged(held)

    return docs.select("key", "doc_id", "text").mapInArrow(run, ROW)


def merged(held: list[tuple]) -> pa.RecordBatch:
    """Rows of one bucket and block become one with n = 2 and, as repeated suffixes, ranges with n = 0."""
    bucket, block, key, doc, known, lo, hi, lead = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((block, bucket))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (bucket[order][1:] == bucket[order][:-1]) & (block[order][1:] == block[order][:-1])
    repeated, later = same[1:] | same[:-1], same[:-1]
    keep, ranges = order[~later], order[repeated]
    n = np.where(repeated[~later], 2, 1)
    ranges = ranges[np.lexsort((lo[ranges], doc[ranges], key[ranges]))]
    a, b = ranges[:-1], ranges[1:]
    joins = (key[a] == key[b]) & (doc[a] == doc[b]) & (lo[b] <= hi[a] + 1)
    start = np.flatnonzero(np.concatenate([[True], ~joins])) if len(ranges) else np.zeros(0, np.int64)
    last = np.append(start[1:], len(ranges)) - 1 if len(ranges) else start
    rows = np.concatenate([keep, ranges[start]])
    to = np.concatenate([hi[keep], hi[ranges[last]]])
    # ranges are spread by their text; they meet no bucket
    spread = np.concatenate([bucket[keep], mix(key[ranges[start]].view(np.uint64) + lo[ranges[start]].astype(np.uint64))])
    return pa.RecordBatch.from_arrays([
        pa.array(spread.view(np.int64)), pa.array(block[rows].view(np.int64)), pa.array(key[rows]),
        pa.array(doc[rows], pa.int64(), mask=~known[rows]), *[pa.array(x.astype(np.int32)) for x in (lo[rows], to, lead[rows])],
        pa.array(np.concatenate([n, np.zeros(len(start))]).astype(np.int32))], NAMES)


def with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch | None, pa.RecordBatch | None]]:
    """Every batch with the last row before it and the first row after it."""
    before, now = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if now is not None:
            yield now, before, batch.slice(0, 1)
            before = now.slice(now.num_rows - 1)
        now = batch
    if now is not None:
        yield now, before, None


def equal_to(batch, before, after, columns) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row equals the row before it, and the row after it, in the columns."""
    value = lambda b: np.stack([b.column(c).to_numpy() for c in columns], 1)
    x = value(batch)
    up = np.concatenate([[before is not None and bool((value(before)[0] == x[0]).all())], (x[1:] == x[:-1]).all(1)])
    down = np.append(up[1:], after is not None and bool((value(after)[0] == x[-1]).all()))
    return up, down


def refine_blocks(rows: DataFrame) -> DataFrame:
    """Steps 1 and 2: repeated suffixes, rows that go on, and one row of every class that others may match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranked():
            for batch in batches:
                ready = batch.column("n").to_numpy() == 0
                done.append(batch.filter(pa.array(ready)))
                yield batch.filter(pa.array(~ready))

        done: list[pa.RecordBatch] = []
        for batch, before, after in with_neighbours(ranked()):
            for x in done:
                if x.num_rows:
                    yield marked(x, np.full(x.num_rows, _RESOLVED), np.zeros(x.num_rows, bool))
            done.clear()
            up, down = equal_to(batch, before, after, ["bucket", "block"])
            wide_up, wide_down = equal_to(batch, before, after, ["bucket"])
            resolved = up | down | (batch.column("n").to_numpy() > 1)
            use = resolved | wide_up | wide_down
            if use.any():
                yield marked(batch.filter(pa.array(use)), np.where(resolved, _RESOLVED, _MIXED)[use], (resolved & ~up)[use])
        for x in done:
            if x.num_rows:
                yield marked(x, np.full(x.num_rows, _RESOLVED), np.zeros(x.num_rows, bool))

    def marked(batch, state, leads):
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("bucket", "key", "doc_id", "lo", "hi", "lead")), pa.array(state.astype(np.int32)), pa.array(leads)],
            ["bucket", "key", "doc_id", "lo", "hi", "lead", "state", "leads"])

    return rows.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(
        run, "bucket long, key long, doc_id long, lo int, hi int, lead int, state int, leads boolean")


def refine_suffixes(docs: DataFrame, rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Step 3: (key, doc_id, lo, hi) of repeated suffixes among the rows that went on."""
    mixed = rows.where(F.col("state") == _MIXED)
    partners = rows.where("leads").join(mixed.select("bucket").distinct(), "bucket", "left_semi")
    wanted = mixed.unionByName(partners).groupBy("key", "doc_id").agg(
        F.collect_list(F.struct("bucket", "lo", "hi", "lead", F.col("state").alias("state"))).alias("wanted"))
    texts = docs.join(wanted.withColumnRenamed("key", "k").withColumnRenamed("doc_id", "d"), F.expr("key = k AND doc_id <=> d")).select(
        "key", "doc_id", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                spans = batch.column("wanted")[i].values
                bucket, lo, hi, lead, state = (spans.field(c).to_numpy() for c in ("bucket", "lo", "hi", "lead", "state"))
                sums, count = prefix_hash(data), hi - lo + 1
                row = np.repeat(np.arange(len(lo)), count)
                at = (np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count) + lo[row]).astype(np.int64)
                # the pair of bucket identifiers, at the suffix and one gram later
                pair = mix(span_hash(sums, at, at + gram) * np.uint64(3) + span_hash(sums, at + length - gram, at + length))
                place = mix(bucket[row].view(np.uint64) + (lead[row] - at).astype(np.uint64))
                # a partner is only compared with: where it lies is not needed, and zeros shuffle small
                own, doc_id = state[row] == _MIXED, batch.column("doc_id")[i].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array(place.view(np.int64)), pa.array(pair.view(np.int64)), pa.array(np.where(own, batch.column("key")[i].as_py(), 0)),
                    pa.array(np.full(len(at), doc_id or 0), pa.int64(), mask=np.full(len(at), doc_id is None) | ~own),
                    pa.array(np.where(own, at, 0).astype(np.int32)), pa.array(own)], ["place", "pair", "key", "doc_id", "lo", "mixed"])

    suffixes = texts.mapInArrow(run, "place long, pair long, key long, doc_id long, lo int, mixed boolean")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, before, after in with_neighbours(batches):
            up, down = equal_to(batch, before, after, ["place", "pair"])
            use = (up | down) & batch.column("mixed").to_numpy(zero_copy_only=False)
            out = batch.filter(pa.array(use))
            yield pa.RecordBatch.from_arrays([*(out.column(c) for c in ("key", "doc_id", "lo")), out.column("lo")], ["key", "doc_id", "lo", "hi"])

    return suffixes.repartition("place", "pair").sortWithinPartitions("place", "pair").mapInArrow(
        keep, "key long, doc_id long, lo int, hi int")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by ranges lo..hi-1."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], hi[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key, doc_id, text and the suffixes of each row that begin a repeated string, as arrays lo and hi."""
    docs = keyed(docs)
    rows = stage_table(refine_blocks(led_rows(docs, length, gram)), "buckets")
    known = rows.where(F.col("state") == _RESOLVED).select("key", "doc_id", "lo", "hi")
    ranges = known.unionByName(refine_suffixes(docs, rows, length, gram)).groupBy("key", "doc_id").agg(
        F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return docs.join(
        ranges.select(F.col("key").alias("k"), F.col("doc_id").alias("d"), "ranges"), F.expr("key = k AND doc_id <=> d"), "left").select("doc_id", "text", "ranges")


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """What removing every byte of a repeated string leaves of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("ranges")):
                data = text.encode("utf-8", "surrogatepass")
                if not spans.is_valid:
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                lo, hi = union(spans.values.field("lo").to_numpy().astype(np.int64), spans.values.field("hi").to_numpy().astype(np.int64) + length)
                rest, at = hashlib.sha256(), 0
                for a, b in zip(lo.tolist(), hi.tolist()):
                    rest.update(data[at:a])
                    at = b
                rest.update(data[at:])
                out.append((len(data), int((hi - lo).sum()), len(lo), rest.hexdigest()))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
                [c.split()[0] for c in RESULT.split(", ")])

    return removed_spans(docs, length, gram).mapInArrow(run, RESULT)


@query("op6_substrings")
def op6_substrings(spark, sf_dir):
    """Repeated strings of 200 bytes of all documents."""
    return deduplicate(table(spark, sf_dir, "documents"))
