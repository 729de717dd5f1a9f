"""Token ids of documents in binary shards, with a minimal perfect hash index for keyed access.

Files below one folder, which the driver and all executors share:

* ``shard-00000.ids``: ids of consecutive documents in ascending order of doc_id, little-endian, 2
  bytes each where the vocabulary fits them, else 4; nothing else.
* ``index-00000.mph``: one bucket of keys.  A header (magic, keys, levels, words of each level), the
  bits of a minimal perfect hash and their ranks, then one fixed-size slot per key: a 64-bit
  fingerprint, shard, place, length, ids before, and how often the document id occurs.

A key is (doc_id, n): the n-th document of that id, so that an id that a third of all rows share is
spread over buckets like any other.  A lookup hashes the key to a bucket, walks a few levels of
bits to a slot, compares the fingerprint and reads one range of one shard.

Writing: a global sort deals documents to tasks in order (an id that many rows share is split by
the hash of the text, and copies of one text by their row number), each task streams its shard out
under an attempt's name and renames it, so a task that is run again replaces its own file.  Shard
totals, one row per task, give the ids before each shard.  Keys are dealt to buckets of about
``BUCKET`` keys by hash.  Reading: keys go to buckets, found places go to shards, and neighbouring
ranges of a shard are read together.

Defined cases: null or empty text is the end token alone; documents of one id follow each other by
the hash of their text; null ids come first and are keys like others; an id that is not in the
files gives no row; an empty table gives no files and no rows; other columns are ignored.  A key
outside the files passes for one inside with a probability of 2^-64.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidegate.llm.common import identified, mix, prepare, table
from tidegate.llm.registry import query
from tidegate.llm.tokens import encoder, runs
from tidegate.session import scratch, stage_table

END = 0
BUCKET, LEAST_BUCKETS = 1 << 16, 16
READ_BYTES = 1 << 23
MAGIC = b"MPHIDX01"
SLOT = np.dtype([("mark", "<u8"), ("shard", "<u4"), ("place", "<u8"), ("tokens", "<u8"), ("start", "<u8"), ("rows", "<u8")])
SPACING = 1.6   # bits of a level for each key that reaches it
ENTRY = "doc_id long, nth long, rows long, shard int, place long, tokens long"
FOUND = "doc_id long, nth long, rows long, shard int, place long, tokens long, start long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path in it."""
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def whole_file(folder: str, name: str) -> bytes | None:
    """The bytes of a file; None if there is none."""
    store, root = opened(folder)
    if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
        return None
    with store.open_input_file(f"{root}/{name}") as f:
        return f.read()


class Hash:
    """A minimal perfect hash: each level sends the keys that are left to bits; a key alone on its bit stays there."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels   # words of 64 bits
        self.sizes = [len(w) * 64 for w in levels]
        flat = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(flat).astype(np.int64))])
        self.first = np.concatenate([[0], np.cumsum([len(w) for w in levels])]).astype(np.int64)

    @staticmethod
    def spot(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a + b * np.uint64(2 * level + 1) + np.uint64(level * 0x9E3779B97F4A7C15 % 2 ** 64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> "Hash":
        """a, b: two hashes of every key; no two keys share both."""
        levels, left = [], np.arange(len(a))
        while len(left):
            words = max(1, -(-int(len(left) * SPACING) // 64))
            at = cls.spot(a[left], b[left], len(levels), words * 64)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            left = left[~alone[at]]
        return cls(levels)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of every key, from 0; -1 for keys that no level holds."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for k, words in enumerate(self.levels):
            if not len(left):
                break
            at = self.spot(a[left], b[left], k, self.sizes[k])
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[here]] = (self.ranks[self.first[k] + (at >> 6)] + below)[here]
            left = left[~here]
        return out


def pack_bucket(a: np.ndarray, b: np.ndarray, slots: np.ndarray) -> bytes:
    """A bucket file; slots in the order of the keys."""
    h = Hash.build(a, b)
    placed = np.zeros(len(slots), SLOT)
    placed[h.find(a, b)] = slots
    head = struct.pack(f"<8sQI{len(h.levels)}I", MAGIC, len(slots), len(h.levels), *[len(w) for w in h.levels])
    return head + b"".join(w.astype("<u8").tobytes() for w in h.levels) + placed.tobytes()


def unpack_bucket(data: bytes) -> tuple[Hash, np.ndarray]:
    magic, keys, n = struct.unpack_from("<8sQI", data)
    if magic != MAGIC:
        raise ValueError("not an index file")
    sizes, at, levels = struct.unpack_from(f"<{n}I", data, 20), 20 + 4 * n, []
    for size in sizes:
        levels.append(np.frombuffer(data, "<u8", size, at).astype(np.uint64))
        at += 8 * size
    return Hash(levels), np.frombuffer(data, SLOT, keys, at)


def key_hashes(doc_id: pa.Array, nth: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every key."""
    nulls = np.asarray(doc_id.is_null())
    ids = np.asarray(doc_id.fill_null(0)).astype(np.int64).view(np.uint64)
    n = np.asarray(nth).astype(np.int64).view(np.uint64)
    salt = np.where(nulls, np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))
    one = mix(mix(ids ^ salt) + n * np.uint64(0x9E3779B97F4A7C15))
    return one, mix(mix(ids + salt * np.uint64(3)) ^ mix(n + np.uint64(0xD6E8FEB86659FD93)))


def bucket_of(a: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(a ^ np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(buckets)).astype(np.int64)


class Files:
    """A written set of token files: folder, id width, number of index buckets; small enough to send to tasks."""

    def __init__(self, folder: str, width: int, buckets: int, documents: int, tokens: int):
        self.folder, self.width, self.buckets, self.documents, self.tokens = folder, width, buckets, documents, tokens

    def shard(self, k: int) -> str:
        return f"shard-{k:05d}.ids"

    def bucket(self, k: int) -> str:
        return f"index-{k:05d}.mph"

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        """The ids of one document by key: one bucket's bits, one slot, one range of a shard."""
        if not self.buckets:
            return None
        a, b = key_hashes(pa.array([doc_id], pa.int64()), pa.array([nth], pa.int64()))
        data = whole_file(self.folder, self.bucket(int(bucket_of(a, self.buckets)[0])))
        if data is None:  # no key fell into this bucket
            return None
        head, slots = unpack_bucket(data)
        at = int(head.find(a, b)[0])
        if at < 0 or slots[at]["mark"] != b[0]:
            return None
        s = slots[at]
        store, root = opened(self.folder)
        with store.open_input_file(f"{root}/{self.shard(int(s['shard']))}") as f:
            return np.frombuffer(f.read_at(int(s["tokens"]) * self.width, int(s["place"]) * self.width), f"<u{self.width}")


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None, end: int) -> DataFrame:
    """Write the shards; one row per document: where its ids lie, its number within its id in this shard, and how
    many rows of that id the shard holds.  edge: 1 for the shard's first id, 2 for its last, 3 for both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary), TaskContext.get()
        closing = np.asarray([end], encode.kind).tobytes()
        store, root = opened(folder)
        name = f"{root}/shard-{task.partitionId():05d}.ids"
        part, out, ids, counts = f"{name}.{task.taskAttemptId()}", None, [], []
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for piece in runs(texts):
                coded = encode.batch(texts[piece])
                counts.extend(len(x) // encode.width + 1 for x in coded)
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(part)
                out.write(closing.join([*coded, b""]))
            ids.append(batch.column("doc_id"))
        if out is None:
            return
        out.close()
        store.move(part, name)
        key = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in ids])
        value, null = np.asarray(key.fill_null(0)), np.asarray(key.is_null())
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (null[1:] != null[:-1])])
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        size = np.diff(np.append(first, len(value)))
        tokens = np.asarray(counts, np.int64)
        edge = (group == 0) * 1 + (group == group[-1]) * 2
        columns = [key, pa.array(np.arange(len(value)) - first[group]), pa.array(size[group]), pa.array(np.full(len(value), task.partitionId()), pa.int32()),
                   pa.array(np.cumsum(tokens) - tokens), pa.array(tokens), pa.array(edge, pa.int32())]
        for at in range(0, len(value), 10_000):
            yield pa.RecordBatch.from_arrays([c.slice(at, 10_000) for c in columns], ["doc_id", "nth", "rows", "shard", "place", "tokens", "edge"])

    # a hot id is split by its texts, and copies of one text by their row; equal rows are interchangeable
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row")).orderBy("doc_id", "h", "row")
    return ordered.select("doc_id", "text").mapInArrow(run, ENTRY + ", edge int")


def shard_starts(entries: DataFrame) -> list[tuple[int, int, int, int]]:
    """(shard, ids before it, rows of its first id in earlier shards, rows of its last id in later ones); a row per task."""
    rows = entries.groupBy("shard").agg(
        F.sum("tokens").alias("tokens"),
        *[F.max(F.when(F.col("edge").bitwiseAND(e) > 0, F.struct("doc_id", "rows"))).alias(n) for n, e in (("first", 1), ("last", 2))],
        F.min("edge").alias("least"), F.max("edge").alias("most")).orderBy("shard").collect()
    out, total, before = [], 0, 0
    for i, r in enumerate(rows):
        same = i > 0 and rows[i - 1].last.doc_id == r.first.doc_id
        before = (before if rows[i - 1].most == 3 else 0) + rows[i - 1].last.rows if same else 0
        out.append([r.shard, total, before, 0])
        total += r.tokens
    after = 0
    for i in range(len(rows) - 2, -1, -1):
        r, later = rows[i], rows[i + 1]
        after = later.first.rows + (after if later.most == 3 else 0) if r.last.doc_id == later.first.doc_id else 0
        out[i][3] = after
    return [tuple(r) for r in out]


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END) -> Files:
    """Write shards and index of all documents below the folder."""
    spark = prepare(docs.sparkSession)
    entries = stage_table(write_shards(identified(docs), folder, vocabulary, end), "entries")
    starts = shard_starts(entries)
    total = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    files = Files(folder, encoder(vocabulary).width, 0, total.n, total.t)
    if not total.n:
        return files
    files.buckets = buckets = max(LEAST_BUCKETS, -(-total.n // BUCKET))
    shards = spark.createDataFrame(starts, "shard int, base long, before long, after long")
    first, last = (F.col("edge").bitwiseAND(e) > 0 for e in (1, 2))
    keyed = entries.join(shards, "shard").select(
        "doc_id", (F.col("nth") + F.when(first, F.col("before")).otherwise(0)).alias("nth"),
        (F.col("rows") + F.when(first, F.col("before")).otherwise(0) + F.when(last, F.col("after")).otherwise(0)).alias("rows"),
        "shard", "place", "tokens", (F.col("base") + F.col("place")).alias("start"))

    def build(bucket: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = key_hashes(rows.column("doc_id").combine_chunks(), rows.column("nth").combine_chunks())
        slots = np.zeros(rows.num_rows, SLOT)
        slots["mark"] = b
        for name in ("shard", "place", "tokens", "start", "rows"):
            slots[name] = np.asarray(rows.column(name))
        store, root = opened(folder)
        name = f"{root}/{files.bucket(bucket)}"
        part = f"{name}.{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(part) as f:
            f.write(pack_bucket(a, b, slots))
        store.move(part, name)
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([rows.num_rows], pa.int64())], ["bucket", "keys"])

    by_bucket(keyed, buckets, build, "bucket int, keys long").agg(F.sum("keys")).collect()
    return files


def by_bucket(keyed: DataFrame, buckets: int, fn, schema: str) -> DataFrame:
    """Apply fn(bucket, rows) to the rows of every bucket; rows need doc_id and nth."""
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, _ = key_hashes(batch.column("doc_id"), batch.column("nth"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket_of(a, buckets), pa.int32())], [*batch.schema.names, "bucket"])

    fields = ", ".join(f"{n} {t}" for n, t in keyed.dtypes)
    routed = keyed.mapInArrow(route, f"{fields}, bucket int")
    empty = [pa.RecordBatch.from_pylist([], to_arrow_schema(_parse_datatype_string(schema)))]
    return routed.groupBy("bucket").applyInArrow(lambda key, rows: pa.Table.from_batches([*fn(key[0].as_py(), rows)] or empty), schema)


def look_up(keys: DataFrame, files: Files) -> DataFrame:
    """Places of the keys (doc_id, nth) that the files hold, by index."""
    def probe(bucket: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        data = whole_file(files.folder, files.bucket(bucket))
        if data is None:
            return
        head, slots = unpack_bucket(data)
        doc_id, nth = rows.column("doc_id").combine_chunks(), rows.column("nth").combine_chunks()
        a, b = key_hashes(doc_id, nth)
        at = head.find(a, b)
        known = np.flatnonzero((at >= 0) & (slots["mark"][at] == b))
        s = slots[at[known]]
        yield pa.RecordBatch.from_arrays(
            [doc_id.take(pa.array(known)), nth.take(pa.array(known)), *[pa.array(s[n].astype(t)) for n, t in
             (("rows", np.int64), ("shard", np.int32), ("place", np.int64), ("tokens", np.int64), ("start", np.int64))]],
            ["doc_id", "nth", "rows", "shard", "place", "tokens", "start"])

    return by_bucket(keys, files.buckets, probe, FOUND)


def read(keys: DataFrame, files: Files, with_ids: bool = True) -> DataFrame:
    """Every document whose doc_id is among the keys: doc_id, nth, start, n_tokens, ids_crc32 (of ids as 32-bit values) and, if wanted, ids.

    keys needs a column doc_id; an id that occurs often in it is looked up once.
    """
    schema = "doc_id long, nth long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if not files.buckets:
        return keys.sparkSession.createDataFrame([], schema)
    one = look_up(keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("nth", F.lit(0).cast("long")), files)
    one = stage_table(one, "places")
    # further documents of an id: numbered in blocks, so that a hot id's keys are made by many tasks
    blocks = one.where("rows > 1").select("doc_id", "rows", F.explode(F.expr(f"sequence(0L, (rows - 1) div {BUCKET})")).alias("block"))
    more = blocks.repartition("doc_id", "block").select(
        "doc_id", F.explode(F.expr(f"sequence(greatest(1L, block * {BUCKET}), least(rows, (block + 1) * {BUCKET}) - 1)")).alias("nth"))
    places = one.union(look_up(more, files)).select("doc_id", "nth", "shard", "place", "tokens", "start")
    width = files.width

    def fetch(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        place, tokens = (np.asarray(rows.column(n)).astype(np.int64) for n in ("place", "tokens"))
        crc, ids, at = [], [], 0
        store, root = opened(files.folder)
        with store.open_input_file(f"{root}/{files.shard(key[0].as_py())}") as f:
            while at < len(place):
                end = at + 1
                while end < len(place) and (place[end] + tokens[end] - place[at]) * width <= READ_BYTES:
                    end += 1
                data = f.read_at(int(place[end - 1] + tokens[end - 1] - place[at]) * width, int(place[at]) * width)
                raw = np.frombuffer(data, f"<u{width}").astype("<u4")
                for i in range(at, end):
                    own = raw[place[i] - place[at]: place[i] - place[at] + tokens[i]]
                    crc.append(zlib.crc32(own.tobytes()))
                    if with_ids:
                        ids.append(own.astype(np.int64))
                at = end
        columns = [rows.column("doc_id"), rows.column("nth"), rows.column("start"), rows.column("tokens"), pa.array(crc, pa.int64())]
        names = ["doc_id", "nth", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            columns, names = [*columns, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names)

    return places.groupBy("shard").applyInArrow(fetch, schema)


@query("op12_token_index")
def op12_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written, and read back by key."""
    docs = table(spark, sf_dir, "documents")
    files = write(docs, scratch(spark, "tokens"))
    return read(docs, files, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
