"""Prefix trie of conversations with subtree totals, by time-forward processing.

A node is a distinct sequence of the first d turns.  It is named by its depth and the combined
hash (128 bits) of its turns, each hashed with its place, so a node's name and its parent's are
running values over a conversation and no two turns are ever compared side by side.

Subtree totals: nodes are put in reverse level order by Spark's external sort, deepest first, and
every node sends its total to its parent through a priority queue ordered like the nodes; the
queue of a task spills sorted runs to the shared folder.  A shard is one subtree: the topmost node
with at most ``SHARD`` members, and what lies below.  What shards send to nodes with more members
is added up by Spark and reaches them in a last pass over those nodes, of which there are at most
rows / SHARD.  Subtrees deeper than ``BAND`` levels (or a sixteenth of the deepest conversation, if
that is more) are cut into bands, processed deepest first, so that one very long conversation is no
single task's work either.

Hot keys: running values come from a global sort that splits a conversation over tasks, with one
carried-in row per task; joins by conversation are by slices of its turns; nodes are grouped with
partial aggregates; the members that end at a node are hashed as a sorted stream.

Defined cases: a null role or text is empty; a null turn comes first; turns of equal number follow
each other by role, then by hash of the text; repeated rows are turns of their own; rows without a
conversation id belong to none and are left out; an empty table gives no rows (no root either);
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.common import prepare, table
from tidegate.llm.registry import query
from tidegate.llm.tokenfile import opened
from tidegate.session import scratch, stage_table

SHARD, BAND, SLICE, QUEUE = 4096, 4096, 4096, 1 << 20
SALTS = 64
CHUNK = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


# --- running values over a global order -------------------------------------------------------

def running(df: DataFrame, key: str, order: list, xor: tuple[str, ...] = ()) -> DataFrame:
    """Adds n (number within the key, from 1) and, for each xor column c, run_c (combined over rows 1..n).

    key is a long without nulls.  The rows are sorted by key and order over all tasks; a key may
    span tasks, and what a task must know of earlier ones is a row per task.
    """
    extra = ["n", *[f"run_{c}" for c in xor]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, leading, shard = None, [0] * len(extra), True, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.asarray(batch.column(key))
            start = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
            size = np.diff(np.append(start, len(k)))
            goes_on = last is not None and k[0] == last
            head = np.arange(len(k)) < size[0]
            columns = []
            for i, name in enumerate(["", *xor]):
                if i:
                    v = np.asarray(batch.column(name))
                    acc = np.bitwise_xor.accumulate(v)
                    before = np.concatenate([[0], acc[start[1:] - 1]]).astype(np.int64)
                    acc = acc ^ np.repeat(before, size)
                    acc = np.where(head, acc ^ state[i], acc) if goes_on else acc
                else:
                    acc = np.arange(1, len(k) + 1) - np.repeat(start, size)
                    acc = np.where(head, acc + state[0], acc) if goes_on else acc
                columns.append(acc)
            # the task's first key may have begun in an earlier task
            first = head & (last is None or (leading and goes_on))
            leading = bool(first.all())
            last, state = k[-1], [int(c[-1]) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, pa.int64()) for c in columns], pa.array(np.full(len(k), shard), pa.int32()), pa.array(first)],
                [*batch.schema.names, *extra, "shard", "first"])

    fields = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    spec = f"{fields}, " + "".join(f"{e} long, " for e in extra) + "shard int, first boolean"
    scanned = stage_table(df.orderBy(key, *order).mapInArrow(scan, spec), "running")
    ends = scanned.groupBy("shard").agg(
        F.min(key).alias("least"), F.max(F.struct(F.col(key).alias("k"), *extra)).alias("end")).orderBy("shard").collect()
    carried, held, before = [], [0] * len(extra), None
    for r in ends:
        begins = held if before == r.least else [0] * len(extra)
        if begins[0]:
            carried.append((r.shard, *begins))
        own = list(r.end)[1:]
        held = [own[0] + begins[0], *[a ^ b for a, b in zip(own[1:], begins[1:])]] if r.end.k == r.least else own
        before = r.end.k
    kept = [c for c in scanned.columns if c not in (*extra, "shard", "first")]
    if not carried:
        return scanned.select(*kept, *extra)
    add = df.sparkSession.createDataFrame(carried, "shard int, " + ", ".join(f"c_{e} long" for e in extra))
    own = {e: F.when(F.col("first"), F.coalesce(f"c_{e}", F.lit(0))).otherwise(0).cast("long") for e in extra}
    return scanned.join(add, "shard", "left").select(
        *kept, (F.col("n") + own["n"]).alias("n"), *[F.col(e).bitwiseXOR(own[e]).alias(e) for e in extra[1:]])


def by_slice(rows: DataFrame, place: str, per_key: DataFrame, key: str, length: str) -> DataFrame:
    """Join rows with one row per key, slice by slice of a key's places 0..length."""
    copies = per_key.withColumn("_slice", F.explode(F.expr(f"sequence(0L, {length} div {SLICE})")))
    return rows.withColumn("_slice", F.expr(f"{place} div {SLICE}")).join(copies, [key, "_slice"]).drop("_slice")


# --- conversations to rows (conversation, depth) ------------------------------------------------

def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, n (place of the turn, from 1), two hashes of role and text, bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("g1"), F.xxhash64(F.lit(2), role, text).alias("g2"), F.octet_length(text).cast("long").alias("bytes"))
    return running(turns, "conv_id", [F.col("turn").asc_nulls_first(), "role", "g1", "g2"]).drop("turn", "role")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with their depth, conversations with their length), nothing rebuilt."""
    convs = stage_table(turns.groupBy("conv_id").agg(F.max("n").alias("length")), "convs")
    return turns.withColumnRenamed("n", "depth"), convs


def rebuilt(turns: DataFrame, every: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of conversation c - c % every, then their own turns after the
    first h, with h = crc32(c) % spread.  (turns with their depth, conversations with their length)"""
    convs = turns.groupBy("conv_id").agg(F.max("n").alias("own")).withColumns({
        "base": F.expr(f"conv_id - conv_id % {every}"), "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread})
    convs = stage_table(convs, "own")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0)).cast("long"))).withColumn(
        "length", F.expr("taken + greatest(0L, own - h)"))
    convs = stage_table(convs, "convs")
    # a turn is at most spread - 1 places into its base, and a base has fewer than 2 * every followers
    taken = turns.where(F.col("n") < spread).select(F.col("conv_id").alias("base"), F.col("n").alias("depth"), "g1", "g2", "bytes").join(
        convs.select("conv_id", "base", "taken"), "base").where("depth <= taken").select("conv_id", "depth", "g1", "g2", "bytes")
    own = by_slice(turns, "n", convs.select("conv_id", "h", "taken", "own"), "conv_id", "own").where("n > h").select(
        "conv_id", F.expr("n - h + taken").alias("depth"), "g1", "g2", "bytes")
    return taken.union(own), convs.select("conv_id", "length")


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and depth from 0: the node's name (h1, h2), its parent's (p1, p2), bytes of the last turn,
    and whether the conversation ends there."""
    placed = turns.select("conv_id", "depth", "bytes", *[F.xxhash64(F.lit(i), "g1", "g2", "depth").alias(f"v{i}") for i in (1, 2)])
    deep = by_slice(running(placed, "conv_id", ["depth"], ("v1", "v2")).drop("n"), "depth", convs, "conv_id", "length").select(
        "conv_id", "depth", F.col("run_v1").alias("h1"), F.col("run_v2").alias("h2"),
        F.col("run_v1").bitwiseXOR(F.col("v1")).alias("p1"), F.col("run_v2").bitwiseXOR(F.col("v2")).alias("p2"),
        "bytes", (F.col("depth") == F.col("length")).alias("ends"))
    zero = F.lit(0).cast("long")
    return convs.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in ("h1", "h2", "p1", "p2", "bytes")], (F.col("length") == 0).alias("ends")).union(deep)


# --- totals --------------------------------------------------------------------------------------

class Mail:
    """A priority queue of messages (order, leaves, saved, children) that spills sorted runs to the shared folder."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.heap, self.runs, self.files, self.ahead = folder, limit, [], [], [], []

    def send(self, order: tuple, leaves: int, saved: int, children: int = 1) -> None:
        heapq.heappush(self.heap, (order, leaves, saved, children))
        if len(self.heap) >= self.limit:
            self._spill()

    def _spill(self) -> None:
        store, root = opened(self.folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/{uuid.uuid4().hex}.run"
        with store.open_output_stream(path) as f:
            for at in range(0, len(block := sorted(self.heap)), 4096):
                pickle.dump(block[at: at + 4096], f)
        self.heap = []
        self.files.append((store, path))
        run = self._read(store, path)
        if (head := next(run, None)) is not None:
            heapq.heappush(self.runs, (head, len(self.files), run))

    @staticmethod
    def _read(store, path: str):
        with store.open_input_stream(path) as f:
            while True:
                try:
                    yield from pickle.load(f)
                except EOFError:
                    return

    def take(self, order: tuple) -> tuple[int, int, int]:
        """Sums of the messages for this address."""
        leaves = saved = children = 0
        while True:
            spilled = self.runs and (not self.heap or self.runs[0][0] < self.heap[0])
            head = self.runs[0][0] if spilled else self.heap[0] if self.heap else None
            if head is None or head[0] != order:
                return leaves, saved, children
            if spilled:
                _, i, run = heapq.heappop(self.runs)
                if (after := next(run, None)) is not None:
                    heapq.heappush(self.runs, (after, i, run))
            else:
                heapq.heappop(self.heap)
            leaves, saved, children = leaves + head[1], saved + head[2], children + head[3]

    def clear(self) -> None:
        for store, path in self.files:
            store.delete_file(path)


NODE = "depth long, h1 long, h2 long, p1 long, p2 long, conv_id long, n_convs long, bytes long, n_ends long, cut long, s1 long, s2 long, band long"
TOTAL = NODE + ", n_children long, n_leaves long, saved_tokens long"
MAIL = ("depth", "h1", "h2", "leaves", "saved", "children")


def time_forward(nodes: DataFrame, mail: DataFrame | None, folder: str, band: int, limit: int) -> DataFrame:
    """Nodes of whole shards, with the messages that other shards sent them, to nodes with totals.

    Within a shard the rows come deepest first, so everything a node needs was sent before its turn.
    """
    names = [x.split()[0] for x in NODE.split(", ")]
    stream = nodes.select(*names, *[F.lit(None).cast("long").alias(c) for c in MAIL[3:]])
    if mail is not None:
        # messages stand before the node they are for; they know its shard, not its other columns
        stream = stream.union(mail.select(
            *[F.col(c) if c in ("depth", "h1", "h2", "s1", "s2", "band") else F.lit(None).cast("long").alias(c) for c in names], *MAIL[3:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue = None, Mail(folder, limit)
        for batch in batches:
            rows, keep, extra = batch.to_pydict(), [], ([], [], [])
            for i, (d, h1, h2, p1, p2, n_convs, size, ends, cut, s1, s2, b, leaves, saved, children) in enumerate(zip(*[rows[c] for c in (
                    "depth", "h1", "h2", "p1", "p2", "n_convs", "bytes", "n_ends", "cut", "s1", "s2", "band", *MAIL[3:])])):
                if shard != (s1, s2, b):
                    shard = (s1, s2, b)
                if leaves is not None:
                    queue.send((s1, s2, b, -d, h1, h2), leaves, saved, children)
                    continue
                leaves, saved, children = queue.take((s1, s2, b, -d, h1, h2))
                if ends == n_convs:
                    leaves = 1
                saved += (n_convs - 1) * size
                keep.append(i)
                for column, value in zip(extra, (children, leaves, saved)):
                    column.append(value)
                # the parent lies in this shard unless this node is the top of it
                if d and (b < 0 or d > cut + b * band):
                    queue.send((s1, s2, b, 1 - d, p1, p2), leaves, saved)
            out = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[out.column(c) for c in names], *[pa.array(c, pa.int64()) for c in extra]],
                                             [*names, "n_children", "n_leaves", "saved_tokens"])
        queue.clear()

    ordered = stream.repartition("s1", "s2", "band").sortWithinPartitions(
        "s1", "s2", "band", F.col("depth").desc(), "h1", "h2", F.col("leaves").isNull())
    return ordered.mapInArrow(run, TOTAL)


def totals(nodes: DataFrame, band: int, bands: list[int], limit: int) -> DataFrame:
    """All nodes with totals: bands from the deepest on, then the nodes above all shards (band -1)."""
    spark, done, mail = nodes.sparkSession, [], None
    nodes = stage_table(nodes, "nodes")
    for b in [*sorted(bands, reverse=True), -1]:
        part = stage_table(time_forward(nodes.where(F.col("band") == b), mail, scratch(spark, "mail"), band, limit), "totals")
        done.append(part)
        # tops of these shards, added up by receiver: the band above in the same subtree, or a node above all shards
        tops = part.where(F.expr(f"depth > 0 AND band >= 0 AND depth = cut + band * {band}"))
        mail = tops.groupBy(
            (F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"),
            *[F.when(F.col("band") > 0, F.col(c)).otherwise(F.lit(0)).cast("long").alias(c) for c in ("s1", "s2")],
            (F.col("band") - 1).alias("band")).agg(
            F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("children"))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def ends_digest(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, ascending and comma-joined: a sorted stream, in which a node with
    many ends spans tasks; such tasks pass on text of at most ``CHUNK`` bytes a row, which one stream hashes in turn."""
    spec = "depth long, h1 long, h2 long, shard int, chunk int, text string, digest string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, node, first, held, size, chunk, sha, out = TaskContext.get().partitionId(), None, True, [], 0, 0, None, []

        def flush():
            nonlocal held, size, chunk, sha
            text, sha = ",".join(held), sha or hashlib.sha256()
            if first:
                # the first node of a task may have begun in an earlier one
                out.append((*node, shard, chunk, text, None))
            else:
                sha.update(("," if chunk else "").encode() + text.encode())
                spare.append(text)
            held, size, chunk = [], 0, chunk + 1

        spare: list[str] = []
        for batch in batches:
            for d, h1, h2, c in zip(*[batch.column(n).to_pylist() for n in ("depth", "h1", "h2", "conv_id")]):
                if node != (d, h1, h2):
                    if node is not None:
                        if held:
                            flush()
                        if not first:
                            out.append((*node, shard, 0, None, sha.hexdigest()))
                        first = False
                    node, chunk, sha, spare = (d, h1, h2), 0, None, []
                held.append(str(c))
                size += len(held[-1]) + 1
                if size >= CHUNK:
                    flush()
            if len(out) >= 1000:
                yield to_batch(out)
                out = []
        if node is not None:
            if held:
                flush()
            if not first:
                # the last node may go on in the next task: pass its text on
                out.extend((*node, shard, i, t, None) for i, t in enumerate(spare))
        if out:
            yield to_batch(out)

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("depth", "h1", "h2", "shard", "chunk", "text", "digest"), r)) for r in rows], pa.schema([
            *[(n, pa.int64()) for n in ("depth", "h1", "h2")], ("shard", pa.int32()), ("chunk", pa.int32()), ("text", pa.string()), ("digest", pa.string())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for d, h1, h2, text in zip(*[batch.column(n).to_pylist() for n in ("depth", "h1", "h2", "text")]):
                if node != (d, h1, h2):
                    if node is not None:
                        out.append((*node, 0, 0, None, sha.hexdigest()))
                    node, sha = (d, h1, h2), hashlib.sha256()
                    sha.update(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if out:
                yield to_batch(out)
        if node is not None:
            yield to_batch([(*node, 0, 0, None, sha.hexdigest())])

    scanned = stage_table(rows.select("depth", "h1", "h2", "conv_id").orderBy("depth", "h1", "h2", "conv_id").mapInArrow(scan, spec), "ends")
    open_ = scanned.where("digest IS NULL").repartition("depth", "h1", "h2").sortWithinPartitions("depth", "h1", "h2", "shard", "chunk").mapInArrow(finish, spec)
    return scanned.where("digest IS NOT NULL").union(open_).select("depth", "h1", "h2", "digest")


def trie(turns: DataFrame, convs: DataFrame, shard: int = SHARD, band: int = BAND, queue: int = QUEUE) -> DataFrame:
    """The nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    name = ["depth", "h1", "h2"]
    rows = stage_table(paths(turns, convs), "paths")
    nodes = stage_table(rows.groupBy(*name).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.max("bytes").alias("bytes"), F.sum(F.col("ends").cast("long")).alias("n_ends")), "trie")
    # nodes above all shards: more members than a shard holds
    above = stage_table(nodes.where(F.col("n_convs") > shard).select(*name, "conv_id"), "above")
    # where each conversation leaves them: the depth and name of its shard's top
    entered = rows.join(above.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2")), ["depth", "p1", "p2"], "left_semi")
    tops = entered.groupBy("conv_id").agg(F.max(F.struct(*name)).alias("top"))
    per = convs.join(tops, "conv_id", "left").select(
        "conv_id", "length", *[F.coalesce(F.col(f"top.{c}"), F.lit(0)).cast("long").alias(a) for c, a in (("depth", "cut"), ("h1", "s1"), ("h2", "s2"))])
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return turns.sparkSession.createDataFrame([], (
            "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"))
    band = max(band, -(-deepest // 16))
    heavy = F.col("n_convs") > shard
    placed = by_slice(nodes, "depth", per, "conv_id", "length").select(
        *name, "p1", "p2", "conv_id", "n_convs", "bytes", "n_ends",
        *[F.when(heavy, F.lit(v)).otherwise(F.col(c)).cast("long").alias(c) for c, v in (("cut", 0), ("s1", 0), ("s2", 0))],
        F.when(heavy, F.lit(-1)).otherwise(F.expr(f"(depth - cut) div {band}")).cast("long").alias("band"))
    full = totals(placed, band, list(range(deepest // band + 1)), queue)
    # a node above all shards may have very many children: its row is copied and its children dealt over the copies
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.explode(
        F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    inside = F.expr("band >= 0 AND depth > cut")
    full = full.withColumn("salt", F.when(inside, F.lit(0)).otherwise(F.pmod(F.col("h1"), F.lit(SALTS)).cast("int")))
    return full.join(parents, ["depth", "p1", "p2", "salt"], "left").join(ends_digest(rows.where("ends")), name, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.lit(EMPTY)).alias("ends_sha256"))


PLAIN_SQL = """
WITH RECURSIVE own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
-- the checksum of the decimal id, bit by bit
bits AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS pos, 0 AS step, CAST(4294967295 AS BIGINT) AS c FROM own
  UNION ALL
  SELECT conv_id, s, CASE WHEN step = 8 THEN pos + 1 ELSE pos END, CASE WHEN step = 8 THEN 0 ELSE step + 1 END,
    CASE WHEN step = 0 THEN xor(c, CAST(ascii(substr(s, pos + 1, 1)) AS BIGINT)) ELSE c END AS c
  FROM (SELECT conv_id, s, pos, step, CASE WHEN step = 0 THEN c WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END AS c FROM bits)
  WHERE pos < length(s)),
h AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM bits WHERE pos = length(s)),
size AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
conv AS (
  SELECT h.conv_id, h, h.conv_id - h.conv_id % 5 AS base, least(h, coalesce(b.n, 0)) AS taken, size.n AS own
  FROM h JOIN size ON size.conv_id = h.conv_id LEFT JOIN size b ON b.conv_id = h.conv_id - h.conv_id % 5),
turns AS (
  SELECT c.conv_id, o.n AS depth, o.role, o.text FROM conv c JOIN own o ON o.conv_id = c.base AND o.n <= c.taken
  UNION ALL
  SELECT c.conv_id, o.n - c.h + c.taken, o.role, o.text FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.n > c.h),
seq AS MATERIALIZED (
  SELECT conv_id, depth, strlen(text) AS bytes,
    list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
  UNION ALL SELECT conv_id, 0, 0, [] FROM conv),
node AS MATERIALIZED (SELECT path, min(conv_id) AS conv_id, depth, count(*) AS n_convs, any_value(bytes) AS bytes FROM seq GROUP BY path, depth),
member AS MATERIALIZED (
  SELECT s.conv_id AS member, s.depth, n.conv_id, s.depth = c.taken + greatest(0, c.own - c.h) AS ends
  FROM seq s JOIN node n ON n.depth = s.depth AND n.path = s.path JOIN conv c ON c.conv_id = s.conv_id),
edge AS MATERIALIZED (
  SELECT n.conv_id, n.depth, p.conv_id AS parent FROM node n LEFT JOIN member p ON p.member = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS k FROM edge WHERE depth > 0 GROUP BY ALL),
own_values AS (
  SELECT n.conv_id, n.depth, (n.n_convs - 1) * n.bytes AS saved, CASE WHEN k IS NULL THEN 1 ELSE 0 END AS leaf
  FROM node n LEFT JOIN kids USING (conv_id, depth)),
below AS (
  SELECT m.conv_id, m.depth, sum(v.saved) AS saved, sum(v.leaf) AS leaves
  FROM own_values v JOIN member m ON m.member = v.conv_id AND m.depth <= v.depth GROUP BY ALL),
ends AS (SELECT conv_id, depth, string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) AS s FROM member WHERE ends GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, e.parent AS parent_conv_id, n.n_convs, coalesce(k.k, 0) AS n_children,
  CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(s, '')) AS ends_sha256
FROM node n JOIN edge e USING (conv_id, depth) LEFT JOIN kids k USING (conv_id, depth) JOIN below b USING (conv_id, depth)
LEFT JOIN ends USING (conv_id, depth)"""


@query("op11_prefix_trie", PLAIN_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt to share beginnings."""
    prepare(spark)
    return trie(*rebuilt(turns_of(table(spark, sf_dir, "conversations"))))
