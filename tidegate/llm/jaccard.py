"""Exact n-gram Jaccard join of documents with a token-group matrix.

A text is the set of its distinct word shingles; equal sets are one node.  Two sets of
similarity t share one of the first n - ceil(t n) + 1 tokens of each in any common order, so
only these leading tokens are indexed.  The order puts rare tokens first: the most frequent
ones (``HEAVY`` at most, from counts over all texts) come last by count, so passages that many
documents share seldom lead; any order gives the same result.

1. Leading tokens that more than one set leads with are kept if two of these sets can link, by the
   tokens' ranks, the sets' sizes, and how many leading tokens each shares at all; sets without
   any are alone.
2. Sets are partitioned into groups of similar ones: by their most widely shared leading token
   and a band of sizes, in parts of about ``GROUP`` sets.  The token-group matrix has a row for each (token, group).
3. Groups whose matrix rows share a token, and whose sizes are compatible, are candidates.  The
   sets of one group query the other: the overlap of the query with the group's whole token
   union bounds its overlap with any member, and only a group that reaches the bound is opened
   and its members are counted exactly.  A group queries itself as well.
4. A task returns its links as (set, root of the set in this task), never as pairs.

Tokens of step 1 meet in blocks that hold a bounded share of the corpus; pairs (heavy token,
set) need no counting and go by set.  No step holds a token's or a component's sets together.

Defined cases: null and empty texts, and those of white space, have an empty set and link with
nothing; a text of fewer words than a shingle is one shingle; repeated rows are equal sets; a
null id is no smallest id; an empty table gives no rows.  Shingles and sets are told apart by
64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidegate.llm.common import identified, mix, shingles, slices, table, words
from tidegate.llm.components import Forest, components
from tidegate.llm.registry import query
from tidegate.session import stage_table

HEAVY = 1 << 20
GROUP = 256
LIST = 2048
STRIP = 128
FILTER_BITS = 1 << 24
BLOCK_BYTES = 4 << 20
FLUSH_TOKENS = 1_500_000
# 32 bytes each, held about four times over while they are sorted and packed
LEAD_TOKENS = 300_000


def token_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts by text and in order, the first of each text (n + 1), and each set's fingerprint."""
    h, owner = shingles(*words(texts), size)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    total = np.zeros((2, len(h) + 1), np.uint64)
    np.cumsum(mix(h), out=total[0, 1:])
    np.cumsum(mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F)), out=total[1, 1:])
    a, b = (t[first[1:]] - t[first[:-1]] for t in total)
    return h, first, mix(a * np.uint64(3) + mix(b + np.diff(first).astype(np.uint64)))


def least_overlap(n, percent: int):
    """Tokens that a set of n shares with any set it links with, at least."""
    return (percent * n + 99) // 100


def top_counts(tokens: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    if len(tokens) > most:
        at = np.argpartition(counts, len(counts) - most)[len(counts) - most:]
        tokens, counts = tokens[at], counts[at]
    return tokens, counts


def keyed(docs: DataFrame) -> DataFrame:
    return identified(docs).withColumn("key", F.xxhash64("doc_id", "text"))


def described(docs: DataFrame, size: int) -> DataFrame:
    """A row for each text (key, doc_id, n, node), and rows with the frequent tokens of a part of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pending = [], 0

        def frequent():
            t = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            n = np.diff(np.append(first, len(t)))
            many = n > 1
            tokens, n = top_counts(t[first][many], n[many], HEAVY // 2)
            return pa.RecordBatch.from_arrays([
                pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()),
                pa.array([tokens.tobytes()], pa.binary()), pa.array([n.astype("<i8").tobytes()], pa.binary())], NAMES)

        for batch, texts in slices(batches):
            h, first, node = token_sets(texts, size)
            n = np.diff(first)
            held.append(h)
            pending += len(h)
            none = pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node.view(np.int64), mask=n == 0), none, none], NAMES)
            if pending > FLUSH_TOKENS:
                yield frequent()
                held, pending = [], 0
        if pending:
            yield frequent()

    return docs.select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, n long, node long, tokens binary, counts binary")


NAMES = ["key", "doc_id", "n", "node", "tokens", "counts"]


def heavy_tokens(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most HEAVY tokens with the largest counts, by token."""

    def flat(batches):
        for batch in batches:
            for t, n in zip(batch.column("tokens").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, "<i8")), pa.array(np.frombuffer(n, "<i8"))], ["token", "n"])

    top = (rows.where("tokens IS NOT NULL").select("tokens", "counts").mapInArrow(flat, "token long, n long")
           .groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(HEAVY).toArrow())
    tokens, n = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def weight(h: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 for a token that is not frequent, else its count."""
    tokens, n = heavy
    if not len(tokens) or not len(h):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
    return np.where(tokens[at] == h, n[at], 0)


def leading(docs: DataFrame, size: int, percent: int, heavy, bits: int) -> DataFrame:
    """Leading tokens with their sets, packed by block of tokens; pairs with a heavy token by set, as negative blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pending = [], 0

        def rows():
            b = np.concatenate([x[0] for x in held])
            order = np.argsort(b, kind="stable")
            b = b[order]
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            last, columns = np.append(first[1:], len(b)), []
            for k in range(1, 5):  # one column at a time
                c = np.concatenate([x[k] for x in held])[order]
                columns.append(pa.array([c[x:y].tobytes() for x, y in zip(first, last)], pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(b[first]), *columns], ["block", "tokens", "nodes", "sizes", "ranks"])

        for _, texts in slices(batches):
            h, first, node = token_sets(texts, size)
            n = np.diff(first)
            owner = np.repeat(np.arange(len(n)), n)
            w = weight(h, heavy)
            order = np.lexsort((h, w, owner))
            rank = np.arange(len(h)) - first[owner]
            lead = order[rank < (n - least_overlap(n, percent) + 1)[owner]]
            t, s = h[lead], node[owner[lead]]
            top = np.uint64(64 - bits)
            block = (t >> top).astype(np.int64) if bits else np.zeros(len(t), np.int64)
            spread = (s >> top).astype(np.int64) if bits else np.zeros(len(t), np.int64)
            held.append((np.where(w[lead] > 0, -1 - spread, block), t, s, n[owner[lead]].astype("<i4"), rank[rank < (n - least_overlap(n, percent) + 1)[owner]].astype("<i4")))
            pending += len(t)
            if pending > LEAD_TOKENS:
                yield rows()
                held, pending = [], 0
        if pending:
            yield rows()

    return docs.select("text").mapInArrow(run, "block long, tokens binary, nodes binary, sizes binary, ranks binary")


def may_link(n, m, i, j, percent: int):
    """Whether sets of n and m tokens whose first common token has ranks i and j can overlap enough."""
    return (100 + percent) * np.minimum(n - i, m - j) >= percent * (n + m)


def shared(packed: DataFrame) -> DataFrame:
    """(token, node, n, rank) of tokens that lead more than one set, and of heavy tokens."""

    def run(t: pa.Table) -> pa.Table:
        token, node, size, rank = (
            np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()])
            for c, kind in (("tokens", "<u8"), ("nodes", "<u8"), ("sizes", "<i4"), ("ranks", "<i4")))
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, size, rank = token[new], node[new], size[order][new], rank[order][new]
        if t.column("block")[0].as_py() >= 0:
            more = np.zeros(len(token) + 1, bool)
            more[1:-1] = token[1:] == token[:-1]
            use = more[1:] | more[:-1]
            token, node, size, rank = token[use], node[use], size[use], rank[use]
        return pa.table({"token": pa.array(token.view(np.int64)), "node": pa.array(node.view(np.int64)), "n": pa.array(size), "rank": pa.array(rank)})

    return packed.groupBy("block").applyInArrow(run, "token long, node long, n int, rank int")


def viable(rows: DataFrame, percent: int) -> DataFrame:
    """(token, node) pairs of tokens with which the set may meet a set it links with.

    Of two sets that link, let A be the one whose leading tokens end first in the order: all
    their common tokens up to there lead both.  A has s leading tokens that others lead with, and
    n - p tokens beyond its p leading ones, so at most s + n - p are common, which bounds the size
    of its partner by ``reach``.  Lists of tokens are compared as far as ``LIST`` sets; longer ones
    stay as they are.
    """
    shared_by = rows.groupBy("node").agg(F.count("*").alias("s"))
    sized = rows.join(shared_by, "node").withColumn("reach", F.floor(
        (F.col("s") + F.floor((percent * F.col("n") + 99) / 100) - 1) * (100 + percent) / F.lit(percent) - F.col("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, long = 0, False
        last = None
        for batch in batches:
            token = batch.column("token").to_numpy()
            columns = [batch.column(c).to_numpy() for c in ("node", "n", "rank", "reach")]
            edge = [0, *(np.flatnonzero(token[1:] != token[:-1]) + 1), len(token)]
            for x, y in zip(edge, edge[1:]):
                if token[x] != last:
                    if held:
                        yield from checked(last, held)
                    last, held, size, long = token[x], [], 0, False
                held.append([c[x:y] for c in columns])
                size += y - x
                if long or size > LIST:
                    long = True
                    yield kept(last, np.concatenate([h[0] for h in held]))
                    held = []
        if held:
            yield from checked(last, held)

    def checked(token, held):
        node, n, rank, reach = (np.concatenate(c) for c in zip(*held))
        if len(node) > 1:
            n, rank, use = n.astype(np.int64), rank.astype(np.int64), np.zeros(len(node), bool)
            for at in range(0, len(node), STRIP):  # in strips, so a long list takes little memory
                i = slice(at, at + STRIP)
                fits = may_link(n[i, None], n[None], rank[i, None], rank[None], percent) & ((n[None] <= reach[i, None]) | (n[i, None] <= reach[None]))
                fits[np.arange(len(fits)), np.arange(at, at + len(fits))] = False
                use[i] = fits.any(1)
            if use.any():
                yield kept(token, node[use])

    def kept(token, node):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(node), token)), pa.array(node)], ["token", "node"])

    return sized.repartition("token").sortWithinPartitions("token").mapInArrow(run, "token long, node long")


def grouped(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """node, n, key and the group it is put in; sets of a group have similar sizes."""
    count = pairs.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    choice = pairs.join(count, "token").groupBy("node").agg(F.max(F.struct("n", "token")).alias("c")).select("node", F.col("c.token").alias("token"))
    choice = choice.join(sizes, "node").withColumn("band", F.floor(F.log("n") / float(np.log(100 / min(percent, 99)))))
    parts = choice.groupBy("token", "band").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    return choice.join(parts, ["token", "band"]).select("node", "n", "key", F.xxhash64("token", "band", F.pmod(F.xxhash64("node"), "parts")).alias("gid"))


def key_filter(keys: DataFrame):
    """A column function: whether a key may be among ``keys`` (never false for one that is).

    A Bloom filter of FILTER_BITS bits, 2 MB whatever the data, spares most rows a shuffle of
    their texts; beyond some ten million keys it passes nearly all rows, and only that is lost.
    """
    places = keys.select(F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(k)), F.lit(FILTER_BITS)) for k in range(2)])).alias("p"))
    table_ = places.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[table_.column("w").to_numpy()] = table_.column("bits").to_numpy()

    @F.pandas_udf("boolean")
    def has(a: pd.Series, b: pd.Series) -> pd.Series:
        hit = np.ones(len(a), bool)
        for p in (a.to_numpy(), b.to_numpy()):
            hit &= (bits[p // 64] >> (p % 64)) & 1 == 1
        return pd.Series(hit)

    return lambda key: has(*[F.pmod(F.xxhash64(key, F.lit(k)), F.lit(FILTER_BITS)) for k in range(2)])


class Group:
    """The sets of one group: token union, and which members hold each token."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray]):
        self.nodes, self.size = np.array(nodes), np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        flat, self.member = flat[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        self.union, self.first, self.last = flat[first], first, np.append(first[1:], len(flat))

    def links(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """Members that the set links with; the group is opened only if its union holds enough of the set."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        if len(at) < least_overlap(len(tokens), percent):
            return np.zeros(0, np.int64)
        n = (self.last - self.first)[at]
        place = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(self.member[place], minlength=len(self.nodes))
        return np.flatnonzero((common > 0) & (100 * common >= percent * (len(tokens) + self.size - common)))


def opened(rows: DataFrame, percent: int) -> DataFrame:
    """(node, root) links of every group with its queries; rows of a group come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, nodes, sets, group, forest = None, [], [], None, Forest()
        for batch in batches:
            for g, asks, home, node, raw in zip(*(batch.column(c).to_pylist() for c in ("gid", "asks", "home", "node", "tokens"))):
                if g != gid:
                    if forest.parent:
                        yield result(forest)
                    gid, nodes, sets, group, forest = g, [], [], None, Forest()
                tokens = np.frombuffer(raw, "<u8")
                if not asks:
                    nodes.append(node)
                    sets.append(tokens)
                    continue
                if group is None:
                    group = Group(nodes, sets)
                for k in group.links(tokens, percent):
                    other = int(group.nodes[k])
                    if other != node:
                        forest.join(node, other)
        if forest.parent:
            yield result(forest)

    def result(forest: Forest) -> pa.RecordBatch:
        names = list(forest.parent)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([forest.root(x) for x in names], pa.int64())], ["node", "root"])

    return rows.mapInArrow(run, "node long, root long")


def links(docs: DataFrame, sets: DataFrame, heavy, size: int, percent: int) -> DataFrame:
    """(a, b) links that connect exactly the sets that link."""
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, bytes_ / BLOCK_BYTES)))))
    rows = stage_table(shared(leading(docs, size, percent, heavy, bits)), "shared")
    pairs = stage_table(viable(rows, percent), "viable")
    sizes = sets.where("node IS NOT NULL").groupBy("node").agg(F.max("n").alias("n"), F.min("key").alias("key"))
    member = stage_table(grouped(pairs, sizes, percent), "groups")
    matrix = pairs.join(member.select("node", "gid"), "node").select("token", "gid").distinct()
    bounds = member.groupBy("gid").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("sets"))
    left = matrix.join(bounds, "gid")
    met = left.alias("l").join(left.alias("r"), F.expr(
        f"l.token = r.token AND l.gid < r.gid AND 100 * l.high >= {percent} * r.low AND 100 * r.high >= {percent} * l.low"))
    # the smaller group asks the larger one
    couples = met.selectExpr(
        "IF(l.sets <= r.sets, l.gid, r.gid) AS asker", "IF(l.sets <= r.sets, r.gid, l.gid) AS gid").distinct()
    own = bounds.where("sets > 1").select(F.col("gid").alias("asker"), "gid")
    couples = stage_table(couples.union(own), "couples")
    used = couples.select("gid").union(couples.select(F.col("asker").alias("gid"))).distinct()
    wanted = member.join(used, "gid", "left_semi").select("key", "node", "gid")
    docs = docs.where(key_filter(wanted)("key"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            h, first, _ = token_sets(texts, size)
            raw = [h[a:b].tobytes() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("gid"), pa.array(raw, pa.binary())], ["node", "gid", "tokens"])

    full = docs.join(wanted, "key").select("node", "gid", "text").mapInArrow(tokens, "node long, gid long, tokens binary")
    full = stage_table(full, "sets")
    kept = full.join(couples.select("gid").distinct(), "gid", "left_semi").selectExpr("gid", "false AS asks", "node", "tokens", "false AS home")
    asking = full.withColumnRenamed("gid", "asker").join(couples, "asker").selectExpr("gid", "true AS asks", "node", "tokens", "asker = gid AS home")
    asked = kept.union(asking).repartition("gid").sortWithinPartitions("gid", "asks")
    return opened(asked, percent).select(F.col("node").alias("a"), F.col("root").alias("b"))


def similar_documents(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """key, doc_id, n_shingles, node and component_id of every row."""
    docs = keyed(docs)
    rows = stage_table(described(docs, size), "documents")
    sets = rows.where("tokens IS NULL").select("key", "doc_id", "n", "node")
    heavy = heavy_tokens(rows)
    roots = components(links(docs, sets, heavy, size, percent))
    classes = sets.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return sets.join(classes.join(least, "root").select("node", "root", "component_id"), "node", "left").select(
        "key", "doc_id", F.col("n").alias("n_shingles"), "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, of one document of each group: the one of the smallest id; empty texts stay."""
    found = similar_documents(docs, size, percent).where("root IS NOT NULL")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    losers = found.join(first, "root").where("key <> first.key").select("key").distinct()
    twice = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    marked = stage_table(losers.withColumn("lost", F.lit(True)).unionByName(twice.withColumn("lost", F.lit(False)))
                         .groupBy("key").agg(F.max("lost").alias("lost")), "losers").selectExpr("key AS __marked", "lost AS __lost")
    keyed_docs = docs.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    may = key_filter(marked.withColumnRenamed("__marked", "key"))
    seen = keyed_docs.withColumn("__may", may(F.col("__key")))
    # equal rows share a key; of those with words (others are not among the marked) one stays
    nth = F.row_number().over(W.partitionBy("__key").orderBy("__key"))
    met = seen.where("__may").join(marked, F.col("__key") == F.col("__marked"), "left").where("NOT coalesce(__lost, false)")
    met = met.withColumn("__nth", nth).where("__nth = 1 OR __marked IS NULL")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return seen.where("NOT __may").select(names).union(met.select(names))


@query("op8_jaccard")
def op8_jaccard(spark, sf_dir):
    """All documents, four-word shingles, similarity of 0.85 or more."""
    return similar_documents(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")
