"""Hierarchical multi-length packing of tokenised documents.

Documents are routed by length to context-size tiers.  A document longer than the largest
tier gives whole windows and a rest; rests of (512, 1023] tokens open 1024-token windows,
(256, 512] open 512-token ones, shorter ones 256-token ones.  The gap of a window is filled
with the largest rests of shorter tiers that fit, and closed by cutting one document at the
end, so that every window but the last of a task is exactly full.  Each task packs its own
rows in one pass without a shuffle; it holds at most ``POOL`` open rests.  The windows of a
tier are dealt evenly into step groups of about ``step_tokens`` tokens.

Ids are those of the tokenizers library, which takes an added token of the file that stands in a
text (``<|endoftext|>``) as that token.

Defined cases: null or empty text is the end token alone; repeated rows and null ids are
packed as they come; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidegate.llm.common import identified, release, table
from tidegate.llm.registry import query
from tidegate.llm.tokens import encoder, runs

TIERS = (256, 512, 1024)
STEP_TOKENS = 1 << 16
END = 0
POOL = 8192
SETTLE = 512
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier long, step_group long")


class Packer:
    """Packs the rests of one task; rows() gives what is complete."""

    def __init__(self, task: int, tiers=TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step, self.base = tuple(sorted(tiers)), step_tokens, task << 40
        self.top = self.tiers[-1]
        self.pool: list[tuple] = []   # (length, arrival, document, start, ids), sorted
        self.arrival = self.sequences = self.groups = 0
        self.done: list[tuple[int, list[tuple]]] = []  # (tier, pieces)
        self.settled: list[tuple[int, list[tuple]]] = []  # the same with number and crc32 of a piece's ids in their place

    def add(self, document: tuple, ids: bytes) -> None:
        """document: (doc_id, tokens).  Cuts whole windows; the rest waits."""
        n, at = len(ids) // 4, 0
        while n - at >= self.top:
            self.done.append((self.top, [(document, at, ids[4 * at: 4 * (at + self.top)])]))
            at += self.top
        if at < n:
            self._wait(document, at, ids[4 * at:])

    def _wait(self, document, start: int, ids: bytes) -> None:
        self.arrival += 1
        insort(self.pool, (len(ids) // 4, self.arrival, document, start, ids), key=lambda x: x[:2])

    def _take(self, i: int) -> tuple:
        return self.pool.pop(i)

    def pack(self, last: bool) -> None:
        """Fill windows from the longest tier down; what cannot be completed waits unless this is the last call."""
        while self.pool:
            length, _, document, start, ids = self._take(len(self.pool) - 1)
            tier = self.tiers[bisect_left(self.tiers, length)]
            held, gap = [(document, start, ids)], tier - length
            while gap and self.pool:
                shorter = max([t for t in self.tiers if t < tier], default=tier)
                i = bisect_right(self.pool, min(gap, shorter), key=lambda x: x[0]) - 1
                if i >= 0:
                    n, _, other, at, more = self._take(i)
                    held.append((other, at, more))
                    gap -= n
                    continue
                n, _, other, at, more = self._take(bisect_right(self.pool, gap, key=lambda x: x[0]) % len(self.pool))
                cut = min(n, gap)
                held.append((other, at, more[: 4 * cut]))
                if cut < n:
                    self._wait(other, at + cut, more[4 * cut:])
                gap -= cut
            if gap and not last:
                for other, at, more in held:
                    self._wait(other, at, more)
                return
            self.done.append((tier if not gap else self.top, held))

    def settle(self) -> int:
        """Number of complete windows; their ids are no longer held."""
        for tier, pieces in self.done:
            self.settled.append((tier, [(document, start, len(ids) // 4, zlib.crc32(ids)) for document, start, ids in pieces]))
        self.done = []
        return len(self.settled)

    def rows(self) -> pa.RecordBatch | None:
        if not self.settle():
            return None
        total = {t: sum(1 for tier, _ in self.settled if tier == t) for t in self.tiers}
        groups = {t: max(1, round(total[t] * t / self.step)) for t in self.tiers}
        first, seen, out = {}, dict.fromkeys(self.tiers, 0), [[] for _ in range(9)]
        for t in self.tiers:
            first[t] = self.base + self.groups
            self.groups += groups[t] if total[t] else 0
        for tier, pieces in self.settled:
            group, at = first[tier] + seen[tier] * groups[tier] // total[tier], 0
            seen[tier] += 1
            for (doc_id, tokens), start, n, crc in pieces:
                for column, value in zip(out, (doc_id, start, n, crc, tokens, self.base + self.sequences, at, tier, group)):
                    column.append(value)
                at += n
            self.sequences += 1
        self.settled = []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)


def pack(docs: DataFrame, tiers=TIERS, step_tokens: int = STEP_TOKENS, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """One row per piece of a document: where its ids lie in the document and in which sequence."""
    closing = np.asarray([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary), Packer(TaskContext.get().partitionId(), tiers, step_tokens)
        for batch in batches:
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for piece in runs(texts):
                for doc_id, raw in zip(doc_ids[piece], encode.batch(texts[piece])):
                    ids = np.frombuffer(raw, encode.kind).astype("<u4").tobytes() + closing
                    packer.add((doc_id, len(ids) // 4), ids)
                    if len(packer.pool) >= POOL:
                        packer.pack(last=False)
                    if len(packer.done) >= SETTLE:
                        packer.settle()
                    if len(packer.settled) + len(packer.done) >= 2 * POOL:
                        yield packer.rows()
        packer.pack(last=True)
        if (rows := packer.rows()) is not None:
            yield rows
        release()

    return identified(docs).mapInArrow(run, SCHEMA)


@query("op5_packing")
def op5_packing(spark, sf_dir):
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
