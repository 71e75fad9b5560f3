"""Packing by Karmarkar-Karp multiway differencing.

Documents are encoded where they are read; nothing is shuffled. Each whole window of a long document is a sequence of
its own. What is left of each is cut into pieces of at most PIECE ids, and short pieces are strung together to at least
STRING ids. Once pieces fill WINDOWS windows, differencing packs them: it starts with one partial partition a piece, and
again and again merges the two with the largest imbalance, the fullest window of one with the emptiest of the other. That
gives windows of nearly equal length. If one exceeds the capacity, the group gets one window more. At the end of a
partition, whole windows are packed likewise; only the last one is part-filled.

A task holds the ids of one group at most, and partial partitions hold only their windows in use: memory is bounded
however short or long texts are.

Defined results: null is an empty text, of the end id only; a null doc_id stays null; repeated rows are packed one by one; an
empty table gives an empty result; extra columns don't matter. sequence_id has the partition in its upper 31 bits, so
it is the same as long as the input is cut alike.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import tokens
from kelpline.llm.common import batches_of, pieces, table, text_bytes

CAPACITY, PIECE, STRING, WINDOWS, END = 2048, 256, 64, 128, 1
#: The last of a group's ids, one in FINE, are cut to pieces of FINEST.
FINE, FINEST = 32, 16
#: Ids that a group stays below the capacity of its windows, for each window: what differencing can't even out.
SPARE = 4


class Piece(NamedTuple):
    """Ids of a document from start on; `tokens` is the document's length, `row` tells documents of a task apart."""

    row: int
    doc_id: int | None
    start: int
    ids: bytes
    tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[: 4 * n]), self._replace(start=self.start + n, ids=self.ids[4 * n :])

    def size(self) -> int:
        return len(self.ids) // 4


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k lists of positions whose sums are nearly equal.

    A partial partition is the list of its used windows, fullest first: (sum, number of a set of positions).
    """
    n = len(sizes)
    tree: list[tuple[int, int]] = []  # joined sets: numbers under n are positions, others are n + place in tree
    heap: list[tuple[int, int, list[tuple[int, int]]]] = [(-s if k > 1 else 0, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = max(0, len(a) + len(b) - k)  # so many emptiest windows of both meet, the emptiest of a the fullest of b
        alone = a[: len(a) - over] + b[: len(b) - over]
        for (x, p), (y, q) in zip(reversed(a[len(a) - over :]), b[len(b) - over :], strict=True):
            tree.append((p, q))
            alone.append((x + y, n + len(tree) - 1))
        alone.sort(key=lambda w: -w[0])
        heapq.heappush(heap, ((alone[-1][0] if len(alone) == k else 0) - alone[0][0], turn, alone))
        turn += 1
    out: list[list[int]] = [[] for _ in range(k)]
    for members, (_, top) in zip(out, heap[0][2] if heap else [], strict=False):
        stack = [top]
        while stack:
            x = stack.pop()
            if x < n:
                members.append(x)
            else:
                stack.extend(tree[x - n])
        members.sort()
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """As few near-equal windows as differencing finds with none above the capacity."""
    k = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        k += 1


def strung(rest: list[Piece]) -> list[list[Piece]]:
    """Even pieces of at most PIECE ids, short ones together; the last FINE of all ids in pieces of FINEST: they even out what the larger leave."""
    out: list[list[Piece]] = []
    open_, left = STRING, sum(p.size() for p in rest)
    fine = left // FINE
    for p in rest:
        most = PIECE if left > fine else FINEST
        left -= p.size()
        each = -(-p.size() // -(-p.size() // most))
        while p.ids:
            part, p = p.cut(each)
            n = part.size()
            if open_ < min(STRING, most):
                out[-1].append(part)
                open_ += n
            else:
                out.append([part])
                open_ = n
    return out


def joined(parts: list[Piece]) -> list[Piece]:
    """Neighbouring pieces of a document as one."""
    out: list[Piece] = []
    for p in parts:
        if out and out[-1].row == p.row and out[-1].start + out[-1].size() == p.start:
            out[-1] = out[-1]._replace(ids=out[-1].ids + p.ids)
        else:
            out.append(p)
    return out


def grouped(rest: list[Piece], capacity: int) -> list[list[Piece]]:
    """The windows of one group."""
    strings = strung(rest)
    return [joined([p for i in members for p in strings[i]]) for members in windows([sum(p.size() for p in x) for x in strings], capacity)]


class Packer:
    """Sequences of the pieces that come in; `held` ids wait."""

    def __init__(self, capacity: int):
        self.capacity, self.rest, self.held = capacity, deque[Piece](), 0

    def taken(self, n: int) -> list[Piece]:
        """The first n ids that wait."""
        out = []
        self.held -= n
        while n:
            p = self.rest.popleft()
            if p.size() > n:
                p, left = p.cut(n)
                self.rest.appendleft(left)
            out.append(p)
            n -= p.size()
        return out

    def put(self, doc: Piece) -> Iterator[list[Piece]]:
        whole = doc.size() - doc.size() % self.capacity
        for at in range(0, whole, self.capacity):
            yield [doc._replace(start=at, ids=doc.ids[4 * at : 4 * (at + self.capacity)])]
        if doc.size() > whole:
            self.rest.append(doc.cut(whole)[1])
            self.held += doc.size() - whole
        if self.held >= WINDOWS * self.capacity:
            yield from grouped(self.taken(WINDOWS * (self.capacity - SPARE)), self.capacity)

    def end(self) -> Iterator[list[Piece]]:
        if k := self.held // self.capacity:
            yield from grouped(self.taken(k * (self.capacity - SPARE)), self.capacity)
        while self.held:
            yield joined(self.taken(min(self.held, self.capacity)))


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece of (doc_id, text)."""
    vocabulary = vocabulary or tokens.path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence, packer = tokens.encoder(vocabulary).encode, TaskContext.get().partitionId() << 33, Packer(capacity)
        out: list[tuple[int | None, ...]] = []
        row = 0

        def rows(found: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for window in found:
                offset = 0
                for p in window:
                    out.append((p.doc_id, p.start, p.size(), zlib.crc32(p.ids), p.tokens, sequence, offset))
                    offset += p.size()
                sequence += 1

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
            out.clear()
            return made

        for some in pieces(batches):
            key, text = some.column(0).to_pylist(), text_bytes(some.column(1))
            for s in batches_of(text):
                for k, x in zip(key[s], encode(text[s]), strict=True):
                    row += 1
                    rows(packer.put(Piece(row, k, 0, x + END.to_bytes(4, "little"), len(x) // 4 + 1)))
                    if len(out) >= 10_000:
                        yield batch()
        rows(packer.end())
        if out:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
