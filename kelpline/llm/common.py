"""Shared pieces of the training-data operators: word rules, Arrow helpers, staged tables and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.sources.staging import dropped, removed, shared_dir, staged  # noqa: F401  for the operators
from kelpline.sources.tables import table  # noqa: F401

#: Fixed value: a word is a run of anything but space and \x09-\x0D. bytes.split() without arguments cuts exactly there.
WORD = r"[^\x20\x09-\x0D]+"


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, which bounds what Python holds of wide rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batches_of(texts: list[bytes], size: int = 4_000_000) -> list[slice]:
    """Slices of at most that many bytes, or of one text."""
    out, begin, held = [], 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > size:
            out.append(slice(begin, k))
            begin, held = k, 0
        held += len(t)
    return [*out, slice(begin, len(texts))] if texts else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Positions of the edges that a union-find over 0..n-1 takes, in the given order: at most n - 1."""
    up = list(range(n))

    def top(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    taken = []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            taken.append(k)
    return np.asarray(taken, dtype=np.int64)


def cells(keys: list[np.ndarray], rank: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of each set of rows with equal keys, by rank in it."""
    order = np.lexsort((rank, *keys))
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    yield from np.split(order, np.flatnonzero(new))


#: Rows of a few numbers each that are sent to all executors at most: under 100 MB as a table to join with.
FEW_ROWS = 1_000_000


def sent(rows: DataFrame) -> DataFrame:
    """rows of a few numbers for a join: sent to all executors if they are at most FEW_ROWS (counted), else shuffled."""
    return F.broadcast(rows) if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS else rows


#: Edges (two numbers each) that are few enough to be joined by one task.
FEW_EDGES = 16_384


def joined_up(edges: DataFrame) -> DataFrame:
    """(v, to) of every vertex of at most FEW_EDGES edges (a, b): the smallest that it reaches, found by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [np.stack([np.asarray(x.column(0)), np.asarray(x.column(1))]) for x in batches]
        if both:
            a, b = np.concatenate(both, axis=1)
            names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            up = np.arange(len(names))
            for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist(), strict=True):
                while up[x] != x:
                    up[x] = x = up[up[x]]
                while up[y] != y:
                    up[y] = y = up[up[y]]
                up[max(x, y)] = min(x, y)
            while (up != up[up]).any():
                up = up[up]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(names[up], pa.int64())], names=["v", "to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "v long, to long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(v, component) of every vertex of the edges (a, b): the smallest vertex that it reaches.

    By contraction: in each round a vertex joins the first of itself and its neighbours, in an order by degree and then by a
    hash that is new each round. Chains of such steps are followed four deep, the edges get the new names, and those within a
    name go. Stars are gone after a round and paths shrink by a factor, so the rounds grow with the logarithm of the size and
    the work is mostly that of the first. Joins and map-side combined minima only; each round is a staged table. Once at most
    FEW_EDGES are left, one task ends it.
    """
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges")
    steps: list[DataFrame] = []
    while edges.count() > FEW_EDGES:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        ranks = staged(both.groupBy("v").agg(F.count("*").alias("degree")).select("v", F.struct(-F.col("degree"), F.xxhash64("v", F.lit(len(steps))), "v").alias("rank")), f"{name}-ranks")
        near = both.join(ranks.select(F.col("v").alias("u"), F.col("rank").alias("other")), "u").groupBy("v").agg(F.min("other").alias("other"))
        first = step = staged(ranks.join(near, "v").select("v", F.least("rank", "other")["v"].alias("to")), f"{name}-step")
        for _ in range(2):
            step = step.join(step.select(F.col("v").alias("to"), F.col("to").alias("next")), "to").select("v", F.col("next").alias("to"))
        step = staged(step, f"{name}-step")
        new = edges
        for c in ("a", "b"):
            new = new.join(step.select(F.col("v").alias(c), F.col("to").alias(f"new_{c}")), c)
        new = new.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).where("a <> b").distinct()
        new = staged(new, f"{name}-edges")
        dropped(edges, ranks, first)
        edges = new
        steps.append(step)
    steps.append(staged(joined_up(edges), f"{name}-step"))
    if len(steps) == 1:
        return steps[0].select("v", F.col("to").alias("component"))
    roots = steps[-1].select("v", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        roots = step.join(roots.select(F.col("v").alias("to"), "root"), "to", "left").select("v", F.coalesce("root", "to").alias("root"))
    roots = staged(roots, f"{name}-roots")
    found = staged(roots.join(roots.groupBy("root").agg(F.min("v").alias("component")), "root").select("v", "component"), f"{name}-components")
    dropped(edges, roots, *steps)
    return found
