"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosines.

Vectors are normalised, and only those of one label and dimension are compared. A table's hash of a vector is that of
PROJECTIONS quantised random projections floor((a.x + b) / WIDTH). Vectors at the threshold share a table's bucket with
a chance p that depends on their distance, so as many tables are made as reach RECALL there. The number of projections
grows with the logarithm of the largest label, so that buckets of unlike vectors stay small.

A bucket of more than BLOCK vectors is cut into blocks, compared two by two; so any bucket, however large, is compared
exactly, as tasks of bounded size. A pair counts in the first table whose bucket it shares. Of the pairs
found a task passes on only each vector's number of links and a spanning forest. Equal vectors are one class with a
count.

Defined results: a null label and a vector that is null, empty, zero or holds a null or non-finite component link with
nothing; repeated rows count as other vectors, and so do several vectors of one id; a component is named by its smallest
id, which is null if all of its ids are; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.common import cells, components, forest, mix64, pieces, staged, table

COSINE, RECALL, WIDTH, BLOCK, SEED = 0.93, 0.995, 2.0, 1024, 17
#: Rows that a task's group gets, about: many small buckets, or a pair of blocks.
GROUP = 4096


def chance(distance: float, width: float = WIDTH) -> float:
    """Of two vectors at that distance to share a quantised projection (p-stable hashing, normal projections)."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(most: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(projections, tables): about one unlike vector (at a right angle) a bucket among `most`."""
    near, far = chance(math.sqrt(2 - 2 * cosine)), chance(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(most, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def normalised(values: list[float | None] | None) -> np.ndarray | None:
    """In double precision, or None where it can't be."""
    if not values or None in values:
        return None
    x = np.asarray(values, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()  # keeps squares of very large or small components in range
    return x / np.sqrt((x * x).sum())


@lru_cache(4)
def projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, k, tables])
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, WIDTH, k * tables)


def hashed(units: np.ndarray, k: int, tables: int, first: int | None = None) -> np.ndarray:
    """64-bit bucket of each vector (row) in each of the first tables (column)."""
    first = tables if first is None else first
    a, b = (x[..., : k * first] for x in projections(units.shape[1], k, tables))
    cells = np.floor((units @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(units), first, k)
    out = np.repeat(np.arange(first, dtype=np.uint64)[None, :], len(units), axis=0)
    for i in range(k):
        out = mix64(out ^ cells[:, :, i])
    return out


def prepared(vectors: DataFrame) -> DataFrame:
    """(row, key, label, dim, unit, digest) of each vector; the last three are null where it can't link. row is a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in pieces(batches):
            labels = batch.column(2).to_pylist()
            units = [normalised(v) if g is not None else None for v, g in zip(batch.column(3).to_pylist(), labels, strict=True)]
            blobs = [None if u is None else u.tobytes() for u in units]
            dims = pa.array([None if u is None else len(u) for u in units], pa.int32())
            digests = pa.array([None if x is None else xxhash.xxh3_128_digest(f"{g}:".encode() + x) for g, x in zip(labels, blobs, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), dims, pa.array(blobs, pa.binary()), digests], names=["row", "key", "label", "dim", "unit", "digest"])

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("key"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "row long, key long, label long, dim int, unit binary, digest binary")


def bucketed(classes: DataFrame, k: int, tables: int) -> DataFrame:
    """classes with buckets, the 64-bit hashes of all tables as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            dim, units = np.asarray(batch.column(1)), batch.column(2).to_pylist()
            out: list[bytes] = [b""] * len(units)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                for i, h in zip(at.tolist(), hashed(np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(len(at), d), k, tables), strict=True):
                    out[i] = h.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), batch.column(4), pa.array(out, pa.binary())], names=["label", "dim", "unit", "class", "copies", "buckets"])

    return classes.select("label", "dim", "unit", "class", "copies").mapInArrow(run, "label long, dim int, unit binary, class long, copies long, buckets binary")


def linked_pairs(classes: DataFrame, k: int, tables: int, cosine: float, name: str) -> DataFrame:
    """(a, b, n): with b null, the class a links with n vectors of other classes found by a task; else a and b link."""
    places = classes.select("class", "label", "dim", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.substring("buckets", t * 8 + 1, F.lit(8)))).alias("t", "bucket"))
    sizes = places.groupBy("label", "dim", "t", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    cell = F.xxhash64("label", "dim", "t", "bucket")
    places = staged(places.join(sizes, ["label", "dim", "t", "bucket"]).select(cell.alias("cell"), "t", "size", "class"), f"{name}-places")
    groups = max(1, places.count() // GROUP)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = places.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("class", "t"), blocks).cast("int"))
    partners = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    rows = rows.withColumn("p", F.explode(partners)).select(F.pmod(F.xxhash64("cell", "p"), F.lit(groups)).alias("group"), "cell", "t", "p.i", "p.j", "own", "class")
    rows = rows.join(classes.select("class", "unit", "copies"), "class")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, ti, i_, j_, own, class_, copies = (pdf[c].to_numpy() for c in ("cell", "t", "i", "j", "own", "class", "copies"))
        units, out = pdf["unit"].to_numpy(), []
        wide = lambda x: np.frombuffer(b"".join(x), np.float64).reshape(len(x), -1)
        for at in cells([j_, i_, cell], class_):
            t, i, j = (int(c[at[0]]) for c in (ti, i_, j_))
            left, right = at[own[at] == i], at[own[at] == j]
            if not len(left) or not len(right):
                continue
            u, v = wide(units[left]), wide(units[right])
            hit = u @ v.T >= cosine
            if i == j:
                hit = np.triu(hit, 1)
            x, y = np.nonzero(hit)
            if not len(x):
                continue
            if t:  # an earlier table counts those that share its bucket
                (p, x_of), (q, y_of) = (np.unique(z, return_inverse=True) for z in (x, y))
                new = (hashed(u[p], k, tables, t)[x_of] != hashed(v[q], k, tables, t)[y_of]).all(axis=1)
                x, y = x[new], y[new]
            a, b = class_[left], class_[right]
            to_a, to_b = np.bincount(x, weights=copies[right][y], minlength=len(a)).astype(np.int64), np.bincount(y, weights=copies[left][x], minlength=len(b)).astype(np.int64)
            keep = forest(len(a) + len(b), x, y if i == j else y + len(a))
            for v, n in ((a, to_a), (b, to_b)):
                some = np.flatnonzero(n)
                out.append(np.stack([v[some], np.full(len(some), -1), n[some]]))
            out.append(np.stack([a[x[keep]], b[y[keep]], np.zeros(len(keep), np.int64)]))
        a, b, n = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return pd.DataFrame({"a": a, "b": pd.Series(b, dtype="Int64").mask(pd.Series(n) > 0), "n": n})

    return staged(rows.groupBy("group").applyInPandas(run, "a long, b long, n long"), f"{name}-pairs")


def linked(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(key, n_links, component_id) of each vector of (vec_id, embedding, label)."""
    name = "embeddings"
    rows = staged(prepared(vectors), f"{name}-units")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("row").alias("class"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit"))
    classes = staged(classes, f"{name}-classes")
    most = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    k, tables = plan(most, cosine, recall)
    pairs = linked_pairs(staged(bucketed(classes, k, tables), f"{name}-buckets"), k, tables, cosine, name)
    links = pairs.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    found = components(pairs.where("b is not null").select("a", "b").distinct(), name).withColumnRenamed("v", "class")
    of = classes.select("digest", "class", "copies").join(links, "class", "left").join(found, "class", "left")
    of = of.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component"))
    some = staged(rows.where("digest is not null").select("key", "digest").join(of, "digest").select("key", "n_links", "component"), f"{name}-found")
    names = some.groupBy("component").agg(F.min("key").alias("component_id"))
    some = some.join(names, "component").select("key", "n_links", "component_id")
    return some.unionByName(rows.where("digest is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linked(table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("key").alias("vec_id"), "n_links", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))
