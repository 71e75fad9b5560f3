"""Token ids in a binary format of byte or bit planes.

A dataset holds two Parquet tables (any file system that Spark writes to will do):
* chunks: (part, chunk, docs, lengths, block_ids, planes, payload). A chunk holds whole documents, at least CHUNK ids
  unless it is the last of its part. Its ids are cut into blocks of BLOCK ids; a block is transposed into 4 byte planes (or 32 bit
  planes), each plane is compressed with zstandard, and `planes` has the compressed sizes.
* index: (part, chunk, first_doc, last_doc, n_docs, start, n_ids), start: ids of all chunks before.
Parts are ranges of ascending (doc_id, hash of the text), so (part, chunk) is the order of documents.

Defined results: null is an empty text, whose only id is the end; a null doc_id comes first; repeated rows are kept,
each in its own place, by a hash of the text among rows of one id, so that reruns agree; an empty table makes an empty
dataset; extra columns don't matter.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.llm import tokens
from kelpline.llm.common import batches_of, pieces, shared_dir, table, text_bytes

BLOCK, CHUNK, END, LEVEL = 1 << 16, 1 << 18, 0, 3


class Files(NamedTuple):
    chunks: DataFrame
    index: DataFrame


def shuffled(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of one block, lowest first."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if not bits:
        return [r.tobytes() for r in rows]
    return [np.packbits(r >> np.uint8(k) & np.uint8(1)).tobytes() for r in rows for k in range(8)]


def unshuffled(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    else:
        ones = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes]).reshape(4, 8, n)
        rows = (ones << np.arange(8, dtype=np.uint8)[None, :, None]).sum(1, dtype=np.uint8)
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


def packed(ids: np.ndarray, bits: bool = False) -> tuple[list[int], list[int], bytes]:
    """(ids of each block, compressed size of each plane, payload)."""
    import zstandard

    out, sizes, press = [], [], zstandard.ZstdCompressor(level=LEVEL)
    blocks = [ids[at : at + BLOCK] for at in range(0, len(ids), BLOCK)]
    for block in blocks:
        for plane in shuffled(block, bits):
            out.append(press.compress(plane))
            sizes.append(len(out[-1]))
    return [len(b) for b in blocks], sizes, b"".join(out)


def unpacked(blocks: list[int], sizes: list[int], payload: bytes) -> np.ndarray:
    import zstandard

    if not blocks:
        return np.zeros(0, "<u4")
    press, at, k, out, each = zstandard.ZstdDecompressor(), 0, 0, [], len(sizes) // len(blocks)
    for n in blocks:
        planes = []
        for size in sizes[k : k + each]:
            planes.append(press.decompress(payload[at : at + size]))
            at += size
        k += each
        out.append(unshuffled(planes, n))
    return np.concatenate(out)


def write(docs: DataFrame, path: str, vocabulary: str | None = None, bits: bool = False) -> None:
    """Encodes (doc_id, text) and writes the dataset at path."""
    vocabulary = vocabulary or tokens.path()
    names = ["part", "chunk", "docs", "lengths", "block_ids", "planes", "payload"]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, chunk = tokens.encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        keys: list[int | None] = []
        held = 0

        def closed() -> pa.RecordBatch:
            row = [part, chunk, keys, [len(x) // 4 for x in ids], *packed(np.frombuffer(b"".join(ids), "<u4"), bits)]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=names)

        for batch in pieces(batches):
            key, text = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for s in batches_of(text):
                for k, x in zip(key[s], encode(text[s]), strict=True):
                    keys.append(k)
                    ids.append(x + END.to_bytes(4, "little"))
                    held += len(ids[-1]) // 4
                    if held >= CHUNK:
                        yield closed()
                        chunk, held, ids, keys = chunk + 1, 0, [], []
        if ids:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(run, "part int, chunk long, docs array<long>, lengths array<long>, block_ids array<int>, planes array<int>, payload binary").write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    chunks = docs.sparkSession.read.parquet(f"{path}/chunks")
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, x: a + x)
    index = chunks.select("part", "chunk", F.element_at("docs", 1).alias("first_doc"), F.element_at("docs", -1).alias("last_doc"), F.size("docs").cast("long").alias("n_docs"), total("lengths").alias("n_ids"))
    # one row a part passes through the window over all parts
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("base"))
    index = index.withColumn("inner", before(Window.partitionBy("part").orderBy("chunk"))).join(parts, "part")
    index.select("part", "chunk", "first_doc", "last_doc", "n_docs", (F.col("base") + F.col("inner")).alias("start"), "n_ids").write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> Files:
    return Files(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/index"))


def documents(files: Files, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the chunks; with ids: also ids, as array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8):
            for r in batch.to_pylist():
                data = unpacked(r["block_ids"], r["planes"], r["payload"])
                ends = np.cumsum(r["lengths"])
                cut = [data[e - n : e] for e, n in zip(ends.tolist(), r["lengths"], strict=True)]
                columns = [pa.array([r["part"]] * len(cut), pa.int32()), pa.array([r["chunk"]] * len(cut), pa.int64()), pa.array(r["docs"], pa.int64()), pa.array(ends - r["lengths"], pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                names = ["part", "chunk", "doc_id", "inner", "n_tokens", "ids_crc32"]
                if ids:
                    columns, names = [*columns, pa.array([x.tolist() for x in cut], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = files.chunks.mapInArrow(run, "part int, chunk long, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
    rows = rows.join(files.index.select("part", "chunk", "start"), ["part", "chunk"])
    return rows.select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def op6_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/kelpline-ids-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return documents(read(spark, path))
