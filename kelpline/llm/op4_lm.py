"""Language-model scores by deleted interpolation.

The probability of a word after another is a mix of the maximum-likelihood bigram, the unigram and the uniform
distribution. The weights depend on the frequency bucket (a power of two) of the context. Expectation-maximisation
learns them on held-out counts: every training token is held out once, its own occurrence deleted from all counts.

How it runs: tasks turn documents into chunks of about CHUNK tokens. A chunk sends each of its distinct words and
bigrams once, as a 64-bit hash with its training count, to the bucket of the hash; so a frequent one weighs no more than a rare one.
Buckets add the counts up and send each chunk the totals of what it sent, in its order. With these, chunks score their
documents. A chunk writes FAN rows at any size of input. Where FAN buckets would be too large, sums of FAN chunks are
dealt out to FAN buckets of each, and so on: an exchange of several levels, whose replies go back the same way. Chunks and replies are
staged tables; nothing of the corpus reaches the driver but the number of tokens and
words, and the counts of (frequency bucket, bigram bin, unigram bin), at most 64 * BINS ** 2 rows at any size of input.

`score` is the model's log10 probability of the text. `deleted_score` is the same with each training token's own
occurrence deleted from its counts, as in learning: documents that the model has not seen elsewhere score as if held out.

Defined results: null is an empty text, whose only token is the end; a null doc_id counts as training; repeated rows
count and are scored each; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.common import mix64, pieces, removed, shared_dir, staged, table, text_bytes

FOLDS, HELD_OUT = 7, 2
CHUNK, BUCKET_BYTES, FAN = 2_000_000, 12_000_000, 128
#: Bins of log10 probability for the weights: 0.1 wide; bin 0 holds what is 0.
BINS, ROUNDS = 121, 100
#: Tokens whose probabilities are computed at a time.
SLICE = 250_000
STREAM, WORDS, PAIRS = 0, 1, 2


class Ids(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def squeezed(x: np.ndarray) -> bytes:
    """Byte planes of an array of integers, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def expanded(blob: bytes, kind: str) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pairs_of(tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context of each token, code of each bigram): contexts are token numbers, that of a first token is the end (0)."""
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[np.cumsum(lengths) - lengths] = 0
    return context, context * len(hashes) + tokens


def pair_keys(codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix64(mix64(hashes[codes // len(hashes)]) ^ (hashes[codes % len(hashes)] >> np.uint64(1)))


def dealt(keys: np.ndarray, counts: np.ndarray, fan: int, within: int = 0, of: int = 1) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, keys, counts) of ascending keys of bucket `within` of `of`, dealt out to its `fan` buckets."""
    edges = np.searchsorted(bucket_of(keys, of * fan), np.arange(within * fan, (within + 1) * fan + 1))
    for k in range(fan):
        s = slice(edges[k], edges[k + 1])
        if s.stop > s.start:
            yield within * fan + k, squeezed(np.diff(keys[s], prepend=np.uint64(0))), squeezed(counts[s])


def chunks(docs: DataFrame, fan: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(kind, chunk, bucket, keys, counts, docs, lengths): of each chunk its stream of tokens, and keys by bucket.

    A stream's `keys` are the hashes of its words in the order of their numbers, and its `counts` are the tokens' numbers. 0 is the end.
    """
    names = ["kind", "chunk", "bucket", "keys", "counts", "docs", "lengths"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        chunk = TaskContext.get().partitionId() << 32
        ids, doc_ids, parts, held = Ids({b"": 0}), [], [], 0

        def closed() -> pa.RecordBatch:
            lengths = np.array([len(p) for p in parts], np.int64)
            tokens = np.concatenate(parts)
            parts.clear()
            # frequent words get low numbers, which compress well
            count = np.bincount(tokens, minlength=len(ids))
            count[0] = len(tokens) + 1
            order = np.argsort(-count, kind="stable")
            number = np.empty_like(order)
            number[order] = np.arange(len(order))
            tokens = number[tokens]
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))[order]
            del count, order, number
            ids.clear()
            trains = np.repeat(~np.array([is_held_out(d) for d in doc_ids]), lengths)
            rows = [(STREAM, chunk, -1, hashes.tobytes(), squeezed(tokens.astype(np.int32)), doc_ids, lengths.tolist())]
            codes = pairs_of(tokens, lengths, hashes)[1]
            by = np.argsort(hashes)
            rows.extend((WORDS, chunk, *row, None, None) for row in dealt(hashes[by], np.bincount(tokens[trains], minlength=len(hashes))[by], fan))
            del tokens
            some, all_ = codes[trains], np.unique(codes)
            del codes
            some, n = np.unique(some, return_counts=True)
            counts = np.zeros(len(all_), np.int64)
            counts[np.searchsorted(all_, some)] = n
            del some, n
            keys = pair_keys(all_, hashes)
            del all_
            by = np.argsort(keys)
            rows.extend((PAIRS, chunk, *row, None, None) for row in dealt(keys[by], counts[by], fan))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in pieces(batches, 256):
            for d, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                words = t.lower().split()
                part = np.empty(len(words) + 1, np.int64)
                part[:-1] = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
                part[-1] = 0
                parts.append(part)
                doc_ids.append(d)
                held += len(part)
                if held >= CHUNK:
                    yield closed()
                    chunk, ids, doc_ids, parts, held = chunk + 1, Ids({b"": 0}), [], [], 0
        if parts:
            yield closed()

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "kind int, chunk long, bucket long, keys binary, counts binary, docs array<long>, lengths array<long>")


def added(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(keys of each row, all distinct ones, sums of their counts)."""
    keys = [np.cumsum(expanded(x, "<u8"), dtype=np.uint64) for x in pdf["keys"]]
    counts = np.concatenate([expanded(x, "<i8") for x in pdf["counts"]])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, distinct, np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)


def answers(pdf: pd.DataFrame, keys: list[np.ndarray], distinct: np.ndarray, total: np.ndarray) -> pd.DataFrame:
    """The totals of each row's keys, in their order."""
    found = [squeezed(total[np.searchsorted(distinct, k)]) for k in keys]
    return pd.DataFrame({"chunk": pdf["chunk"], "totals": found, "kind": pdf["kind"], "bucket": pdf["bucket"], "words": 0, "tokens": 0})


REPLY = "chunk long, totals binary, kind int, bucket long, words long, tokens long"


def summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The totals of one bucket for each chunk, in the chunk's order; chunk -1: number of words and tokens."""
    keys, distinct, total = added(pdf)
    own = {"chunk": [-1], "totals": [b""], "kind": [int(pdf["kind"].iloc[0])], "bucket": [int(pdf["bucket"].iloc[0])], "words": [int((total > 0).sum())], "tokens": [int(total.sum())]}
    return pd.concat([answers(pdf, keys, distinct, total), pd.DataFrame(own)])


def totals(rows: DataFrame, n_chunks: int, levels: int, of: int) -> DataFrame:
    """REPLY to rows (kind, chunk, bucket, keys, counts) with `of` buckets, which the levels below deal out further."""
    if levels <= 1:
        return staged(rows.groupBy("kind", "bucket").applyInPandas(summed, REPLY), "lm-replies")
    fan, n_above = FAN, max(1, n_chunks // FAN)
    above = F.pmod(F.xxhash64("chunk"), F.lit(n_above)).alias("above")

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        _, distinct, total = added(pdf)
        out = pd.DataFrame(list(dealt(distinct, total, fan, int(pdf["bucket"].iloc[0]), of)), columns=["bucket", "keys", "counts"])
        return out.assign(kind=int(pdf["kind"].iloc[0]), chunk=int(pdf["above"].iloc[0]))

    def spread(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        keys, distinct, _ = added(pdf)
        return answers(pdf, keys, distinct, np.concatenate([expanded(x, "<i8") for x in replies.sort_values("bucket")["totals"]]))

    rows = rows.select("*", above)
    up = staged(rows.groupBy("kind", "bucket", "above").applyInPandas(merged, "kind int, chunk long, bucket long, keys binary, counts binary"), "lm-up")
    below = totals(up, n_above, levels - 1, of * fan)
    mine = below.where("chunk >= 0").select("kind", F.floor(F.col("bucket") / fan).alias("own"), F.col("chunk").alias("above"), "bucket", "totals")
    down = rows.groupBy("kind", "bucket", "above").cogroup(mine.groupBy("kind", "own", "above")).applyInPandas(spread, REPLY)
    return staged(down.unionByName(below.where("chunk = -1")), "lm-replies")


class Resolved:
    """A chunk with the training counts of each token (word), its context and its bigram."""

    def __init__(self, stream: pd.DataFrame, replies: pd.DataFrame):
        row = stream.iloc[0]
        self.docs, self.lengths = list(row["docs"]), np.asarray(row["lengths"], np.int64)
        hashes, tokens = np.frombuffer(row["keys"], np.uint64), expanded(row["counts"], "<i4").astype(np.int64)
        context, codes = pairs_of(tokens, self.lengths, hashes)
        codes, place = np.unique(codes, return_inverse=True)
        words = self.totals(replies, WORDS, hashes)
        # a word in training text is always a context too; the end stands for the start, once a document
        self.word, self.context, self.pair = words[tokens], words[context], self.totals(replies, PAIRS, pair_keys(codes, hashes))[place]
        self.trains = np.repeat(~np.array([is_held_out(None if pd.isna(d) else int(d)) for d in self.docs]), self.lengths)

    @staticmethod
    def totals(replies: pd.DataFrame, kind: int, keys: np.ndarray) -> np.ndarray:
        mine = replies[replies["kind"] == kind].sort_values("bucket")
        out = np.empty(len(keys), np.int64)
        out[np.argsort(keys, kind="stable")] = np.concatenate([expanded(x, "<i8") for x in mine["totals"]])
        return out


    def slices(self) -> Iterator[tuple[slice, slice]]:
        """(documents, their tokens) of about SLICE tokens each, which bounds what is computed at a time."""
        ends = np.cumsum(self.lengths)
        at = begin = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, begin + SLICE, side="right")))
            yield slice(at, to), slice(begin, int(ends[to - 1]))
            at, begin = to, int(ends[to - 1])


def frequency(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's count: 0 for 0, else one more than the whole part of its binary logarithm."""
    return np.frexp(context.astype(np.float64))[1]


def bins(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(BINS - 1 + np.floor(np.log10(p) * 10), 1, BINS - 1), 0).astype(np.int64)


def evidence(chunk: Resolved, n: int) -> pd.DataFrame:
    """(bucket, bigram bin, unigram bin) of the training tokens of a chunk, each deleted from the counts: number and sums."""
    out = []
    for _, at in chunk.slices():
        t = chunk.trains[at]
        context, pair, word = chunk.context[at][t] - 1, chunk.pair[at][t] - 1, chunk.word[at][t] - 1
        p2, p1 = pair / np.maximum(context, 1), word / max(n - 1, 1)
        code = (frequency(context) * BINS + bins(p2)) * BINS + bins(p1)
        cells, place, count = np.unique(code, return_inverse=True, return_counts=True)
        sums = [np.bincount(place, weights=p, minlength=len(cells)) for p in (p2, p1)]
        out.append(pd.DataFrame({"bucket": cells // BINS**2, "cell": cells, "n": count, "p2": sums[0], "p1": sums[1]}))
    return pd.concat(out).groupby(["bucket", "cell"], as_index=False).sum()


def weights(cells: pd.DataFrame, words: int) -> np.ndarray:
    """(bigram, unigram, uniform) for each frequency bucket, by expectation-maximisation; unseen buckets use the next lower."""
    out = np.tile([0.0, 0.9, 0.1], (65, 1))
    for g in range(65):
        c = cells[cells["bucket"] == g]
        if not len(c):
            out[g] = out[g - 1] if g else out[g]
            continue
        n = c["n"].to_numpy(float)
        p = np.stack([c["p2"] / n, c["p1"] / n, np.full(len(c), 1 / (words + 1))])
        w = np.array([1 / 3, 1 / 3, 1 / 3]) if g else np.array([0, 0.5, 0.5])
        for _ in range(ROUNDS):
            share = w[:, None] * p
            w = (share / share.sum(0) * n).sum(1) / n.sum()
        w = np.maximum(w, 1e-9 * np.array([g > 0, 1, 1]))
        out[g] = w / w.sum()
    return out


def scores(chunk: Resolved, n: int, words: int, mix: np.ndarray) -> pd.DataFrame:
    def logs(context: np.ndarray, pair: np.ndarray, word: np.ndarray, total: np.ndarray | int) -> np.ndarray:
        w = mix[frequency(context)]
        return np.log10(w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / np.maximum(total, 1) + w[:, 2] / (words + 1))

    out = []
    for docs, at in chunk.slices():
        starts = np.cumsum(chunk.lengths[docs]) - chunk.lengths[docs]
        context, pair, word, t = chunk.context[at], chunk.pair[at], chunk.word[at], chunk.trains[at].astype(np.int64)
        values = {
            "n_known": (word > 0).astype(np.int64),
            "base_score": np.log10((word + 1) / (n + words + 1)),
            "score": logs(context, pair, word, n),
            "deleted_score": logs(context - t, pair - t, word - t, n - t),  # without the token's own occurrence, where it is one of training
        }
        own = pd.DataFrame({"doc_id": pd.Series(chunk.docs[docs], dtype="Int64"), "n_tokens": chunk.lengths[docs], "train_tokens": n} | {k: np.add.reduceat(x, starts) for k, x in values.items()})
        out.append(own.assign(held_out=[is_held_out(None if pd.isna(d) else int(d)) for d in chunk.docs[docs]]))
    return pd.concat(out)[["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "deleted_score"]]


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, deleted_score) of each document."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    path = f"{shared_dir(spark)}/kelpline-lm-{uuid.uuid4().hex}"
    levels = max(1, math.ceil(math.log(1 + size // BUCKET_BYTES, FAN)))
    found = chunks(docs, FAN)
    found.write.partitionBy("kind").option("compression", "uncompressed").parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    keys = found.where(F.col("kind") != STREAM).select("kind", "chunk", "bucket", "keys", "counts")
    replies = totals(keys, found.where(F.col("kind") == STREAM).count(), levels, FAN)
    for kind in (WORDS, PAIRS):  # summed up and answered: not read again
        removed(spark, f"{path}/kind={kind}")
    own = replies.where(F.col("chunk") == -1).where(F.col("kind") == WORDS).agg(F.sum("words"), F.sum("tokens")).first()
    words, n = own[0] or 0, own[1] or 0
    both = found.where(F.col("kind") == STREAM).groupBy("chunk").cogroup(replies.where("chunk >= 0").select("chunk", "kind", "bucket", "totals").groupBy("chunk"))

    def gather(stream: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return evidence(Resolved(stream, answers), n)

    cells = both.applyInPandas(gather, "bucket int, cell long, n long, p2 double, p1 double").groupBy("bucket", "cell").agg(*(F.sum(c).alias(c) for c in ("n", "p2", "p1")))
    mix = weights(cells.toPandas(), words)

    def score(stream: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return scores(Resolved(stream, answers), n, words, mix)

    return both.applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, deleted_score double")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
