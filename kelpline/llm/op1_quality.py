"""Quality rules as weak supervision: rules vote or abstain, EM estimates accuracies, a posterior decides.

Each document gets nine votes: 1 (good), -1 (bad) or 0 (abstains). A two-class model in which votes are independent
given the class is fitted by expectation-maximisation over the counts of vote patterns of *all* documents. There are
at most 3 ** 9 patterns, so what reaches the driver has that bound at any size of input.

Defined results: a null or empty text has no word, fails the base rule and isn't kept; repeated rows get the same
verdict each; an empty table gives an empty result; other columns are left alone whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.common import column, pieces, staged, table, text_bytes

MIN_WORDS, MAX_REPEAT_PERCENT, RARE = 50, 50, 0.01
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
#: Bytes that are neither white space nor, in UTF-8, part of a letter or another character above ASCII.
NOT_LETTERS = bytes(b for b in range(128) if bytes([b]) not in (bytes([x]) for x in SPACES) and not chr(b).isalpha())
RULES = ("symbols", "capitals", "word_length", "dup_lines", "repeats", "distinct", "letters", "line_ends", "worded")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_letters", "n_distinct", "n_lines", "n_ended", "n_worded")


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words in 3-word windows that are found twice or more."""
    if len(ids) < 4:
        return 0
    if distinct < 1 << 21:
        keys = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:  # the product of three would overflow
        pair = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
        keys = pair[:-1] * distinct + ids[2:]
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= twice
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """BASE and MORE of one text."""
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    spaces = int(bytes_[list(SPACES)].sum())
    upper = int(bytes_[65:91].sum())
    return (
        len(words), len(text) - int(bytes_[128:192].sum()) - spaces, int(bytes_[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeat_words(ids, len(seen)),
        upper, upper + int(bytes_[97:123].sum()) + int(bytes_[192:].sum()), len(seen), len(lines), sum(x.rstrip(SPACES)[-1:] in b".!?" for x in lines), len(text.translate(None, NOT_LETTERS).split()),
    )


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """The pattern of votes of each document as a number in base 3, digit 0: bad, 1: abstains, 2: good."""
    per_word = lambda x: x / np.maximum(m["n_words"], 1)
    share = lambda x, of: x / np.maximum(of, 1)
    vote = lambda good, bad: good.astype(np.int64) - bad + 1
    length, upper, ended = per_word(m["word_chars"]), share(m["n_upper"], m["n_letters"]), share(m["n_ended"], m["n_lines"])
    dup, letters, long = share(m["n_dup_lines"], m["n_lines"]), share(m["n_letters"], m["word_chars"]), m["n_words"] >= MIN_WORDS
    cast = (
        vote(per_word(m["n_symbols"]) <= 0.02, per_word(m["n_symbols"]) > 0.1),
        vote(upper < 0.1, upper > 0.3),
        vote((length > 3) & (length < 6.5), (length < 2.5) | (length > 7.2)),
        vote((dup == 0) & (m["n_lines"] > 2), dup > 0.4),
        vote(long & (per_word(m["n_repeat_words"]) < 0.1), per_word(m["n_repeat_words"]) > 0.3),
        vote(long & (per_word(m["n_distinct"]) > 0.4), long & (per_word(m["n_distinct"]) < 0.2)),
        vote(letters > 0.85, letters < 0.7),
        vote(ended > 0.7, (ended < 0.3) & (m["n_lines"] > 2)),
        vote(per_word(m["n_worded"]) > 0.9, per_word(m["n_worded"]) < 0.75),
    )
    pattern = np.zeros(len(length), dtype=np.int64)
    for digit in cast:
        pattern = pattern * 3 + digit
    return pattern


def _measured(text: pa.Array) -> dict[str, np.ndarray]:
    rows = np.array([measure(t) for t in text_bytes(text)], dtype=np.int64).reshape(-1, len(BASE + MORE))
    return dict(zip(BASE + MORE, rows.T, strict=True))


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, BASE columns, base_failed, pattern) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            m = _measured(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[k]) for k in BASE), pa.array(base_failed(m)), pa.array(votes(m))], names=["key", *BASE, "base_failed", "pattern"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {', '.join(f'{k} long' for k in BASE)}, base_failed boolean, pattern long")


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> dict[int, float]:
    """Posterior probability of good for each pattern. EM over (prior, accuracy among good, accuracy among bad).

    Each accuracy has a Beta(8, 2) prior, which fixes which class is the good one and holds rules that rarely vote. A
    rule's bad votes are cast so late that at most RARE of the good documents get one; without that bound, a kind of bad
    document that only few rules see would be taken for good ones with odd votes.
    """
    cast = np.stack([patterns // 3**k % 3 for k in reversed(range(len(RULES)))], axis=1) - 1
    plus, minus, c = (cast > 0).astype(float), (cast < 0).astype(float), counts.astype(float)
    good = (plus.sum(1) - 2 * minus.sum(1) > 0).astype(float) * 0.8 + 0.1
    for _ in range(rounds):
        w, v = c * good, c * (1 - good)
        prior = (w.sum() + 8) / (c.sum() + 10)
        yes = np.maximum((w @ plus + 8) / (w @ (plus + minus) + 10), 1 - RARE)
        no = (v @ minus + 8) / (v @ (plus + minus) + 10)
        score = np.log(prior / (1 - prior)) + plus @ np.log(yes / (1 - no)) + minus @ np.log((1 - yes) / no)
        good = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
    return dict(zip(patterns.tolist(), good.tolist(), strict=True))


def learn(measured_docs: DataFrame) -> dict[int, float]:
    """The posterior of every vote pattern, from the pattern counts of all documents (at most 3 ** 9 rows)."""
    rows = measured_docs.where("n_words > 0").groupBy("pattern").count().collect()
    return fit(np.array([r["pattern"] for r in rows], dtype=np.int64), np.array([r["count"] for r in rows], dtype=np.int64)) if rows else {}


def judged(measured_docs: DataFrame, posterior: dict[int, float], threshold: float = 0.5) -> DataFrame:
    """Adds posterior and kept."""
    found = measured_docs.sparkSession.createDataFrame([*posterior.items()], "pattern long, posterior double")
    out = measured_docs.join(F.broadcast(found), "pattern", "left").withColumn("posterior", F.coalesce("posterior", F.lit(0.0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = staged(measured(table(spark, sf_dir, "documents")), "quality")
    return judged(docs, learn(docs)).select(F.col("key").alias("doc_id"), *BASE, "base_failed", "kept", "posterior")


def keep_good(docs: DataFrame, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The documents with a posterior of at least threshold that pass the base rule, with all their columns.

    The first pass fits the model; the second measures again while it filters, so whole texts are never shuffled.
    """
    posterior = learn(measured(docs, docs.columns[0], text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            m = _measured(column(batch, text))
            good = np.array([posterior.get(p, 0.0) >= threshold for p in votes(m).tolist()], dtype=bool)
            yield batch.filter(pa.array(good & ~base_failed(m)))

    return docs.mapInArrow(run, docs.schema)
