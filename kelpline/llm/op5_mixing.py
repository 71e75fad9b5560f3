"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same fractional number of copies, target / size of the source. The whole part is
taken; the fraction is a probability. Two documents at a time, mass (probability times size) moves from one to the
other at random, so that the sum of the mass and each expectation stay, until one probability is 0 or 1. What a
bucket of documents can't settle, one residual document, meets the residuals of other buckets in a reduction tree;
one document a source is rounded last. Long documents go first, so that a short one is left: a source's taken words
miss the target by less than one document, and most often by a short one.

Randomness comes from hashes of ids, and buckets from hashes and counts: reruns agree on any layout of the input.

Defined results: a null text has size 0 and takes 0; null is a source of its own, the last; repeated rows (same id and
text) are one unit and share its decision; a table without words takes nothing; extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.llm.common import WORD, sent, staged, table

BUCKET, FAN_IN, MOST, CYCLE = 256, 64, 3, 3
#: Sources are dealt out to documents by a broadcast join up to this many (checked), by a shuffled join beyond.
BROADCAST_SOURCES = 20_000


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, src, size, mark): mark tells texts apart where ids repeat."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("key"), F.col(source).alias("src"), words.alias("size"), F.xxhash64(F.col(key), F.col(text), F.col(source)).alias("mark"))


def targets(units: DataFrame) -> DataFrame:
    """(src, source_size, target, n): weights 1, 2, 3 repeat in the order of sources; none takes over 3 times its size.

    Water filling: with sources in ascending order of cap / weight, the first k are at their cap and the others share
    the rest by weight, for the least k that leaves none above. One row a source passes through these windows.
    """
    by = Window.orderBy(F.col("src").asc_nulls_last())
    rows = units.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rows = rows.withColumn("weight", ((F.row_number().over(by) - 1) % CYCLE + 1).cast("double")).withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("src").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.select("*", F.sum("source_size").over(every).cast("double").alias("total"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"), (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"))
    rows = rows.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open")).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    rows = rows.withColumn("free", F.max(F.col("fits").cast("int")).over(order)).withColumn("at", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    return rows.select("src", "source_size", F.when(F.col("free") == 1, F.col("at") * F.col("weight")).otherwise(F.col("cap")).alias("target"), "n")


def settle(pdf: pd.DataFrame, first: bool, last: bool) -> pd.DataFrame:
    """Pivotal rounding, long documents first; p ends at 0 or 1 but for one row, which `last` rounds too.

    A document whose mass all shorter ones together can't absorb pair by pair (its square exceeds the sum of theirs)
    is paired with all of them at once, as long as they share one probability (`first`): they move together.
    """
    pdf = pdf.sort_values(["rank", "mark", "key"], kind="stable", na_position="last")
    p, mass, coin = pdf["p"].tolist(), pdf["unit"].astype(float).tolist(), ((pdf["mark"].to_numpy("int64").view("uint64") >> 11) / 2.0**53).tolist()
    if first:
        rest, squares = sum(mass), sum(x * x for x in mass)
        for i, m in enumerate(mass):
            rest, squares = rest - m, squares - m * m
            if m * m < squares or rest <= 0:
                break
            less, more = p[i] - (1 - p[i]) * m / rest, p[i] + p[i] * m / rest
            if 0 < p[i] < 1 and 0 <= less and more <= 1:
                taken = coin[i] < p[i]
                p[i + 1 :] = [less if taken else more] * (len(p) - i - 1)
                p[i] = float(taken)
    open_, turn = -1, 0
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if mass[j] == 0:
            p[j] = 0.0
            continue
        if open_ < 0:
            open_ = j
            continue
        i, turn = open_, turn + 1
        up, down = min((1 - p[i]) * mass[i], p[j] * mass[j]), min(p[i] * mass[i], (1 - p[j]) * mass[j])
        u = (coin[i] + coin[j] * 0.6180339887498949 + turn * 0.7548776662466927) % 1.0
        if u * (up + down) < down:  # i gains with the chance that keeps both expectations
            full, p_i, p_j = (1 - p[i]) * mass[i] <= p[j] * mass[j], p[i] + up / mass[i], p[j] - up / mass[j]
            p[i], p[j] = (1.0, p_j) if full else (p_i, 0.0)
        else:
            empty, p_i, p_j = p[i] * mass[i] <= (1 - p[j]) * mass[j], p[i] - down / mass[i], p[j] + down / mass[j]
            p[i], p[j] = (0.0, p_j) if empty else (p_i, 1.0)
        p[i], p[j] = (min(max(x, 0.0), 1.0) if 1e-12 < x < 1 - 1e-12 else float(round(x)) for x in (p[i], p[j]))
        open_ = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    if last and open_ >= 0:
        p[open_] = float(coin[open_] < p[open_])
    return pdf.assign(p=p)


def settler(first: bool, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return settle(pdf, first, last)

    return run


def copies(units: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, src, mark, size, source_size, target, copies) for each unit."""
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    most = sources.agg(F.max("n")).first()[0] or 0
    same = units.groupBy("key", "src", "mark", "size").agg(F.count("*").alias("rows"))
    own = same["src"].eqNullSafe(sources["src"])
    rows = same.join(F.broadcast(sources) if few else sources, own).drop(sources["src"])
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    rows = rows.select("key", "src", "mark", "size", "source_size", "target", "rows", (F.col("size") * F.col("rows")).alias("unit"), F.floor(ratio).cast("long").alias("whole"), (ratio - F.floor(ratio)).alias("p"), (-F.col("size") * F.col("rows")).alias("rank"), F.pmod(F.xxhash64("mark"), F.ceil(F.col("n") / BUCKET)).alias("bucket"))
    kinds = rows.schema
    levels, spread = 0, math.ceil(most / BUCKET)
    while spread > 1:
        levels, spread = levels + 1, math.ceil(spread / FAN_IN)
    done = None
    for level in range(levels + 1):
        last = level == levels
        rows = staged(rows.groupBy("src", "bucket").applyInPandas(settler(level == 0, last), kinds), f"mix-{level}")
        closed = rows.where("p = 0 or p = 1") if not last else rows
        done = closed if done is None else done.unionByName(closed)
        rows = rows.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
    return done.withColumn("copies", F.col("whole") + F.col("p").cast("long"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each row of docs: (key, src, mark, size, source_size, target, copies)."""
    units = staged(sized(docs, key, text, source), "mix-units")
    found = copies(units, staged(targets(units), "mix-sources"))
    return found.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select("key", "src", "mark", "size", "source_size", "target", "copies")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(table(spark, sf_dir, "documents"))
    return rows.select(F.col("key").alias("doc_id"), "size", F.col("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def take(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; all columns and their order stay."""
    names = docs.columns
    units = staged(sized(docs), "mix-units")
    found = sent(staged(copies(units, staged(targets(units), "mix-sources")).select("key", "mark", "copies").where("copies > 0"), "mix-copies"))
    rows = docs.select(F.struct(*names).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text", "source").alias("own"))
    rows = rows.join(found, (F.col("own") == F.col("mark")) & F.col("id").eqNullSafe(F.col("key")))
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
