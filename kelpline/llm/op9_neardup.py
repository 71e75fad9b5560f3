"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is that of its shingles; equal sets are one class from the start, so copies are never compared. Each
class has SIGNATURE minwise tokens. In each of several independent trees, a node holds the classes that agree in the
tokens its path has chosen. A node with more than BLOCK classes is branched (BRANCH times, by STEP more tokens each)
until DEPTH; smaller ones are compared exhaustively by signature. There are as many trees as let a pair at the threshold
meet with chance RECALL, if all nodes on its way are branched: 10 at 85 %, 15 at 80 %.

Only components are asked for, so a comparison passes on a spanning forest of its candidates, the likeliest first: less
rows than it got. What stays over BLOCK at the last level is a crowd, whose members are candidates of its first one.
Candidates make up families, and within these all links are found exactly, on full sets:

* A family of up to BLOCK classes is compared as a whole in a task.
* In a larger one, each set is told by how it differs from the family's reference, the tokens that most members hold
  (`parted`). Members whose differences are few enough link with the most central one. Other links must share differences,
  of which the commonest can be left out (a prefix filter). Members that share one make smaller families, which are
  treated alike. Pages of one template differ in tokens of their own, so their family falls apart at once: rows grow
  with the sets' sizes, not with the square of the family. Only a family that doesn't shrink so is compared in pairs of blocks.

Defined results: null, empty and wordless texts have the empty set and link with nothing; repeated rows are a class; an
empty table gives an empty result; extra columns don't matter. Rows are told apart by a number of their own, so an id may
be null or stand for several texts. A component is named by its smallest id, which is null if all of its ids are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.llm.common import cells, components, dropped, forest, mix64, pieces, sent, staged, table, text_bytes

WORDS, PERCENT = 3, 85
SIGNATURE, FIRST, STEP, BRANCH, DEPTH, BLOCK = 64, 3, 2, 2, 3, 256
#: Chance of a pair at the threshold to meet in a tree.
RECALL = 0.9995
#: Rows that a task's group gets, about: signatures of many small nodes, or full sets of many small families.
GROUP, SETS = 8192, 512
#: A part of a family that is larger than this share of it has not shrunk.
SHRUNK = 0.9
#: Standard errors of the estimated similarity that a candidate may lie below the threshold.
SLACK = 3.5


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; A-Z are lower-cased first."""
    import xxhash

    found = text.lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1) if len(h) else 0
    k = min(words, len(h))
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix64(out ^ h[i : i + n])
    return np.unique(out)


def signature(shingles_: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The minwise token of each of the seeds' orders, 32 bits each."""
    best = np.full(len(seeds), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles_), 4096):
        part = shingles_[at : at + 4096]
        with np.errstate(over="ignore"):
            best = np.minimum(best, ((part[None, :] * seeds[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return best


def seeds(n: int = SIGNATURE) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def sketched(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, n_shingles, set_id, signature): set_id is a 128-bit hash of the set, null for the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        by = seeds()
        for batch in pieces(batches):
            sets = [shingles(t, words) for t in text_bytes(batch.column(1))]
            ids = [xxhash.xxh3_128_digest(s) if len(s) else None for s in sets]
            signs = [signature(s, by).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(ids, pa.binary()), pa.array(signs, pa.binary())], names=["key", "n_shingles", "set_id", "signature"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_shingles long, set_id binary, signature binary")


def trees(percent: int) -> int:
    """How many reach RECALL at the threshold, if a path is branched at all levels."""
    similar, on = percent / 100, 1.0
    for _ in range(DEPTH - 1):
        on = 1 - (1 - similar**STEP * on) ** BRANCH
    return math.ceil(math.log(1 - RECALL) / math.log(1 - similar**FIRST * on))


def branched(rows: DataFrame, level: int, n_trees: int) -> DataFrame:
    """(node, class) at the next level: tree, branch and the tokens chosen at the node extend the path."""
    token = lambda k: F.substring("signature", k.cast("int") * 4 + 1, F.lit(4))
    if level == 0:
        rows = rows.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
        path = [token(F.pmod(F.col("branch") * FIRST + i, F.lit(SIGNATURE))) for i in range(FIRST)]
    else:
        rows = rows.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(BRANCH - 1))))
        path = ["node", *(token(F.pmod(F.xxhash64("node", "branch", F.lit(i)), F.lit(SIGNATURE))) for i in range(STEP))]
    return rows.select(F.xxhash64(F.lit(level), "branch", *path).alias("node"), "class")


def nodes(classes: DataFrame, percent: int, name: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(node, size, class, n, signature) of all nodes to be compared, and of those that stay large, none of one class; and the tables behind."""
    rows, found, made = classes, None, []
    for level in range(DEPTH):
        paths = branched(rows, level, trees(percent))
        size = paths.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        rows = staged(paths.join(size, "node").join(classes, "class").select("node", "size", "class", "n", "signature"), f"{name}-nodes-{level}")
        made.append(rows)
        here = rows.where(F.col("size") <= BLOCK)
        found = here if found is None else found.unionByName(here)
        rows = rows.where(F.col("size") > BLOCK)
    return found, rows, made


def compared(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of rows (node, size, class, n, signature): a spanning forest of each node."""
    least = percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / SIGNATURE) ** 0.5
    groups = F.lit(max(1, rows.count() // GROUP))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, class_, n = (pdf[c].to_numpy() for c in ("node", "class", "n"))
        signs = np.frombuffer(b"".join(pdf["signature"]), "<u4").reshape(-1, SIGNATURE)
        pairs = [np.zeros((2, 0), np.int64)]
        for at in cells([node], class_):
            xs, ys, ws = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for k, row in enumerate(at[:-1].tolist()):
                to = at[k + 1 :]
                hit = np.flatnonzero(100 * np.minimum(n[to], n[row]) >= percent * np.maximum(n[to], n[row]))
                alike = (signs[to[hit]] == signs[row]).mean(axis=1)
                good = alike >= least
                xs.append(np.full(good.sum(), k))
                ys.append(hit[good] + k + 1)
                ws.append(alike[good])
            x, y = np.concatenate(xs), np.concatenate(ys)
            order = np.argsort(-np.concatenate(ws), kind="stable")
            x, y = x[order], y[order]
            keep = forest(len(at), x, y)
            pairs.append(np.stack([class_[at[x[keep]]], class_[at[y[keep]]]]))
        a, b = np.concatenate(pairs, axis=1)
        return pd.DataFrame({"a": a, "b": b})

    dealt = rows.select(F.pmod(F.xxhash64("node"), groups).alias("group"), "node", "class", "n", "signature")
    return dealt.groupBy("group").applyInPandas(run, "a long, b long").distinct()


def stars(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (a, b) of the first class of each key to its others: as connected as all pairs."""
    first = rows.groupBy(*keys).agg(F.min("class").alias("a"))
    return rows.join(first, keys).select("a", F.col("class").alias("b")).where("a <> b").distinct()


def overlaps(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of 0/1 matrices of at most that many columns at a time."""
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    column, owner = (np.cumsum(several) - 1)[place], np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    some = np.flatnonzero(several[place])
    some = some[np.argsort(column[some], kind="stable")]
    column, owner = column[some], owner[some]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(several.sum()), width):
        s = slice(np.searchsorted(column, at), np.searchsorted(column, at + width))
        ones = np.zeros((len(sets), min(width, int(several.sum()) - at)), np.float32)
        ones[owner[s], column[s] - at] = 1
        out += ones @ ones.T
    return out


def within(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of families of rows (family, class), each compared as a whole in a task: a spanning forest of each."""
    groups = F.lit(max(1, rows.count() // SETS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        family, class_, blobs = (pdf[c].to_numpy() for c in ("family", "class", "set"))
        pairs = [np.zeros((2, 0), np.int64)]
        for at in cells([family], class_):
            if len(at) < 2:
                continue
            own = [np.frombuffer(b, "<u8") for b in blobs[at]]
            both, n = overlaps(own), np.array([len(x) for x in own])
            x, y = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))
            keep = forest(len(at), x, y)
            pairs.append(np.stack([class_[at[x[keep]]], class_[at[y[keep]]]]))
        a, b = np.concatenate(pairs, axis=1)
        return pd.DataFrame({"a": a, "b": b})

    dealt = sets.join(sent(rows.select(F.pmod(F.xxhash64("family"), groups).alias("group"), "family", "class")), "class")
    return dealt.groupBy("group").applyInPandas(run, "a long, b long")


def parted(rows: DataFrame, sets: DataFrame, percent: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) with the most central class of each family of rows (family, size, class), and (family, was, class,
    component) of the parts in which all other links between components of these are; was: the size of the whole.

    With a reference R, X = |A ^ B| and D = |A ^ R|, A and B link if X * (100 + p) <= (|A| + |B|) * (100 - p), and
    X = D(A) + D(B) - 2 * (differences shared). So with E = D * (100 + p) - n * (100 - p) they link if E(A) + E(B) <= 0, and
    else only if they share (E(A) + E(B)) / (2 * (100 + p)) differences. What links without sharing links with the class
    of the least E, too.
    """
    slots = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = staged(rows.withColumn("slot", F.pmod(F.xxhash64("class"), slots).cast("int")).join(sets, "class"), f"{name}-dealt")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        token, n = np.unique(np.concatenate([np.frombuffer(b, "<i8") for b in pdf["set"]]), return_counts=True)
        return pd.DataFrame({"family": np.full(len(token), pdf["family"].iloc[0]), "token": token, "n": n})

    held = dealt.groupBy("family", "slot").applyInPandas(count, "family long, token long, n long").groupBy("family", "token").agg(F.sum("n").alias("n"))
    size = rows.select("family", "size").distinct()
    held = staged(held.join(size, "family").withColumn("usual", 2 * F.col("n") > F.col("size")), f"{name}-held")
    reference = held.where("usual").groupBy("family").agg(F.collect_list("token").alias("reference"))  # at most twice the mean set
    reference = size.join(reference, "family", "left").withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1)))

    def differ(pdf: pd.DataFrame, ref: pd.DataFrame) -> pd.DataFrame:
        usual = ref["reference"].iloc[0]
        usual = np.zeros(0, np.int64) if usual is None else np.sort(np.asarray(usual, np.int64))
        own = [np.frombuffer(b, "<i8") for b in pdf["set"]]
        other = [np.setxor1d(x, usual, assume_unique=True) for x in own]
        return pd.DataFrame({"family": pdf["family"], "class": pdf["class"], "excess": [len(d) * (100 + percent) - len(x) * (100 - percent) for d, x in zip(other, own, strict=True)], "other": other})

    told = dealt.groupBy("family", "slot").cogroup(reference.groupBy("family", "slot")).applyInPandas(differ, "family long, class long, excess long, other array<long>")
    told = staged(told, f"{name}-told")
    center = told.groupBy("family").agg(F.min(F.struct("excess", "class")).alias("center")).select("family", F.col("center.excess").alias("least"), F.col("center.class").alias("center"))
    excess = staged(told.select("family", "class", "excess").join(center, "family"), f"{name}-excess")
    links = excess.where("excess + least <= 0 and class <> center").select(F.col("center").alias("a"), F.col("class").alias("b"))
    component = excess.select("family", "class", "excess", "least", F.when(F.col("excess") + F.col("least") <= 0, F.col("center")).otherwise(F.col("class")).alias("component"))
    # the differences that several classes have, the commonest first
    times = held.select("family", "token", F.when(F.col("usual"), F.col("size") - F.col("n")).otherwise(F.col("n")).alias("times")).where("times > 1")
    shares = told.select("family", "class", F.explode("other").alias("token")).join(times, ["family", "token"])
    shares = shares.withColumn("rank", F.row_number().over(Window.partitionBy("family", "class").orderBy(F.desc("times"), "token")))
    needs = F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col("least")) / (2 * (100 + percent))))
    shares = staged(shares.join(component, ["family", "class"]).where(F.col("rank") >= needs).select("family", "token", "class", "component"), f"{name}-shares")
    between = shares.groupBy("family", "token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("family", "token")
    parts = components(stars(shares.join(between, ["family", "token"]), ["family", "token"]), name).select(F.col("v").alias("class"), F.col("component").alias("part"))
    parts = parts.join(component.select("family", "class", "component"), "class").join(size, "family")
    return links, parts.select(F.col("part").alias("family"), F.col("size").alias("was"), "class", "component")


def links_of(families: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Links (a, b) of rows (family, class) that connect all classes of a family that links connect."""
    rows, found = families.select("family", "class", F.col("class").alias("component"), F.lit(None).cast("long").alias("was")), []
    while True:
        rows = staged(rows.join(rows.groupBy("family").agg(F.count("*").alias("size")), "family"), f"{name}-families")
        found.append(staged(within(rows.where(F.col("size") <= BLOCK), sets, percent), f"{name}-links"))
        large = rows.where(F.col("size") > BLOCK)
        stuck = F.coalesce(F.col("size") > SHRUNK * F.col("was"), F.lit(False))
        if large.isEmpty():
            break
        if not large.where(stuck).isEmpty():
            found.append(staged(across(large.where(stuck).select("family", "class", "component"), sets, percent), f"{name}-across"))
        links, parts = parted(large.where(~stuck).select("family", "size", "class"), sets, percent, name)
        found.append(staged(links, f"{name}-central"))
        rows = parts
    return reduce(DataFrame.unionByName, found)


def common(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of sets, by products of 0/1 matrices of at most that many columns at a time."""
    known = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(known), width):
        part = known[at : at + width]

        def ones(sets: list[np.ndarray], part: np.ndarray = part) -> np.ndarray:
            m = np.zeros((len(sets), len(part)), np.float32)
            for row, s in zip(m, sets, strict=True):
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                place = np.searchsorted(part, s)
                row[place[part[place] == s]] = 1
            return m

        out += ones(left) @ ones(right).T
    return out


def across(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of a family of rows (family, class, component): a forest of each pair of blocks.

    Left: the classes outside the group's largest component. Right: all of the group.
    """
    sizes = rows.groupBy("family", "component").agg(F.count("*").alias("k")).groupBy("family").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.max("k").alias("k"), F.sum("k").alias("all")).where("k < all")
    rows = rows.join(sizes, "family")
    blocks = lambda n: F.ceil(n / (BLOCK // 2)).cast("int")
    n_left, n_right = blocks(F.col("all") - F.col("k")), blocks(F.col("all"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("class", "family"), n).cast("int")
    left = rows.where("component <> largest").select("family", "class", "component", own(n_left).alias("i"), every(n_right).alias("j"), F.lit(True).alias("is_left"))
    right = rows.select("family", "class", "component", every(n_left).alias("i"), own(n_right).alias("j"), F.lit(False).alias("is_left"))
    dealt = left.unionByName(right)
    groups = max(1, dealt.count() // BLOCK)
    dealt = dealt.select(F.pmod(F.xxhash64("family", "i", "j"), F.lit(groups)).alias("group"), "*").join(sets, "class")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        family, i_, j_, is_left, class_, component = (pdf[c].to_numpy() for c in ("family", "i", "j", "is_left", "class", "component"))
        blobs, pairs = pdf["set"].to_numpy(), [np.zeros((2, 0), np.int64)]
        for at in cells([j_, i_, family], class_):
            left, right = at[is_left[at]], at[~is_left[at]]
            if not len(left) or not len(right):
                continue
            p, q = ([np.frombuffer(b, "<u8") for b in blobs[side]] for side in (left, right))
            both, n_p, n_q = common(p, q), np.array([len(x) for x in p]), np.array([len(x) for x in q])
            link = (100 * both >= percent * (n_p[:, None] + n_q[None, :] - both)) & (component[left][:, None] != component[right][None, :])
            x, y = np.nonzero(link)
            names, place = np.unique(np.concatenate([component[left[x]], component[right[y]]]), return_inverse=True)
            keep = forest(len(names), place[: len(x)], place[len(x) :])
            pairs.append(np.stack([class_[left[x[keep]]], class_[right[y[keep]]]]))
        a, b = np.concatenate(pairs, axis=1)
        return pd.DataFrame({"a": a, "b": b})

    return dealt.groupBy("group").applyInPandas(run, "a long, b long").distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(class, set) of the wanted classes: the shingles of the row of that number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, words).tobytes() for t in text_bytes(batch.column(1))], pa.binary())], names=["class", "set"])

    rows = docs.select(F.col(key).cast("long").alias("class"), F.col(text).alias("text")).join(wanted, "class", "left_semi")
    return rows.mapInArrow(run, "class long, set binary")


def numbered(docs: DataFrame, columns: list) -> DataFrame:
    """The columns with a staged number of each row, `row`."""
    return staged(docs.select(F.monotonically_increasing_id().alias("row"), *columns), "neardup-rows")


def grouped(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(row, n_shingles, component) of rows (row, text); component is the smallest row that links reach."""
    name = "neardup"
    sketches = staged(sketched(rows, "row", "text", words), f"{name}-sketch")
    classes = sketches.where("set_id is not null").groupBy("set_id").agg(F.min("key").alias("class"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = staged(classes, f"{name}-classes")
    small, crowds, made = nodes(classes, percent, name)
    candidates = staged(compared(small, percent).unionByName(stars(crowds, ["node"])), f"{name}-pairs")
    dropped(*made)
    families = components(candidates, name).select(F.col("v").alias("class"), F.col("component").alias("family"))
    sets = staged(full_sets(rows, families, "row", "text", words), f"{name}-sets")
    found = components(links_of(families, sets, percent, name), name).withColumnRenamed("v", "class")
    dropped(candidates, sets)
    joined = classes.select("set_id", "class").join(found, "class", "left").select("set_id", F.coalesce("component", "class").alias("component"))
    some = sketches.where("set_id is not null").join(joined, "set_id").select(F.col("key").alias("row"), "n_shingles", "component")
    return some.unionByName(sketches.where("set_id is null").select(F.col("key").alias("row"), "n_shingles", F.col("key").alias("component")))


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of each document; component_id is the smallest id that links reach."""
    rows = numbered(docs, [F.col(key).alias("key"), F.col(text).alias("text")])
    found = staged(rows.select("row", "key").join(grouped(rows.select("row", "text"), words, percent), "row"), "neardup-found")
    names = found.groupBy("component").agg(F.min("key").alias("component_id"))
    return found.join(names, "component").select("key", "n_shingles", "component_id")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linked(table(spark, sf_dir, "documents"))
    return rows.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all columns: that with the smallest doc_id, nulls last, and of these the first row."""
    names = docs.columns
    rows = numbered(docs, [F.struct(*names).alias("doc")])
    found = grouped(rows.select("row", F.col("doc.text").alias("text")), words, percent)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("row")
    kept = staged(rows.select("row", F.col("doc.doc_id").alias("id")).join(found, "row").groupBy("component").agg(first).select("row"), "neardup-kept")
    return rows.join(sent(kept), "row", "left_semi").select(*(F.col("doc")[c].alias(c) for c in names))
