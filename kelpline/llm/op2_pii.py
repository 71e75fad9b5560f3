"""Personal data by patterns, and terms that disclose it by information content. DataFrame functions only.

Four kinds are found by pattern (leftmost, not overlapping, each kind for itself), and as a fifth the opaque values that
texts assign to names like token or password. Their values are the protected
entities. The corpus then tells which other terms reveal an entity: with N documents, entity e in c(e), term t in c(t)
and both in c(e, t) of them, t discloses
    log(c(e, t) * N / (c(e) * c(t))) / log(N / c(e))
of the information content of e. A term that stands with e in at least SUPPORT distinct texts and discloses THRESHOLD
or more of it gets a span of kind `term` wherever it stands in a document that holds e, to be removed with it.

Terms are all runs of letters, marks and digits outside of the pattern spans, of any length, in lower case; runs joined
by one of ' . _ - are terms both as a whole and part by part. All counts are of whole documents. A term can disclose
THRESHOLD of e only if c(t) <= N ** (1 - THRESHOLD) * c(e) ** THRESHOLD, as c(e, t) <= c(e): others are left out before pairs are
made, which loses none.

Patterns are written with possessive repeats, and start only where a run of their characters starts (or the last
match ended). That finds the same valid matches as the plain patterns, in linear time and without recursion. Matches
become rows, whose places are sums over those before them, and texts are changed in pieces: the work is in proportion to
a text's length, however many matches it holds.

Defined results: null is an empty text, which has no span; repeated rows get the same spans each; an empty table gives
an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.llm.common import staged, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "term")
TERM = KINDS.index("term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of 16 to 19 digits only: all others would be dropped anyway
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # an opaque value that is assigned to a name of secrets
    "secret": r"(?<![A-Za-z0-9])(?i:token|password|passwd|secret|api[_-]?key|access[_-]?key|private[_-]?key)[\x20\t]*+[=:][\x20\t]*+[\"']?+[A-Za-z0-9+/_=-]{16,}+",
}
#: A text without this character has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Characters of a piece of text in which spans are replaced, and terms that are sent to all executors at most (checked).
PIECE, FEW = 4096, 200_000
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
SUPPORT, THRESHOLD = 3, 0.9
#: Terms: single runs, and runs joined by one character. The latter start only where a run does, in linear time.
RUN = r"[\p{L}\p{M}\p{N}]++"
TERMS = (RUN, rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){RUN}(?:['\x{{2019}}._-]{RUN})++")
#: What a removed span is replaced by.
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[SECRET]", "[TERM]")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(number)

    def weighed(k: Column) -> Column:
        twice = F.substring(number, n - k, F.lit(1)).cast("int") * (1 + k % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(value: Column, kind: str) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return luhn(digits(value))
    if kind == "secret":
        return n >= 1
    return (n >= 8) & (n <= 15) if kind == "phone" else F.lit(True)


def might(text: Column) -> Column:
    """False only where no pattern can match: each needs a digit or an @."""
    return F.coalesce(text.rlike("[0-9@]"), F.lit(False))


def hits(text: Column, kind: str) -> Column:
    """All matches of the kind's pattern, valid or not."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.expr("cast(array() as array<string>)")) if kind in NEEDS else found


def holds(text: Column) -> Column:
    """Whether a text has a valid match of any kind."""
    any_valid = lambda kind: F.exists(hits(text, kind), lambda v: valid(v, kind))
    return might(text) & reduce(Column.__or__, map(any_valid, PATTERNS))


def located(texts: DataFrame, patterns: dict[int, str]) -> DataFrame:
    """(mark, k, start, end, value) of all matches of patterns {k: pattern} in rows (mark, text).

    Each match is a row with the gap before it; its place is the sum of the lengths up to it. So a text may hold any
    number of matches.
    """

    def of(k: int, pattern: str) -> Column:
        gaps = F.transform(F.split("text", pattern, -1), F.length)
        pairs = F.zip_with(gaps, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
        return F.struct(F.lit(k).alias("k"), F.filter(pairs, lambda x: x["value"].isNotNull()).alias("pairs"))

    kinds = texts.select("mark", F.explode(F.array(*(of(k, p) for k, p in patterns.items()))).alias("kind"))
    rows = kinds.select("mark", "kind.k", F.posexplode("kind.pairs").alias("pos", "x")).select("mark", "k", "pos", "x.gap", "x.value")
    end = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("mark", "k").orderBy("pos"))
    rows = rows.select("mark", "k", end.alias("end"), "value")
    return rows.select("mark", "k", (F.col("end") - F.length("value")).cast("int").alias("start"), F.col("end").cast("int").alias("end"), "value")


def entity_spans(texts: DataFrame) -> DataFrame:
    """(mark, k, start, end, value) of the valid matches of all kinds in rows (mark, text)."""
    rows = located(texts, {KINDS.index(kind): p for kind, p in PATTERNS.items()})
    return rows.where(reduce(Column.__or__, ((F.col("k") == KINDS.index(kind)) & valid(F.col("value"), kind) for kind in PATTERNS)))


def replaced(texts: DataFrame, spans: DataFrame, label: Callable[[Column], Column] | None) -> DataFrame:
    """(mark, text) of rows (mark, text) with each run of overlapping spans (mark, k, start, end) replaced by the label
    of its first, or with label None by spaces of the same length.

    Texts are cut into pieces of PIECE characters, each meets its own spans and is changed, and the pieces are joined again.
    """
    order = Window.partitionBy("mark").orderBy("start", "end", "k")
    runs = spans.select("mark", "k", "start", "end", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    runs = runs.withColumn("run", F.sum(F.when(F.col("start") < F.col("before"), 0).otherwise(1)).over(order))
    runs = runs.groupBy("mark", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("k", F.struct("start", "end", "k")).alias("k"))
    numbers = F.sequence(F.floor(F.col("start") / PIECE).cast("int"), F.floor((F.col("end") - 1) / PIECE).cast("int"))
    parts = runs.select("mark", "k", "start", "end", F.explode(numbers).alias("no"))
    low = F.col("no") * PIECE
    part = F.struct((F.greatest("start", low) - low).alias("start"), (F.least("end", low + PIECE) - low).alias("end"), "k", (F.col("start") >= low).alias("first"))
    parts = parts.groupBy("mark", "no").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    pieces = texts.select("mark", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("no", "piece"))
    put = (lambda s: F.repeat(F.lit(" "), s["end"] - s["start"])) if label is None else lambda s: F.when(s["first"], label(s["k"])).otherwise("")
    ends = F.concat(F.array(F.lit(0)), F.transform("parts", lambda s: s["end"]))
    changed = F.zip_with(F.slice(ends, 1, F.size("parts")), "parts", lambda at, s: F.concat(F.substring("piece", at + 1, s["start"] - at), put(s)))
    new = F.concat(F.array_join(changed, ""), F.substring("piece", F.element_at(ends, -1) + 1, F.length("piece")))
    pieces = pieces.join(parts, ["mark", "no"], "left").select("mark", F.struct("no", F.when(F.col("parts").isNull(), F.col("piece")).otherwise(new).alias("piece")).alias("p"))
    return pieces.groupBy("mark").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("text"))


def distinct_terms(rest: Column) -> Column:
    return F.array_distinct(F.concat(*(F.transform(F.regexp_extract_all(rest, F.lit(p), F.lit(0)), F.lower) for p in TERMS)))


def disclosing(once: DataFrame, spans: DataFrame, texts: DataFrame) -> DataFrame:
    """(mark, k, start, end): spans of the terms to remove from each distinct text that holds an entity.

    once: (mark, docs, text) of the distinct texts with entities, spans: theirs, texts: (text) of all documents.
    """
    n = float(texts.count())
    entity = F.concat_ws(":", "k", F.lower("value")).alias("entity")
    held = spans.select("mark", entity).distinct().join(once.select("mark", "docs"), "mark")
    c_e = held.groupBy("entity").agg(F.sum("docs").alias("c_e"), F.count("*").alias("texts")).where((F.col("texts") >= SUPPORT) & (F.col("c_e") < n)).select("entity", "c_e")
    held = staged(held.join(c_e, "entity"), "pii-held")
    marks = held.groupBy("mark").agg(F.max("c_e").alias("most"))
    rest = staged(replaced(once.select("mark", "text"), spans, None), "pii-rest")
    terms = staged(rest.join(marks, "mark").select("mark", "most", F.explode(distinct_terms(F.col("text"))).alias("term")), "pii-terms")
    wanted = staged(terms.select("term").distinct(), "pii-wanted")
    wanted = F.broadcast(wanted) if wanted.limit(FEW + 1).count() <= FEW else wanted
    # outside of spans: where a text has none, all of it, else what is left without them
    plain = texts.where(~F.coalesce(holds(F.col("text")), F.lit(False))).select(F.explode(distinct_terms(F.col("text"))).alias("term"), F.lit(1).cast("long").alias("docs"))
    other = rest.join(once.select("mark", "docs"), "mark").select(F.explode(distinct_terms(F.col("text"))).alias("term"), "docs")
    c_t = plain.unionByName(other).join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("docs").alias("c_t")).where(F.col("c_t") >= SUPPORT)
    can = lambda c: F.log(n / F.col("c_t")) >= THRESHOLD * F.log(n / F.col(c)) - 1e-9
    rare = staged(terms.join(c_t, "term").where(can("most")).select("mark", "term", "c_t"), "pii-rare")
    pairs = rare.join(held, "mark").where(can("c_e"))
    gain = F.log(F.col("c_et") * n / (F.col("c_e") * F.col("c_t"))) / F.log(n / F.col("c_e"))
    c_et = pairs.groupBy("entity", "term").agg(F.sum("docs").alias("c_et"), F.count("*").alias("texts"), F.first("c_e").alias("c_e"), F.first("c_t").alias("c_t"))
    told = c_et.where((F.col("texts") >= SUPPORT) & (gain >= THRESHOLD)).select("entity", "term")
    hits = staged(pairs.join(told, ["entity", "term"]).select("mark", "term").distinct(), "pii-hits")
    places = located(rest.join(hits.select("mark").distinct(), "mark", "left_semi"), dict(enumerate(TERMS)))
    places = places.select("mark", F.lower("value").alias("term"), "start", "end").join(hits, ["mark", "term"])
    return places.select("mark", F.lit(TERM).alias("k"), "start", "end").distinct()


def found_in(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(mark, text) of the distinct texts that hold entities, and (mark, k, start, end) of all spans in them."""
    texts = docs.select(F.col(text).alias("text"))
    found = texts.where(F.coalesce(holds(F.col("text")), F.lit(False))).select(F.md5("text").alias("mark"), "text")
    once = staged(found.groupBy("mark").agg(F.count("*").alias("docs"), F.first("text").alias("text")), "pii-once")
    spans = staged(entity_spans(once), "pii-spans")
    terms = disclosing(once, spans, texts)
    return once.select("mark", "text"), staged(spans.select("mark", "k", "start", "end").unionByName(terms), "pii-all")


def spans_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of each document: an array of (k, start, end) by kind, then start."""
    spans = found_in(docs, text)[1].groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("k", "start", "end"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<k:int,start:int,end:int>>)")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    maybe = rows.where(might(F.col("text"))).select("key", F.md5("text").alias("mark")).join(spans, "mark", "left").select("key", F.coalesce("spans", none).alias("spans"))
    return maybe.unionByName(rows.where(~might(F.col("text"))).select("key", none.alias("spans")))


def told(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans_of(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["k"] < len(BASE))
    return rows.select(F.col("key").alias("doc_id"), *map(count, BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), count("secret"), count("term"), F.size("spans").cast("long").alias("n_spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """All documents with their columns; text without personal data and the terms that disclose it, n_chars to match.

    Texts without a digit or @ pass by; the others meet their new texts by a join on the hash of the text.
    """
    once, spans = found_in(docs)
    label = lambda k: F.element_at(F.array(*map(F.lit, LABELS)), k + 1)
    new = replaced(once, spans, label).select("mark", F.col("text").alias("new"))
    names = docs.columns
    maybe = docs.where(might(F.col("text"))).select(F.struct(*names).alias("doc"), F.md5("text").alias("mark")).join(new, "mark", "left")
    own = {"text": F.coalesce("new", F.col("doc.text"))}
    if "n_chars" in names:
        own["n_chars"] = F.coalesce(F.length("new").cast("long"), F.col("doc.n_chars"))
    return docs.where(~might(F.col("text"))).unionByName(maybe.select(*(own.get(c, F.col("doc")[c]).alias(c) for c in names)))
