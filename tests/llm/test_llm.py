"""The training-data operators against plain versions, on supplied rows and on odd ones."""

import collections
import math
import re
import zlib

import brute
import numpy as np
import pytest
from odd import odd_rows, prose
from pyspark.sql import functions as F

from kelpline.llm import op1_quality, op2_pii, op3_html, op4_lm, op5_mixing, op6_binary, op7_embeddings, op8_licenses, op9_neardup, op10_packing, queries, tokens
from kelpline.llm.common import components


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# quality


def test_quality_base(spark, sf, texts):
    got = by_id(queries.QUERIES["op1_quality_rules"](spark, sf))
    for i, t in texts:
        assert tuple(got[i])[1:7] == brute.quality(t)
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_quality_odd(odd, none):
    got = collections.defaultdict(list)
    for r in op1_quality.judged(m := op1_quality.measured(odd), op1_quality.learn(m)).collect():
        got[r["key"]].append(r)
    for i, t, *_ in odd_rows():
        assert all(tuple(r[c] for c in (*op1_quality.BASE, "base_failed")) == brute.quality(t) for r in got[i])
    assert len(got[14]) == 3 and len({r["posterior"] for r in got[14]}) == 1
    assert not got[1][0]["kept"] and op1_quality.learn(op1_quality.measured(none)) == {}


def test_quality_accuracy(spark):
    """Against labels that the rules never see."""
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op1_quality_rules"](spark, sf).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n[0, False] > 0.9 * (n[0, False] + n.get((0, True), 0))


def test_quality_keeps_columns(clash):
    kept = op1_quality.keep_good(clash)
    assert kept.columns == clash.columns and kept.select("kept").distinct().count() == 1


def plain_posteriors(rows, rounds=200):
    """The model of the docstring, vote by vote: {tuple of votes: posterior} of [(votes, count)]."""
    good = {v: 0.9 if sum(x > 0 for x in v) > 2 * sum(x < 0 for x in v) else 0.1 for v, _ in rows}
    rules = range(len(rows[0][0]))
    for _ in range(rounds):
        all_good = sum(c * good[v] for v, c in rows)
        prior = (all_good + 8) / (sum(c for _, c in rows) + 10)
        yes = [max((sum(c * good[v] for v, c in rows if v[k] > 0) + 8) / (sum(c * good[v] for v, c in rows if v[k]) + 10), 1 - op1_quality.RARE) for k in rules]
        no = [(sum(c * (1 - good[v]) for v, c in rows if v[k] < 0) + 8) / (sum(c * (1 - good[v]) for v, c in rows if v[k]) + 10) for k in rules]
        for v, _ in rows:
            a = prior * math.prod(yes[k] if v[k] > 0 else 1 - yes[k] for k in rules if v[k])
            b = (1 - prior) * math.prod(no[k] if v[k] < 0 else 1 - no[k] for k in rules if v[k])
            good[v] = a / (a + b)
    return good


def test_quality_verdicts(spark, sf):
    """The query's verdicts against a plain fit of the votes of all documents."""
    rows = queries.QUERIES["op1_quality_rules"](spark, sf).collect()
    measured = op1_quality.measured(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    votes = {r["key"]: tuple(r["pattern"] // 3 ** (8 - k) % 3 - 1 for k in range(9)) for r in measured if r["n_words"]}
    found = plain_posteriors([*collections.Counter(votes.values()).items()])
    for r in rows:
        want = found[votes[r["doc_id"]]] if r["doc_id"] in votes else 0.0
        assert abs(r["posterior"] - want) < 1e-6 and r["kept"] == (want >= 0.5 and not r["base_failed"])


def test_quality_em():
    """Two rules that agree and a third that takes half of the bad ones for good: its good votes get little say."""
    cast = {(1, 1, 1): 700, (1, 1, 0): 80, (1, 0, 1): 20, (-1, -1, 1): 90, (-1, -1, -1): 100, (-1, 0, 1): 10}
    code = lambda v: sum((x + 1) * 3 ** (8 - k) for k, x in enumerate((*v, 0, 0, 0, 0, 0, 0))) + 0
    found = op1_quality.fit(np.array([code(v) for v in cast]), np.array([*cast.values()]))
    assert min(found[code(v)] for v in ((1, 1, 1), (1, 1, 0), (1, 0, 1))) > 0.9
    assert max(found[code(v)] for v in ((-1, -1, 1), (-1, -1, -1), (-1, 0, 1))) < 0.5


# personal data


def check_spans(rows, texts):
    for i, t in texts:
        want = brute.spans(t)
        n = collections.Counter(k for k, *_ in want)
        r = rows[i]
        assert [r[f"n_{k}"] for k in brute.PATTERNS] == [n[k] for k in brute.PATTERNS]
        assert r["base_sha256"] == brute.digest(t) and r["spans"].startswith(brute.told(want))


def test_pii(spark, sf, texts):
    rows = by_id(queries.QUERIES["op2_pii"](spark, sf))
    assert len(rows) == len(texts)
    check_spans(rows, texts)


def test_pii_odd(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = op2_pii.op2_pii(spark, str(tmp_path))
    assert got.count() == odd.count()
    check_spans(by_id(got), [(i, t) for i, t, *_ in odd_rows()])


def test_pii_terms_and_cleaning(spark):
    """A name that only ever stands beside an address discloses it; common words don't."""
    rows = [(i, f"Ask {'Zebulon' if i < 6 else 'the'} zeb@mail.org about the matter {prose(i, 20)}" if i < 6 else f"the {prose(i, 20)}", "en", "a", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clean = by_id(op2_pii.sanitised(docs))
    assert len(clean) == 40
    assert all("[TERM] [EMAIL]" in clean[i]["text"] and "Zebulon" not in clean[i]["text"] for i in range(6))
    assert all(clean[i]["text"] == rows[i][1] for i in range(6, 40))
    assert all(clean[i]["n_chars"] == len(clean[i]["text"]) for i in range(6))


def brute_terms(docs):
    """{doc_id: (start, end) of all disclosing terms}, from whole documents."""
    run = r"[^\W_]+"
    held, terms = {}, {}
    for i, t in docs:
        rest, held[i], terms[i] = t, set(), collections.defaultdict(set)
        for k, a, b in brute.spans(t):
            held[i].add((k, t[a:b].lower()))
            rest = rest[:a] + " " * (b - a) + rest[b:]
        for m in (m for p in (run, rf"{run}(?:['._-]{run})+") for m in re.finditer(p, rest)):
            terms[i][m.group().lower()].add(m.span())
    n, c_t = len(docs), collections.Counter(t for i, _ in docs for t in terms[i])
    text, out = dict(docs), {i: set() for i, _ in docs}
    for e in set().union(*held.values()):
        ids = [i for i in held if e in held[i]]
        for t in set().union(*(terms[i] for i in ids)):
            both = [i for i in ids if t in terms[i]]
            if len({text[i] for i in both}) >= op2_pii.SUPPORT and math.log(len(both) * n / (len(ids) * c_t[t])) / math.log(n / len(ids)) >= op2_pii.THRESHOLD:
                for i in both:
                    out[i] |= terms[i][t]
    return out


def test_pii_terms_everywhere(spark):
    """Disclosing terms on other lines, far away, short, with digits or an apostrophe: each place, against brute force."""
    rows = [(i, f"Name: Zebulon O'Brien, {prose(i, 30)}\nof id AB-77, {prose(i + 50, 30)}\nMail: z@x.org {prose(i + 90, 30)}\n李明 and Zebulon's {i}") for i in range(5)]
    rows += [(5, rows[0][1]), *((i, f"{prose(i, 60)} name mail of and id") for i in range(6, 60)), (60, "Only +1 555 010 7788 calls"), (61, None), (62, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_terms([(i, t or "") for i, t in rows])
    got = {r["key"]: {(s["start"], s["end"]) for s in r["spans"] if s["k"] == op2_pii.TERM} for r in op2_pii.spans_of(docs).collect()}
    assert all(got.get(i, set()) == want[i] for i, _ in rows) and len(want[0]) >= 6
    for i, r in by_id(op2_pii.sanitised(docs)).items():
        assert i > 5 or not any(x in r["text"] for x in ("Zebulon", "Brien", "AB-77", "李明", "z@x.org"))
        assert i <= 5 or i == 60 or r["text"] == rows[i][1]


def test_pii_secrets(spark):
    """Values assigned to names of secrets get spans after the base ones; other long runs don't."""
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'de token = "{key}"###', f"api_key: {key} and x@y.org", f"commit {key} and the tokens = 5", "password = short", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["key"]: op2_pii.KINDS and [op2_pii.KINDS[s["k"]] for s in r["spans"]] for r in op2_pii.spans_of(docs).collect()}
    assert got == {0: ["secret"], 1: ["email", "secret"], 2: [], 3: [], 4: []}
    assert all(key not in (r["text"] or "") for i, r in by_id(op2_pii.sanitised(docs)).items() if i < 2)


def test_pii_many_matches(spark):
    """A text of 200,000 addresses, and spans over the edges of pieces: work in proportion to the length."""
    import time

    long = " ".join(f"u{i}@m{i % 7}.example.org" for i in range(200_000))
    edge = "x" * (op2_pii.PIECE - 6) + " a.b@c.org é😀 " + "y" * op2_pii.PIECE + " +1 555 010 7788 z"
    docs = spark.createDataFrame([(1, long), (2, edge), (3, "é" * 5000 + " q@r.st")], "doc_id long, text string")
    began = time.time()
    clean = by_id(op2_pii.sanitised(docs))
    assert time.time() - began < 60
    assert clean[1]["text"] == " ".join(["[EMAIL]"] * 200_000)
    assert clean[2]["text"] == edge.replace("a.b@c.org", "[EMAIL]").replace("+1 555 010 7788", "[PHONE]")
    assert clean[3]["text"] == "é" * 5000 + " [EMAIL]"


def test_pii_keeps_rows(clash, none):
    out = op2_pii.sanitised(clash)
    assert out.columns == clash.columns and out.count() + clash.where("text is null").count() >= clash.count()
    assert out.where("text is null").count() == clash.where("text is null").count()
    assert op2_pii.sanitised(none).count() == 0


# pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("just text, no tags at all.", "just text, no tags at all."),
        ("<body><nav>Menu</nav><article><h1>Head &amp; tail</h1><p>One,\n two   &#233;.</p><p><b>Bold<br>new<p>Third one is here.</article><footer>F</footer>", "Head & tail\nOne, two é.\nBold new\nThird one is here."),
        ("<div class='sidebar'><p>" + "Links, more links, " * 20 + "</p></div><div id=content><p>The first paragraph, it is long enough.</p><p>Short.</p></div><div class='comments'><p>" + "I think, that, this, is long. " * 9 + "</p></div>", "The first paragraph, it is long enough.\nShort."),
        ("<article><p>Text, of the page, cut off in the mid", "Text, of the page, cut off in the mid"),
        ("<article><p>Kept, this one.</p><script>if (a<b) '</p>'</script><style>p{}</style><form><p>Name?</p></form><!-- <p>no</p> --><aside>no</aside><p>And this, too.</p></article>", "Kept, this one.\nAnd this, too."),
    ],
)
def test_html(page, text):
    assert op3_html.extract(page or "") == text


@pytest.mark.parametrize("open_", ['<div class="content with-sidebar">', "<div class='page has-sidebar'>", '<div class="layout no-comments">', '<div id="post-search-for-x">', '<div class="entry social-issues">', '<form action="x.aspx"><input name="v"><select><option>no</select>', '<form><div class="layout no-comments">'])
def test_html_wrappers(open_):
    """Pages in a wrapper of an unlikely name, or in one form; menus and comments in it still go."""
    body = "<p>The first paragraph, it is long enough.</p><p>The second, it is long enough too.</p>"
    page = f"<body><div class='menu'><a href=x>Menu, of links</a></div>{open_}{body}<div class='comments'><p>Nice.</p></div></body>"
    assert op3_html.extract(page) == "The first paragraph, it is long enough.\nThe second, it is long enough too."


def long(name):
    return f"The {name} paragraph, with some words, and a few commas, is long enough to count as text here."


@pytest.mark.parametrize("part", ["<div class='alert'>{}</div>", "<div class='share-price'>{}</div>", "<section class='search'>{}</section>", "<div id='related-work'>{}</div>", "<section><h2 class='header'>Next</h2>{}</section>"])
def test_html_parts_of_articles(part):
    """Names that articles use for parts of their own don't cost these parts."""
    text = op3_html.extract(f"<body><div class='menu'><a href=x>Menu, of links</a></div><article><h1>Head</h1><p>{long('first')}</p>{part.format('<p>' + long('inner') + '</p>')}<p>{long('second')}</p></article></body>")
    assert text.split("\n") == ["Head", long("first"), *["Next"] * ("Next" in part), long("inner"), long("second")]


def test_html_many_containers():
    """An article whose parts stand in containers of their own, some of them deeper."""
    parts = "".join(f"<div><div><p>{long(k)}</p><p>{long(k)}</p></div></div>" for k in ("first", "second", "third"))
    assert op3_html.extract(f"<body><ul><li><a href=x>Menu</a></li></ul><div><h1>Head</h1>{parts}</div></body>").split("\n") == ["Head", *(long(k) for k in ("first", "first", "second", "second", "third", "third"))]


@pytest.mark.parametrize("piece", ["<a ", "</a ", '<a href="x ', "<p class='", "<!-- ", "<!x ", "<", "<style>", "<![CDATA[", "&amp", "<b>", "<b></i>", "<div class=ad>", "<p><b><div></div>"])
def test_html_linear(piece):
    """A megabyte of broken markup."""
    import time

    began = time.process_time()
    op3_html.extract("<article><p>Text, of a page.</p>" + piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 20


def plain_points(node):
    """The points of the docstring, for a tree without links: {id of container: points}."""
    found = collections.Counter()

    def walk(n, above):
        if n.tag == "p":
            text = " ".join("".join(x for x in n.kids if isinstance(x, str)).split())
            if len(text) >= 10:
                for up, share in zip(above, (1, 2, 6, 9, 12), strict=False):
                    found[id(up)] += (1 + text.count(",") + min(len(text) / 100, 3) + len(text) / 1000) / share
        for k in n.kids:
            if not isinstance(k, str):
                walk(k, [n, *above])

    walk(node, [])
    return found


def test_html_scores():
    """The scores of containers against a plain sum over their paragraphs."""
    rng = np.random.default_rng(5)

    def made(depth):
        return "".join(f"<p>{prose(int(rng.integers(99)), int(rng.integers(1, 40)))}{',' * int(rng.integers(4))}</p>" if depth == 4 or rng.random() < 0.5 else f"<div>{made(depth + 1)}</div>" for _ in range(rng.integers(1, 5)))

    for _ in range(20):
        root = op3_html.parse(f"<div>{made(0)}</div>")
        want = plain_points(root)
        for node in op3_html.score(root):
            if id(node) in want:
                assert abs(node.score - want[id(node)] - node.weight) < 1e-6


def test_html_rows(spark):
    """Repeated, null and empty pages, extra columns of clashing names, and an empty table."""
    page = "<article><p>Text, of a page.</p></article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", ""), (3, None, "<p>" + "word, " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' AS text", "7 AS n_chars", "'x' AS kids")
    got = sorted((r["page_id"] or 0, r["text"][:20], r["n_chars"]) for r in op3_html.extracted(pages).collect())
    assert got == [(0, "", 0), (1, "Text, of a page.", 16), (1, "Text, of a page.", 16), (2, "", 0), (3, "word, word, word, wo", 299_999)]
    assert op3_html.extracted(pages.where("false")).count() == 0


def test_html_nested_wrappers():
    assert op3_html.extract("<div class='ad'>" * 3000 + "<p>deep, deep text is here.</p>") == "deep, deep text is here."


def test_html_deep_and_long():
    assert op3_html.extract("<div>" * 5000 + "<p>deep, deep text is here.</p>") == "deep, deep text is here."
    assert len(op3_html.extract("<article>" + "<p>word, word and more of it.</p>" * 20_000)) == 20_000 * 27 - 1


def test_html_pages(spark, sf):
    rows = queries.QUERIES["op3_html"](spark, sf).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    import html
    import re

    for r in rows:
        article = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# language model


def check_base(rows, texts):
    want = brute.language_base(texts)
    for i, _ in texts:
        r = rows[i]
        assert tuple(r)[1:5] == want[i][:4] and abs(r["base_score"] - want[i][4]) < 1e-6 * max(1, abs(want[i][4]))


def test_language_model(spark, sf, texts):
    rows = by_id(queries.QUERIES["op4_lm_scores"](spark, sf))
    check_base(rows, texts)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_odd(odd, none):
    rows = by_id(op4_lm.scored(odd.dropDuplicates(["doc_id"])))
    check_base(rows, [(i, t) for i, t in {i: t for i, t, *_ in odd_rows()}.items()])
    assert all(np.isfinite(r["score"]) for r in rows.values())
    assert op4_lm.scored(none).count() == 0
    assert op4_lm.scored(odd).count() == odd.count()


def test_language_model_probabilities():
    """The mix sums to one over all known words and the unknown one."""
    words, n, mix = 4, 20, np.tile([0.5, 0.3, 0.2], (65, 1))

    class Fake:
        docs, lengths = [1], np.array([words + 1])
        word, pair, context = np.array([8, 6, 4, 2, 0]), np.array([3, 1, 0, 0, 0]), np.full(words + 1, 4)
        trains, slices = np.zeros(words + 1, bool), op4_lm.Resolved.slices

    w = mix[op4_lm.frequency(Fake.context)]
    p = w[:, 0] * Fake.pair / Fake.context + w[:, 1] * Fake.word / n + w[:, 2] / (words + 1)
    assert abs(p.sum() - 1) < 1e-12
    assert abs(op4_lm.scores(Fake(), n, words, mix)["score"][0] - np.log10(p).sum()) < 1e-9


def test_chunks_agree(documents, monkeypatch):
    """Chunks of any size give the same scores."""
    whole = by_id(op4_lm.scored(documents))
    monkeypatch.setattr(op4_lm, "CHUNK", 5000)
    monkeypatch.setattr(op4_lm, "BUCKET_BYTES", 50_000)
    parts = by_id(op4_lm.scored(documents))
    monkeypatch.setattr(op4_lm, "FAN", 3)  # several levels
    deep = by_id(op4_lm.scored(documents))
    for other in (parts, deep):
        assert all(abs(whole[i][c] - other[i][c]) < 1e-3 for i in whole for c in ("base_score", "score", "deleted_score"))


def plain_scores(docs):
    """{doc_id: (score, deleted_score)} by plain counts, and weights by expectation-maximisation over all single tokens."""
    tokens = {i: [*brute.words((t or "").translate(brute.LOWER)), None] for i, t in docs}
    pairs = {i: list(zip([None, *w[:-1]], w, strict=True)) for i, w in tokens.items()}
    c1, c2 = collections.Counter(), collections.Counter()
    for i in tokens:
        if not brute.held_out(i):
            c1.update(tokens[i])
            c2.update(pairs[i])
    n, v = sum(c1.values()), len(c1)
    level = lambda c: c.bit_length()
    seen = collections.defaultdict(list)
    for i in tokens:
        if not brute.held_out(i):
            for a, b in pairs[i]:
                seen[level(c1[a] - 1)].append(((c2[a, b] - 1) / max(c1[a] - 1, 1), (c1[b] - 1) / (n - 1), 1 / (v + 1)))
    mix, last = {}, np.array([0, 0.9, 0.1])
    for g in range(max(seen) + 1):
        if seen[g]:
            p = np.array(seen[g])
            last = np.array([1 / 3] * 3) if g else np.array([0, 0.5, 0.5])
            for _ in range(op4_lm.ROUNDS):
                share = last * p
                last = (share / share.sum(1, keepdims=True)).mean(0)
        mix[g] = last
    out = {}
    for i, found in pairs.items():
        sums = []
        for less in (0, 0 if brute.held_out(i) else 1):
            sums.append(sum(math.log10(mix[min(level(c1[a] - less), max(mix))] @ ((c2[a, b] - less) / max(c1[a] - less, 1), (c1[b] - less) / (n - less), 1 / (v + 1))) for a, b in found))
        out[i] = sums
    return out


def test_language_model_scores(documents, texts):
    """Scores against plain ones. The operator learns its weights from bins 0.1 wide, so they differ by little."""
    got, want = by_id(op4_lm.scored(documents)), plain_scores(texts)
    for i, both in want.items():
        assert all(abs(x - y) < 0.002 * got[i]["n_tokens"] + 1e-6 for x, y in zip((got[i]["score"], got[i]["deleted_score"]), both, strict=True))


def test_language_model_clash(clash):
    rows = op4_lm.scored(clash.dropDuplicates(["doc_id"]))
    assert rows.count() == clash.select("doc_id").distinct().count()


def test_language_model_copies(spark):
    """A text that stands in the corpus twice scores far better than others once own occurrences are deleted."""
    rows = [(i, prose(i % 50 if i < 55 else i, 80)) for i in range(100)]
    got = by_id(op4_lm.scored(spark.createDataFrame(rows, "doc_id long, text string")))
    each = {i: r["deleted_score"] / r["n_tokens"] for i, r in got.items() if not r["held_out"]}
    twice = [i for i in each if (i < 5 or 50 <= i < 55) and not brute.held_out((i + 50) % 100)]
    assert twice and min(each[i] for i in twice) > max(each[i] for i in each if 5 <= i < 50 or i >= 55)


# mixing


def test_mixing(spark, sf, documents):
    rows = queries.QUERIES["op5_mixing"](spark, sf)
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    got, sizes = rows.collect(), collections.Counter()
    for r in got:
        sizes[source[r["doc_id"]]] += r["size"]
    want = brute.targets(sizes)
    longest = max(r["size"] for r in got)
    for s in sizes:
        mine = [r for r in got if source[r["doc_id"]] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * want[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= longest
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
    again = by_id(queries.QUERIES["op5_mixing"](spark, sf))
    assert all(again[r["doc_id"]] == r for r in got)


def test_mixing_odd(odd, none):
    rows = op5_mixing.mixed(odd).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["src"]] += r["size"]
    want = brute.targets({s: sizes[s] for s in {r["src"] for r in rows}})
    assert len(rows) == odd.count()
    assert all(abs(r["target"] - want[r["src"]]) < 1e-6 * max(1, want[r["src"]]) for r in rows)
    assert len({r["copies"] for r in rows if r["key"] == 14}) == 1
    assert op5_mixing.mixed(none).count() == 0 and op5_mixing.take(none).count() == 0


def test_mixing_caps_small_sources(spark):
    docs = spark.createDataFrame([(i, prose(i, 10 if i % 10 == 0 else 200), "en", "b" if i % 10 == 0 else "a", 0) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r["src"]: (r["t"], r["target"], r["size"]) for r in op5_mixing.mixed(docs).groupBy("src").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("target"), F.sum("size").alias("size")).collect()}
    assert taken["b"][0] == taken["b"][1] == 3 * taken["b"][2]
    assert abs(taken["a"][0] - taken["a"][1]) <= 200


def test_mixing_take(clash):
    out = op5_mixing.take(clash)
    assert out.columns == clash.columns
    n = op5_mixing.mixed(clash).agg(F.sum("copies")).first()[0]
    assert out.count() == n


# tokens


def test_encoder_is_the_library():
    rng = np.random.default_rng(0)
    parts = ["a", "the", " ", "\n", " ", "'s", "don't", "é", "1", "23", ".", "!!", "\t", "中", "  ", "\r", "<|endoftext|>", "\x00", "\x1c", "​", "　", "_", "<|"]
    e = tokens.Encoder(tokens.path(), memory=20_000)
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))).encode() for _ in range(20_000)]
    for s in (slice(0, 7000), slice(7000, None)):
        assert e.encode(texts[s]) == e.whole(texts[s])


def test_encoder_knows_its_characters():
    """Each character of the known kinds, alone and between others, against the library."""
    e = tokens.Encoder(tokens.path())
    known = [c for c in map(chr, range(1, 0x10000)) if tokens.KNOWN_KINDS.fullmatch(c)]
    texts = [f"a{c}b {c}{c} 1{c} {c}.{c}\n{c}'s".encode() for c in known]
    assert len(known) > 20_000 and e.encode(texts) == e.whole(texts)


def test_encoder_long_texts(monkeypatch):
    """Texts that are cut in stretches, and what is remembered stays under its bound."""
    text = "".join(f"word{k} no{k % 97}, " if k % 11 else f"  x{k}\n" for k in range(6000)).encode()
    e = tokens.Encoder(tokens.path(), memory=100_000)
    want = e.whole([text])
    monkeypatch.setattr(tokens, "STRETCH", 1000)
    assert e.encode([text]) == want == e.whole([text]) and e.held <= 200_000


def test_packing_tiny_texts():
    """300,000 texts of one id: nothing held grows with their number."""
    import tracemalloc

    tracemalloc.start()
    packer, ids, full = op10_packing.Packer(2048), (1).to_bytes(4, "little"), 0
    for i in range(300_000):
        for window in packer.put(op10_packing.Piece(i, i, 0, ids, 1)):
            full += sum(p.size() for p in window)
    full += sum(p.size() for window in packer.end() for p in window)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert full == 300_000 and most < 120_000_000


def test_binary(spark, sf, texts):
    check_binary(by_id(queries.QUERIES["op6_binary"](spark, sf)), dict(texts))


def check_binary(rows, texts):
    start = 0
    for i, ids in zip(sorted(texts), brute.token_ids([texts[i] for i in sorted(texts)], 0), strict=True):
        assert tuple(rows[i])[1:4] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("bits", [False, True])
def test_binary_odd(spark, odd, none, tmp_path, bits):
    rows = odd.dropDuplicates(["doc_id"])
    op6_binary.write(rows, str(tmp_path / "x"), bits=bits)
    got = op6_binary.documents(op6_binary.read(spark, str(tmp_path / "x")), ids=True).collect()
    check_binary({r["doc_id"]: r for r in got}, {i: t for i, t, *_ in odd_rows()})
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    op6_binary.write(none, str(tmp_path / "none"), bits=bits)
    assert op6_binary.documents(op6_binary.read(spark, str(tmp_path / "none"))).count() == 0
    op6_binary.write(odd, str(tmp_path / "all"), bits=bits)
    assert op6_binary.documents(op6_binary.read(spark, str(tmp_path / "all"))).count() == odd.count()


def test_binary_ties(spark, clash, tmp_path):
    """Rows of one id or none in the same order whatever the layout; clashing names don't matter."""
    rows = [(i % 3 if i % 3 else None, prose(i, 30)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' AS part", "'own' AS tie", "'own' AS lengths")
    found = []
    for k, laid in enumerate((docs.repartition(5), docs.coalesce(1))):
        op6_binary.write(laid, str(tmp_path / str(k)))
        found.append(sorted(tuple(r) for r in op6_binary.documents(op6_binary.read(spark, str(tmp_path / str(k)))).select("start", "n_tokens", "ids_crc32").collect()))
    assert found[0] == found[1] and len(found[0]) == 60
    op6_binary.write(clash, str(tmp_path / "clash"))
    assert op6_binary.documents(op6_binary.read(spark, str(tmp_path / "clash"))).count() == clash.count()


@pytest.mark.parametrize("n", [0, 1, 7, 65_536, 65_537, 150_000])
@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(n, bits):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    assert (op6_binary.unpacked(*op6_binary.packed(ids, bits)) == ids).all()


# embeddings


def odd_vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    rows = [(i, [float(x) for x in base[i % 12] + 0.12 * rng.standard_normal(16)], i % 2) for i in range(300)]
    v = [float(x) for x in base[0]]
    return [*rows, (900, None, 0), (901, [0.0] * 16, 0), (902, [None, *v[1:]], 0), (903, [float("nan"), *v[1:]], 0), (904, [float("inf"), *v[1:]], 0), (905, v, None), (906, v, 1), (907, v, 1), (908, [2 * x for x in v], 1), (909, v[:8], 1), (910, [], 1), (911, [1e300 * x for x in v], 1)]


def test_embeddings(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("class", F.lit("own"))
    want, got = brute.vectors(rows), {r["key"]: (r["n_links"], r["component_id"]) for r in op7_embeddings.linked(df).collect()}
    assert got == want
    assert op7_embeddings.linked(df.where("false")).count() == 0


def test_embeddings_blocks(spark, monkeypatch):
    """Buckets over the block size give the same links."""
    monkeypatch.setattr(op7_embeddings, "BLOCK", 8)
    monkeypatch.setattr(op7_embeddings, "GROUP", 16)
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r["key"]: (r["n_links"], r["component_id"]) for r in op7_embeddings.linked(df).collect()} == brute.vectors(rows)


def test_embeddings_ids(spark):
    """One id with two vectors, repeated rows and null ids are told apart."""
    e = np.eye(16)
    near = lambda i: [float(x) for x in e[i] + 0.2 * e[i + 8]]
    vec = lambda i: [float(x) for x in e[i]]
    rows = [(1, vec(0), 0), (1, vec(1), 0), (2, near(0), 0), (3, near(1), 0), (None, vec(2), 0), (7, near(2), 0), (None, vec(3), 0), (8, vec(4), 0), (8, vec(4), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'own' AS row", "'own' AS digest", "'own' AS copies", "'own' AS unit")
    got = collections.Counter((r["key"], r["n_links"], r["component_id"]) for r in op7_embeddings.linked(df).collect())
    assert got == collections.Counter([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (None, 1, 7), (7, 1, 7), (None, 0, None), (8, 1, 8), (8, 1, 8)])


def test_embeddings_recall(spark, tmp_path):
    """The registered query finds planted pairs just over the threshold among unlike vectors."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((1000, 64))
    side -= (side * base[:1000]).sum(1, keepdims=True) * base[:1000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.931, 0.94, (1000, 1))
    both = np.concatenate([base, c * base[:1000] + np.sqrt(1 - c * c) * side])
    rows = [(i, [float(x) for x in v], i % 1000 % 3) for i, v in enumerate(both)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r for r in queries.QUERIES["op7_embedding_dedup"](spark, str(tmp_path)).collect()}
    assert sum(got[3000 + i]["component_id"] == i and not got[3000 + i]["kept"] for i in range(1000)) >= 980
    assert all(got[i]["kept"] for i in range(1000, 3000)) and sum(r["n_links"] for r in got.values()) <= 2000


def test_embeddings_plan():
    k, tables = op7_embeddings.plan(5000)
    near = op7_embeddings.chance((2 - 2 * 0.93) ** 0.5)
    assert 1 - (1 - near**k) ** tables >= 0.995 and op7_embeddings.plan(10**9)[0] > k


# licences


def test_licences(spark, sf):
    from compare import differences

    for d in (sf, "/root/testdata/sf0.01"):
        assert not differences(queries.QUERIES["op8_licences"](spark, d), d, queries.SQL["op8_licences"])


def test_licence_order(spark, none, odd):
    text = dict(op8_licenses.SENTENCES)
    mit = [text[k] for k in ("mit-grant", "mit-keep", "as-is")]
    docs = spark.createDataFrame([(1, "\n".join(mit)), (2, "\n".join(reversed(mit))), (3, " ".join(x.upper() for x in mit)), (4, None), (5, text["mpl-notice"] + "\n" + text["mit-notice"])], "doc_id long, text string")
    got = {r["doc_id"]: (r["licences"], r["n_sentences"]) for r in op8_licenses.scanned(docs).collect()}
    assert got == {1: ("MIT", 3), 2: ("", 3), 3: ("MIT", 3), 4: ("", 0), 5: ("MIT,MPL-2.0", 2)}
    assert by_id(op8_licenses.scanned(odd))[18]["licences"] == "Apache-2.0,MIT" and op8_licenses.scanned(none).count() == 0


WRAPPED = {
    "MIT": """MIT License\n\nCopyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS BE LIABLE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n(b) Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.""",
    "Apache-2.0": """/*\n * Copyright 2020 Some One\n *\n * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n */""",
    "GPL-3.0": """# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n# GNU General Public License for more details.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
}


def test_licence_wrapped(spark):
    """Licences as they are distributed, and notices on lines of their own."""
    rows = [*((name, t) for name, t in WRAPPED.items()), ("CC-BY-4.0", "A title\nLicensed under CC BY 4.0\nMore text"), ("MIT", "- an item\n- Released under\n  the MIT License")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in op8_licenses.scanned(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [name for name, _ in rows]


COMMON = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def test_licence_texts(spark):
    """Whole licences as a system ships them, and those of Python packages."""
    from importlib.metadata import distribution
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    if not folder.exists():
        pytest.skip("no licence texts here")
    rows = [(name, (folder / file).read_text(errors="replace")) for file, name in COMMON.items()]
    for package, name in (("pytest", "MIT"), ("pluggy", "MIT"), ("pygments", "BSD-2-Clause"), ("idna", "BSD-3-Clause")):
        path = next((f for f in distribution(package).files or [] if f.name.startswith("LICENSE")), None)
        if path:
            rows.append((name, path.locate().read_text(errors="replace")))
    got = op8_licenses.scanned(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"))
    assert [(rows[r["doc_id"]][0], r["licences"]) for r in got.orderBy("doc_id").collect()] == [(name, name) for name, _ in rows]


def test_licence_sentences():
    assert all(re.search(op8_licenses.ANCHOR, x) for x in op8_licenses.ALL_KNOWN)
    assert {i for _, _, ids in op8_licenses.RULES + op8_licenses.MORE_RULES for i in ids} <= {n for n, _ in op8_licenses.SENTENCES + op8_licenses.PUBLISHED}


def test_licence_rows(spark, odd, none):
    """Repeated rows, clashing names, and an empty table."""
    clash = odd.selectExpr("*", "'own' AS sequence", "'own' AS names", "1 AS n_sentences")
    rows = op8_licenses.scanned(clash).collect()
    assert len(rows) == odd.count() and [r["licences"] for r in rows if r["doc_id"] == 18] == ["Apache-2.0,MIT"] and op8_licenses.scanned(none).count() == 0


# near duplicates


def check_near(rows, docs, n=3, percent=85):
    want = brute.near_duplicates(docs, n, percent)
    assert {r["key"]: r["component_id"] for r in rows} == want
    assert all(r["n_shingles"] == len(brute.shingles(dict(docs)[r["key"]], n)) for r in rows)


def test_near_duplicates(documents, texts):
    check_near(op9_neardup.linked(documents).collect(), texts)


def test_near_duplicates_query(spark, sf, texts):
    """The registered query, with what it keeps."""
    want = brute.near_duplicates(texts)
    got = queries.QUERIES["op9_near_dedup"](spark, sf).collect()
    assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in got} == {i: (c, i == c) for i, c in want.items()}


def test_near_duplicates_odd(odd, none):
    check_near(op9_neardup.linked(odd).collect(), [*{i: t for i, t, *_ in odd_rows()}.items()])
    assert op9_neardup.linked(odd).count() == odd.count() and op9_neardup.linked(none).count() == 0


def crowd():
    """300 near copies of a text, a chain of edits, and pairs about the threshold."""
    words, rows = prose(5, 200).split(), []
    for i in range(300):
        w = list(words)
        w[i % 200] = f"new{i}"
        rows.append((i, " ".join(w)))
    chain = prose(6, 150).split()
    for i in range(40):
        rows.append((1000 + i, " ".join(chain[i : i + 100])))
    return rows


@pytest.mark.parametrize(("block", "group"), [(256, 8192), (16, 64)])
def test_near_duplicates_crowd(spark, monkeypatch, block, group):
    """The same with nodes over the block size, which are compared in blocks."""
    monkeypatch.setattr(op9_neardup, "BLOCK", block)
    monkeypatch.setattr(op9_neardup, "GROUP", group)
    rows = crowd()
    check_near(op9_neardup.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def template_crowd(n, pairs):
    """Pages of one template, about 0.8 alike, of which the first 2 * pairs are near copies two by two; every tenth page of a second template."""
    rows = []
    for i in range(n):
        own = i // 2 if i < 2 * pairs else i
        w = prose(70 + (i % 10 == 9), 200).split() + [f"own{own}word{k}" for k in range(24)]
        if i % 2 and i < 2 * pairs:
            w[-1] = "changed"
        rows.append((i, " ".join(w)))
    return rows


def test_near_duplicates_template(spark, monkeypatch):
    """A crowd over the block size whose pages differ by their own words: its links are found, and no family is compared in all pairs of blocks."""
    across = op9_neardup.across

    def none(rows, sets, percent):
        assert rows.isEmpty()
        return across(rows, sets, percent)

    monkeypatch.setattr(op9_neardup, "across", none)
    rows = template_crowd(420, 20)
    want = brute.near_duplicates(rows)
    got = {r["key"]: r["component_id"] for r in op9_neardup.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < 420


def test_near_duplicates_growth(spark, monkeypatch):
    """A crowd of twice the size makes about twice the rows."""
    staged, rows = op9_neardup.staged, []

    def counted(df, name):
        out = staged(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(op9_neardup, "BLOCK", 32)
    monkeypatch.setattr(op9_neardup, "staged", counted)
    made = []
    for n in (100, 200):
        rows.clear()
        op9_neardup.linked(spark.createDataFrame(template_crowd(n, 0), "doc_id long, text string")).count()
        made.append(sum(rows))
    assert made[1] < 2.4 * made[0]


def test_near_duplicates_stuck(spark, monkeypatch):
    """Families that don't shrink are compared in pairs of blocks, with the same result."""
    monkeypatch.setattr(op9_neardup, "BLOCK", 16)
    monkeypatch.setattr(op9_neardup, "SHRUNK", 0.0)
    rows = crowd()[::3] + [(5000 + i, t) for i, t in template_crowd(60, 10)]
    check_near(op9_neardup.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_near_duplicates_trees():
    """The chance of a pair at the threshold to meet, by simulation of its branching path."""
    rng = np.random.default_rng(4)
    for percent in (80, 85):
        similar, n = percent / 100, op9_neardup.trees(percent)
        paths = np.ones((20_000, n), dtype=np.int64) * (rng.random((20_000, n)) < similar**op9_neardup.FIRST)
        for _ in range(op9_neardup.DEPTH - 1):
            paths = rng.binomial(paths * op9_neardup.BRANCH, similar**op9_neardup.STEP)
        assert (paths.sum(axis=1) > 0).mean() > 0.998


def test_deduplicated(clash, documents, texts):
    assert op9_neardup.deduplicated(clash).columns == clash.columns
    want = {i for i, c in brute.near_duplicates(texts, 5, 80).items() if i == c}
    assert {r["doc_id"] for r in op9_neardup.deduplicated(documents).collect()} == want


def test_deduplicated_rows(spark):
    """Repeated rows, null ids, and one id with two texts: one row of each group stays."""
    a, b, c, d, e = (prose(k, 60) for k in range(20, 25))
    rows = [(1, a), (1, a), (1, a), (2, a), (None, b), (None, b), (5, b), (None, c), (None, c), (7, a), (7, d), (8, e), (8, e + " more"), (9, d), (0, d + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"][:40]) for r in op9_neardup.deduplicated(docs).collect())
    assert got == sorted([(1, a[:40]), (5, b[:40]), (-1, c[:40]), (0, d[:40]), (8, e[:40])])
    odd_ids = sorted((r["key"], r["component_id"]) for r in op9_neardup.linked(docs.where("doc_id in (7, 9, 1)")).collect())
    assert odd_ids == [(1, 1), (1, 1), (1, 1), (7, 1), (7, 7), (9, 7)]


@pytest.mark.parametrize("few", [0, 100, 16_384])
def test_components(spark, monkeypatch, few):
    from kelpline.llm import common

    monkeypatch.setattr(common, "FEW_EDGES", few)
    n = 200
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1002, 1001), (7, 7)]
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 1001: 1000, 1002: 1000}
    assert components(spark.createDataFrame([(3, 3)], "a long, b long"), "test").count() == 0


# packing


def check_packed(rows, texts):
    ids = dict(zip(texts, brute.token_ids(texts.values(), 1), strict=True))
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, x in ids.items():
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(x)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return sum(r["length"] for r in rows) / (2048 * len(sequences))


def test_packing(spark, sf, texts):
    assert check_packed(queries.QUERIES["op10_packing"](spark, sf).collect(), dict(texts)) > 0.95


def test_packing_clash(clash):
    assert op10_packing.packed(clash).agg(F.sum("length")).first()[0] == sum(len(x) for x in brute.token_ids([t for _, t, *_ in odd_rows()], 1))


def test_packing_odd(odd, none):
    check_packed(op10_packing.packed(odd.dropDuplicates(["doc_id"])).collect(), {i: t for i, t, *_ in odd_rows()})
    assert op10_packing.packed(none).count() == 0
    assert op10_packing.packed(odd).agg(F.sum("length")).first()[0] == sum(len(x) for x in brute.token_ids([t for _, t, *_ in odd_rows()], 1))


def test_differencing():
    assert op10_packing.differencing([], 3) in ([], [[], [], []])
    found = op10_packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sorted(w) for w in found) == [[0, 1], [2, 3, 4]] or {sum((8, 7, 6, 5, 4)[i] for i in w) for w in found} <= {14, 15, 16}
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 257, rng.integers(1, 400)).tolist()
        found = op10_packing.windows(sizes)
        assert sorted(i for w in found for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= 2048 for w in found)
        assert len(found) <= -(-sum(sizes) // 2048) + 2
