"""Main text of HTML pages by tree scoring.

A page becomes a small tree. What can't be main text (menus, headers, footers, sidebars, notices, adverts, comments,
controls, scripts, styles) is left out by tag, role, or class and id. Unlikely classes and ids, and forms, leave an
element out only after its paragraphs are known: not if its names are likely ones too, nor if it holds most of the page's
points while nothing likely stands outside of it, as wrappers of whole pages do. Names that articles use for parts of
their own (share, search, alert, related) count inside of a likely element only for what has many links or no paragraph. Each paragraph then gives points for its length and commas to
its parent, half of them to the next ancestor and less to those above; a container's points are discounted by its
share of linked text. The best container (or its nearest ancestor with two more parts that score nearly as well) is kept
with those siblings that score well too or are dense plain text.

Defined results: null, empty and textless pages give an empty text; a page cut short is read to its end; repeated rows
get the same text each; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kelpline.llm.common import pieces, table

#: What starts markup, and what decides in a tag: its end, or the quote that opens a value.
START = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([A-Za-z][^\s/>]*))")
IN_TAG = re.compile(r">|=\s*+([\"'])")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
OUT = frozenset("head script style noscript template nav header footer aside button select option textarea iframe object svg canvas menu dialog title xmp noembed noframes fieldset label audio video map".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose direct text counts as a paragraph.
PARAGRAPH = frozenset("p pre td blockquote div section article dd li body".split())
#: Of these, all text counts, and for their parents.
OWN = frozenset("p pre td blockquote dd li".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element is ended by the start of any of these.
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"} | {"li", "dd", "dt"}
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
PART_OF_NAME = r"(?:^|[\s_-])(?:{})(?:$|[\s_-])"
UNLIKELY = re.compile(PART_OF_NAME.format(r"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|breadcrumbs?|combx|comments?|commentlist|disqus|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|foot|footer|footnav|masthead|menu|nav|navbar|navigation|pager|pagination|shoutbox|sidebar|skyscraper|toolbar|login"), re.I)
#: Names that stand for parts of an article as well: inside of one, they tell only about what has no paragraph or many links.
DUBIOUS = re.compile(PART_OF_NAME.format(r"discuss\w*|replies|respond|reactions?|notices?|alert|header|related|recommend\w*|remark|rss|share|sharing|social|side|widget|search"), re.I)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|page|post|story|text)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())


class Node:
    __slots__ = ("commas", "doubtful", "dubious", "kids", "last", "length", "likely", "linked", "number", "parent", "points", "score", "tag", "weight")

    def __init__(self, tag: str, parent: Node | None, weight: float = 0.0):
        self.tag, self.parent, self.weight = tag, parent, weight
        self.kids: list[Node | str] = []
        self.score = self.points = 0.0
        self.doubtful = self.dubious = self.likely = False


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(text)}


def tag_end(page: str, at: int) -> int:
    """The place of the > that ends the tag, past quoted values; -1 if none does."""
    while m := IN_TAG.search(page, at):
        if not m[1]:
            return m.start()
        close = page.find(m[1], m.end())
        at = m.end() if close < 0 else close + 1
    return -1


def parse(page: str) -> Node:
    """The tree without the parts that can't be main text; elements that may be such a part are marked as doubtful.

    Each place of the page is looked at a bounded number of times.
    """
    root = node = Node("html", None)
    at, skip, depth = 0, "", 0  # skip: the tag of the left-out element that is open, depth: of how many such
    opened: Counter[str] = Counter()

    def text(piece: str) -> None:
        if piece and not skip:
            node.kids.append(entities.unescape(piece) if "&" in piece else piece)

    def left(end: Node) -> Node:
        """Closes all open elements up to end, and returns its parent."""
        up = node
        while up is not end:
            opened[up.tag] -= 1
            up = up.parent
        opened[end.tag] -= 1
        return end.parent

    while m := START.search(page, at):
        text(page[at : m.start()])
        at = len(page)
        if m[1]:
            end = page.find("-->", m.end() - 2)
            at = end + 3 if end >= 0 else at
            continue
        if m[2]:
            end = page.find("]]>", m.end())
            text(page[m.end() : end if end >= 0 else at])
            at = end + 3 if end >= 0 else at
            continue
        end = page.find(">", m.end()) if m[3] else tag_end(page, m.end())
        if end < 0:
            break  # the page is cut off inside a tag
        at = end + 1
        if m[3]:
            continue
        tag, inner = m[5].lower(), page[m.end() : end]
        if m[4]:
            if skip:
                depth -= tag == skip
                skip = skip if depth else ""
            elif tag not in VOID and opened[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = left(up)
            continue
        empty = tag in VOID or inner.endswith("/") and tag not in BLOCK
        if tag in RAW and not inner.endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if skip:
            depth += tag == skip
            continue
        if tag == "br" or tag == "hr":
            node.kids.append(" " if tag == "br" else Node("hr", node))
            continue
        if empty or tag == "html":
            continue
        weight, likely, doubtful, dubious = 0.0, tag in ("article", "main"), tag == "form", False
        if inner:
            has = attributes(inner)
            names = f"{has.get('class', '')} {has.get('id', '')}"
            if tag in OUT or tag not in ("body", "article", "main") and (has.get("role", "").lower() in ROLES or "hidden" in has or has.get("aria-hidden") == "true"):
                skip, depth = tag, 1
                continue
            named = bool(LIKELY.search(names))
            weight, likely = 25.0 * named, likely or named
            if tag not in ("body", "article", "main") and tag not in HEADING and not named:
                doubtful = doubtful or bool(UNLIKELY.search(names))
                dubious = not doubtful and bool(DUBIOUS.search(names))
            else:
                doubtful = False
        elif tag in OUT:
            skip, depth = tag, 1
            continue
        if tag in ENDS_P and opened["p"]:  # a block ends an open paragraph, whatever inline elements are open in it
            up = node
            while up.tag != "p" and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p":
                node = left(up)
        if node.tag in ENDS and tag in ENDS[node.tag]:
            node = left(node)
        child = Node(tag, node, weight + {"article": 30.0, "main": 30.0, "section": 5.0, "div": 5.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0}.get(tag, 0.0))
        child.likely, child.doubtful, child.dubious = likely and tag != "body", doubtful, dubious
        node.kids.append(child)
        opened[tag] += 1
        node = child
    else:
        text(page[at:])
    return root


def points(node: Node) -> float:
    """What a paragraph gives by its own length and commas, 0 for other elements; length and commas are set."""
    own = node.tag in OWN
    chars, commas = (node.length, node.commas) if own else (sum(len(k.strip()) for k in node.kids if isinstance(k, str)), sum(k.count(",") for k in node.kids if isinstance(k, str)))
    return 0.0 if node.tag not in PARAGRAPH or chars < 10 else 1 + commas + min(chars / 100, 3) + chars / 1000


def pruned(root: Node) -> None:
    """Takes doubtful elements out of the tree, but for wrappers of most of the page outside of which nothing likely stands."""
    order = measured(root)
    for node in reversed(order):
        node.points = points(node) + sum(k.points for k in node.kids if isinstance(k, Node))
    inside = -1  # number of the last node of the likely element that the walk is in
    for node in order:
        if node.dubious:
            node.doubtful = node.number > inside or not node.points or density(node) >= 0.3
        if node.likely:
            inside = max(inside, node.last)
    top, most = root, root.points / 2
    while True:  # down from wrapper to wrapper: what is doubtful in top and in no other doubtful element, and whether all else is unlikely
        found, clear, stack = [], True, [(k, top.likely) for k in top.kids if isinstance(k, Node)]
        while stack:
            node, likely = stack.pop()
            if node.doubtful:
                found.append(node)
                continue
            likely = likely or node.likely
            clear = clear and not (likely and points(node))
            stack.extend((k, likely) for k in node.kids if isinstance(k, Node))
        wrapper = next((n for n in found if clear and n.points > most), None)
        if wrapper is None:
            break
        wrapper.doubtful, top = False, wrapper
    for node in order:
        node.kids = [k for k in node.kids if isinstance(k, str) or not k.doubtful]


def measured(root: Node) -> list[Node]:
    """Sets number, last (number in the subtree), length, commas and linked of all nodes, which are returned in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.number = len(order)
        order.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    for node in reversed(order):
        node.length = node.commas = node.linked = 0
        node.last = next((k.last for k in reversed(node.kids) if isinstance(k, Node)), node.number)
        for k in node.kids:
            if isinstance(k, str):
                node.length += len(" ".join(k.split()))
                node.commas += k.count(",") + k.count("，") + k.count("、")
            else:
                node.length, node.commas, node.linked = node.length + k.length, node.commas + k.commas, node.linked + k.linked
        if node.tag == "a":
            node.linked = node.length
    return order


def score(root: Node) -> list[Node]:
    """Sets length, commas and linked of all nodes, and score of containers, which are returned in page order."""
    order = measured(root)
    scored: dict[int, Node] = {}
    for node in order:
        given = points(node)
        if not given:
            continue
        up, level = node.parent if node.tag in OWN else node, 0
        while up is not None and level < 5:
            if id(up) not in scored:
                scored[id(up)], up.score = up, up.weight
            up.score += given / (1, 2, 6, 9, 12)[level]
            up, level = up.parent, level + 1
    for node in scored.values():
        node.score *= 1 - density(node)
    return [n for n in order if id(n) in scored]


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def blocks(node: Node, out: list[list[str]]) -> None:
    """Appends the texts of the node's blocks to out, each as a list of pieces; out[-1] is the open block."""
    stack: list[tuple[Node, int]] = [(node, 0)]
    if node.tag in BLOCK:
        out.append([])
    while stack:
        node, k = stack.pop()
        while k < len(node.kids):
            kid = node.kids[k]
            k += 1
            if isinstance(kid, str):
                out[-1].append(kid)
            else:
                if kid.tag in BLOCK:
                    out.append([])
                stack.append((node, k))
                node, k = kid, 0
        if node.tag in BLOCK:
            out.append([])


def container(ranked: list[Node]) -> Node:
    """The best scored node, or its nearest ancestor that holds two or more others that score nearly as well beside it."""
    best = max(ranked, key=lambda n: n.score)
    near = [n.number for n in ranked if n.score >= 0.75 * best.score]  # in page order
    up, own = best.parent, bisect(near, best.last) - bisect(near, best.number - 1)
    while up is not None:
        if bisect(near, up.last) - bisect(near, up.number) - own >= 2:
            up.score = max(up.score, best.score)
            return up
        own += bisect(near, up.number) - bisect(near, up.number - 1)
        up = up.parent
    return best


def extract(page: str) -> str:
    """The main text of a page, one line a block."""
    root = parse(page)
    pruned(root)
    ranked = score(root)
    if not ranked:
        kept = [root]
    else:
        best = container(ranked)
        kept, least = [], max(10.0, best.score * 0.2)
        for kid in best.parent.kids if best.parent is not None else [best]:
            if kid is best:
                kept.append(kid)
            elif isinstance(kid, Node) and (kid.score >= least or kid.tag in ("p", "pre", "blockquote") and density(kid) < 0.25 and (kid.length > 80 or kid.length and "." in "".join(x for x in kid.kids if isinstance(x, str))) or kid.tag in HEADING and density(kid) < 0.3):
                kept.append(kid)
    out: list[list[str]] = [[]]
    for kid in kept:
        out.append([])
        blocks(kid, out)
    lines = (" ".join("".join(parts).split()) for parts in out)
    return "\n".join(x for x in lines if x)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            texts = [extract(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = {k: pages.schema[k].dataType.simpleString() for k in ("page_id", "url")}
    return pages.select("page_id", "url", html).mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
