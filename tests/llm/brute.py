"""Plain versions of the training-data operators' contracts, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def words(text):
    return WORD.findall(text or "")


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = words(text)
    n, windows, covered = len(w), collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k in range(n - 2):
        if windows[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return 8 <= len(d) <= 15 if kind == "phone" else True


def spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(text or "") if valid(k, m.group())]


def told(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def digest(text):
    return hashlib.sha256(told(spans(text)).encode()).hexdigest()


def shingles(text, n=3):
    w = words((text or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def top(self, v):
        while self.up[v] != v:
            self.up[v] = self.up[self.up[v]]
            v = self.up[v]
        return v

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def near_duplicates(docs, n=3, percent=85):
    """{doc_id: component} of all pairs by an inverted index over every shingle."""
    sets = {i: shingles(t, n) for i, t in docs}
    where, found = collections.defaultdict(list), Sets(sets)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        common = collections.Counter(j for x in s for j in where[x] if j < i)
        for j, both in common.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                found.join(i, j)
    return {i: found.top(i) for i in sets}


def vectors(rows, least=0.93):
    """{vec_id: (n_links, component)} of (vec_id, embedding, label)."""
    found, links = Sets([r[0] for r in rows]), collections.Counter()
    unit = {}
    for i, v, g in rows:
        if g is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.asarray(v, float) / np.abs(v).max()
            unit[i] = x / np.linalg.norm(x)
    label = {r[0]: r[2] for r in rows}
    ids = sorted(unit)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                found.join(i, j)
    return {r[0]: (links[r[0]], found.top(r[0])) for r in rows}


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def language_base(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    tokens = {i: [*words((t or "").translate(LOWER)), None] for i, t in docs}
    counts = collections.Counter(w for i, t in tokens.items() if not held_out(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    return {i: (held_out(i), len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)) for i, t in tokens.items()}


def targets(sizes):
    """{source: target} of {source: size}: shares by weight, what is over three times the size is dealt out again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(k % 3 + 1) for k, s in enumerate(order)}
    capped, total = {}, float(sum(sizes.values()))
    while True:
        left = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def token_ids(texts, end):
    """Unsigned 32-bit ids of each text by the library itself, with the end id."""
    from tokenizers import Tokenizer

    from kelpline.llm import tokens

    library = Tokenizer.from_file(tokens.path())
    return [np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]
