"""Texts to token ids with the tokenizers library, inside Spark's tasks."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NAME = "byte_bpe_50k.json"
#: How the byte-level tokenizer cuts a text before it looks for tokens, for characters of known kinds.
#: Letters: ASCII, Latin, Cyrillic, Hebrew, Arabic, kana, Han, Hangul. Other: neither letter, digit nor white space.
LETTERS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f\u0400-\u0481\u048a-\u052f\u05d0-\u05ea\u0620-\u064a\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
DIGITS = "0-9"
OTHER = r"!-/:-@\[-`{-~\xa1-\xa9\xab-\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7\u2010-\u2027\u2030-\u205e\u3001-\u3003\u3008-\u3011\uff0c"
SPACES = r"\x20\n\r\t"
PART = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[{OTHER}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
KNOWN_KINDS = re.compile(rf"[{LETTERS}{DIGITS}{OTHER}{SPACES}]*+")
#: Where words are cut, and white space that can't be cut at each of its characters: three in a row, two at the end, any but space and newline.
SPACED = re.compile(rf"(?<=[^{SPACES}])(?=[{SPACES}])")
SEVERAL = ("  ", "\n\n", " \n", "\n ", "\r", "\t")
ODD = re.compile(rf"[\r\t]|[{SPACES}]{{3}}|[{SPACES}]{{2}}\Z")
#: A single space between two of ASCII's letters and digits: a text can be cut before it.
CUT = re.compile("(?<=[A-Za-z0-9])(?= [A-Za-z0-9])")
#: Bytes that remembered parts may take; characters of the longest that are; bytes of an entry besides its characters.
MEMORY, LONGEST, ENTRY = 64_000_000, 32, 130
#: Characters that are encoded at a time, about.
STRETCH = 4_000_000


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: itself if it is printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


def path(name: str = NAME) -> str:
    """Where the vocabulary file is on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """The text in stretches of about that many characters, whose tokens are those of the text."""
    out, at = [], 0
    while len(text) - at > size and (m := CUT.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def marked(text: str) -> str:
    """The text with a mark where words start."""
    if any(x in text for x in SEVERAL) and ODD.search(text):
        return SPACED.sub("\0", text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0")


class Encoder:
    """encode(texts): the ids of each UTF-8 text as little-endian unsigned 32-bit bytes, without added special tokens.

    A text of characters of known kinds is cut into words where white space starts. Arrow finds the distinct words of a
    batch, these are cut into parts as the tokenizer cuts them, and the ids of a part come from the library's model. Parts
    met before are looked up. What is remembered takes `memory` bytes at most, besides the parts of one batch; when these
    are full, all but the last batch's are forgotten. All other texts, and those that may hold a special token, go through
    the library as a whole.
    """

    def __init__(self, file: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.memory, self.held = Tokenizer.from_file(file), memory, 0
        self.model, self.letters = self.library.model, byte_letters()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[bytes]) -> list[bytes]:
        return [b"".join(np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(stretches(t.decode()), add_special_tokens=False)) for t in texts]

    def known_kinds(self, text: str) -> bool:
        return KNOWN_KINDS.fullmatch(text) is not None and not any(s in text for s in self.special)

    def part(self, part: str) -> bytes:
        """The ids of a part that isn't remembered yet."""
        if part[-1] > " " and part.isascii():  # printable, but for the space in front
            letters = part.replace(" ", self.letters[32])
        else:
            letters = part.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(letters)]
        found = pack(f"<{len(ids)}I", *ids)
        if len(part) <= LONGEST:
            self.known[part] = found
            self.held += ENTRY + len(part) + len(found)
        return found

    def word(self, w: str) -> bytes:
        """The ids of a word that isn't a remembered part."""
        known, part = self.known, self.part
        if w[1:].isalpha() and (w[0] == " " or w[0].isalpha()):
            return part(w)
        stem, mark = w[:-1], w[-1:]
        if stem[1:].isalpha() and (stem[0] == " " or stem[0].isalpha()) and not mark.isalnum():  # a part of letters and a mark after it
            return (known.get(stem) or part(stem)) + (known.get(mark) or part(mark))
        return b"".join([known.get(p) or part(p) for p in PART.findall(w)])

    def words(self, texts: list[str]) -> list[bytes]:
        """The ids of texts of known kinds."""
        lists = pc.split_pattern(pa.array(map(marked, texts), pa.large_string()), "\0")
        found = lists.flatten().dictionary_encode()
        distinct, known, word = found.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known, self.word
        ids = [known.get(w) or word(w) for w in distinct]
        if self.held > self.memory:  # what this batch didn't need is forgotten
            self.known = {w: known[w] for w in distinct if w in known}
            self.held = sum(ENTRY + len(w) + len(x) for w, x in self.known.items())
        size, index = np.fromiter(map(len, ids), np.int64, len(ids)) // 4, found.indices.to_numpy()
        each = size[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        place = np.repeat((np.cumsum(size) - size)[index] - ends[:-1], each) + np.arange(ends[-1])
        out = np.frombuffer(b"".join(ids), "<u4")[place].tobytes()
        edges = 4 * ends[lists.offsets.to_numpy()]
        return [out[a:b] for a, b in pairwise(edges.tolist())]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        some: list[tuple[int, str]] = []
        held = 0

        def close() -> None:
            for (k, _), x in zip(some, self.words([t for _, t in some]), strict=True):
                out[k].append(x)
            some.clear()

        for k, t in enumerate(texts):
            text = t.decode()
            if not self.known_kinds(text):
                out[k] = self.whole([t])
                continue
            for piece in stretches(text):
                some.append((k, piece))
                held += len(piece)
                if held >= STRETCH:
                    close()
                    held = 0
        close()
        return [b"".join(x) for x in out]


@lru_cache(1)
def encoder(file: str) -> Encoder:
    """One for each Python worker, whose tasks share what it remembers."""
    return Encoder(file)
