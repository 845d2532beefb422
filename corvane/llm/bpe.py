"""Byte-level BPE ids through the tokenizers library, word by word, with a bounded table of words seen.

A byte-level pre-tokenizer always starts a new piece at a single space that
stands between two non-space characters, and gives a single line feed between
two such characters a piece of its own. Cutting there, encoding the parts and
joining their ids therefore equals encoding the whole text. A word of letters
alone is one piece, with its space, and goes to the library's model as such;
ASCII punctuation after it is a piece as well. Every other word goes through
the whole tokenizer. A text with other spacing (runs of white space, other
scripts' spaces) or with the string of an added token goes to the tokenizer as
it stands, so the ids are always the library's own.

Tables are bounded by bytes, in two generations: a full one becomes the older,
whose words come back when they are met again.
"""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array

import numpy as np

TOKENIZER = "byte_bpe_50k.json"
#: Bytes, estimated on the safe side, of one generation of a worker's table of words, and of line heads.
TABLE_BYTES = 96 << 20
HEAD_BYTES = 8 << 20
#: Characters after which a text with other spacing is cut where that is exact.
STRETCH = 50_000
_PUNCT = ".,"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in prints)
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


class Odd(Exception):
    """A word at whose ends a text may not be cut."""


class Words(dict):
    """word -> its ids as little-endian 16-bit bytes; learns what it lacks, and keeps at most two generations."""

    def __init__(self, bpe: Bpe, space: str, most: int):
        self.bpe, self.most, self.size, self.old = bpe, most, 0, {}
        self.space, self.opening = space, bpe.letters[32] if space else ""
        self.tokenize = bpe.lib.model.tokenize

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            core = word.rstrip(_PUNCT)
            if core.isascii() and core.isalpha():
                ids = array("H", [t.id for t in self.tokenize(self.opening + core)]).tobytes()
                if len(core) < len(word):
                    ids += self.bpe.heads[word[len(core) :]]
            else:
                ids = self.bpe.word(self.space, word)
        if self.size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        self[word] = ids
        self.size += 4 * len(word) + len(ids) + 240  # two objects and a slot in a table that may be a third full
        return ids


class Bpe:
    """encode(texts): for each text its ids as a uint16 array (the vocabulary has fewer than 65,536 entries)."""

    def __init__(self, path: str | None = None, table_bytes: int = TABLE_BYTES, head_bytes: int = HEAD_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path or default_path())
        if self.lib.get_vocab_size() > 65_536:
            raise ValueError("ids must fit into 16 bits")
        if sys.byteorder != "little":
            raise ValueError("ids are kept as the machine's 16-bit integers, which must be little-endian")
        self.tokenize = self.lib.model.tokenize
        self.letters = byte_letters()
        added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.inner = Words(self, " ", table_bytes)
        self.heads = Words(self, "", head_bytes)
        self.newline = self._raw("\n")

    def _raw(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def word(self, space: str, word: str) -> bytes:
        """The ids of one word with the space before it. Odd: no word, or a space of some kind in it."""
        core = word.rstrip(_PUNCT)
        # letters of the basic plane are letters to every version of Unicode in use
        if core.isalpha() and max(core) <= "\uffff":
            spelled = core.encode().decode("latin-1").translate(self.letters)
            ids = array("H", [t.id for t in self.tokenize((self.letters[32] if space else "") + spelled)]).tobytes()
            return ids + self.heads[word[len(core) :]] if len(core) < len(word) else ids
        if word.split() != [word] or any("\x1c" <= c <= "\x1f" for c in word):
            raise Odd
        return self._raw(space + word)

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        collects = gc.isenabled()
        gc.disable()  # none of the many small objects made here is part of a cycle
        try:
            return [np.frombuffer(self._encode(text), dtype="<u2") for text in batch]
        finally:
            if collects:
                gc.enable()

    def _encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.added.search(text) is None:
            inner, heads = self.inner.__getitem__, self.heads.__getitem__
            try:
                lines = []
                for line in text.split("\n"):
                    words = line.split(" ")
                    words[0], ids = heads(words[0]), map(inner, words[1:])  # Odd where the line begins with a space
                    lines.append(words[0] + b"".join(ids))
                return self.newline.join(lines)
            except Odd:
                pass
        return b"".join(self._careful(text))

    def _careful(self, text: str):
        """A text with other spacing: pieces of bounded length, cut only at single spaces between ASCII letters."""
        at, safe = 0, re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
        while len(text) - at > STRETCH and (m := safe.search(text, at + STRETCH)):
            yield self._raw(text[at : m.start()])
            at = m.start()
        yield self._raw(text[at:])


def worker_bpe(path: str | None, table_bytes: int = TABLE_BYTES) -> Bpe:
    """One tokenizer for each Python worker, path and size of table; workers are used again by later tasks."""
    import tokenizers

    kept = sys.modules["tokenizers"].__dict__.setdefault("_corvane_bpe", {})
    assert tokenizers
    key = path, table_bytes
    if key not in kept:
        kept[key] = Bpe(path, table_bytes)
    return kept[key]
