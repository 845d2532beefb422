"""Patterns that find the same matches sooner: a look at one character decides where a match can begin at all.

Java tries every alternative at every position. A match of an alternative begins
with one of few characters, so a look-ahead for these, put before the pattern,
fails at most positions at once. Alternatives that begin with Latin-1 and those
that begin with other characters exclude each other, so each kind is tried only
where it can begin, in its old order. Nothing that matched fails, nothing else
matches, and groups keep their numbers.

Most texts hold no match of most patterns. Whether one can be there at all is
seen in one pass over a text, whatever the pattern's alternatives, by automata
that know no look-around: they get a looser form of each pattern, which matches
wherever the pattern does. Only texts that may hold a match are searched.
"""

from __future__ import annotations

import re
from functools import cache
from re import _constants as S
from re import _parser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = {S.CATEGORY_DIGIT: "0123456789", S.CATEGORY_SPACE: " \t\n\x0b\f\r", S.CATEGORY_WORD: "".join(map(chr, range(128))).translate({k: None for k in range(128) if not (chr(k).isalnum() or k == 95)})}
OTHER = 256  # stands for all characters beyond Latin-1
#: Alternatives whose parts never give a character back, as what follows does not begin with one they take; and, where
#: case does not matter, a name before "et al" begins where a word or the search does: else it would begin a letter before.
SAME = {
    r"[A-Z][A-Za-z]+\s+et\s+al\.?": (r"(?:(?<![A-Za-z])|\G)", r"[A-Z][A-Za-z]++\s++et\s++al\.?"),
    r"\b\w+\.(?:py|js|ts|tsx|java|cpp|c|h|go|rs|rb|php|sh|yaml|yml|json|md)\b": (r"\b", r"\b\w++\.(?:py|js|ts|tsx|java|cpp|c|h|go|rs|rb|php|sh|yaml|yml|json|md)\b"),
}
#: Places of a match that the look-ahead sees at most.
PLACES = 4
#: Zero-width marks before an alternative that go into the look-ahead, as they fail at most positions too.
MARKS = (r"\b", "^")


class _Open(Exception):
    """A match may begin with nearly any character, or be empty."""


def _of(c: int, fold: bool) -> set[int]:
    if c > 0xFFFF:
        raise _Open
    if c > 255:
        return {OTHER}
    s = chr(c)
    return {ord(x) for x in (s.lower(), s.upper())} if fold and s.isascii() and s.isalpha() else {c}


def _begin(items, fold: bool) -> tuple[set[int], bool]:
    """Characters a sequence may begin with, and whether it may be empty."""
    out: set[int] = set()
    for op, arg in items:
        some, empty = _one(op, arg, fold)
        out |= some
        if not empty:
            return out, False
    return out, True


def _one(op, arg, fold: bool) -> tuple[set[int], bool]:
    if op is S.LITERAL:
        return _of(arg, fold), False
    if op is S.IN:
        out: set[int] = set()
        for kind, x in arg:
            if kind is S.LITERAL:
                out |= _of(x, fold)
            elif kind is S.RANGE:
                for c in range(x[0], min(x[1], 256) + 1):
                    out |= _of(c, fold)
                out |= _of(x[1], fold)
            elif kind is S.CATEGORY and x in CLASSES:
                out |= {ord(c) for c in CLASSES[x]}
            else:
                raise _Open
        return out, False
    if op is S.BRANCH:
        each = [_begin(x, fold) for x in arg[1]]
        return set().union(*[s for s, _ in each]), any(e for _, e in each)
    if op is S.SUBPATTERN and not arg[1] and not arg[2]:
        return _begin(arg[3], fold)
    if op is S.ATOMIC_GROUP:
        return _begin(arg, fold)
    if op in (S.MAX_REPEAT, S.MIN_REPEAT, S.POSSESSIVE_REPEAT):
        some, empty = _begin(arg[2], fold)
        return some, empty or arg[0] == 0
    if op in (S.AT, S.ASSERT, S.ASSERT_NOT):
        return set(), True
    raise _Open


def _heads(items, fold: bool) -> tuple[list[set[int]], bool]:
    """Sets of characters for each of the first places of any match, and whether these are all its places."""
    out: list[set[int]] = []
    for op, arg in items:
        if op in (S.AT, S.ASSERT, S.ASSERT_NOT):
            continue
        whole = True
        if op in (S.LITERAL, S.IN):
            try:
                out.append(_one(op, arg, fold)[0])
            except _Open:
                return out, False
        elif op is S.SUBPATTERN and not arg[1] and not arg[2]:
            some, whole = _heads(arg[3], fold)
            out += some
        elif op is S.BRANCH:
            each = [_heads(x, fold) for x in arg[1]]
            least = min(len(some) for some, _ in each)
            out += [set().union(*[some[k] for some, _ in each]) for k in range(least)]
            whole = all(w and len(some) == least for some, w in each)
        elif op in (S.MAX_REPEAT, S.POSSESSIVE_REPEAT) and arg[0] > 0:
            out += _heads(arg[2], fold)[0]
            whole = False
        else:
            whole = False
        if not whole or len(out) >= PLACES:
            return out[:PLACES], whole and len(out) <= PLACES
    return out, True


def alternatives(pattern: str) -> list[str]:
    """The pattern's parts between bars that no group or class holds."""
    out, depth, k, begin, inside = [], 0, 0, 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            k += 2 if pattern.startswith("^]", k + 1) else pattern.startswith("]", k + 1)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            out.append(pattern[begin:k])
            begin = k + 1
        k += 1
    return [*out, pattern[begin:]]


def _class(chars: set[int]) -> str:
    return "[" + "".join(f"\\x{{{c:x}}}" for c in sorted(chars - {OTHER})) + (r"\x{100}-\x{ffff}" if OTHER in chars else "") + "]"


@cache
def quick(pattern: str) -> str:
    """A pattern with the same matches that fails sooner; the pattern itself where nothing can be said of its beginning."""
    flags, body = re.fullmatch(r"(?s)((?:\(\?[a-zA-Z]+\))?)(.*)", pattern).groups()
    if "U" in flags or "u" in flags or "\\Q" in body:
        return pattern
    fold = "i" in flags
    try:
        parts = []
        for a in alternatives(body):
            mark, a = SAME[a] if fold and a in SAME else (next((m for m in MARKS if a.startswith(m)), ""), a)
            items = _parser.parse(a)
            some, empty = _begin(items, fold)
            if empty:
                return pattern
            parts.append((a, mark, some, (_heads(items, fold)[0] or [some])[1:]))
    except (_Open, re.error):
        return pattern
    kinds = []
    for latin in (True, False):
        mine = [(a, mark, {c for c in some if (c < OTHER) == latin}, more) for a, mark, some, more in parts]
        mine = [x for x in mine if x[2]]
        if mine:
            kinds.append((_ahead([x[1:] for x in mine] if latin else [("", x[2], []) for x in mine]), "|".join(x[0] for x in mine)))
    if len(kinds) > 1 and "(" in re.sub(r"\\.|\(\?", "", body):  # groups that are counted: the alternatives stay as they are
        kinds = [("|".join(k for k, _ in kinds), "|".join(x[0] for x in parts))]
    return flags + "(?:" + "|".join(f"(?={k})(?:{a})" for k, a in kinds) + ")"


def _ahead(begins: list[tuple[str, set[int], list[set[int]]]]) -> str:
    """What the look-ahead looks for: by mark and number of known places, the characters of each place."""
    out: dict[tuple[str, int], list[set[int]]] = {}
    for mark, some, more in begins:
        places = out.setdefault((mark, min(len(more), PLACES - 1) // 2), [some, *more])
        for k, x in enumerate([some, *more][: len(places)]):
            places[k] = places[k] | x
        del places[1 + len(more) :]
    return "|".join(mark + "".join(map(_class, places)) for (mark, _), places in out.items())


def loose(pattern: str) -> str:
    """A pattern for automata that matches somewhere in every text in which the pattern does: without look-around, bounds of words and lines."""
    flags, body = re.fullmatch(r"(?s)((?:\(\?[a-zA-Z]+\))?)(.*)", pattern).groups()
    if "U" in flags or "u" in flags or "\\Q" in body:
        raise ValueError(f"no looser form of {pattern}")
    out, k, inside, drop, depth = [], 0, False, 0, 0
    while k < len(body):
        c, n = body[k], 1
        if c == "\\":
            n = 2
            c = {r"\b": "", r"\s": r"\s\x0b" if inside else r"[\s\x0b]"}.get(body[k : k + 2], body[k : k + 2])
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            n = 3 if body.startswith("^]", k + 1) else 2 if body.startswith(("^", "]"), k + 1) else 1
            c = body[k : k + n]
        elif c in "^$":
            c = ""
        elif c == "(":
            depth += 1
            if body.startswith(("(?=", "(?!", "(?<=", "(?<!"), k):
                drop = drop or depth
            elif body.startswith("(?>", k):
                n, c = 3, "(?:"
        elif c == ")":
            depth -= 1
            if drop == depth + 1:
                drop, c = 0, ""
        elif c == "+" and k and body[k - 1] in "+*?}" and body[k - 2 : k - 1] != "\\":
            c = ""
        if not drop:
            out.append(c)
        k += n
    return ("(?i)" if "i" in flags else "") + "".join(out)


def may(text: Column, patterns: list[str]) -> Column:
    """Bits: the k-th is set where the text may hold a match of the k-th pattern, and not set only where it holds none."""
    forms = [loose(p) for p in patterns]

    @F.arrow_udf("long")
    def run(t: pa.Array) -> pa.Array:  # whole in itself, so that executors need no package
        import numpy
        import pyarrow
        import pyarrow.compute as pc

        bits = numpy.zeros(len(t), dtype="int64")
        for k, p in enumerate(forms):
            bits |= pc.match_substring_regex(t, p).fill_null(False).to_numpy(zero_copy_only=False).astype("int64") << k
        return pyarrow.array(bits)

    return run.asNondeterministic()(text)  # it is not, but Spark makes such a column once and leaves it where it stands


def bit(bits: Column, k: int) -> Column:
    return bits.bitwiseAND(F.lit(1 << k)) != 0
