"""Claim and evidence sentences, and what a claim's numbers say about its support."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import quick
from .scores import NUMBER_UNIT
from .text import CORPUS_SPLIT, content_words, pieces, squeeze

# Marks of conclusions, of what is no claim, of what is no evidence, of bounds around a number, of directions.
CLAIM = (
    r"증가|감소|향상|저하|개선|악화|유의(?:하게|한|함|차)|확인(?:되|됨|하였|했)|나타났|나타냄|보였|보임|관찰(?:되|됨)|더\s*(?:높|낮|크|작|우수)|우수(?:하|했|함)|효과적|"
    r"경향(?:을|이)|결론|시사|의미한다|판단(?:된|됨)|significant|increase[sd]?|decrease[sd]?|improve[sd]?|higher|lower|superior|observ(?:ed|ation)|suggest"
)
NOT_CLAIM = (
    r"\.(?:pptx?|docx?|xlsx?|pdf|hwp|jpe?g|png|zip|csv)\b|^\s*\[?(?:Commit|Merge|Revert|feat|fix|chore|refactor)\b|"
    r"refs?\s*#\d|https?://|[A-Za-z]:\\|/[a-z]+/[a-z]+/"
)
NOT_EVIDENCE = r"[A-Za-z0-9+/]{40,}|(?:\b[0-9a-f]{16,}\b)"
BOUND_BEFORE, BOUND_AFTER = r"(?<![<>≤≥]\s{0,3})", r"(?!\s*(?:이하|이상|미만|초과|under|below|above|over))"
DIRECTION = r"\b(?:increase[sd]?|decrease[sd]?|reduc(?:e|es|ed)|inhibit[s]?|higher|lower|raise[sd]?|elevat(?:e|es|ed)|suppress(?:es|ed)?|improv(?:e|es|ed))\b"
QUANTITY = r"(?<![\w-])(?:\d+\.\d+|\d+)\s*(?:%|micro-?M|µM|nM|mM|mg|kg|fold|times)"


def _found(s: Column, pattern: str) -> Column:
    return F.zip_with(F.regexp_extract_all(s, F.lit(quick(pattern)), 1), F.regexp_extract_all(s, F.lit(quick(pattern)), 2), lambda v, u: F.concat(v, u))


def numbers(s: Column) -> Column:
    """The set of values with their units."""
    return F.array_distinct(_found(s, NUMBER_UNIT))


def exact_numbers(s: Column) -> Column:
    """Those that no inequality binds: changing one surely makes another claim."""
    return F.array_distinct(_found(s, BOUND_BEFORE + NUMBER_UNIT + BOUND_AFTER))


def shared_numbers(claim: Column, evidence: Column) -> Column:
    return F.array_intersect(exact_numbers(claim), exact_numbers(evidence))


def n_numbers(s: Column) -> Column:
    return F.regexp_count(s, F.lit(quick(NUMBER_UNIT)))


def is_claim(s: Column) -> Column:
    return s.rlike(quick("(?i)" + CLAIM)) & ~s.rlike(quick("(?i)" + NOT_CLAIM)) & (n_numbers(s) <= 2) & (F.size(content_words(s)) >= 3)


def is_evidence(s: Column) -> Column:
    return ~s.rlike(NOT_EVIDENCE) & (n_numbers(s) >= 2) & (F.size(content_words(s)) >= 2)


def supports(claim: Column, evidence: Column) -> Column:
    """Two shared words, or one and a shared number."""
    shared = F.size(F.array_intersect(content_words(claim), content_words(evidence)))
    return (shared >= 2) | ((shared >= 1) & F.arrays_overlap(numbers(claim), numbers(evidence)))


def has_quantitative(s: Column) -> Column:
    return s.rlike("(?i)" + QUANTITY) | s.rlike("(?i)" + DIRECTION)


def windows(text: Column, size: int = 800) -> Column:
    """The text itself, or its sentences in greedy windows of at most size characters that overlap by one sentence."""
    some = F.filter(F.transform(F.split(text, CORPUS_SPLIT), squeeze), lambda s: (F.length(s) >= 4) & s.rlike("[A-Za-z가-힣]"))
    empty = F.array().cast("array<string>")

    def add(acc: Column, s: Column) -> Column:
        grown = F.array_join(F.concat(acc["cur"], F.array(s)), " ")
        full = (F.size(acc["cur"]) > 0) & (F.length(grown) > size)
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(F.array_join(acc["cur"], " ")))).otherwise(acc["out"]).alias("out"),
            F.when(full, F.array(F.element_at(acc["cur"], -1), s)).otherwise(F.concat(acc["cur"], F.array(s))).alias("cur"),
        )

    packed = F.aggregate(some, F.struct(empty.alias("out"), empty.alias("cur")), add, lambda a: F.concat(a["out"], F.array(F.array_join(a["cur"], " "))))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(packed)


def abstract_sentences(text: Column) -> Column:
    return pieces(text, r"(?<=[.!?])\s+")
