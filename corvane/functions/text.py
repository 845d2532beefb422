"""Normalisation, splitting and tokens, as Column expressions that stay in generated code."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t\n\r\f\x0B]+"

# Stop words, whose sets differ between token kinds, and number-bearing units.
MATCH_STOP = ["the", "a", "an", "of", "to", "in", "and", "은", "는", "이", "가", "에", "의", "을", "를"]
NLI_STOP = ["the", "a", "an", "of", "to", "in", "and", "is", "are", "be", "for", "with", "that", "this", "by", "on", "as", "at", "or", "from", "은", "는", "이", "가", "에", "의", "을", "를", "도", "으로"]
CONTENT_STOP = ["그리", "그러", "때문", "경우", "대한", "통해", "위한", "이상", "이하", "결과", "확인", "사용", "진행", "다음", "the", "and", "for", "with", "was", "were", "this", "that", "from"]
TOKEN = r"[A-Za-z가-힣0-9.]+"
CONTENT = r"[가-힣]{2,}|[A-Za-z]{3,}"
#: Characters per token, least and most, by script.
CHARS_PER_TOKEN = {"hangul": (1.3, 1.8), "latin": (3.5, 4.5), "digit": (1.5, 2.5), "other": (3.0, 4.5)}

CLAIM_SPLIT = r"(?<=[.!?])\s+|(?<=[다요])\s+|\n+"
ABSTRACT_SPLIT = r"(?<=[.!?])\s+"
DEVIATION_SPLIT = r"(?<=[.!?。])\s+|\n"
DISCUSSION_SPLIT = r"(?<=다)\.\s*"
CORPUS_SPLIT = r"(?<![0-9A-Za-z])\.(?=\s)|[!?。]|\n+|(?<=[다음함됨])\.\s"


def let(value: Column, body) -> Column:
    """body of the value, which is made once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def stripped(text: Column) -> Column:
    """Without any white space: what identifies a passage."""
    return F.regexp_replace(text, SPACES, "")


def unescape(text: Column) -> Column:
    """Literal \\r\\n, \\n, \\r and \\t become line feeds and tabs."""
    return F.regexp_replace(F.regexp_replace(text, r"\\r\\n|\\n|\\r", "\n"), r"\\t", "\t")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a class such as 'A-Z' the text has."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]+", ""))


def letter_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, count_of(text, "A-Za-z가-힣") / F.length(text)).otherwise(F.lit(0.0))


def pieces(text: Column, pattern: str) -> Column:
    """Trimmed, non-empty parts between matches."""
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != "")


def claims(text: Column) -> Column:
    return pieces(text, CLAIM_SPLIT)


def corpus_sentences(text: Column, least: int = 15, most: int = 400) -> Column:
    return F.filter(F.transform(F.split(text, CORPUS_SPLIT), squeeze), lambda s: F.length(s).between(least, most))


def gate_sentences(text: Column) -> Column:
    """Pieces of 4 characters or more that hold a letter; without any, the text itself."""
    some = F.filter(F.transform(F.split(text, CORPUS_SPLIT), squeeze), lambda s: (F.length(s) >= 4) & s.rlike("[A-Za-z가-힣]"))
    return F.when(F.size(some) > 0, some).otherwise(F.array(text))


def match_tokens(text: Column, stop: list[str] = MATCH_STOP) -> Column:
    """The set of lower-case tokens of two characters or more, without stop words."""
    long = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({TOKEN[:-1]}{{2,}})"), 1))
    return F.array_except(F.transform(long, F.lower), F.array(*map(F.lit, stop)))  # a set, in the order of the first


def nli_tokens(text: Column) -> Column:
    return match_tokens(text, NLI_STOP)


def content_words(text: Column) -> Column:
    """The set of content words: Hangul by the first two syllables, Latin in lower case."""
    all_ = F.transform(
        F.regexp_extract_all(text, F.lit(f"({CONTENT})"), 1),
        lambda w: F.when(w.rlike("^[가-힣]"), F.substring(w, 1, 2)).otherwise(F.lower(w)),
    )
    return F.array_distinct(F.filter(all_, lambda w: ~w.isin(CONTENT_STOP)))


def normalised_title(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "))


def shape_mask(text: Column) -> Column:
    """Digits become D, Hangul K and Latin letters A."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[A-Za-z]", "A"), "[0-9]", "D"), "[가-힣]", "K")


def length_bucket(n: Column) -> Column:
    # The bounds of the bins.
    out = F.lit("10000+")
    for below, name in ((10_000, "5000-9999"), (5000, "2000-4999"), (2000, "1000-1999"), (1000, "500-999"), (500, "200-499"), (200, "0-199")):
        out = F.when(n < below, name).otherwise(out)
    return out


def language_bucket(text: Column) -> Column:
    hangul, latin = count_of(text, "가-힣"), count_of(text, "A-Za-z")
    share = hangul / (hangul + latin)
    return F.when(hangul + latin == 0, "none").when(share > 0.7, "korean").when(share > 0.3, "mixed").otherwise("latin")


def token_bounds(text: Column) -> tuple[Column, Column]:
    """Least and most tokens, from characters per token of each script."""
    n = {"hangul": count_of(text, "가-힣"), "latin": count_of(text, "A-Za-z"), "digit": count_of(text, "0-9")}
    n["other"] = F.length(text) - n["hangul"] - n["latin"] - n["digit"]
    return tuple(sum((n[k] / F.lit(v[end]) for k, v in CHARS_PER_TOKEN.items()), F.lit(0.0)) for end in (1, 0))


def hangul_share(text: Column) -> Column:
    """Hangul among all Hangul and Latin letters; 0 without letters."""
    hangul = count_of(text, "가-힣")
    return hangul / F.greatest(F.lit(1), hangul + count_of(text, "A-Za-z"))


def usable_abstract(text: Column, least: int = 400, most: int = 1500, hangul: float = 0.5) -> Column:
    """An abstract of such a length, at least half Hangul, white space aside."""
    body = F.regexp_replace(text, SPACES, "")
    return F.length(text).between(least, most) & (count_of(body, "가-힣") >= hangul * F.length(body))


def strip_tags(html: Column) -> Column:
    """Text of a page: no scripts, styles or tags, the five common entities undone."""
    t = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(c))
    return squeeze(t)


OCR_DATE = r"([0-9OolI|]{4})\s*[-./년]\s*([0-9OolI|]{1,2})\s*[-./월]\s*([0-9OolI|]{1,2})"


def ocr_dates(text: Column) -> Column:
    """The text with each date whose digits were misread (O for 0, l, I or | for 1) as yyyy-mm-dd, in its place.

    A replacement is computed from each match, which Spark SQL cannot do, so this runs in Arrow batches.
    """

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        digits = str.maketrans("OolI|", "00111")
        fix = lambda m: "{:04d}-{:02d}-{:02d}".format(*(int(g.translate(digits)) for g in m.groups()))
        return s.map(lambda t: re.sub(OCR_DATE, fix, t), na_action="ignore")

    return run(text)


def final_consonant(word: Column) -> Column:
    """Whether the last Hangul syllable ends in a consonant."""
    code = F.ascii(F.substring(word, -1, 1))
    return code.between(0xAC00, 0xD7A3) & ((code - 0xAC00) % 28 > 0)


def particle(word: Column, after_consonant: str, after_vowel: str) -> Column:
    """The word with the particle that fits its last syllable."""
    return F.concat(word, F.when(final_consonant(word), after_consonant).otherwise(after_vowel))


def overlap(claim: Column, evidence: Column) -> Column:
    """Share of the claim's tokens that the evidence has."""
    a, b = match_tokens(claim), match_tokens(evidence)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def human_bytes(n: Column) -> Column:
    """A size with one decimal and its unit."""
    out = F.concat(F.format_string("%.1f", n / float(1024**5)), F.lit("PB"))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(n < 1024 ** (k + 1), F.concat(F.format_string("%.1f", n / float(1024**k)), F.lit(unit))).otherwise(out)
    return out
