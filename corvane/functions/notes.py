"""Fields and sections of scanned research notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of fields, headers of sections, lines of noise, labels and headers that are not joined, ends of sentences.
SEPARATOR = r"[:：;]?"
META = {
    "project_no": rf"과\s*제\s*(?:번호|고유번호){SEPARATOR}\s*([^\n]+)", "project_title": rf"과\s*제\s*명{SEPARATOR}\s*([^\n]+)",
    "institution": rf"(?:수행)?\s*기\s*관{SEPARATOR}\s*([^\n]+)", "researcher": rf"(?:연\s*구\s*자|작\s*성\s*자){SEPARATOR}\s*([^\n]+)",
    "reviewer": rf"(?:점\s*검\s*자|입\s*회\s*자|확\s*인\s*자){SEPARATOR}\s*([^\n]+)", "exp_date": rf"실\s*험\s*일{SEPARATOR}\s*([^\n]+)", "record_date": rf"기\s*록\s*일{SEPARATOR}\s*([^\n]+)",
}
SECTIONS = {
    "purpose": r"(?:^|\n)\s*\d?\s*[.)]?\s*(?:실\s*험\s*)?목\s*적", "methods": r"(?:^|\n)\s*\d?\s*[.)]?\s*(?:재\s*료\s*(?:및|와)?\s*)?방\s*법",
    "results": r"(?:^|\n)\s*\d?\s*[.)]?\s*(?:실\s*험\s*)?결\s*과", "discussion": r"(?:^|\n)\s*\d?\s*[.)]?\s*(?:고\s*찰|결\s*론)",
}
NOISE = r"^[\s\-_=~·.]{0,4}$|^[|/\\]{1,3}$"
LABEL = r"^\s*[가-힣A-Za-z][가-힣A-Za-z\s]{0,12}[:：]"
HEADER = r"^\s*\d\s*[.)]\s*\S"
ENDED = r"[.!?다요:：]\s*$"
LEAST_LINE = 20
#: Notes less complete than this were not read well; they are no violations.
LEAST_COMPLETE = 0.4


def rejoined(text: Column) -> Column:
    """Scanned lines without noise, each joined to the one before where that is long and goes on."""
    lines = F.filter(F.transform(F.split(text, "\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: ~F.regexp_replace(x, r"^\s+", "").rlike(NOISE))

    def add(acc: Column, line: Column) -> Column:
        before = F.coalesce(F.element_at(acc, -1), F.lit(""))
        joins = (F.length(before) > LEAST_LINE) & ~before.rlike(ENDED) & ~before.rlike(LABEL) & ~line.rlike(LABEL) & ~line.rlike(HEADER)
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(before, F.lit(" "), F.regexp_replace(line, r"^\s+", ""))))
        return F.when((F.size(acc) > 0) & joins, longer).otherwise(F.concat(acc, F.array(line)))

    # element_at fails on an empty array, so the fold starts with a line that never joins
    folded = F.aggregate(lines, F.array(F.lit("")), add)
    return F.array_join(F.slice(folded, 2, F.greatest(F.size(folded) - 1, F.lit(0))), "\n")


def meta(text: Column) -> Column:
    """Map of the fields that are there."""
    pairs = [F.struct(F.lit(k).alias("key"), F.trim(F.regexp_extract(text, p, 1)).alias("value")) for k, p in META.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"] != ""))


def sections(text: Column) -> Column:
    """Map of the sections that are there: each from its header's end to the next header's end."""
    end = lambda p: F.length(F.regexp_extract(text, rf"(?s)^(.*?(?:{p.replace('(?:^|', '(?:(?-s)^|', 1)}))", 1))
    found = F.filter(F.array(*[F.struct(end(p).alias("at"), F.lit(k).alias("key")) for k, p in SECTIONS.items()]), lambda x: x["at"] > 0)
    found = F.array_sort(found)
    stop = lambda k: F.coalesce(F.get(found, k + 1)["at"], F.length(text))
    body = lambda x, k: F.regexp_replace(F.substr(text, x["at"] + 1, stop(k) - x["at"]), r"^[ :：\n]+|[ :：\n]+$", "")
    every = F.transform(found, lambda x, k: F.struct(x["key"].alias("key"), body(x, k).alias("value")))
    return F.map_from_entries(F.filter(every, lambda x: x["value"] != ""))


def completeness(fields: Column, parts: Column) -> Column:
    return (F.size(fields) + F.size(parts)) / (len(META) + len(SECTIONS))


def quality(fields: Column, parts: Column) -> Column:
    """Struct of completeness (three places), signed and dated, as 1 or 0, and usable."""
    has = lambda k: F.when(F.map_contains_key(fields, k), 1.0).otherwise(0.0)
    c = completeness(fields, parts)
    return F.struct(F.bround(c, 3).alias("completeness"), has("researcher").alias("signed"), F.greatest(has("exp_date"), has("record_date")).alias("dated"), (c >= LEAST_COMPLETE).alias("usable"))
