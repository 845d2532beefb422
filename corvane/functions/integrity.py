"""Integrity scores and document checks of research records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import quick
from .text import let

# Unit spellings and marks that the scores look for.
ALCOA_UNIT = r"([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)[ \t]*(°c|℃|k|mol|mm|nm|μm|ph|%|명|건|개|회|년|세|시간|일|주|개월|점|배)"
ALCOA_INCOMPLETE = r"\.\.\.|…|등등|기타\s*등|TBD|to be|작성\s*예정"
HALLUC_UNIT = r"([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)[ \t]*(°c|℃|micro-?m|µm|nm|mm|mg|kg|mol|ph|%|fold|times|명|건|개|회|년|세|시간|일|주|개월|점|배)"
RECORD_UNIT = r"([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)[ \t]*(℃|°C|%p|%|μM|mM|nM|N/m|ms|초|분|시간|일|주|개월|년|nm|㎛|μm|mm|cm|mg|kg|g|mL|L|rpm|명|건|회|배|점)"
RECORD_INCOMPLETE = r"TBD|추후\s*기재|작성\s*예정|…|\.\.\.|미정|해당\s*없음\s*$"
NO_SIGN = r"\(\s*서명\s*없음\s*\)|미기재|없음"
CORRECTION = r"정정\s*이력|정정\s*사유|수정\s*사유|원본\s*보존"
RESTATED, PLANNED = r"확인되었|측정되었|산출되었|나타났|기록되었|대표값", r"차기|향후|예정|계획|검토할|추가로|제안한다|필요하다"
DERIVED = r"단축|절감|향상|개선|증가|감소|대비|배\s|상회|하회|수준"
DATE = r"\d{4}\s*[-./년]\s*\d{1,2}\s*[-./월]\s*\d{1,2}"
DEVIATION, DEVIATION_TOLD = r"이탈|일탈|계획\s*변경|deviation", r"승인|사유|보고|문서화|approv|reason|document"
SPECIMEN = r"검체|시료|샘플|specimen|sample"
SPECIMEN_ID = r"(?:시료|검체|샘플|sample|specimen)\s*(?:번호|ID|No\.?|#)|[A-Z]{1,4}-?\d{2,}"
COVER = {
    "기관명": r"기관명|연구소|연구원(?![가-힣])|대학교|주식회사|㈜|\(주\)|Inc\.|Co\.,", "과제명": r"과제\s*명|과제\s*번호|연구\s*과제|project",
    "일련번호": r"일련\s*번호|노트\s*(?:번호|No)|No\.\s*\d+|#\s*\d+", "쪽번호": r"\d+\s*/\s*\d+\s*(?:쪽|page)?|(?:page|p\.)\s*\d+|-\s*\d+\s*-|\d+\s*쪽",
}
LIMIT_DAYS = 3


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(quick("(?i)" + pattern)), F.lit(False))


def value_units(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Set of (u, v); units in lower case where case is ignored."""
    p = F.lit(quick(("(?i)" if ignore_case else "") + pattern))
    unit = (lambda u: F.lower(u)) if ignore_case else (lambda u: u)
    return F.array_distinct(F.zip_with(F.regexp_extract_all(text, p, 2), F.regexp_extract_all(text, p, 1), lambda u, v: F.struct(unit(u).alias("u"), v.alias("v"))))


def alcoa(text: Column, model_known: Column, timestamped: Column) -> Column:
    """Mean of attributable, accurate, complete and consistent."""
    attributable = F.when(model_known, 0.5).otherwise(0.0) + F.when(timestamped, 0.5).otherwise(0.0)
    bare = F.regexp_count(text, F.lit(r"(?U)(?<![\w.])\d+(?:\.\d+)?(?![\w.%°])"))
    unit = F.regexp_count(text, F.lit("(?i)" + ALCOA_UNIT))
    accurate = F.when(bare + unit == 0, 1.0).otherwise(unit / (bare + unit))
    complete = F.when(_has(text, ALCOA_INCOMPLETE), 0.0).otherwise(1.0)
    pairs = value_units(text, ALCOA_UNIT)
    units = F.array_distinct(F.transform(pairs, lambda x: x["u"]))
    clashing = F.size(F.filter(units, lambda u: F.size(F.filter(pairs, lambda x: x["u"] == u)) >= 3))
    consistent = F.when(F.size(units) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - clashing / F.size(units)))
    return (attributable + accurate + complete + consistent) / 4


def changed_numbers(text: Column, evidence: Column) -> Column:
    """Share of values, among those whose unit the evidence has, that the evidence lacks in that unit."""
    mine, theirs = value_units(text, HALLUC_UNIT), value_units(evidence, HALLUC_UNIT)
    checked = F.filter(mine, lambda x: F.exists(theirs, lambda y: y["u"] == x["u"]))
    wrong = F.filter(checked, lambda x: ~F.array_contains(theirs, x))
    return F.when(F.size(checked) > 0, F.size(wrong) / F.size(checked)).otherwise(0.0)


def halluc(citations: Column, numbers: Column, swapped: Column) -> Column:
    return F.greatest(citations, F.when(swapped, 1.0).otherwise(numbers))


def section(text: Column, header: str) -> Column:
    """Body of a numbered section, up to the next number at the start of a line."""
    return F.regexp_extract(text, rf"(?s)\Q{header}\E[^\n]*\n(.*?)(?=\n\d\.\s|\z)", 1)


def _label(text: Column, pattern: str) -> Column:
    return F.trim(F.regexp_extract(text, pattern, 1))


def attributable(text: Column) -> Column:
    signed = lambda p: let(_label(text, p), lambda name: (name != "") & ~_has(name, NO_SIGN))
    return 1.0 - F.when(signed(r"연구자[^:：\n]*[:：]\s*([^\n]*)"), 0.0).otherwise(0.6) - F.when(signed(r"점검자[^:：\n]*[:：]\s*([^\n]*)"), 0.0).otherwise(0.4)


def contemporaneous(text: Column, limit: int = LIMIT_DAYS) -> Column:
    day = lambda p: F.regexp_extract(text, p + r"\s*[:：]\s*(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    late = lambda delay: F.greatest(F.lit(0.0), 1.0 - (delay - limit) / 30)
    return let(F.datediff(day("기록일"), day("실험일")), lambda delay: F.when(delay.isNull() | (delay < 0), 0.0).when(delay <= limit, 1.0).otherwise(late(delay)))


def original(text: Column, evidence: Column) -> Column:
    """0 if a unit's values in the results were replaced and no correction is noted; nothing to compare: 1."""
    body = lambda t: let(section(t, "4. 결과"), lambda s: F.when(s != "", s).otherwise(t))
    both = F.struct(*[value_units(body(t), RECORD_UNIT, False).alias(k) for k, t in (("cur", text), ("ref", evidence))])
    units = lambda b, a, c: F.transform(F.array_except(b[a], b[c]), lambda x: x["u"])
    replaced = let(both, lambda b: F.arrays_overlap(units(b, "ref", "cur"), units(b, "cur", "ref")))
    return F.when(F.coalesce(replaced, F.lit(False)) & ~_has(text, CORRECTION), 0.0).otherwise(1.0)


def complete(text: Column) -> Column:
    return F.when(_has(text, RECORD_INCOMPLETE), 0.0).otherwise(1.0)


def consistent(text: Column) -> Column:
    """0 if the discussion restates a value that the results have otherwise."""
    results = let(section(text, "4. 결과"), lambda s: value_units(F.when(s != "", s).otherwise(text), RECORD_UNIT, False))
    said = F.filter(F.split(section(text, "5. 고찰"), r"(?<=다)\.\s*"), lambda s: s.rlike(RESTATED) & ~s.rlike(PLANNED) & ~s.rlike(DERIVED))
    again = value_units(F.array_join(said, " "), RECORD_UNIT, False)
    clash = let(results, lambda r: F.exists(again, lambda x: F.exists(r, lambda y: y["u"] == x["u"]) & ~F.array_contains(r, x)))
    return F.when(clash, 0.0).otherwise(1.0)


def accurate(text: Column) -> Column:
    """Share of numbers with a unit among numbers, dates and section numbers aside; 1 without any."""
    body = F.regexp_replace(F.regexp_replace(text, DATE, " "), r"(?m)^\s*\d\.\s", " ")
    unit = F.regexp_count(body, F.lit("(?i)" + RECORD_UNIT))
    bare = F.regexp_count(F.regexp_replace(body, "(?i)" + RECORD_UNIT, " "), F.lit(r"(?<![0-9A-Za-z_.-])[0-9]+(?:\.[0-9]+)?(?![0-9A-Za-z_.%-])"))
    return F.when(unit + bare == 0, 1.0).otherwise(unit / (unit + bare))


def record_report(text: Column, evidence: Column) -> Column:
    """Struct of the six scores, their mean (overall) and the attributes below 1 (violated)."""
    scores = {"Attributable": attributable(text), "Contemporaneous": contemporaneous(text), "Original": F.when(F.coalesce(evidence, F.lit("")) == "", 1.0).otherwise(original(text, evidence)), "Accurate": accurate(text), "Complete": complete(text), "Consistent": consistent(text)}
    overall = sum(scores.values(), F.lit(0.0)) / len(scores)
    violated = F.array_compact(F.array(*[F.when(c < 1, k) for k, c in scores.items()]))
    return F.struct(*[c.alias(k.lower()) for k, c in scores.items()], overall.alias("overall"), violated.alias("violated"))


def undocumented_deviations(text: Column) -> Column:
    """Sentences that name a deviation without approval or reason."""
    return F.filter(F.split(text, r"(?<=[.!?。])\s+|\n"), lambda s: s.rlike("(?i)" + DEVIATION) & ~s.rlike("(?i)" + DEVIATION_TOLD))


def specimen_findings(text: Column) -> Column:
    named = _has(text, SPECIMEN)
    return F.array_compact(F.array(F.when(named & ~_has(text, SPECIMEN_ID), F.lit("id")), F.when(named & ~_has(text, DATE), F.lit("date"))))


def cover_findings(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(~_has(text, p), F.lit(k)) for k, p in COVER.items()]))


def projects(text: Column) -> Column:
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"과제\s*명\s*[:：]\s*([^\n]+)"), 1), lambda x: F.trim(x))))
