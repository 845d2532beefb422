"""Rows made from records: compliant answers and their tampered forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import tamper_number
from ..functions.patterns import quick
from ..functions.text import let, particle

# Words and their opposites, a DOI that does not exist, authors to swap in.
ANTONYMS = {
    "increase": "decrease", "increases": "decreases", "increased": "decreased", "decrease": "increase", "decreases": "increases", "decreased": "increased",
    "higher": "lower", "lower": "higher", "reduce": "elevate", "reduces": "elevates", "reduced": "elevated", "elevate": "reduce", "elevates": "reduces", "elevated": "reduced",
    "inhibits": "activates", "inhibit": "activate", "suppresses": "induces", "suppress": "induce", "improves": "worsens", "improve": "worsen", "improved": "worsened",
    "raise": "lower", "raises": "lowers", "raised": "lowered",
}
QUANTITY = r"(?i)(?<![A-Za-z0-9_-])(\d+\.\d+|\d+)(?=\s*(?:%|micro-?M|µM|nM|mM|mg|kg|fold|times))"
FAKE_DOI = "10.1101/2024.99.99.999999"
SWAP_AUTHORS = ("Zhang et al.", "Smith et al.", "Nakamura et al.", "Muller et al.")
FAKE_PROJECT = "NCT09999999"


def tamper_polarity(sentence: Column) -> Column:
    """The first word with an opposite replaced by it, capitals kept; null where there is none."""
    p = quick(r"(?i)(?<![A-Za-z0-9_])(" + "|".join(ANTONYMS) + r")(?![A-Za-z0-9_])")
    word = F.regexp_extract(sentence, p, 1)
    at = F.length(F.regexp_extract(sentence, rf"(?is)^(.*?)(?<![A-Za-z0-9_])(?:{'|'.join(ANTONYMS)})(?![A-Za-z0-9_])", 1))
    other = F.create_map(*[F.lit(x) for kv in ANTONYMS.items() for x in kv])[F.lower(word)]
    other = F.when(F.substring(word, 1, 1).rlike("[A-Z]"), F.concat(F.upper(F.substring(other, 1, 1)), F.substring(other, 2, 99))).otherwise(other)
    return F.when(word != "", F.concat(F.substr(sentence, F.lit(1), at), other, F.substr(sentence, at + F.length(word) + 1)))


def tamper_biblio(citation: Column, surname: Column) -> Column:
    """The citation with the first author of the pool whose name does not begin like the real one."""
    start = F.lower(F.substring(surname, 1, 3))
    swap = F.coalesce(*[F.when(~F.startswith(F.lower(F.lit(a)), start), F.lit(a)) for a in SWAP_AUTHORS])
    return F.replace(citation, F.concat(surname, F.lit(" et al.")), swap)


def tamper_year(citation: Column, year: Column) -> Column:
    bracket = lambda y: F.concat(F.lit("("), y.cast("string"), F.lit(")"))
    return F.replace(citation, bracket(year), bracket(year - 5))


def cited(claim: Column, surname: Column, year: Column, doi: Column) -> Column:
    return F.concat(claim, F.lit(" ("), surname, F.lit(" et al. ("), year.cast("string"), F.lit("); DOI: "), doi, F.lit(")"))


def examples(claims: DataFrame) -> DataFrame:
    """label, halluc_type, response with each row's columns (claim, surname, year, doi, ...): one compliant answer and up to six that are not."""
    c, s, y, d = (F.col(x) for x in ("claim", "surname", "year", "doi"))
    fine = cited(c, s, y, d)
    biblio = tamper_biblio(fine, s)
    kinds = [
        ("compliant", None, fine), ("no_source", None, c), ("numeric_tamper", "C", let(tamper_number(c, QUANTITY), lambda number: F.when(number.isNotNull(), cited(number, s, y, d)))), ("fake_doi", "A", cited(c, s, y, F.lit(FAKE_DOI))),
        ("polarity_flip", "C", let(tamper_polarity(c), lambda polarity: F.when(polarity != c, cited(polarity, s, y, d)))), ("biblio_tamper", "A", let(biblio, lambda b: F.when(b != fine, b))), ("year_drift", "A", tamper_year(fine, y)),
    ]
    each = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(t).cast("string").alias("halluc_type"), r.alias("response")) for k, t, r in kinds])
    return claims.select("*", F.inline(F.filter(each, lambda x: x["response"].isNotNull())))


def preference_pairs(made: DataFrame, key: str) -> DataFrame:
    """key, kind, chosen, rejected of examples(): each compliant answer with each other of its row."""
    good = made.where("label = 'compliant'").select(key, F.col("response").alias("chosen"))
    bad = made.where("label <> 'compliant'").select(key, F.col("label").alias("kind"), F.col("response").alias("rejected"))
    return good.join(bad, key)


def trial_claim(sponsor: Column, condition: Column, study_type: Column, enrolled: Column, year: Column) -> Column:
    """What a trial's record says, in Korean."""
    kind = F.when(study_type == "INTERVENTIONAL", "중재연구").when(study_type == "OBSERVATIONAL", "관찰연구").otherwise("연구")
    first = F.concat(particle(sponsor, "은", "는"), F.lit(" "), particle(condition, "을", "를"), F.lit(" 대상으로 "), kind, F.lit("를 수행하였다"))
    second = F.when(enrolled.isNotNull(), F.concat(F.lit("본 연구에는 총 "), F.format_number(enrolled, 0), F.lit("명이 등록되었다")))
    third = F.when(year.isNotNull(), F.concat(F.lit("연구 개시 시점은 "), year.cast("string"), F.lit("년이다")))
    return F.concat(F.concat_ws(". ", first, second, third), F.lit("."))


def trial_source(sponsor: Column, year: Column, project: Column) -> Column:
    return F.concat(F.lit("(출처: "), sponsor, F.lit(", "), year.cast("string"), F.lit(", 과제번호 "), project, F.lit(")"))


def trial_items(trials: DataFrame, other_sponsor: Column) -> DataFrame:
    """label, response of trials (sponsor, condition, study_type, enrolled, year, project): the true answer and those with a wrong sponsor, number, year, project or no source."""
    sp, co, st, en, ye, pr = (F.col(x) for x in ("sponsor", "condition", "study_type", "enrolled", "year", "project"))
    told = lambda s=sp, e=en, y=ye: trial_claim(s, co, st, e, y)
    both = lambda claim, s=sp, y=ye, p=pr: F.concat(claim, F.lit(" "), trial_source(s, y, p))
    kinds = {
        "compliant": both(told()), "sponsor": both(told(s=other_sponsor), s=other_sponsor), "enrollment": F.when(en.isNotNull(), both(told(e=en * 3 + 7))),
        "date": F.when(ye.isNotNull(), both(told(y=ye - 4), y=ye - 4)), "id": both(told(), p=F.lit(FAKE_PROJECT)), "no_source": told(),
    }
    each = F.array(*[F.struct(F.lit(k).alias("label"), r.alias("response")) for k, r in kinds.items()])
    return trials.select("*", F.inline(F.filter(each, lambda x: x["response"].isNotNull())))
