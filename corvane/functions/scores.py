"""Verification scores and small-sample statistics as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nli_tokens

# Words that negate, opposite directions, unit spellings and unit dimensions.
NEGATION = ["not", "no", "without", "lack", "lacks", "lacking", "fail", "fails", "failed", "absence", "absent", "cannot", "neither", "nor", "none", "unable", "un", "않", "없", "못"]
OPPOSITES = [
    ("increase", "decrease"), ("increases", "decreases"), ("increased", "decreased"), ("raise", "lower"), ("raises", "lowers"), ("raised", "lowered"),
    ("high", "low"), ("higher", "lower"), ("more", "less"), ("greater", "fewer"), ("positive", "negative"), ("activate", "inhibit"),
    ("activates", "inhibits"), ("induce", "suppress"), ("induces", "suppresses"), ("promote", "prevent"), ("promotes", "prevents"),
    ("enhance", "reduce"), ("enhances", "reduces"), ("gain", "loss"), ("up", "down"), ("upregulate", "downregulate"), ("improve", "worsen"),
    ("improves", "worsens"), ("stimulate", "block"),
]
UNITS = (
    r"(℃|°C|%|㎍|μg|µg|ug|ng|mg|kg|g|㎖|mL|ml|μL|µL|uL|L|μM|µM|uM|mM|nM|M|nm|㎛|μm|µm|um|mm|cm|rpm|hr|min|sec|시간|분|초|일|주|개월|배|명|건|회|"
    r"ppm|kPa|MPa|GPa|kWh|Wh|W|kW|V|A|Hz|kHz|㎡|m2|mol|eq|wt%|vol%)"
)
NUMBER_UNIT = r"(?<![A-Za-z0-9-])([0-9]+(?:\.[0-9]+)?)\s*" + UNITS + r"(?![A-Za-z0-9-])"
ALIAS = {
    "ug": "µg", "μg": "µg", "㎍": "µg", "uM": "µM", "μM": "µM", "um": "µm", "μm": "µm", "㎛": "µm", "uL": "µL", "μL": "µL", "ml": "mL", "㎖": "mL",
    "sec": "s", "초": "s", "분": "min", "hr": "h", "시간": "h", "일": "d", "주": "wk", "개월": "mo",
}
DIMENSION = {
    "mass": ("ng", "µg", "mg", "g", "kg"), "conc": ("nM", "µM", "mM", "M"), "vol": ("µL", "mL", "L"), "len": ("nm", "µm", "mm", "cm"),
    "time": ("s", "min", "h", "d", "wk", "mo"), "energy": ("Wh", "kWh"), "power": ("W", "kW"),
}
VCR_WEIGHTS = {"source_exist": 0.25, "source_match": 0.30, "alcoa": 0.25, "halluc": 0.20}
POLARITY_FACTOR = 0.35


def _literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def negated(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, NEGATION))) | F.array_join(tokens, " ").rlike("[않없못]")


def polarity_conflict(premise: Column, hypothesis: Column) -> Column:
    """Token sets that name opposite directions, or of which one alone is negated."""
    mates = F.flatten(F.transform(hypothesis, lambda t: F.coalesce(_literal_pairs()[t], F.array().cast("array<string>"))))
    return F.arrays_overlap(mates, premise) | (negated(premise) != negated(hypothesis))


def _literal_pairs() -> Column:
    """Word to the one that the later of its pairs opposes to it."""
    d: dict[str, str] = {}
    for a, b in OPPOSITES:
        d[a], d[b] = b, a
    return F.create_map(*[x for a, b in d.items() for x in (F.lit(a), F.array(F.lit(b)))])


def set_cosine(premise: Column, hypothesis: Column) -> Column:
    """Cosine of two token sets, every token with the same weight."""
    common = F.size(F.array_intersect(premise, hypothesis))
    return F.when(common == 0, 0.0).otherwise(common / F.sqrt(F.size(premise) * F.size(hypothesis)))


def entailment(premise: Column, hypothesis: Column) -> Column:
    """set_cosine of the texts' tokens, less where their polarities conflict."""
    p, h = nli_tokens(premise), nli_tokens(hypothesis)
    return set_cosine(p, h) * F.when(polarity_conflict(p, h), POLARITY_FACTOR).otherwise(1.0)


def number_units(text: Column) -> Column:
    """Array of (value, unit), units in one spelling."""
    v = F.regexp_extract_all(text, F.lit(NUMBER_UNIT), 1)
    u = F.regexp_extract_all(text, F.lit(NUMBER_UNIT), 2)
    alias = _literal_map(ALIAS)
    return F.zip_with(v, u, lambda a, b: F.struct(a.alias("v"), F.coalesce(alias[b], b).alias("u")))


def unit_swaps(text: Column, evidence: Column) -> Column:
    """Values of the text that the evidence has with another unit of the same dimension alone; 1 is exempt."""
    family = _literal_map({u: d for d, us in DIMENSION.items() for u in us})
    ev = number_units(F.coalesce(evidence, F.lit("")))
    swapped = F.filter(
        number_units(F.coalesce(text, F.lit(""))),
        lambda x: (x["v"] != "1")
        & ~F.exists(ev, lambda e: (e["v"] == x["v"]) & (e["u"] == x["u"]))
        & F.exists(ev, lambda e: (e["v"] == x["v"]) & (family[e["u"]] == family[x["u"]])),
    )
    return F.transform(swapped, lambda x: F.concat(x["v"], x["u"]))


def _keys(numbers: Column) -> Column:
    return F.transform(numbers, lambda n: F.coalesce(F.replace(n, F.lit(","), F.lit("")).try_cast("double").cast("string"), n))


def novel_numbers(text: Column, evidence: Column) -> Column:
    """Numbers of the text, as written, whose values the evidence lacks."""
    pattern = F.lit(r"([0-9]+(?:[.,][0-9]+)*)")
    seen = _keys(F.regexp_extract_all(F.coalesce(evidence, F.lit("")), pattern, 1))
    mine = F.regexp_extract_all(F.coalesce(text, F.lit("")), pattern, 1)
    return F.filter(mine, lambda n: ~F.array_contains(seen, _keys(F.array(n))[0]))


def cascade(encoder: Column, llm: Column, swapped: Column, novel: Column, lo: float = 0.005, hi: float = 0.8) -> Column:
    """The encoder's score where it is sure, else the large model's; a unit swap is 0."""
    return F.when(swapped, 0.0).when(novel, llm).when((encoder < lo) | (encoder >= hi), encoder).otherwise(llm)


def vcr(source_exist: Column, source_match: Column, alcoa: Column, halluc: Column) -> Column:
    """Weighted verification score, rounded half-even to four places."""
    w = VCR_WEIGHTS
    s = w["source_exist"] * source_exist + w["source_match"] * source_match + w["alcoa"] * alcoa + w["halluc"] * (1 - halluc)
    return F.bround(s, 4)


def decision(score: Column, threshold: Column, sentences_ok: Column, findings: Column, regenerations: Column, most: int = 3) -> Column:
    passed = (score >= threshold) & sentences_ok & (F.size(findings) == 0)
    return F.when(passed, "pass").when(regenerations < most, "regen").otherwise("block")


def year_similarity(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d == 0, 1.0).when(d == 1, 0.5).otherwise(0.0)


def metadata_score(title: Column, author: Column, year: Column) -> Column:
    """Mean of the similarities that are not null, weighted 0.6, 0.3 and 0.1."""
    parts = ((0.6, title), (0.3, author), (0.1, year))
    total = sum((F.when(c.isNotNull(), w).otherwise(0.0) for w, c in parts), F.lit(0.0))
    return F.when(total > 0, sum((F.coalesce(c * w, F.lit(0.0)) for w, c in parts), F.lit(0.0)) / total).otherwise(0.0)


def verdict(parse: Column) -> Column:
    """First of the words support, neutral, contradict in an answer: 1, 0.5 or 0; none of them: 0.5."""
    u = F.upper(parse)
    return F.when(u.contains("SUPPORT"), 1.0).when(u.contains("NEUTRAL"), 0.5).when(u.contains("CONTRADICT"), 0.0).otherwise(0.5)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a proportion; (0, 0) where n is 0."""
    p = k / n
    centre, d = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = lambda c: F.when(n > 0, c / d).otherwise(0.0)
    return bound(centre - half), bound(centre + half)


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact p of discordant counts, at most 1."""
    n, k = b + c, F.least(b, c)
    # one pass: the logarithm of a binomial coefficient follows from the one before
    start = F.struct(F.lit(0.0).alias("log"), F.exp(-n * F.ln(F.lit(2.0))).alias("sum"))
    step = lambda acc, i: (new := acc["log"] + F.ln((n - i + 1) / i), F.struct(new.alias("log"), (acc["sum"] + F.exp(new - n * F.ln(F.lit(2.0)))).alias("sum")))[1]
    more = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(more, start, step, lambda acc: acc["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def tamper_number(sentence: Column, pattern: str = r"([0-9]+(?:\.[0-9]+)?)") -> Column:
    """The first number clearly changed; null where there is none."""
    n = F.regexp_extract(sentence, pattern, 1)
    at = F.call_function("instr", sentence, n)
    v = n.try_cast("double")
    half = F.regexp_replace(F.format_string("%.2f", F.bround(v * 0.5 + 1.0, 2)), r"\.?0+$", "")
    whole = n.try_cast("bigint")
    moved = F.when(whole < 50, whole + 20).otherwise(F.greatest(F.lit(1).cast("bigint"), F.floor(whole / 2)))
    new = F.when(n.contains("."), half).otherwise(moved.cast("string"))
    new = F.when(new == n, F.concat(n, F.lit("9"))).otherwise(new)
    return F.when(n != "", F.concat(F.substring(sentence, F.lit(1), at - 1), new, F.substring(sentence, at + F.length(n), F.length(sentence))))
