"""Quality gate, duplicates and samples over tables of texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.patterns import quick
from ..functions.text import letter_ratio, squeeze
from ..storage import written
from .order import placed

# Marks of people, of health, of safety events, of diseases near clinical verbs, of other subjects; bounded quantities.
SUBJECT = (
    r"환자|피험자|대상자|참여자|수진자|내담자|아동|영아|유아|소아|신생아|남아|여아|아이(?:가|는|의|에게|들)|"
    r"\d{1,2}\s*세(?![대기트])\s*(?:남|여|아동|환자)?|\d{1,2}\s*개월\s*(?:된|아|영아)|"
    r"(?:남|여)성\s*\d{1,2}\s*세"
)
SUBJECT_LATIN = r"patient|subject\s*\d|participant|child(?:ren)?\b"
HEALTH = (
    r"진단|병력|증상|질환|질병|투약|투여|처방|복용|수술|입원|외래|재활|치료|청력|난청|언어\s*발달|발달\s*(?:평가|지연|검사)|인지\s*(?:검사|기능)|"
    r"검체|조직\s*검사|병리|통증|요통|부상|종양|암\s*(?:진단|환자|조직|병기|재발)|(?:폐|위|간|유방|대장|갑상선|췌장|전립선|자궁경부)암|"
    r"혈압|혈당|체중\s*감소"
)
HEALTH_LATIN = r"BMI|diagnos|symptom|medical history|treatment"
ADVERSE = r"부작용|이상\s*반응|이상\s*사례|중대한\s*이상"
ADVERSE_LATIN = r"adverse\s+event|side\s+effect|\bSAE\b"
#: For each Latin pattern, plain strings of which a match holds one.
STEMS = {
    SUBJECT_LATIN: ("patient", "subject", "participant", "child"),
    HEALTH_LATIN: ("bmi", "diagnos", "symptom", "medical history", "treatment"),
    ADVERSE_LATIN: ("adverse", "side", "sae"),
}
DISEASE = (
    r"당뇨|고혈압|고지혈증|천식|우울증|공황\s*장애|불안\s*장애|조현병|치매|뇌졸중|심근경색|협심증|"
    r"간염|결핵|아토피|ADHD|자폐|파킨슨|알츠하이머|관절염|디스크"
)
CLINICAL = rf"(?:{DISEASE})[^.\n]{{0,15}}?(?:진단|투약|처방|복용|입원|수술|병력)|(?:진단|병력)[^.\n]{{0,8}}?(?:{DISEASE})"
NONHUMAN = (
    r"마우스|생쥐|랫드|래트|동물|세포|모델|유발|치료제|후보\s*물질|신약|in\s*vitro|키트|"
    r"진단\s*(?:기기|용|시약|기술|장비|모니터링)|\bmice\b|\bmouse\b|\brats?\b|\bcells?\b"
)
NUMBER = r"(\d{1,5}(?:[.,]\d+)?)"
BOUNDED = {
    "pH": (rf"pH\s*(?:값)?\s*[:=]?\s*{NUMBER}", 0, 14),
    "순도": (rf"(?:순도|purity)\s*[:=]?\s*{NUMBER}\s*%", 0, 100),
    "함량": (rf"(?:함량|함유량|content)\s*[:=]?\s*{NUMBER}\s*%", 0, 100),
    "습도": (rf"(?:습도|humidity|\bRH\b)\s*[:=]?\s*{NUMBER}\s*%", 0, 100),
    "수율": (rf"(?:수율|yield)\s*[:=]?\s*{NUMBER}\s*%", 0, 100),
}
MIN_CHARS, MIN_LETTERS = 200, 0.30


def has(text: Column, hangul: str, latin: str | None = None) -> Column:
    """Whether either pattern occurs; each alternative of the first holds a Hangul letter, so other texts are not searched for it."""
    found = text.rlike("[가-힣]") & text.rlike(quick("(?i)" + hangul))
    if latin:
        low = F.lower(text)
        stem = reduce(or_, [low.contains(x) for x in STEMS[latin]])  # a plain search is much cheaper than the pattern
        found = (stem & text.rlike(quick("(?i)" + latin))) | found
    return F.coalesce(found, F.lit(False))


def _signs(text: Column) -> tuple[Column, Column, Column]:
    both = has(text, HEALTH, HEALTH_LATIN) & has(text, SUBJECT, SUBJECT_LATIN)
    clinical = has(text, CLINICAL) & ~text.rlike(quick("(?i)" + NONHUMAN))
    return has(text, ADVERSE, ADVERSE_LATIN), both, clinical


def sensitive_signals(text: Column) -> Column:
    """adverse; subject_health where both marks stand; otherwise clinical, unless about other subjects."""
    adverse, both, clinical = _signs(text)
    return F.array_compact(F.array(F.when(adverse, F.lit("adverse")), F.when(both, "subject_health").when(clinical, "clinical")))


def is_sensitive(text: Column) -> Column:
    """Whether a text has any of these signals; the first that stands settles it."""
    return F.coalesce(reduce(or_, _signs(text)), F.lit(False))


def bounded_violations(text: Column) -> Column:
    """Names of the quantities of which a value lies outside its bounds."""
    out = []
    for name, (pattern, lo, hi) in BOUNDED.items():
        v = F.transform(F.regexp_extract_all(text, F.lit(quick("(?i)" + pattern)), 1), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))
        out.append(F.when(F.exists(v, lambda x: (x < lo) | (x > hi)), F.lit(name)))
    return F.array_compact(F.array(*out))


def gate(
    docs: DataFrame, sensitive: Column | None = None, paper: Column | None = None, min_chars: int = MIN_CHARS, min_letters: float = MIN_LETTERS,
    carry: Sequence[str | Column] = (),
) -> DataFrame:
    """One row per row of docs: doc_id, the carried columns, and reason: paper, sensitive, too_short, low_letter, dup, or null for rows that pass.

    A duplicate is a later row (by doc_id, then by position) with the squeezed text of a row that nothing else stopped.
    Texts are read once; what they come to is written. First rows are then found by partial minima per text digest and
    joined by their position, so copies never meet in one task and repeated ids stay one row each.
    """
    text = F.coalesce("text", F.lit(""))
    norm = squeeze(text)
    blocked = is_sensitive(text) if sensitive is None else sensitive
    reason = F.when(F.lit(False) if paper is None else paper, "paper").when(blocked, "sensitive")
    reason = reason.when(F.length(norm) < min_chars, "too_short").when(letter_ratio(norm) < min_letters, "low_letter")
    kept = docs.select("doc_id", *carry).columns[1:]
    marked = docs.select("doc_id", *carry, reason.alias("reason"), F.sha2(norm, 256).alias("_digest"), F.monotonically_increasing_id().alias("_row"))
    marked = written(marked, "gate")
    firsts = marked.where("reason is null").groupBy("_digest").agg(F.min(F.struct("doc_id", "_row")).alias("f")).select("f._row", F.lit(True).alias("_first"))
    got = marked.join(firsts, "_row", "left")
    dup = F.col("reason").isNull() & F.col("_first").isNull()
    return got.select("doc_id", *kept, F.when(dup, "dup").otherwise(F.col("reason")).alias("reason"))


def gate_flagged(docs: DataFrame, **options) -> DataFrame:
    """Rows that pass the gate, with the names of their quantities out of bounds; a row with such names stays."""
    flags = bounded_violations(F.coalesce("text", F.lit(""))).alias("violations")
    return gate(docs, carry=[*options.pop("carry", ()), flags], **options).where("reason is null").drop("reason")


def hash_number(key: Column, salt: str = "") -> Column:
    """A number from the first 32 bits of an MD5, alike in other engines."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("bigint")


def hash_stride(rows: DataFrame, key: str, stride: int, residue: int = 0) -> DataFrame:
    """Rows whose key's hash has the residue: a document's rows go together, residues are disjoint."""
    return rows.where(hash_number(F.col(key)) % stride == residue)


def uniform_sample(rows: DataFrame, key: str, n: int, seed: str = "s") -> DataFrame:
    """n rows with the smallest seeded hashes: a top-n in each task, then one of those."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def stratified_sample(rows: DataFrame, stratum: str, key: str, quota: int, seed: str = "s") -> DataFrame:
    """At most quota rows of each stratum, with the population of theirs. Ranks beyond it are cut before the shuffle."""
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    ranked = rows.withColumn("pick", F.row_number().over(Window.partitionBy(stratum).orderBy(h, key))).where(F.col("pick") <= quota)
    return ranked.join(rows.groupBy(stratum).agg(F.count("*").alias("population")), stratum)


def quota_sample(rows: DataFrame, stratum: str, key: str, quota: int, total: int, seed: str = "s") -> DataFrame:
    """stratified_sample, filled up to total rows with the smallest hashes among the rest."""
    first = stratified_sample(rows, stratum, key, quota, seed).select(*rows.columns)
    short = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    rest = rows.join(first.select(key), key, "left_anti").orderBy(short, key).limit(total)
    both = first.withColumn("_refill", F.lit(0)).unionByName(rest.withColumn("_refill", F.lit(1)))
    return both.orderBy("_refill", short, key).limit(total).drop("_refill")


def held_out(rows: DataFrame, key: str, buckets: int = 20) -> DataFrame:
    return rows.withColumn("held", hash_number(F.col(key)) % buckets == 0)


def every_nth(rows: DataFrame, order: str | list[str], n: int) -> DataFrame:
    """Each n-th row in the order, from the first on; no task sees all rows."""
    return placed(rows, order, "every-nth").where(F.col("_place") % n == 0).drop("_place")


def shards(rows: DataFrame, key: str, n: int) -> DataFrame:
    """rows with shard: dealt in turn in the order of their key's digest."""
    return placed(rows, [F.sha2(F.col(key).cast("string"), 256), F.col(key)], "shards").withColumn("shard", (F.col("_place") % n).cast("int")).drop("_place")
