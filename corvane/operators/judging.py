"""Triage, judged sentences, consensus of several judges, citation verification against a registry."""

from __future__ import annotations

import difflib
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions.scores import metadata_score, year_similarity
from ..functions.text import count_of, normalised_title

# Marks of laboratory notes and of citations.
NOTE_MARKS = (r"과제\s*(?:명|번호)", r"연구자|작성자", r"점검자|입회자|확인자", r"실험\s*일|기록\s*일", r"실험\s*목적", r"재료\s*(?:및|와)?\s*방법", r"실험\s*결과", r"고\s*찰|차기\s*계획")
CITE_MARKS = (
    r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+", r"references?|참고\s*문헌|인용\s*문헌", r"[A-Z][A-Za-z]+\s+et\s+al\.?,?\s*\(?\d{4}",
    r"[가-힣]{2,4}\s*(?:외|등)\s*[,]?\s*\(?\d{4}", r"\[\d{1,3}\]",
)

#: Records that a fuzzy search takes, as its reference does; rows of a block of citations and of titles.
NEAREST, CITE_BLOCK, TITLE_BLOCK = 5, 64, 1000


def use_triage(text: Column) -> Column:
    hits = lambda marks, flag: sum((text.rlike(flag + m).cast("int") for m in marks), F.lit(0))
    lines = F.split(text, "\r\n|\n|\r")
    short = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*\S{0,12}\s*$"))) / F.size(lines)
    hangul, latin = count_of(text, "가-힣"), count_of(text, "A-Za-z")
    korean = hangul / F.greatest(F.lit(1), hangul + latin)
    out = F.when(F.length(F.trim(text)) < 200, "low_value").when(hits(NOTE_MARKS, "") >= 4, "labnote_like").when(hits(CITE_MARKS, "(?i)") >= 2, "cited")
    return out.when(short > 0.6, "tabular").when(korean >= 0.4, "korean_prose").otherwise("low_value")


def passed(sentences: Column, threshold: float = 0.5) -> Column:
    """Whether every judged sentence is supported; none: not."""
    return (F.size(sentences) > 0) & F.forall(sentences, lambda s: s >= threshold)


def line_consensus(votes: Column, judges: int, threshold: float = 0.5) -> Column:
    """votes: for each line, the judges' scores; each line needs all of them, or all but one of more than three."""
    need = judges - 1 if judges > 3 else judges
    return (F.size(votes) > 0) & F.forall(votes, lambda line: F.size(F.filter(line, lambda s: s >= threshold)) >= need)


def consensus(scores: Column, thresholds: list[float]) -> Column:
    """entail if all judges reach their thresholds, neutral if fewer than half do, else null."""
    ok = F.size(F.filter(F.zip_with(scores, F.array(*[F.lit(t) for t in thresholds]), lambda s, t: s >= t), lambda x: x))
    return F.when(ok == len(thresholds), "entail").when(ok * 2 < len(thresholds), "neutral")


def unsupported(rows: DataFrame, key: list[str], sentences: Column, windows: Column, score, threshold: float) -> DataFrame:
    """key, sentence (its place), best: sentences that no window supports."""
    s = rows.select(*key, windows.alias("w"), F.posexplode(sentences).alias("sentence", "s")).where("s <> ''")
    s = s.select(*key, "sentence", "s", F.explode("w").alias("w"))
    best = s.select(*key, "sentence", score(F.col("w"), F.col("s")).alias("x")).groupBy(*key, "sentence").agg(F.max("x").alias("best"))
    return best.where(F.col("best") < threshold)


def similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks; 0 if either is empty."""

    @F.pandas_udf(DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() if p and q else 0.0 for p, q in zip(x, y)])

    return run(a, b)


def _nearest(cited: list[str], titles: list[str], places: list[int], most: int) -> list[tuple[int, int, float]]:
    """Citation's index, title's index, ratio (above 0) of each citation's nearest titles; of equal ones the first places."""
    best: list[list[tuple[float, int, int]]] = [[] for _ in cited]
    m = difflib.SequenceMatcher()
    for j, t in enumerate(titles):
        m.set_seq2(t)
        for i, c in enumerate(cited):
            m.set_seq1(c)
            least = best[i][0][0] if len(best[i]) == most else 0.0
            if m.real_quick_ratio() >= least and m.quick_ratio() >= least and (x := m.ratio()) > 0:
                (heapq.heappush if len(best[i]) < most else heapq.heappushpop)(best[i], (x, -places[j], j))
    return [(i, j, x) for i, b in enumerate(best) for x, _, j in b]


def nearest_titles(cited: DataFrame, records: DataFrame, most: int = NEAREST) -> DataFrame:
    """id, year, ry2, ratio of the records (rt2, ry2, position) whose titles are nearest to a citation's (id, _t, year).

    Blocks of citations meet blocks of titles, so that every title is compared:
    with equal years a ratio of 0.65 makes 0.70 in all, and such titles need not
    share any two neighbouring characters, so no index of n-grams is exact.
    Bounds by length and by counts of characters spare most exact ratios.
    """
    r = records.withColumn("_k", F.row_number().over(Window.partitionBy("rt2").orderBy("position"))).where(F.col("_k") <= most)  # later records of a title are not among the nearest

    def blocks(df: DataFrame, name: str, size: int, cols: list[str]) -> DataFrame:
        b = F.pmod(F.xxhash64(*cols), F.lit(-(-df.count() // size) or 1))
        return df.groupBy(b.alias("_b")).agg(F.collect_list(F.struct(*cols)).alias(name)).drop("_b")

    @F.pandas_udf("array<struct<i:int,j:int,x:double>>")
    def run(c: pd.Series, t: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([[{"i": i, "j": j, "x": x} for i, j, x in _nearest(list(a), list(b), list(q), most)] for a, b, q in zip(c, t, p)])

    pairs = blocks(cited, "c", CITE_BLOCK, ["id", "_t", "year"]).crossJoin(blocks(r, "r", TITLE_BLOCK, ["rt2", "ry2", "position"]))
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few rows with much work each
    pairs = pairs.withColumn("hits", run(F.col("c._t"), F.col("r.rt2"), F.col("r.position")))
    got = lambda h: F.struct(
        F.get("c", h["i"])["id"].alias("id"), F.get("c", h["i"])["year"].alias("year"), F.get("r", h["j"])["ry2"].alias("ry2"),
        F.get("r", h["j"])["position"].alias("position"), h["x"].alias("ratio"),
    )
    w = Window.partitionBy("id").orderBy(F.desc("ratio"), "position")
    return pairs.select(F.inline(F.transform("hits", got))).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k", "position")


def verify_citations(citations: DataFrame, registry: DataFrame) -> DataFrame:
    """id, status, score of citations (id, doi, title, year) against a registry (doi, title, year, position).

    A DOI's last record counts. Where it is missing, the last record of the
    equal normalised title decides, and without one the best of the NEAREST
    records by title in the whole registry; nothing to go by: unverified.
    """
    w = Window.partitionBy(F.lower("doi")).orderBy(F.desc("position"))
    by_doi = registry.where("doi is not null").withColumn("_k", F.row_number().over(w)).where("_k = 1")
    by_doi = by_doi.select(F.lower("doi").alias("rd"), F.col("title").alias("rt"), F.col("year").alias("ry"))
    c = citations.withColumn("_d", F.lower("doi")).withColumn("_t", normalised_title(F.coalesce("title", F.lit(""))))
    hit = c.join(by_doi, c["_d"] == by_doi["rd"], "left")
    title = F.when((F.col("_t") != "") & F.col("rt").isNotNull(), similarity(F.col("_t"), normalised_title(F.col("rt"))))
    year = F.when(F.col("year").isNotNull() & F.col("ry").isNotNull(), year_similarity(F.col("year"), F.col("ry")))
    hit = hit.withColumn("exact", F.when(F.col("rd").isNotNull(), F.when((title.isNull()) & year.isNull(), 1.0).otherwise(metadata_score(title, F.lit(None).cast("double"), year))))
    r = registry.select(normalised_title(F.coalesce("title", F.lit(""))).alias("rt2"), F.col("year").alias("ry2"), "position").where("rt2 <> ''")
    last = r.withColumn("_k", F.row_number().over(Window.partitionBy("rt2").orderBy(F.desc("position")))).where("_k = 1")
    miss = hit.where("exact is null and _t <> ''").select("id", "_t", "year")
    found = miss.join(last.select("rt2", "ry2"), miss["_t"] == last["rt2"], "left")
    equal = found.where("rt2 is not null").select("id", "year", "ry2", F.lit(1.0).alias("ratio"))
    near = equal.unionByName(nearest_titles(found.where("rt2 is null").select("id", "_t", "year"), r))
    y2 = F.when(F.col("year").isNotNull() & F.col("ry2").isNotNull(), year_similarity(F.col("year"), F.col("ry2")))
    near = near.groupBy("id").agg(F.max(metadata_score(F.col("ratio"), F.lit(None).cast("double"), y2)).alias("fuzzy"))
    got = hit.select("id", "_d", "_t", "exact").join(near, "id", "left")
    score = F.coalesce("exact", "fuzzy", F.lit(0.0))
    status = (
        F.when(score >= 0.92, "valid").when(F.col("exact").isNotNull() | (score >= 0.70), "partially_valid")
        .when(F.col("_d").isNotNull() | (F.col("_t") != ""), "hallucinated").otherwise("unverified")
    )
    return got.select("id", status.alias("status"), score.alias("score"))


def surname(author: Column) -> Column:
    """Of "Alam, W.", "W. Alam" or "Alam", in lower case."""
    return F.lower(F.trim(F.when(author.contains(","), F.substring_index(author, ",", 1)).otherwise(F.substring_index(F.trim(author), " ", -1))))


def author_similarity(claimed: Column, author: Column) -> Column:
    """1 for equal surnames, else the ratio of their matching blocks; 0 where one is missing. claimed: as cited, such as "Kim et al."."""
    c = F.substring_index(F.trim(F.replace(normalised_title(F.coalesce(claimed, F.lit(""))), F.lit(" et al"), F.lit(""))), " ", 1)
    r = F.coalesce(surname(author), F.lit(""))
    return F.when((c == "") | (r == ""), 0.0).when(c == r, 1.0).otherwise(similarity(c, r))


def metadata_mismatches(title: Column, author: Column, year: Column) -> Column:
    """The fields whose similarities, where known, are too low."""
    return F.array_compact(F.array(F.when(title < 0.85, F.lit("title")), F.when(author < 0.85, F.lit("author")), F.when(year < 1.0, F.lit("year"))))


def stratum(source: Column, text: Column, own: Column, others: Column) -> Column:
    """source, form of the line, verdict of one judge and of two others (number of passes), as one label."""
    form = F.when(text.rlike(r"^[-•*\d.\s]*([^:：]{1,40})[:：]\s*(\S.*)$"), "kv").otherwise("prose")
    return F.concat_ws("/", source, form, F.when(own, "phi+").otherwise("phi-"), F.when(others == 0, "oth-").when(others == 1, "split").otherwise("oth+"))
