"""From a text to a decision: citations, their match with the sources, invented ones, the verification score, and fitted entailment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import integrity as I
from ..functions import scores as S
from ..functions import text as T
from ..functions.citations import cited
from .evaluation import idf

PENALTY = {"valid": 0.0, "partially_valid": 0.5, "hallucinated": 1.0}


def fitted_idf(corpus: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Token weights of a corpus, and the one-row weight of a token that it lacks."""
    default = corpus.agg((F.ln(F.greatest(F.count("*"), F.lit(1)) + 1.0) + 1).alias("unseen"))
    return idf(corpus, T.nli_tokens(F.coalesce(text, F.lit("")))).select("token", "idf"), default


def fitted_entailment(pairs: DataFrame, key: list[str], weights: tuple[DataFrame, DataFrame], premise: str = "premise", hypothesis: str = "hypothesis") -> DataFrame:
    """key, score: cosine of the token sets, each token weighted by its idf, less where polarities conflict.

    The tokens of a pair go to their weights and their sums come back; Spark
    broadcasts the weights while they are small and joins by token beyond.
    """
    idf_, default = weights
    p, h = T.nli_tokens(F.coalesce(premise, F.lit(""))), T.nli_tokens(F.coalesce(hypothesis, F.lit("")))
    rows = pairs.select(*key, p.alias("p"), h.alias("h"))
    kinds = ((F.array_intersect("p", "h"), True, True), (F.array_except("p", "h"), True, False), (F.array_except("h", "p"), False, True))
    each = [F.transform(s, lambda t: F.struct(t.alias("token"), F.lit(a).alias("in_p"), F.lit(b).alias("in_h"))) for s, a, b in kinds]
    rows = rows.select(*key, S.polarity_conflict(F.col("p"), F.col("h")).alias("conflict"), F.concat(*each).alias("each"))
    rows = rows.select(*key, "conflict", F.explode_outer("each").alias("t")).select(*key, "conflict", "t.*")  # what is made beside an explode is made for each of its rows
    w = rows.join(idf_, "token", "left").join(F.broadcast(default)).withColumn("w2", F.pow(F.coalesce("idf", "unseen"), 2))  # default: one row
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("w2"))), F.lit(0.0))
    g = w.groupBy(*key).agg(part(F.col("in_p") & F.col("in_h")).alias("dot"), part(F.col("in_p")).alias("np"), part(F.col("in_h")).alias("nh"), F.bool_or("conflict").alias("conflict"))
    score = F.when((F.col("dot") > 0), F.col("dot") / F.sqrt(F.col("np") * F.col("nh"))).otherwise(0.0)
    return g.select(*key, (score * F.when(F.col("conflict"), S.POLARITY_FACTOR).otherwise(1.0)).alias("score"))


def source_match(claims: Column, grounding: Column, nli=S.entailment) -> Column:
    """Mean over citations of the best entailment of their claims by a source; no citations: 0; no sources: 0.5."""
    best = F.transform(claims, lambda c: F.coalesce(F.array_max(F.transform(grounding, lambda g: nli(g, c))), F.lit(0.0)))
    mean = F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(claims)
    return F.when(F.size(claims) == 0, 0.0).when(F.size(grounding) == 0, 0.5).otherwise(mean)


def invented(cites: Column, grounding: Column, known: Column) -> Column:
    """Share of checkable citations that are false: with a DOI that no registry knows, or a title of whose words no source has any.

    known: array of the text's DOIs that a registry knows; null: there is no registry.
    """
    words = T.match_tokens(F.array_join(grounding, " "))
    by_doi = lambda c: c["doi"].isNotNull() & known.isNotNull()
    by_title = lambda c: c["title"].isNotNull() & (F.size(grounding) > 0)
    titled = lambda c: T.match_tokens(c["title"])
    checkable = F.filter(cites, lambda c: by_doi(c) | by_title(c))
    bad = F.filter(checkable, lambda c: F.when(by_doi(c), ~F.array_contains(known, c["doi"])).otherwise((F.size(titled(c)) > 0) & ~F.arrays_overlap(titled(c), words)))
    return F.when(F.size(checkable) > 0, F.size(bad) / F.size(checkable)).otherwise(0.0)


def penalty(statuses: Column) -> Column:
    """Mean penalty of verified citations; null if none could be verified, 0 without citations."""
    known = F.filter(statuses, lambda s: s.isin(*PENALTY))
    worth = F.transform(known, lambda s: F.when(s == "valid", 0.0).when(s == "partially_valid", 0.5).otherwise(1.0))
    return F.when(F.size(statuses) == 0, 0.0).when(F.size(known) > 0, F.aggregate(worth, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def known_dois(rows: DataFrame, key: str, cites: str, registry: DataFrame, doi: str = "doi") -> DataFrame:
    """rows with known: the array of their DOIs that the registry has."""
    each = rows.select(key, F.explode(F.col(f"{cites}.doi")).alias("_doi")).where("_doi is not null")
    hit = each.join(registry.select(F.col(doi).alias("_doi")).distinct(), "_doi").groupBy(key).agg(F.collect_set("_doi").alias("known"))
    return rows.join(hit, key, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def score(rows: DataFrame, key: str, registry: DataFrame | None = None, response: str = "response", grounding: str = "grounding", model: str = "model_id", statuses: str | None = None) -> DataFrame:
    """rows with source_exist, source_match, alcoa, halluc (each rounded half-even to four places) and vcr.

    statuses: array of verified citations' statuses, which count before the heuristic.
    """
    text = F.coalesce(response, F.lit(""))
    d = rows.withColumn("_c", cited(F.col(response)))
    d = d.withColumn("_cites", F.col("_c.cites"))
    d = known_dois(d, key, "_cites", registry) if registry is not None else d.withColumn("known", F.lit(None).cast("array<string>"))
    g = F.coalesce(grounding, F.array().cast("array<string>"))
    evidence = F.array_join(g, " ")
    ab = invented(F.col("_cites"), g, F.col("known"))
    if statuses:
        ab = F.coalesce(penalty(F.col(statuses)), ab)
    model_known = F.coalesce(F.col(model), F.lit("unknown")) != "unknown"
    ha = I.halluc(ab, F.when(F.size(g) > 0, I.changed_numbers(text, evidence)).otherwise(0.0), (F.size(g) > 0) & (F.size(S.unit_swaps(text, evidence)) > 0))
    parts = {
        "_se": F.when(F.size("_cites") > 0, F.col("_c.covered")).otherwise(0.0), "_sm": source_match(F.col("_c.claims"), g),
        "_al": I.alcoa(text, model_known & (F.col(model) != ""), F.lit(True)), "_ha": ha,
    }
    d = d.withColumns(parts)
    v = S.vcr(F.col("_se"), F.col("_sm"), F.col("_al"), F.col("_ha"))
    out = {"source_exist": "_se", "source_match": "_sm", "alcoa": "_al", "halluc": "_ha"}
    return d.withColumns({k: F.bround(c, 4) for k, c in out.items()} | {"vcr": v}).drop("_c", "_cites", "known", *parts)


def unsupported_sentences(rows: DataFrame, key: list[str], threshold: float, response: str = "response", grounding: str = "grounding", nli=S.entailment) -> DataFrame:
    """key, sentence, text, score of the sentences that no window of any source supports; without sources nothing is checked."""
    from ..functions.claims import windows

    chunks = F.flatten(F.transform(F.coalesce(grounding, F.array().cast("array<string>")), windows))
    s = rows.where(F.size(grounding) > 0).select(*key, chunks.alias("w"), F.posexplode(T.gate_sentences(F.coalesce(response, F.lit("")))).alias("sentence", "text"))
    best = F.array_max(F.transform("w", lambda w: nli(w, F.col("text"))))
    return s.select(*key, "sentence", "text", F.bround(best, 4).alias("score"), best.alias("_x")).where(F.col("_x") < threshold).drop("_x")


def decide(scored: DataFrame, unsupported: DataFrame | None, key: str, theta: float = 0.60, most: int = 3, findings: str | None = None, regenerations: str | None = None) -> DataFrame:
    """scored with sentences (unsupported ones) and decision."""
    if unsupported is not None:
        n = unsupported.groupBy(key).agg(F.count("*").alias("sentences"))
        scored = scored.join(n, key, "left").withColumn("sentences", F.coalesce("sentences", F.lit(0)))
    else:
        scored = scored.withColumn("sentences", F.lit(0).cast("bigint"))
    f = F.col(findings) if findings else F.array().cast("array<string>")
    r = F.col(regenerations) if regenerations else F.lit(0)
    return scored.withColumn("decision", S.decision(F.col("vcr"), F.lit(theta), F.col("sentences") == 0, f, r, most))


def citation_accuracy(rows: DataFrame, key: str, cited_dois: str, source_dois: str, registry: DataFrame, doi: str = "doi") -> DataFrame:
    """One row: cited, in_sources, resolvable, accurate (both), accuracy (null if nothing is cited); cases do not count among the sources."""
    sources = F.transform(F.coalesce(source_dois, F.array().cast("array<string>")), F.lower)
    each = rows.select(key, sources.alias("_s"), F.explode(cited_dois).alias("_d"))
    known = registry.select(F.col(doi).alias("_d")).distinct().withColumn("_known", F.lit(True))
    each = each.join(known, "_d", "left").select(F.array_contains("_s", F.lower("_d")).alias("s"), F.col("_known").isNotNull().alias("r"))
    g = each.agg(F.count("*").alias("cited"), F.count_if("s").alias("in_sources"), F.count_if("r").alias("resolvable"), F.count_if(F.col("s") & F.col("r")).alias("accurate"))
    return g.withColumn("accuracy", F.when(F.col("cited") > 0, F.col("accurate") / F.col("cited")))


def feedback(scored: DataFrame, sentences: str = "unsupported", unknown: str = "unknown_dois", cited_: str = "n_cited") -> DataFrame:
    """scored with feedback: an ordered list of what to mend, or that sources and answer match too little.

    sentences and unknown are arrays of strings; cited_ is the number of citations.
    """
    none = F.array().cast("array<string>")
    told = F.concat(
        F.transform(F.coalesce(sentences, none), lambda s: F.concat(F.lit("- unsupported sentence: "), s)), F.transform(F.coalesce(unknown, none), lambda d: F.concat(F.lit("- DOI not among the sources: "), d)),
        F.array_compact(F.array(
            F.when(F.col(cited_) == 0, "- no citation"), F.when(F.col("source_exist") < 0.6, F.format_string("- too few sources (%.2f)", "source_exist")),
            F.when(F.col("halluc") > 0.3, F.format_string("- numbers or citations without a source (%.2f)", "halluc")), F.when(F.col("alcoa") < 0.6, F.format_string("- unfinished or without units (%.2f)", "alcoa")),
        )),
    )
    weak = F.array(F.format_string("- sources and answer match little (%.2f)", "source_match"))
    return scored.withColumn("feedback", F.when(F.size(told) > 0, told).otherwise(weak))
