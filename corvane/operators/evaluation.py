"""Agreement, ranking and interval statistics over labelled rows.

Rows are reduced to counts per score, label or stratum first, so that windows
and sorts see distinct values alone and never a group's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import mcnemar, wilson
from .order import running


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def by_score(rows: DataFrame, score: str, label: str) -> DataFrame:
    """score, pos, neg: one row for each distinct score."""
    y = F.col(label) == 1
    return rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.sum(F.when(y, 1).otherwise(0)).cast("bigint").alias("pos"), F.sum(F.when(y, 0).otherwise(1)).cast("bigint").alias("neg")
    )


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """auc: share of (positive, negative) pairs in order, ties for one half; NaN without one of the classes."""
    c = running(by_score(rows, score, label), "score", "neg")
    t = c.withColumn("twice", F.col("pos") * (2 * F.col("up_neg") + F.col("neg")))
    t = t.agg(F.sum("twice").alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return t.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (2.0 * F.col("p") * F.col("n"))).otherwise(F.lit(float("nan"))).alias("auc"))


def prf(rows: DataFrame, predicted: Column, actual: Column, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and pass_rate; 0 where a denominator is 0."""
    g = rows.groupBy(*by).agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count("*").alias("n"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(
        *by, "tp", "fp", "fn", _safe(tp, tp + fp).alias("precision"), _safe(tp, tp + fn).alias("recall"),
        _safe(2 * tp, 2 * tp + fp + fn).alias("f1"), _safe(F.col("n") - tp - fp, F.col("n")).alias("pass_rate"),
    )


def best_threshold(rows: DataFrame, score: str, label: str) -> DataFrame:
    """The threshold (predict 1 at it and above) of the best accuracy, the least one of equals."""
    c = running(by_score(rows, score, label), "score", "pos", "neg")
    right = F.col("all_pos") - F.col("up_pos") + F.col("up_neg")
    t = c.select("score", (right / (F.col("all_pos") + F.col("all_neg"))).alias("accuracy"))
    return t.orderBy(F.desc("accuracy"), "score").limit(1).select(F.col("score").alias("threshold"), "accuracy")


def sweep(rows: DataFrame, score: str, label: str, thresholds: list) -> DataFrame:
    """prf for each threshold of a short list, in one pass: a row is flagged if its score is below."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    c = by_score(rows, score, label).withColumn("threshold", grid)
    flagged = F.col("score") < F.col("threshold")
    g = c.groupBy("threshold").agg(
        F.sum(F.when(flagged, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(flagged, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(flagged, 0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.col("pos") + F.col("neg")).alias("n"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(
        "threshold", _safe(tp, tp + fp).alias("precision"), _safe(tp, tp + fn).alias("recall"),
        _safe(2 * tp, 2 * tp + fp + fn).alias("f1"), _safe(F.col("n") - tp - fp, F.col("n")).alias("pass_rate"),
    )


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed, kappa of two raters; 1 where agreement by chance is certain."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    left = cells.groupBy(F.col("a").alias("k")).agg(F.sum("c").alias("l"))
    right = cells.groupBy(F.col("b").alias("k")).agg(F.sum("c").alias("r"))
    chance = left.join(right, "k").agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("lr"))
    same = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    t = same.join(F.broadcast(chance))  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("lr") / (F.col("n") * F.col("n"))
    return t.select("n", po.alias("observed"), F.when(F.col("lr") == F.col("n") * F.col("n"), 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def weighted_confusion(rows: DataFrame, stratum: str, population: str, predicted: Column, actual: Column) -> DataFrame:
    """Accuracy, precision and recall as of the population: a stratum's rows weigh population / sampled."""
    g = rows.groupBy(stratum).agg(
        F.max(population).alias("pop"), F.count("*").alias("n"), F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"),
    )
    w = F.col("pop") / F.col("n")
    t = g.agg(*[F.sum(w * F.col(c)).alias(c) for c in ("tp", "fp", "fn", "tn")], F.sum(F.col("tp") + F.col("tn")).alias("right"), F.sum("n").alias("n"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return t.select(
        _safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), _safe(tp, tp + fp).alias("precision"), _safe(tp, tp + fn).alias("recall"),
        _safe(fn, tp + fn).alias("false_reject"), _safe(fp, fp + tn).alias("false_accept"), _safe(F.col("right"), F.col("n")).alias("raw_accuracy"),
    )


def prevalence(corpus: DataFrame, sample: DataFrame, predicted: str, gold: str) -> DataFrame:
    """gold, share and margin: corpus shares of predictions turned into shares of gold by the sample's confusions.

    A prediction that the sample lacks stands for itself.
    """
    shares = corpus.groupBy(F.col(predicted).alias("p")).agg(F.count("*").alias("c"))
    total = corpus.agg(F.count("*").alias("total"))
    cells = sample.groupBy(F.col(predicted).alias("p"), F.col(gold).alias("g")).agg(F.count("*").alias("k"))
    per = cells.groupBy("p").agg(F.sum("k").alias("n"))
    t = shares.join(per, "p", "left").join(cells, "p", "left").join(F.broadcast(total))  # total: one row
    w, q = F.col("c") / F.col("total"), F.coalesce(F.col("k") / F.col("n"), F.lit(1.0))
    t = t.select(F.coalesce("g", "p").alias("gold"), (w * q).alias("x"), F.coalesce(w * w * q * (1 - q) / F.col("n"), F.lit(0.0)).alias("v"))
    return t.groupBy("gold").agg(F.sum("x").alias("share"), (1.96 * F.sqrt(F.sum("v"))).alias("margin"))


def rates(rows: DataFrame, passed: Column, *by: str) -> DataFrame:
    """n, passed, rate and its Wilson interval for each group."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(passed).alias("passed"))
    lo, hi = wilson(F.col("passed"), F.col("n"))
    return g.select(*by, "n", "passed", _safe(F.col("passed"), F.col("n")).alias("rate"), lo.alias("low"), hi.alias("high"))


def paired(a: DataFrame, b: DataFrame, key: str, passed: str) -> DataFrame:
    """Passes of two runs over the same keys (of repeated keys any pass counts), and McNemar's exact p."""
    one = lambda df, name: df.groupBy(key).agg(F.max(F.col(passed).cast("int")).alias(name))
    t = one(a, "x").join(one(b, "y"), key).agg(
        F.count("*").alias("n"), F.sum("x").alias("a"), F.sum("y").alias("b"),
        F.count_if((F.col("x") == 1) & (F.col("y") == 0)).alias("a_only"), F.count_if((F.col("x") == 0) & (F.col("y") == 1)).alias("b_only"),
    )
    return t.select("n", _safe(F.col("a"), F.col("n")).alias("a"), _safe(F.col("b"), F.col("n")).alias("b"), "a_only", "b_only", mcnemar(F.col("a_only"), F.col("b_only")).alias("p"))


def concentration(rows: DataFrame, key: str, tops: tuple = (1, 5, 10)) -> DataFrame:
    """Shares of the largest keys and the Gini coefficient of rows per key."""
    per = rows.groupBy(key).agg(F.count("*").alias("n"))
    # keys of equal size are alike: one row for each size
    sizes = per.groupBy("n").agg(F.count("*").alias("k"))
    down = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("larger", F.coalesce(F.sum("k").over(down), F.lit(0))).withColumn("smaller", F.coalesce(F.sum("k").over(up), F.lit(0)))
    k, n = F.col("k"), F.col("n")
    top = [F.sum(n * F.greatest(F.lit(0), F.least(k, F.lit(t) - F.col("larger")))).alias(f"t{t}") for t in tops]
    rank_sum = n * (k * F.col("smaller") + k * (k + 1) / 2)  # of n over its ranks from 1
    g = s.agg(F.sum(k).alias("keys"), F.sum(n * k).alias("rows"), F.sum(rank_sum).alias("ranked"), *top)
    gini = 2 * F.col("ranked") / (F.col("keys") * F.col("rows")) - (F.col("keys") + 1) / F.col("keys")
    return g.select("keys", "rows", *[(F.col(f"t{t}") / F.col("rows")).alias(f"top{t}_share") for t in tops], gini.alias("gini"))


def upper_quantile(rows: DataFrame, value: str, *by: str, q: float = 0.5) -> DataFrame:
    """The element at place floor(q n) of each group's sorted values, from counts of distinct values; and n."""
    c = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    c = c.withColumn("end", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.join(c.groupBy(*by).agg(F.sum("c").alias("n")), list(by))
    at = F.least(F.floor(F.col("n") * q), F.col("n") - 1)
    return c.where(F.col("end") > at).groupBy(*by).agg(F.min(value).alias("quantile"), F.max("n").alias("n"))


def surface_leak(rows: DataFrame, label: str, *buckets: str) -> DataFrame:
    """Accuracy of guessing each bucket's most frequent label."""
    c = rows.groupBy(*buckets, label).agg(F.count("*").alias("c"))
    m = c.groupBy(*buckets).agg(F.max("c").alias("m"), F.sum("c").alias("n"))
    return m.agg((F.sum("m") / F.sum("n")).alias("leak"))


def idf(rows: DataFrame, tokens: Column) -> DataFrame:
    """token, df and smoothed inverse document frequency over rows' token sets."""
    n = rows.agg(F.count("*").alias("n"))
    df = rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("token", "df", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # n: one row


def cluster_bootstrap(rows: DataFrame, cluster: str, difference: str, replicates: int = 2000, seed: str = "b") -> DataFrame:
    """mean, low, high: 95 % interval of a mean difference when clusters are drawn again, by seeded Poisson weights.

    Clusters are summed first; each replicate's weight of a cluster comes from a
    hash, so that reruns agree and no task needs another's draws.
    """
    per = rows.groupBy(cluster).agg(F.sum(difference).alias("s"), F.count("*").alias("n"))
    each = per.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("r").cast("string"), F.lit(":"), F.col(cluster).cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    weight, total, term = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(12):  # Poisson(1) by its distribution function
        total += term
        term /= k + 1
        weight = weight + F.when(h > total, 1).otherwise(0)
    reps = each.withColumn("w", weight).groupBy("r").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    t = reps.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return per.agg((F.sum("s") / F.sum("n")).alias("mean")).join(F.broadcast(t))  # one row each


def grid_search(rows: DataFrame, encoder: str, llm: str, label: str, lows: list[float], highs: list[float], theta: float = 0.5, least_pass: float = 0.9) -> DataFrame:
    """lo, hi, f1, calls, pass_rate of the cascade with the best (f1, fewest calls) among those that pass enough true rows.

    Positive rows (label 0: unsupported) are flagged below theta. The grid is a short list.
    """
    grid = [(lo, hi) for lo in lows for hi in highs if lo < hi]
    g = F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in grid]))
    r = rows.select(encoder, llm, label, g.alias("g")).select("*", "g.lo", "g.hi")
    asked = (F.col(encoder) >= F.col("lo")) & (F.col(encoder) < F.col("hi"))
    flagged = F.when(asked, F.col(llm)).otherwise(F.col(encoder)) < theta
    wrong = F.col(label) == 0
    t = r.groupBy("lo", "hi").agg(
        F.count_if(flagged & wrong).alias("tp"), F.count_if(flagged & ~wrong).alias("fp"), F.count_if(~flagged & wrong).alias("fn"),
        F.count_if(~flagged & ~wrong).alias("tn"), F.count_if(asked).alias("calls"),
    )
    t = t.select(
        "lo", "hi", "calls", _safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), _safe(F.col("tn"), F.col("tn") + F.col("fp")).alias("pass_rate")
    )
    return t.where(F.col("pass_rate") >= least_pass).orderBy(F.desc("f1"), "calls", "lo", "hi").limit(1)


def balanced_threshold(rows: DataFrame, score: str, label: str) -> DataFrame:
    """The threshold of the best mean of both classes' shares, the least one of equals: for judges whose scores have scales of their own."""
    c = running(by_score(rows, score, label), "score", "pos", "neg")
    mean = ((F.col("all_pos") - F.col("up_pos")) / F.col("all_pos") + F.col("up_neg") / F.col("all_neg")) / 2
    t = c.where("all_pos > 0 and all_neg > 0").select("score", mean.alias("balanced"))
    return t.orderBy(F.desc("balanced"), "score").limit(1).select(F.col("score").alias("threshold"), "balanced")


def backend_scores(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row: auc, best threshold and its accuracy, accuracy at one half, mean scores of both classes."""
    y = F.col(label) == 1
    right = (F.col(score) >= 0.5) == y
    m = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).agg(
        F.avg(right.cast("double")).alias("accuracy_at_half"), F.avg(F.when(y, F.col(score))).alias("mean_positive"), F.avg(F.when(~y, F.col(score))).alias("mean_negative")
    )
    best = best_threshold(rows, score, label)
    return auc(rows, score, label).join(F.broadcast(best)).join(F.broadcast(m))  # one row each


def best_of_sweep(table: DataFrame, least_pass: float = 0.8) -> DataFrame:
    """kind (usable: enough rows pass; raw), threshold, f1, pass_rate: the best f1, the least threshold of equals."""
    best = lambda df, kind: df.orderBy(F.desc("f1"), "threshold").limit(1).select(F.lit(kind).alias("kind"), "threshold", "f1", "pass_rate")
    return best(table.where(F.col("pass_rate") >= least_pass), "usable").unionByName(best(table, "raw"))


def label_scores(rows: DataFrame, gold: str, predicted: str, weights: DataFrame | None = None, weight: str = "weight") -> DataFrame:
    """label, gold_n, predicted_n, recall, precision; a gold of 'ok' stands for the prediction.

    weights (label, weight) adds the share of each prediction in the corpus times its precision, to be summed to an accuracy there.
    """
    g = F.when(F.col(gold) == "ok", F.col(predicted)).otherwise(F.col(gold))
    cells = rows.select(g.alias("g"), F.col(predicted).alias("p")).groupBy("g", "p").agg(F.count("*").alias("c"))
    a = cells.groupBy(F.col("g").alias("label")).agg(F.sum("c").alias("gold_n"), F.sum(F.when(F.col("g") == F.col("p"), F.col("c")).otherwise(0)).alias("right"))
    b = cells.groupBy(F.col("p").alias("label")).agg(F.sum("c").alias("predicted_n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    t = a.join(b, "label", "full").select("label", zero("gold_n").alias("gold_n"), zero("predicted_n").alias("predicted_n"), zero("right").alias("right"))
    t = t.select("label", "gold_n", "predicted_n", _safe(F.col("right"), F.col("gold_n")).alias("recall"), _safe(F.col("right"), F.col("predicted_n")).alias("precision"))
    if weights is None:
        return t
    total = weights.agg(F.sum(weight).alias("_t"))
    w = weights.join(F.broadcast(total)).select("label", (F.col(weight) / F.col("_t")).alias("share"))  # one row
    return t.join(w, "label", "left").withColumn("weighted", F.coalesce("share", F.lit(0.0)) * F.col("precision")).drop("share")


def drift(now: DataFrame, before: DataFrame, bucket: str, share: str = "share") -> DataFrame:
    """One row: the widest gap between two distributions over buckets, and whether it is small, moderate or large."""
    a, b = now.select(bucket, F.col(share).alias("_a")), before.select(bucket, F.col(share).alias("_b"))
    gap = F.max(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))))
    t = a.join(b, bucket, "full").agg(gap.alias("gap"))
    return t.withColumn("verdict", F.when(F.col("gap") < 0.02, "small").when(F.col("gap") < 0.05, "moderate").otherwise("large"))


def reward_check(rows: DataFrame, score: str, label: str, components: list[str], least_spread: float = 0.02) -> DataFrame:
    """One row: auc, spread of the score, whether it suffices, and components that never change."""
    spread = rows.agg(F.stddev_pop(score).alias("spread"), *[(F.min(c) == F.max(c)).alias(c) for c in components])
    constant = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in components]))
    s = spread.select("spread", (F.col("spread") >= least_spread).alias("varies"), F.array_join(constant, ",").alias("constant"))
    return auc(rows, score, label).join(F.broadcast(s))  # one row each


def self_check(pairs: DataFrame, chosen: str, rejected: str, kind: str, theta: float) -> DataFrame:
    """By kind and in all (kind null): n, wins of the chosen answer, mean margin, shares of chosen that pass and of rejected that are caught."""
    c, r = F.col(chosen), F.col(rejected)
    as_share = lambda x: F.avg(x.cast("double"))
    return pairs.rollup(kind).agg(F.count("*").alias("n"), as_share(c > r).alias("win_rate"), F.avg(c - r).alias("margin"), as_share(c >= theta).alias("passed"), as_share(r < theta).alias("caught"))


def mean_of_rates(rows: DataFrame, attribute: str, kind: str, caught: Column) -> DataFrame:
    """attribute, rate: the mean over an attribute's kinds of the share caught of each."""
    per = rows.groupBy(attribute, kind).agg(F.avg(caught.cast("double")).alias("r"))
    return per.groupBy(attribute).agg(F.avg("r").alias("rate"))


def reviewed(sheets: DataFrame, key: str, reviewer: str, verdict: str) -> DataFrame:
    """key, gold, agreed of items that reviewers judged: gold is what all of them said, unless that is x."""
    g = sheets.groupBy(key).agg(F.min(verdict).alias("_a"), F.max(verdict).alias("_b"), F.count_distinct(reviewer).alias("reviewers"))
    agreed = F.col("_a") == F.col("_b")
    return g.select(key, "reviewers", agreed.alias("agreed"), F.when(agreed & (F.col("_a") != "x"), F.col("_a")).alias("gold"))


def held_out_cascade(rows: DataFrame, document: str, encoder: str, llm: str, label: str, lows: list[float], highs: list[float]) -> DataFrame:
    """fold, lo, hi, n, right: the grid point that one half of the documents chooses, on the other half; halves by places of sorted documents."""
    from .order import placed

    folds = placed(rows.select(document).distinct(), document, "folds").select(document, (F.col("_place") % 2).alias("fold"))
    r = rows.join(folds, document)
    out = None
    for k in (0, 1):
        best = grid_search(r.where(F.col("fold") != k), encoder, llm, label, lows, highs).select("lo", "hi")
        t = r.where(F.col("fold") == k).join(F.broadcast(best))  # one row
        asked = (F.col(encoder) >= F.col("lo")) & (F.col(encoder) < F.col("hi"))
        s = F.when(asked, F.col(llm)).otherwise(F.col(encoder))
        one = t.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.count_if((s >= 0.5) == (F.col(label) == 1)).alias("right")).select(F.lit(k).alias("fold"), "lo", "hi", "n", "right")
        out = one if out is None else out.unionByName(one)
    return out
