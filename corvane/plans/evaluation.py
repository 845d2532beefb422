"""Evaluation statistics over labels and what the relational tables give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import match_tokens
from ..operators import evaluation as E
from ..operators import relations as R
from ..sources.tables import table
from .registry import query

J = "(SELECT l.doc_id, l.quality, l.toxic, d.n_chars, d.source, d.lang FROM labels l JOIN documents d USING (doc_id))"


def joined(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang"), "doc_id")


@query(f"""SELECT sum(CASE WHEN p.n_chars > q.n_chars THEN 1.0 WHEN p.n_chars = q.n_chars THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS auc
  FROM {J} p, {J} q WHERE p.quality = 1 AND q.quality = 0""")
def auc_length_quality(spark, sf):
    return E.auc(joined(spark, sf), "n_chars", "quality")


PRF = """tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END::DOUBLE AS f1, CASE WHEN n > 0 THEN (n - tp - fp) / n ELSE 0 END::DOUBLE AS pass_rate"""


@query(f"""SELECT lang, {PRF} FROM (SELECT lang, count(*) FILTER (n_chars < 800 AND quality = 0)::BIGINT AS tp, count(*) FILTER (n_chars < 800 AND quality = 1)::BIGINT AS fp,
  count(*) FILTER (n_chars >= 800 AND quality = 0)::BIGINT AS fn, count(*)::BIGINT AS n FROM {J} GROUP BY lang)""")
def precision_recall_by_language(spark, sf):
    return E.prf(joined(spark, sf), F.col("n_chars") < 800, F.col("quality") == 0, "lang")


@query(f"""WITH j AS {J}, t AS (SELECT DISTINCT n_chars AS t FROM j)
SELECT t AS threshold, (count(*) FILTER ((n_chars >= t) = (quality = 1)))::DOUBLE / count(*) AS accuracy FROM t, j GROUP BY t ORDER BY accuracy DESC, t LIMIT 1""")
def best_length_threshold(spark, sf):
    return E.best_threshold(joined(spark, sf), "n_chars", "quality")


@query(f"""SELECT threshold, {PRF.replace("tp, fp, fn, ", "")} FROM (
  SELECT threshold::DOUBLE AS threshold, count(*) FILTER (n_chars < threshold AND toxic = 1) AS tp, count(*) FILTER (n_chars < threshold AND toxic = 0) AS fp,
  count(*) FILTER (n_chars >= threshold AND toxic = 1) AS fn, count(*) AS n FROM {J}, (VALUES (200), (500), (1000), (2000), (5000)) v(threshold) GROUP BY threshold)""")
def threshold_sweep(spark, sf):
    return E.sweep(joined(spark, sf), "n_chars", "toxic", [200, 500, 1000, 2000, 5000])


@query("""WITH c AS (SELECT quality AS a, toxic AS b FROM labels), t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b)::DOUBLE AS same,
  (count(*) FILTER (a = 1) * count(*) FILTER (b = 1) + count(*) FILTER (a = 0) * count(*) FILTER (b = 0))::DOUBLE AS lr FROM c)
SELECT n::BIGINT AS n, same / n AS observed, CASE WHEN lr = n * n THEN 1 ELSE (same / n - lr / (n * n)) / (1 - lr / (n * n)) END AS kappa FROM t""")
def kappa_quality_toxic(spark, sf):
    return E.kappa(table(spark, sf, "labels"), "quality", "toxic")


@query(f"""WITH s AS (SELECT lang, (SELECT count(*) FROM documents d WHERE d.lang = j.lang) AS pop, count(*) AS n, count(*) FILTER (toxic = 1 AND quality = 1) AS tp,
  count(*) FILTER (toxic = 1 AND quality = 0) AS fp, count(*) FILTER (toxic = 0 AND quality = 1) AS fn, count(*) FILTER (toxic = 0 AND quality = 0) AS tn FROM {J} j GROUP BY lang),
w AS (SELECT sum(pop / n * tp) AS tp, sum(pop / n * fp) AS fp, sum(pop / n * fn) AS fn, sum(pop / n * tn) AS tn, sum(tp + tn) AS ok, sum(n) AS n FROM s)
SELECT round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, (ok / n)::DOUBLE AS raw_accuracy FROM w""")
def weighted_accuracy(spark, sf):
    pop = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("pop"))
    g = E.weighted_confusion(joined(spark, sf).join(pop, "lang"), "lang", "pop", F.col("toxic") == 1, F.col("quality") == 1)
    return g.select(*[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall")], "raw_accuracy")


@query(f"""WITH j AS (SELECT n_chars < 1000 AS p, quality = 0 AS g FROM {J}), c AS (SELECT n_chars < 1000 AS p, count(*) AS c FROM documents GROUP BY 1),
k AS (SELECT p, g, count(*) AS k, sum(count(*)) OVER (PARTITION BY p) AS n FROM j GROUP BY p, g),
t AS (SELECT coalesce(k.g, c.p) AS gold, c.c / (SELECT count(*) FROM documents)::DOUBLE AS w, coalesce(k.k / k.n, 1)::DOUBLE AS q, k.n FROM c LEFT JOIN k USING (p))
SELECT gold, round(sum(w * q), 9) AS share, round(1.96 * sqrt(sum(coalesce(w * w * q * (1 - q) / n, 0))), 9) AS margin FROM t GROUP BY gold""")
def corrected_prevalence(spark, sf):
    corpus = table(spark, sf, "documents").select((F.col("n_chars") < 1000).alias("p"))
    sample = joined(spark, sf).select((F.col("n_chars") < 1000).alias("p"), (F.col("quality") == 0).alias("g"))
    return E.prevalence(corpus, sample, "p", "g").select("gold", F.round("share", 9).alias("share"), F.round("margin", 9).alias("margin"))


@query(f"""SELECT source, n, passed, p AS rate, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9)::DOUBLE AS low,
  round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9)::DOUBLE AS high
  FROM (SELECT source, count(*)::BIGINT AS n, count(*) FILTER (quality = 1)::BIGINT AS passed, avg(quality)::DOUBLE AS p FROM {J} GROUP BY source)""")
def pass_rates(spark, sf):
    g = E.rates(joined(spark, sf), F.col("quality") == 1, "source")
    return g.select("source", "n", "passed", "rate", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("SELECT count(*)::BIGINT AS n, avg(quality)::DOUBLE AS a, avg(toxic)::DOUBLE AS b, count(*) FILTER (quality > toxic)::BIGINT AS a_only, count(*) FILTER (quality < toxic)::BIGINT AS b_only FROM labels")
def paired_runs(spark, sf):
    labels = table(spark, sf, "labels")
    one = lambda c: labels.select("doc_id", F.col(c).alias("ok"))
    return E.paired(one("quality"), one("toxic"), "doc_id", "ok").drop("p")


GINI = """SELECT count(*)::BIGINT AS keys, sum(n)::BIGINT AS rows, (sum(n) FILTER (r <= 1))::DOUBLE / sum(n) AS top1_share, (sum(n) FILTER (r <= 5))::DOUBLE / sum(n) AS top5_share,
  (sum(n) FILTER (r <= 10))::DOUBLE / sum(n) AS top10_share, round(2 * sum(n * u)::DOUBLE / (count(*) * sum(n)) - (count(*) + 1) / count(*), 9)::DOUBLE AS gini FROM (
  SELECT n, row_number() OVER (ORDER BY n DESC) AS r, row_number() OVER (ORDER BY n) AS u FROM (SELECT count(*) AS n FROM {} GROUP BY {}))"""


@query(GINI.format("documents", "source"))
def source_concentration(spark, sf):
    return E.concentration(table(spark, sf, "documents"), "source").withColumn("gini", F.round("gini", 9))


@query(GINI.format("orders", "o_custkey"))
def customer_concentration(spark, sf):
    return E.concentration(table(spark, sf, "orders"), "o_custkey").withColumn("gini", F.round("gini", 9))


@query("""SELECT source, n_chars AS quantile, n::BIGINT AS n FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
  WHERE r = least(floor(n * 0.5), n - 1) + 1""")
def upper_medians(spark, sf):
    return E.upper_quantile(table(spark, sf, "documents"), "n_chars", "source")


@query(f"SELECT sum(m)::DOUBLE / sum(n) AS leak FROM (SELECT max(c) AS m, sum(c) AS n FROM (SELECT source, n_chars < 500 AS s, toxic, count(*) AS c FROM {J} GROUP BY 1, 2, 3) GROUP BY source, s)")
def surface_leak(spark, sf):
    return E.surface_leak(joined(spark, sf).withColumn("s", F.col("n_chars") < 500), "toxic", "source", "s")


@query(r"""WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z가-힣0-9.]+'), lambda x: lower(x)),
  lambda x: length(x) > 1 AND x NOT IN ('the', 'a', 'an', 'of', 'to', 'in', 'and', '은', '는', '이', '가', '에', '의', '을', '를')))) AS token FROM documents)
SELECT token, count(*)::BIGINT AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1, 9) AS idf FROM t GROUP BY token""")
def inverse_document_frequency(spark, sf):
    return E.idf(table(spark, sf, "documents").select("text"), match_tokens(F.col("text"))).withColumn("idf", F.round("idf", 9))


@query(f"""WITH r AS (SELECT source, quality, doc_id, row_number() OVER (PARTITION BY source, quality = 1 ORDER BY doc_id) AS i FROM {J})
SELECT a.source, a.doc_id AS chosen, b.doc_id AS rejected FROM r a JOIN r b ON a.source = b.source AND a.i = b.i AND a.quality = 1 AND b.quality <> 1""")
def preference_pairs(spark, sf):
    return R.aligned_pairs(joined(spark, sf), "source", F.col("quality") == 1, "doc_id")


@query(f"SELECT lang, count(*)::BIGINT AS n, avg(quality)::DOUBLE AS quality_rate, avg(toxic)::DOUBLE AS toxic_rate FROM {J} GROUP BY ROLLUP (lang)")
def judge_report(spark, sf):
    return joined(spark, sf).rollup("lang").agg(F.count("*").alias("n"), F.avg("quality").alias("quality_rate"), F.avg("toxic").alias("toxic_rate"))


@query(f"SELECT quality, toxic, lang, count(*)::BIGINT AS n FROM {J} GROUP BY GROUPING SETS ((), (lang), (quality, toxic))")
def coverage_sets(spark, sf):
    return joined(spark, sf).groupingSets([[], ["lang"], ["quality", "toxic"]], "quality", "toxic", "lang").agg(F.count("*").alias("n"))


# scores of order lines: the discount as a judge's score, a returned line as the label

LINES = "(SELECT l_orderkey AS k, l_discount * 10 AS s, (l_returnflag = 'R')::INT AS y FROM lineitem)"


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_discount") * 10).alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_tax") * 12.5).alias("e"))


@query(f"""WITH g AS (SELECT s, sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS n FROM {LINES} GROUP BY s), c AS (SELECT s, (sum(p) OVER (ORDER BY s DESC) / sum(p) OVER () + coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER ()) / 2 AS b FROM g)
SELECT s AS threshold, round(b, 12) AS balanced FROM c ORDER BY round(b, 12) DESC, s LIMIT 1""")
def balanced_threshold(spark, sf):
    return E.balanced_threshold(lines(spark, sf), "s", "y").withColumn("balanced", F.round("balanced", 12))


@query(f"""SELECT avg(((s >= 0.5)::INT = y)::INT) AS accuracy_at_half, round(avg(s) FILTER (y = 1), 9) AS mean_positive, round(avg(s) FILTER (y = 0), 9) AS mean_negative FROM {LINES}""")
def backend_scores(spark, sf):
    b = E.backend_scores(lines(spark, sf), "s", "y").where(F.col("auc").between(0, 1) & (F.col("accuracy") >= F.col("accuracy_at_half")))
    return b.select("accuracy_at_half", F.round("mean_positive", 9).alias("mean_positive"), F.round("mean_negative", 9).alias("mean_negative"))


GRID = [0.1, 0.25, 0.45, 0.65, 0.85]
SWEPT = f"""t AS (SELECT th, sum((s < th)::INT * y)::DOUBLE AS tp, sum((s < th)::INT * (1 - y)) AS fp, sum((s >= th)::INT * y) AS fn, count(*) AS n FROM {LINES}, (SELECT unnest({GRID})::DOUBLE AS th) GROUP BY th),
f AS (SELECT th AS threshold, 2 * tp / (2 * tp + fp + fn) AS f1, (n - tp - fp) / n AS pass_rate FROM t)"""


@query(f"""WITH {SWEPT}, u AS (SELECT 'usable' AS kind, * FROM f WHERE pass_rate >= 0.8 ORDER BY f1 DESC, threshold LIMIT 1), r AS (SELECT 'raw' AS kind, * FROM f ORDER BY f1 DESC, threshold LIMIT 1) SELECT * FROM u UNION ALL SELECT * FROM r""")
def best_of_sweep(spark, sf):
    return E.best_of_sweep(E.sweep(lines(spark, sf), "s", "y", GRID))


@query("""WITH r AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'ok' WHEN doc_id % 4 = 1 THEN 'en' WHEN doc_id % 4 = 2 THEN 'none' ELSE lang END AS gold, lang AS p FROM documents), c AS (SELECT CASE WHEN gold = 'ok' THEN p ELSE gold END AS g, p FROM r),
a AS (SELECT g AS label, count(*)::BIGINT AS gold_n, count(*) FILTER (g = p)::BIGINT AS hit FROM c GROUP BY g), b AS (SELECT p AS label, count(*)::BIGINT AS predicted_n FROM c GROUP BY p), w AS (SELECT lang AS label, sum(n_chars)::DOUBLE / (SELECT sum(n_chars) FROM documents) AS share FROM documents GROUP BY lang)
SELECT label, coalesce(gold_n, 0)::BIGINT AS gold_n, coalesce(predicted_n, 0)::BIGINT AS predicted_n, CASE WHEN coalesce(gold_n, 0) > 0 THEN hit / gold_n ELSE 0 END::DOUBLE AS recall, CASE WHEN coalesce(predicted_n, 0) > 0 THEN coalesce(hit, 0) / predicted_n ELSE 0 END::DOUBLE AS "precision",
  coalesce(share, 0) * CASE WHEN coalesce(predicted_n, 0) > 0 THEN coalesce(hit, 0) / predicted_n ELSE 0 END::DOUBLE AS weighted FROM a FULL JOIN b USING (label) LEFT JOIN w USING (label)""")
def label_scores(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    rows = d.select(F.when(k % 4 == 0, "ok").when(k % 4 == 1, "en").when(k % 4 == 2, "none").otherwise(F.col("lang")).alias("gold"), F.col("lang").alias("p"))
    return E.label_scores(rows, "gold", "p", d.groupBy(F.col("lang").alias("label")).agg(F.sum("n_chars").alias("weight")))


@query("""WITH a AS (SELECT lang, count(*) / sum(count(*)) OVER () AS s FROM documents GROUP BY lang), b AS (SELECT lang, count(*) / sum(count(*)) OVER () AS s FROM documents WHERE doc_id % 3 = 0 GROUP BY lang), g AS (SELECT max(abs(coalesce(a.s, 0) - coalesce(b.s, 0))) AS gap FROM a FULL JOIN b USING (lang))
SELECT round(gap, 12)::DOUBLE AS gap, CASE WHEN gap < 0.02 THEN 'small' WHEN gap < 0.05 THEN 'moderate' ELSE 'large' END AS verdict FROM g""")
def bucket_drift(spark, sf):
    from pyspark.sql.window import Window

    d = table(spark, sf, "documents")
    share = lambda r: r.groupBy("lang").agg(F.count("*").alias("c")).select("lang", (F.col("c") / F.sum("c").over(Window.partitionBy())).alias("share"))
    return E.drift(share(d), share(d.where("doc_id % 3 = 0")), "lang").withColumn("gap", F.round("gap", 12))


@query(f"SELECT round(stddev_pop(s), 9) AS spread, stddev_pop(s) >= 0.02 AS varies, 'fixed' AS constant FROM {LINES}")
def reward_check(spark, sf):
    r = E.reward_check(lines(spark, sf).withColumn("fixed", F.lit(1)), "s", "y", ["s", "e", "fixed"])
    return r.where(F.col("auc").between(0, 1)).select(F.round("spread", 9).alias("spread"), "varies", "constant")


@query("""SELECT l_returnflag AS kind, count(*)::BIGINT AS n, avg((l_discount * 10 > l_tax * 12.5)::INT) AS win_rate, round(avg(l_discount * 10 - l_tax * 12.5), 9) AS margin, avg((l_discount * 10 >= 0.45)::INT) AS passed, avg((l_tax * 12.5 < 0.45)::INT) AS caught FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def self_check(spark, sf):
    p = table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("c"), (F.col("l_tax") * 12.5).alias("r"), F.col("l_returnflag").alias("kind"))
    return E.self_check(p, "c", "r", "kind", 0.45).withColumn("margin", F.round("margin", 9))


@query("""SELECT a AS attribute, avg(r) AS rate FROM (SELECT l_returnflag AS a, l_linestatus AS k, avg((l_discount > 0.05)::INT) AS r FROM lineitem GROUP BY 1, 2) GROUP BY a""")
def mean_of_rates(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "attribute")
    return E.mean_of_rates(li, "attribute", "l_linestatus", F.col("l_discount") > 0.05)


@query("""WITH s AS (SELECT o_orderkey AS k, r, CASE WHEN o_orderkey % 5 = 0 AND r = 1 THEN 'no' WHEN o_orderkey % 7 = 0 THEN 'x' ELSE 'yes' END AS v FROM orders, (SELECT unnest([1, 2]) AS r))
SELECT k, count(DISTINCT r)::BIGINT AS reviewers, min(v) = max(v) AS agreed, CASE WHEN min(v) = max(v) AND min(v) <> 'x' THEN min(v) END AS gold FROM s GROUP BY k""")
def reviewed_items(spark, sf):
    k = F.col("o_orderkey")
    s = table(spark, sf, "orders").select(k.alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("r"))
    s = s.withColumn("v", F.when((F.col("k") % 5 == 0) & (F.col("r") == 1), "no").when(F.col("k") % 7 == 0, "x").otherwise("yes"))
    return E.reviewed(s, "k", "r", "v")


@query("""WITH f AS (SELECT l_orderkey AS d, (dense_rank() OVER (ORDER BY l_orderkey) - 1) % 2 AS fold FROM lineitem) SELECT fold::INT AS fold, count(*)::BIGINT AS n FROM f GROUP BY fold""")
def held_out_cascade(spark, sf):
    r = lines(spark, sf).withColumn("s", F.col("y") * 0.8 + 0.1)  # a large model that is right
    h = E.held_out_cascade(r, "k", "e", "s", "y", [0.0, 0.2], [0.6, 1.1])
    return h.where("right <= n and right > 0").select("fold", "n")
