"""Mixing sources to target weights by capped water-filling.

Each source's target is min(cap, weight * level): a source whose share would
exceed ``max_epochs`` times its size is clamped there, and what it leaves over
goes to the others in proportion to their weights, until none is above its
cap. The level has a closed form: with the sources by cap / weight, and
level_i = (total - caps before i) / weights from i on, it is the largest
level_i.

A source's words are then taken as whole repetitions of all its documents and
a fractional one: documents in the order of a seeded hash, up to the words
still wanted, the last document in part. The cut is found by sums over 4096
hash ranges per source and a closer look at the one range that holds it, so no
task ever sorts a source. What is decided per source is one short row, written
and joined to the documents: broadcast if the table's size is under Spark's
threshold for that, else by a join in which Spark splits a hot source.

Defined results: a null text has size 0 and takes 0; a null source is a source
of its own and sorts last; rows that share an id share a hash, and if the cut
falls among them each takes an equal share of its size; an empty table gives
no rows; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def seeded(seed: str = SEED) -> Column:
    return F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 16)


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select(
        "doc_id",
        F.coalesce(F.col("source"), F.lit("")).alias("src"),
        F.col("source").isNull().alias("no_src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        seeded(seed).alias("h"),
    )


def targets(by_source: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """by_source: src, no_src, source_size; adds target. One row per source, so its windows hold the sources alone."""
    w = Window.orderBy("no_src", "src")
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = by_source.withColumn("weight", F.element_at(cycle, (F.row_number().over(w) - 1) % len(weights) + 1))
    t = t.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    t = t.withColumn("total", F.sum("source_size").over(every.orderBy(F.lit(0))).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "no_src", "src")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level_i", (F.col("total") - before) / onward)
    level = F.max("level_i").over(every.orderBy(F.lit(0)))
    return t.withColumn("target", F.least("cap", F.col("weight") * level)).drop("level_i", "total", "cap", "weight")


def decisions(sized: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: target, whole repetitions, and where the fractional one ends (hash, words, of how many)."""
    of = ["no_src", "src"]
    ranges = sized.groupBy(*of, F.substring("h", 1, 3).alias("range")).agg(F.sum("size").alias("n"))
    per = targets(ranges.groupBy(*of).agg(F.sum("n").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    per = per.withColumn("whole", whole.cast("long"))
    want = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long")
    per = per.withColumn("want", want)
    w = Window.partitionBy(*of).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    cut = ranges.join(per, of).where("before < want and want <= before + n").select(*of, "range", "before", "want")
    near = sized.withColumn("range", F.substring("h", 1, 3)).join(cut, [*of, "range"])
    near = near.groupBy(*of, "h", "before", "want").agg(F.sum("size").alias("n"))
    w = Window.partitionBy(*of).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    near = near.where("at < want and want <= at + n")
    near = near.select(*of, F.col("h").alias("cut_h"), (F.col("want") - F.col("at")).alias("cut_words"), F.col("n").alias("cut_of"))
    return per.join(near, of, "left").select(
        *of, "source_size", "target", "whole", F.coalesce("cut_h", F.lit("")).alias("cut_h"), "cut_words", "cut_of"
    )


def taken() -> Column:
    part = F.when(F.col("h") < F.col("cut_h"), F.col("size"))
    part = part.when(F.col("h") == F.col("cut_h"), F.expr("(size * cut_words) div cut_of"))
    return (F.col("whole") * F.col("size") + F.coalesce(part, F.lit(0))).cast("long")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of docs."""
    sized = written(sizes(docs, seed), "mix-sizes")
    per = written(decisions(sized, weights, max_epochs), "mix-decisions")
    got = sized.join(per, ["no_src", "src"])
    return got.select("doc_id", "size", "source_size", "target", taken().alias("taken"))


def repeated(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, and the rows at a cut with their first words besides.

    n_chars, where there is one, is that of the text in the row.
    """
    per = written(decisions(written(sizes(docs, seed), "mix-sizes"), weights, max_epochs), "mix-decisions")
    # a row travels whole in one column, so that none of its names meets one of these
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce("source", F.lit("")).alias("src"),
        F.col("source").isNull().alias("no_src"),
        seeded(seed).alias("h"),
    )
    got = rows.join(per, ["no_src", "src"])
    got = got.withColumn("full", F.col("whole") + F.when(F.col("h") < F.col("cut_h"), 1).otherwise(0))
    # only rows at a cut count their words
    size = F.regexp_count("row.text", F.lit(WORD)).cast("long")
    some = F.when(F.col("h") == F.col("cut_h"), F.floor(size * F.col("cut_words") / F.col("cut_of"))).cast("long")
    got = got.withColumn("some", F.coalesce(some, F.lit(0)))
    times = (F.col("full") + F.when(F.col("some") > 0, 1).otherwise(0)).cast("int")
    got = got.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times))))
    words = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("some"), F.lit(1)).cast("int")), "")
    text = F.when(F.col("copy") > F.col("full"), head).otherwise(F.col("row.text"))
    kinds = dict(docs.dtypes)
    cols = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in cols:
        cols["n_chars"] = F.length(text).cast(kinds["n_chars"])
    return got.select(*[v.alias(c) for c, v in cols.items()])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS no_src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 16) AS h
  FROM documents),
per AS (SELECT no_src, src, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY no_src, src) - 1) % 3 + 1)::INT] AS weight,
         (source_size * 3)::DOUBLE AS cap, (SELECT sum(source_size) FROM per)::DOUBLE AS total
  FROM per),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, no_src, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(weight) OVER (ORDER BY cap / weight, no_src, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_i
  FROM weighed),
goal AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole
  FROM (SELECT no_src, src, source_size, least(cap, weight * (SELECT max(level_i) FROM levels)) AS target FROM levels)),
want AS (SELECT *, floor(target - whole * source_size + 0.5)::BIGINT AS want FROM goal),
ties AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY no_src, src ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM (SELECT no_src, src, h, sum(size)::BIGINT AS n FROM sized GROUP BY ALL))
SELECT s.doc_id, s.size, w.source_size, w.target,
       (w.whole * s.size + CASE WHEN t.before + t.n <= w.want THEN s.size
                                WHEN t.before >= w.want THEN 0
                                ELSE s.size * (w.want - t.before) // t.n END)::BIGINT AS taken
FROM sized s JOIN want w USING (no_src, src) JOIN ties t USING (no_src, src, h)
"""
