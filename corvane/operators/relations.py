"""Joins and order-dependent operators: pairings, neighbours, components, passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written
from .order import placed


def without_held_out(rows: DataFrame, passages: DataFrame, text: Column, passage: Column) -> DataFrame:
    """rows whose text, white space aside, is no passage's. Digests are compared, so that the join's keys are short."""
    strip = lambda c: F.sha2(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", ""), 256)
    return rows.withColumn("_digest", strip(text)).join(passages.select(strip(passage).alias("_digest")).distinct(), "_digest", "left_anti").drop("_digest")


def aligned_pairs(rows: DataFrame, group: str, good: Column, key: str) -> DataFrame:
    """group, chosen, rejected: the i-th good row of a group with its i-th other row, in the order of key.

    A row's number in its group is its place in the whole less that of the group's first, so a hot group is no hot task.
    """
    r = placed(rows.select(group, good.alias("_good"), key).where(F.col(group).isNotNull() & F.col("_good").isNotNull()), [group, "_good", key], "aligned")
    first = r.groupBy(group, "_good").agg(F.min("_place").alias("_first"))
    r = r.join(first, [group, "_good"]).select(group, "_good", key, (F.col("_place") - F.col("_first")).alias("_i"))
    a = r.where("_good").select(group, "_i", F.col(key).alias("chosen"))
    b = r.where("not _good").select(group, "_i", F.col(key).alias("rejected"))
    return a.join(b, [group, "_i"]).select(group, "chosen", "rejected")


def sharing_pairs(rows: DataFrame, key: str, words: Column, least: int) -> DataFrame:
    """a, b, shared: pairs of rows with at least so many words in common, by prefixes of rare words.

    A pair that shares ``least`` words shares one outside of any least - 1 of
    them: each row keeps its rarest words but leaves out its least - 1 most
    frequent ones when candidates are sought; the whole sets then decide.
    """
    w = rows.select(F.col(key).alias("id"), words.alias("words"))
    each = w.select("id", F.explode("words").alias("word"))
    freq = each.groupBy("word").agg(F.count("*").alias("df")).where("df > 1")
    order = Window.partitionBy("id").orderBy("df", "word")
    n = each.join(freq, "word").withColumn("at", F.row_number().over(order))
    sizes = n.groupBy("id").agg(F.max("at").alias("size"))
    probe = n.join(sizes, "id").where(F.col("at") <= F.col("size") - F.lit(least - 1)).select("id", "word")
    a, b = probe.select(F.col("id").alias("a"), "word"), probe.select(F.col("id").alias("b"), "word")
    cand = a.join(b, "word").where("a < b").select("a", "b").distinct()
    full = cand.join(w.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(w.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    return full.select("a", "b", F.size(F.array_intersect("wa", "wb")).cast("bigint").alias("shared")).where(F.col("shared") >= least)


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest reachable node) by rounds of minima over neighbours and jumps along roots.

    Each round is written to the shared folder, so that lineage does not grow and lost executors cost one round at most.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        nxt = state.join(near, state["node"] == near["a"]).select("node", F.least("root", "r").alias("root"), F.col("root").alias("old"))
        jump = nxt.select(F.col("node").alias("j"), F.col("root").alias("jr"))
        nxt = written(nxt.join(jump, nxt["root"] == jump["j"]).select("node", F.least("root", "jr").alias("root"), "old"), "roots")
        state = nxt.select("node", "root")
        if nxt.where("root <> old").isEmpty():
            return state


def ring(rows: DataFrame, order: str, step: int, prefix: str = "other_") -> DataFrame:
    """Each row beside the one ``step`` places on (order: numbers 1..n without gaps), past the last to the first."""
    n = rows.agg(F.max(order).alias("_n"))
    r = rows.join(F.broadcast(n)).withColumn("_to", F.pmod(F.col(order) - 1 + step, F.col("_n")) + 1).drop("_n")  # n: one row
    other = rows.select(*[F.col(c).alias(prefix + c) for c in rows.columns])
    return r.join(other, r["_to"] == other[prefix + order]).drop("_to")


def passages(rows: DataFrame, by: str, order: str, text: str, before: int = 2, after: int = 1) -> DataFrame:
    """Each row's text with those around it in its group."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("passage", F.array_join(F.collect_list(text).over(w.rowsBetween(-before, after)), " "))


def islands(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Runs of equal neighbouring values within a group: by, island (from 0), value, first, last, n."""
    w = Window.partitionBy(by).orderBy(order)
    r = rows.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    r = r.withColumn("island", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("bigint"))
    return r.groupBy(by, "island").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def buffers(rows: DataFrame, by: str, order: str, claim: Column, evidence: Column, cap: int = 12) -> DataFrame:
    """by, order, kind: the first claims of a group up to cap; once they are full a claim may serve as evidence, up to cap too."""
    w = Window.partitionBy(by).orderBy(order)
    r = rows.withColumn("_c", claim).withColumn("_e", evidence)
    r = r.withColumn("_n", F.sum(F.col("_c").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    as_claim = F.col("_c") & (F.col("_n") <= cap)
    r = r.withColumn("kind", F.when(as_claim, "claim").when(F.col("_e"), "evidence")).where("kind is not null")
    r = r.withColumn("_k", F.row_number().over(Window.partitionBy(by, "kind").orderBy(order))).where(F.col("_k") <= cap)
    return r.select(by, order, "kind")
