"""Entailment, rendered claims and their tampered forms over conversations and the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from ..functions import text as T
from ..operators import judging as J
from ..operators import relations as R
from ..sources.tables import table
from .registry import query

TOKENS = r"""list_distinct(list_filter(list_transform(regexp_extract_all({}, '[A-Za-z가-힣0-9.]+'), lambda x: lower(x)),
  lambda x: length(x) > 1 AND x NOT IN ('the', 'a', 'an', 'of', 'to', 'in', 'and', '은', '는', '이', '가', '에', '의', '을', '를')))"""
NLI_TOKENS = TOKENS.replace("'the', 'a', 'an', 'of', 'to', 'in', 'and', '은', '는', '이', '가', '에', '의', '을', '를'", ", ".join(f"'{w}'" for w in T.NLI_STOP))
PAIRS = "(SELECT conv_id, turn, text AS h, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"
ASKED = "WHERE role = 'assistant' AND before = 'user'"


def pairs(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("h"), F.lag("text").over(w).alias("p"), F.lag("role").over(w).alias("before"))
    return c.where(ASKED[6:])


@query(f"""WITH t AS (SELECT conv_id, turn, {TOKENS.format("h")} AS h, {TOKENS.format("p")} AS p FROM {PAIRS} {ASKED})
SELECT conv_id, turn, CASE WHEN len(h) = 0 OR len(p) = 0 THEN 0 ELSE len(list_intersect(h, p)) / len(h) END::DOUBLE AS overlap FROM t""")
def answer_overlap(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", T.overlap(F.col("h"), F.col("p")).alias("overlap"))


def _mates() -> str:
    d = {}
    for a, b in S.OPPOSITES:
        d[a], d[b] = b, a
    return "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in d.items()) + " END"


NEG = "len(list_filter({}, lambda x: x IN (" + ", ".join(f"'{w}'" for w in S.NEGATION) + ") OR regexp_matches(x, '않|없|못'))) > 0"


@query(f"""WITH t AS (SELECT conv_id, turn, {NLI_TOKENS.format("h")} AS h, {NLI_TOKENS.format("p")} AS p FROM {PAIRS} {ASKED}),
c AS (SELECT *, len(list_intersect(h, p)) AS common, len(list_intersect(list_filter(list_transform(h, lambda x: {_mates()}), lambda x: x IS NOT NULL), p)) > 0 OR ({NEG.format("h")}) <> ({NEG.format("p")}) AS conflict FROM t)
SELECT conv_id, turn, round(CASE WHEN common = 0 THEN 0 ELSE common / sqrt(len(h) * len(p)) END * CASE WHEN conflict THEN 0.35 ELSE 1 END, 9)::DOUBLE AS score FROM c""")
def answer_entailment(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", F.round(S.entailment(F.col("p"), F.col("h")), 9).alias("score"))


@query("""SELECT o_orderkey, 'Order ' || o_orderkey || ' was placed in ' || year(o_orderdate) || ' by customer ' || o_custkey || '.' AS claim,
  'Order ' || o_orderkey || ' was placed in ' || (year(o_orderdate) - 5) || ' by customer ' || o_custkey || '.' AS late FROM orders""")
def tampered_years(spark, sf):
    say = lambda y: F.concat(F.lit("Order "), F.col("o_orderkey"), F.lit(" was placed in "), y.cast("string"), F.lit(" by customer "), F.col("o_custkey"), F.lit("."))
    y = F.year("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", say(y).alias("claim"), say(y - 5).alias("late"))


@query("""SELECT p_partkey, 'size ' || p_size || ' mm' AS claim, 'size ' || CASE WHEN p_size < 50 THEN p_size + 20 ELSE greatest(1, p_size // 2) END || ' mm' AS tampered FROM part""")
def tampered_numbers(spark, sf):
    claim = F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit(" mm"))
    return table(spark, sf, "part").select("p_partkey", claim.alias("claim"), S.tamper_number(claim).alias("tampered"))


@query("""WITH s AS (SELECT *, count(*) OVER () AS n FROM supplier)
SELECT a.s_suppkey, d.step, b.s_name AS other_name, b.s_nationkey <> a.s_nationkey AS differs FROM s a, (VALUES (1), (2)) d(step) JOIN s b ON b.s_suppkey = (a.s_suppkey + d.step) % a.n""")
def ring_misattribution(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", (F.col("s_suppkey") + 1).alias("place"))
    out = [R.ring(s, "place", k).select("s_suppkey", F.lit(k).alias("step"), F.col("other_s_name").alias("other_name"), (F.col("other_s_nationkey") != F.col("s_nationkey")).alias("differs")) for k in (1, 2)]
    return out[0].unionByName(out[1])


@query("""WITH m AS (SELECT o_orderkey, year(o_orderdate) AS y, year(o_orderdate) - o_orderkey % 3 AS cited, o_orderpriority = '1-URGENT' AS urgent FROM orders)
SELECT o_orderkey, CASE abs(y - cited) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS year_score,
  round((CASE WHEN urgent THEN 0.6 ELSE 0 END + 0.1 * CASE abs(y - cited) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END) / 0.7, 9)::DOUBLE AS score FROM m""")
def metadata_verification(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    year = S.year_similarity(F.col("y"), F.col("y") - F.col("o_orderkey") % 3)
    title = F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)
    return o.select("o_orderkey", year.alias("year_score"), F.round(S.metadata_score(title, F.lit(None).cast("double"), year), 9).alias("score"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS se, l_tax * 10 AS sm, l_quantity / 50 AS al, (l_linenumber % 3) / 2.0::DOUBLE AS ha FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN 0.25::DOUBLE * se + 0.3::DOUBLE * sm + 0.25::DOUBLE * al + 0.2::DOUBLE * (1 - ha) >= 0.55 THEN 'pass' WHEN l_linenumber % 5 < 3 THEN 'regen' ELSE 'block' END AS decision FROM c""")
def gateway_decisions(spark, sf):
    li = table(spark, sf, "lineitem")
    se, sm, al, ha = F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, (F.col("l_linenumber") % 3) / 2.0
    w = S.VCR_WEIGHTS
    score = w["source_exist"] * se + w["source_match"] * sm + w["alcoa"] * al + w["halluc"] * (1 - ha)
    d = S.decision(score, F.lit(0.55), F.lit(True), F.array(), F.col("l_linenumber") % 5)
    return li.select("l_orderkey", "l_linenumber", d.alias("decision"))


@query(r"""WITH w AS (SELECT unnest(['and the', 'here in', 'ation']) AS w), h AS (SELECT doc_id, n_chars, (SELECT count(*) FROM w WHERE contains(lower(text), w)) AS hits FROM documents)
SELECT doc_id, hits::BIGINT AS hits FROM h WHERE hits > 0 ORDER BY hits DESC, doc_id DESC LIMIT 10""")
def memory_recall(spark, sf):
    hits = sum((F.lower("text").contains(w).cast("bigint") for w in ("and the", "here in", "ation")), F.lit(0).cast("bigint"))
    d = table(spark, sf, "documents").select("doc_id", hits.alias("hits")).where("hits > 0")
    return d.orderBy(F.desc("hits"), F.desc("doc_id")).limit(10)


@query(rf"""WITH t AS (SELECT conv_id, turn, p, unnest(string_split(regexp_replace(trim(h), '([.!?])[ \t\n\r\f\x0B]+', '\1' || chr(1), 'g'), chr(1))) AS s,
  generate_subscripts(string_split(regexp_replace(trim(h), '([.!?])[ \t\n\r\f\x0B]+', '\1' || chr(1), 'g'), chr(1)), 1) AS k FROM {PAIRS} {ASKED}),
x AS (SELECT conv_id, turn, k, {TOKENS.format("s")} AS a, {TOKENS.format("p")} AS b FROM t WHERE s <> '')
SELECT conv_id, turn, (k - 1)::INT AS sentence, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END::DOUBLE, 9) AS best FROM x
WHERE CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END < 0.2""")
def unsupported_sentences(spark, sf):
    parts = F.split(F.trim("h"), r"(?<=[.!?])[ \t\n\r\f\x0B]+")
    got = J.unsupported(pairs(spark, sf), ["conv_id", "turn"], parts, F.array("p"), lambda w, s: T.overlap(s, w), 0.2)
    return got.withColumn("best", F.round("best", 9))
