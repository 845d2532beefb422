"""Gateway scores over conversations, and judged answers made of orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import curation as C
from ..operators import gateway as G
from ..operators import judged as J
from ..sources.tables import table
from .phrases import quoted, said, said_sql
from .registry import query
from .verification import ASKED, NEG, NLI_TOKENS, PAIRS, _mates, pairs


def _entailment_sql(p: str, h: str) -> str:
    """SQL: cosine of two token lists with the polarity factor."""
    return f"""(CASE WHEN len(list_intersect({h}, {p})) = 0 THEN 0 ELSE len(list_intersect({h}, {p})) / sqrt(len({h}) * len({p})) END
      * CASE WHEN len(list_intersect(list_filter(list_transform({h}, lambda x: {_mates()}), lambda x: x IS NOT NULL), {p})) > 0 OR ({NEG.format(h)}) <> ({NEG.format(p)}) THEN 0.35 ELSE 1 END)"""


@query(f"""WITH d AS (SELECT count(*) AS n FROM documents), f AS (SELECT token, count(*) AS df FROM (SELECT unnest({NLI_TOKENS.format("coalesce(text, '')")}) AS token FROM documents) GROUP BY token),
w AS (SELECT token, ln((n + 1) / (df + 1)) + 1 AS idf FROM f, d), t AS (SELECT conv_id, turn, {NLI_TOKENS.format("coalesce(h, '')")} AS h, {NLI_TOKENS.format("coalesce(p, '')")} AS p FROM {PAIRS} {ASKED}),
u AS (SELECT conv_id, turn, unnest(list_distinct(list_concat(p, h))) AS token, p, h FROM t),
g AS (SELECT conv_id, turn, any_value(p) AS p, any_value(h) AS h, sum(CASE WHEN list_contains(p, u.token) AND list_contains(h, u.token) THEN coalesce(idf, ln(n + 1) + 1) ** 2 END) AS dot,
  sum(CASE WHEN list_contains(p, u.token) THEN coalesce(idf, ln(n + 1) + 1) ** 2 END) AS np, sum(CASE WHEN list_contains(h, u.token) THEN coalesce(idf, ln(n + 1) + 1) ** 2 END) AS nh FROM u LEFT JOIN w ON w.token = u.token, d GROUP BY conv_id, turn)
SELECT conv_id, turn, round(CASE WHEN dot > 0 THEN dot / sqrt(np * nh) ELSE 0 END
  * CASE WHEN len(list_intersect(list_filter(list_transform(h, lambda x: {_mates()}), lambda x: x IS NOT NULL), p)) > 0 OR ({NEG.format("h")}) <> ({NEG.format("p")}) THEN 0.35 ELSE 1 END, 9)::DOUBLE AS score FROM g""")
def fitted_entailment(spark, sf):
    weights = G.fitted_idf(table(spark, sf, "documents"), "text")
    got = G.fitted_entailment(pairs(spark, sf), ["conv_id", "turn"], weights, "p", "h")
    return got.withColumn("score", F.round("score", 9))


LONG = "Water was measured at 5 mg there 10.9999/unknown. Then see https://a.org/x. And water decreases in 3 mg of the later long long sample (see Lee et al. 2019)."
BLOCK = "강물이 따뜻하다 (출처: 한국연구원, 2021, 과제번호 AB-12345)."
#: Answers; the claims that their citations carry, how far those reach, and how much of what can be checked is false.
#: A citation that runs over a sentence's end, or whose own point ends one, is said of the whole text; so is one after less than ten characters.
SAID = [
    ("The warm river rises slowly.", [], 0.0, 0.0),
    ("The warm river rises slowly (Kim et al., 2020).", ["The warm river rises slowly"], 1.0, 0.0),
    ("The warm river rises. It is not cold here 10.1234/known.5. More follows without a source.", ["It is not cold here"], 2 / 3, 0.0),
    (LONG, [LONG, LONG], 1.0, 1.0),
    ('It says "a title of unheard wonders beyond" in the warm river.', ["It says  in the warm river"], 1.0, 1.0),
    (BLOCK, [BLOCK], 1.0, 1.0),
]


EVIDENCE = "the warm river rises slowly with water measured at 5 mg in a sample "


def _claims_sql() -> str:
    return "([" + ", ".join("[" + ", ".join(map(quoted, c)) + "]::VARCHAR[]" for _, c, _, _ in SAID) + "])[k + 1]"


def _numbers_sql(values: list[float]) -> str:
    return "([" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "])[k + 1]"


ANSWERS = f"""WITH x AS (SELECT conv_id, turn, (conv_id + turn) % {len(SAID)} AS k, '{EVIDENCE}' || p AS g FROM {PAIRS} {ASKED}),
y AS (SELECT conv_id, turn, k, {NLI_TOKENS.format("g")} AS p, {_claims_sql()} AS claims FROM x)
"""


def answers(spark, sf):
    a = pairs(spark, sf).withColumn("_k", F.col("conv_id") + F.col("turn"))
    return a.select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"), said("_k", [s[0] for s in SAID]).alias("response"), F.array(F.concat(F.lit(EVIDENCE), "p")).alias("grounding"), F.when(F.col("turn") % 4 == 1, "m1").otherwise("unknown").alias("model_id"))


def registry(spark):
    return spark.createDataFrame([("10.1234/known.5",)], "doi string")


@query(ANSWERS + f"""SELECT conv_id, turn, round({_numbers_sql([s[2] for s in SAID])}, 4) AS source_exist,
  round(CASE WHEN len(claims) = 0 THEN 0 ELSE list_avg(list_transform(claims, lambda c: {_entailment_sql("p", "(" + NLI_TOKENS.format("c") + ")")})) END, 4)::DOUBLE AS source_match FROM y""")
def source_matches(spark, sf):
    return G.score(answers(spark, sf), "id", registry(spark)).select("conv_id", "turn", "source_exist", "source_match")


@query(ANSWERS + f"""SELECT conv_id, turn, round({_numbers_sql([s[3] for s in SAID])}, 4) AS invented FROM y""")
def invented_citations(spark, sf):
    from ..functions.citations import cited

    a = answers(spark, sf).withColumn("c", cited(F.col("response"))).withColumn("cites", F.col("c.cites"))
    a = G.known_dois(a, "id", "cites", registry(spark)).withColumn("grounding", F.array(F.lit(EVIDENCE)))
    return a.select("conv_id", "turn", F.round(G.invented(F.col("cites"), F.col("grounding"), F.col("known")), 4).alias("invented"))


@query(f"""WITH t AS (SELECT (conv_id + turn) % {len(SAID)} AS k, turn FROM {PAIRS} {ASKED}) SELECT k::BIGINT AS k, turn % 4 = 1 AS known, count(*)::BIGINT AS n FROM t GROUP BY 1, 2""")
def gateway_answers(spark, sf):
    """Every answer reaches a decision: none is lost on the way from text to decision."""
    a = answers(spark, sf)
    scored = G.score(a, "id", registry(spark))
    done = G.decide(scored, G.unsupported_sentences(a, ["id"], 0.2), "id", 0.6)
    d = done.where(F.col("decision").isin("pass", "regen") & F.col("vcr").between(0, 1))
    return d.groupBy(((F.col("conv_id") + F.col("turn")) % len(SAID)).alias("k"), (F.col("model_id") == "m1").alias("known")).agg(F.count("*").alias("n"))


# judged answers: an order is an answer, its lines are its sentences

TASKS = ["summary", "conditions", "qa"]
LINES = ["plain text", "key: value", "항목: 값 하나"]
SENTS = f"""s AS (SELECT l_orderkey AS k, list(struct_pack(t := {said_sql("l_linenumber", LINES)}, u := l_linenumber = 7, v := l_linenumber = 6, m := l_discount * 10, e := l_tax * 12.5) ORDER BY l_linenumber, l_discount, l_tax) AS sents FROM lineitem GROUP BY l_orderkey)"""
JUDGED = f"""WITH {SENTS}, j AS (SELECT o_orderkey AS k, 'd' || o_custkey % 40 AS doc, 'passage ' || o_custkey % 60 AS passage, {said_sql("o_orderkey", TASKS)} AS task, CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 4 > 0 THEN 'q' || o_orderkey % 2 END AS question,
  'answer ' || o_orderkey % 9 AS answer, o_orderkey % 13 = 0 AS pii, o_orderkey % 17 = 0 AS sensitive, CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 5 > 0 THEN (o_orderkey % 10) / 10 END::DOUBLE AS qa_ok, coalesce(sents, []) AS sents FROM orders LEFT JOIN s ON s.k = o_orderkey),
c AS (SELECT *, list_transform(sents, lambda x: CASE WHEN x.u THEN 0 WHEN x.v THEN x.m WHEN x.e < 0.005 OR x.e >= 0.98 THEN x.e ELSE x.m END) AS cs, NOT pii AND NOT sensitive AND len(sents) > 0 AS clean FROM j),
v AS (SELECT *, clean AND len(list_filter(cs, lambda x: x < 0.01)) = 0 AS cascade, clean AND len(list_filter(sents, lambda x: x.m < 0.01)) = 0 AS llm, coalesce(qa_ok >= 0.5, true) AS fits FROM c)
"""


def judged(spark, sf, shift: float = 0.0):
    li = table(spark, sf, "lineitem")
    s = F.struct("l_linenumber", said("l_linenumber", LINES).alias("text"), (F.col("l_linenumber") == 7).alias("unit_swap"), (F.col("l_linenumber") == 6).alias("novel_num"), (F.col("l_discount") * 10 - shift).alias("llm"), (F.col("l_tax") * 12.5).alias("enc"))
    sents = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(s)).alias("sents"))
    o, k = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "k"), F.col("k")
    empty = F.array().cast(sents.schema["sents"].dataType)
    return o.join(sents, "k", "left").select(
        "k", F.concat(F.lit("d"), F.col("o_custkey") % 40).alias("doc"), F.concat(F.lit("passage "), F.col("o_custkey") % 60).alias("passage"), said("k", TASKS).alias("task"),
        F.when((k % 3 == 2) & (k % 4 > 0), F.concat(F.lit("q"), k % 2)).alias("question"), F.concat(F.lit("answer "), k % 9).alias("answer"), (k % 13 == 0).alias("pii"), (k % 17 == 0).alias("sensitive"),
        F.when((k % 3 == 2) & (k % 5 > 0), (k % 10) / 10).alias("qa_ok"), F.coalesce("sents", empty).alias("sents"),
    )


@query(JUDGED + """SELECT task, count(*)::BIGINT AS n, avg(cascade::INT) AS cascade, avg(llm::INT) AS llm, avg((cascade AND NOT llm)::INT) AS cascade_only, avg((llm AND NOT cascade)::INT) AS llm_only,
  avg(CASE WHEN qa_ok IS NOT NULL THEN fits::INT END) AS qa_ok, avg((cascade AND fits)::INT) AS "final" FROM v GROUP BY ROLLUP (task)""")
def judge_reports(spark, sf):
    return J.report(judged(spark, sf))


JUDGES = {"a": 0.15, "b": 0.2, "c": 0.25}
VOTES = """, w AS (SELECT *, (len(list_filter(sents, lambda x: x.m < 0.15)) = 0)::INT + (len(list_filter(sents, lambda x: x.m - 0.02 < 0.2)) = 0)::INT + (len(list_filter(sents, lambda x: x.m - 0.04 < 0.25)) = 0)::INT AS votes, CASE WHEN task = 'qa' THEN coalesce(trim(question), '') ELSE '' END AS q,
  replace(passage, ' ', '') AS pk, coalesce(qa_ok >= 0.5, false) AS fit FROM c WHERE NOT pii AND NOT sensitive AND len(sents) > 0 AND passage <> 'passage 7'),
y AS (SELECT *, CASE WHEN votes = 3 AND (task <> 'qa' OR fit) THEN 'good' WHEN votes < 2 OR (task = 'qa' AND NOT fit) THEN 'bad' END AS verdict FROM w WHERE task <> 'qa' OR q <> '')
"""


def agreed(spark, sf):
    each = {"a": judged(spark, sf), "b": judged(spark, sf, 0.02), "c": judged(spark, sf, 0.04)}
    held = spark.createDataFrame([("passage  7",)], "passage string")
    return J.agreed(J.aligned(each, ["k"]), JUDGES, held)


@query(JUDGED + VOTES + "SELECT task, verdict, votes::INT AS votes, count(*)::BIGINT AS n FROM y GROUP BY ALL")
def judge_agreement(spark, sf):
    return agreed(spark, sf).groupBy("task", "verdict", "votes").agg(F.count("*").alias("n"))


@query(JUDGED + VOTES + """, r AS (SELECT *, row_number() OVER (PARTITION BY pk, task, q, verdict ORDER BY k) AS i FROM y WHERE verdict IS NOT NULL)
SELECT g.pk AS passage_key, g.task, g.q AS question, g.answer AS chosen, b.answer AS rejected FROM r g JOIN r b ON g.pk = b.pk AND g.task = b.task AND g.q = b.q AND g.i = b.i AND g.verdict = 'good' AND b.verdict = 'bad' WHERE g.answer <> b.answer""")
def consensus_pairs(spark, sf):
    return J.preference_pairs(agreed(spark, sf), JUDGES, ["k"])


@query(JUDGED + """, x AS (SELECT k, doc, unnest(sents) AS s, generate_subscripts(sents, 1) - 1 AS sentence FROM c WHERE NOT passage = 'passage 7'),
z AS (SELECT *, (s.m >= 0.15)::INT + (s.m - 0.02 >= 0.2)::INT + (s.m - 0.04 >= 0.25)::INT AS votes FROM x WHERE NOT s.u AND s.t = 'plain text'),
l AS (SELECT *, CASE WHEN votes = 3 THEN 'entail' WHEN votes < 2 THEN 'neutral' END AS label FROM z),
n AS (SELECT count(*) FILTER (label = 'entail') AS e, count(*) FILTER (label = 'neutral') AS n FROM l), m AS (SELECT *, least(e, 2 * n) AS most, least(1.0::DOUBLE, 300 / (least(e, 2 * n) + n)) AS share FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('d:' || k || ':' || sentence), k, sentence) AS i FROM l WHERE label IS NOT NULL)
SELECT k, sentence::INT AS sentence, doc, label FROM r, m WHERE i <= CASE WHEN share < 1 THEN floor(CASE label WHEN 'entail' THEN most ELSE n END * share) ELSE CASE label WHEN 'entail' THEN most ELSE n END END""")
def consensus_sentences(spark, sf):
    each = {"a": judged(spark, sf), "b": judged(spark, sf, 0.02), "c": judged(spark, sf, 0.04)}
    held = spark.createDataFrame([("passage 7",)], "passage string")
    got = J.distilled(J.aligned(each, ["k"]), JUDGES, ["k"], cap=300, heldout=held)
    return got.select("k", "sentence", "doc", "label")


@query(JUDGED + """SELECT k, CASE WHEN len(sents) = 0 THEN false ELSE len(list_filter(sents, lambda x: CASE WHEN x.t = 'plain text' THEN x.m < 0.3 ELSE (x.m >= 0.5)::INT + (x.m + 0.05 >= 0.5)::INT + (x.e >= 0.5)::INT + (x.m * 2 >= 0.5)::INT < 3 END)) = 0 END AS passes FROM c""")
def key_value_rows(spark, sf):
    j = judged(spark, sf).select("k", "sents").withColumn("kv", F.transform("sents", lambda s: J.is_key_value(s["text"])))
    one = lambda f: F.transform("sents", lambda s, i: F.when(F.get("kv", i), f(s)))
    kv = F.array(one(lambda s: s["llm"]), one(lambda s: s["llm"] + 0.05), one(lambda s: s["enc"]), one(lambda s: s["llm"] * 2))
    return j.select("k", J.kv_row_passes(kv, F.transform("sents", lambda s: s["llm"] >= 0.3)).alias("passes"))


@query(JUDGED + """ SELECT count(DISTINCT doc)::BIGINT AS documents, count(*)::BIGINT AS n FROM j""")
def group_documents(spark, sf):
    d = J.leakage_safe_split(judged(spark, sf).select("doc", "passage"), 10)
    return d.agg(F.count_distinct("doc").alias("documents"), F.count("*").alias("n"))


SPLIT = """WITH RECURSIVE j AS (SELECT o_orderkey AS k, 'd' || o_custkey AS doc, 'p' || CASE WHEN o_custkey % 4 = 0 THEN o_custkey // 8 ELSE 1000000 + o_custkey END AS passage FROM orders),
e AS (SELECT DISTINCT a.doc AS a, b.doc AS b FROM (SELECT DISTINCT doc, passage FROM j) a JOIN (SELECT DISTINCT doc, passage FROM j) b USING (passage)), g AS (SELECT a AS doc, min(b) AS grp FROM e GROUP BY a),
x AS (SELECT doc, grp, sha256(grp) AS h FROM g)
"""
_REST = "0"
for _k in range(8):
    _REST = f"(({_REST}) * {(1 << 32) % 7} + ('0x' || substr(h, {8 * _k + 1}, 8))::BIGINT) % 7"


@query(SPLIT + f"""SELECT doc, grp AS "group", ({_REST}) = 0 AND grp NOT IN (SELECT grp FROM g WHERE substr(doc, 2)::INT % 50 = 0) AS held FROM x""")
def leakage_safe_split(spark, sf):
    o = table(spark, sf, "orders")
    c = F.col("o_custkey")
    rows = o.select(F.concat(F.lit("d"), c).alias("doc"), F.concat(F.lit("p"), F.when(c % 4 == 0, F.floor(c / 8)).otherwise(c + 1000000)).alias("passage"))
    seen = rows.where(F.substring("doc", 2, 20).cast("int") % 50 == 0).select("doc", F.lit("unseen").alias("passage"))
    return J.leakage_safe_split(rows, 7, seen).select("doc", "group", "held").distinct()


@query("""WITH p AS (SELECT o_orderkey AS k, 'prompt ' || o_custkey % 30 AS prompt, 'yes ' || o_orderkey % 4 AS chosen, CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey % 11) / 10 END::DOUBLE AS c, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 5) / 10 END::DOUBLE AS r FROM orders)
SELECT prompt, chosen, count(*)::BIGINT AS n FROM p WHERE coalesce(c, 1) > coalesce(r, 0) AND coalesce(c, 1) >= 0.4 GROUP BY 1, 2""")
def accepted_pairs(spark, sf):
    k = F.col("o_orderkey")
    p = table(spark, sf, "orders").select(F.concat(F.lit("prompt "), F.col("o_custkey") % 30).alias("prompt"), F.concat(F.lit("yes "), k % 4).alias("chosen"), F.when(k % 6 > 0, (k % 11) / 10).alias("vcr_chosen"), F.when(k % 7 > 0, (k % 5) / 10).alias("vcr_rejected"))
    return J.accepted_pairs(p, 0.4).groupBy("prompt", "chosen").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT 'prompt ' || o_custkey % 30 AS prompt, 'yes ' || o_orderkey % 4 AS chosen, 'user' AS first_role, 2::INT AS messages FROM orders""")
def sft_examples(spark, sf):
    p = table(spark, sf, "orders").select(F.concat(F.lit("prompt "), F.col("o_custkey") % 30).alias("prompt"), F.concat(F.lit("yes "), F.col("o_orderkey") % 4).alias("chosen"))
    return J.sft_examples(p).select("prompt", "chosen", F.col("messages")[0]["role"].alias("first_role"), F.size("messages").alias("messages"))


@query(JUDGED + """SELECT k FROM j WHERE ('p' || k % 50, answer) NOT IN (SELECT ('p' || k % 50, answer) FROM j WHERE task = 'qa' AND qa_ok < 0.5)""")
def without_bad_pairs(spark, sf):
    j = judged(spark, sf).withColumn("prompt", F.concat(F.lit("p"), F.col("k") % 50))
    return J.without_bad_pairs(j.select("k", "prompt", "answer"), j).select("k")


@query(JUDGED + """SELECT k, CASE WHEN task <> 'qa' THEN NULL WHEN coalesce(trim(question), '') <> '' AND coalesce(qa_ok >= 0.5, true) THEN trim(question) END AS asked, CASE WHEN task <> 'qa' THEN '' END AS told,
  coalesce(question, CASE WHEN task = 'qa' THEN 'what of ' || k ELSE '' END) AS recovered, md5(CASE task WHEN 'summary' THEN 'sum up' WHEN 'conditions' THEN 'list' ELSE coalesce(question, '?') END || chr(10) || chr(10) || CASE WHEN k % 2 = 0 THEN '[논문 초록]' ELSE '[연구노트]' END || chr(10) || passage) AS prompt FROM j""")
def prompts_and_questions(spark, sf):
    j, k = judged(spark, sf), F.col("k")
    kind = F.when(k % 2 == 0, "abstract").otherwise("note")
    asks = {"summary": "sum up", "conditions": "list"}
    made = J.prompt(F.col("task"), F.concat(F.lit("what of "), k), F.col("passage"), kind, asks)
    return j.select(
        "k", J.sampled_question(F.col("task"), F.col("question"), F.col("qa_ok"), True).alias("asked"), J.sampled_question(F.col("task"), F.col("question"), F.col("qa_ok")).alias("told"),
        J.question_of(F.col("task"), F.col("question"), made).alias("recovered"), F.md5(J.prompt(F.col("task"), F.coalesce("question", F.lit("?")), F.col("passage"), kind, asks)).alias("prompt"),
    )


REASONS = ["pass", "empty", "pass", "pii", "sensitive", "unsupported", "pass"]
RUN = f"(SELECT o_orderkey AS k, {said_sql('o_orderkey', TASKS)} AS task, {said_sql('o_orderkey', REASONS)} AS reason, {said_sql('o_orderkey // 2', REASONS)} AS later, (o_orderkey % 6) AS n_sent, (o_orderkey % 6) * (o_orderkey % 2) AS n_supported, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 5) / 5 END::DOUBLE AS num_recall FROM orders)"


def run(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "k").withColumn("_h", F.floor(F.col("k") / 2))
    k = F.col("k")
    return o.select("k", said("k", TASKS).alias("task"), said("k", REASONS).alias("reason"), said("_h", REASONS).alias("later"), (k % 6).alias("n_sent"), ((k % 6) * (k % 2)).alias("n_supported"), F.when(k % 4 > 0, (k % 5) / 5).alias("num_recall"))


@query(f"""WITH g AS (SELECT task, count(*)::BIGINT AS n, count(*) FILTER (reason = 'pass') AS k, sum(n_supported)::DOUBLE / greatest(1, sum(n_sent)) AS supported, avg(n_sent) AS sentences, avg(num_recall) AS number_recall, count(*) FILTER (reason = 'empty')::BIGINT AS empty, count(*) FILTER (reason = 'pii')::BIGINT AS pii,
  count(*) FILTER (reason = 'sensitive')::BIGINT AS sensitive, count(*) FILTER (reason = 'unsupported')::BIGINT AS unsupported FROM {RUN} GROUP BY ROLLUP (task)), p AS (SELECT *, k / n AS q, 1.96::DOUBLE AS z FROM g)
SELECT * EXCLUDE (k, q, z), q AS pass_rate, ((q + z*z/(2*n)) - z * sqrt(q*(1-q)/n + z*z/(4*n*n))) / (1 + z*z/n) AS low, ((q + z*z/(2*n)) + z * sqrt(q*(1-q)/n + z*z/(4*n*n))) / (1 + z*z/n) AS high FROM p""")
def run_summary(spark, sf):
    return J.run_summary(run(spark, sf).drop("later"))


@query(f"SELECT count(*)::BIGINT AS n, avg(((reason = 'pass') = (later = 'pass'))::INT) AS agree, count(*) FILTER (reason = 'pass' AND later <> 'pass')::BIGINT AS before_only, count(*) FILTER (reason <> 'pass' AND later = 'pass')::BIGINT AS after_only FROM {RUN}")
def rejudged(spark, sf):
    r = run(spark, sf)
    return J.rejudged(r.select("k", "reason"), r.select("k", F.col("later").alias("reason")), "k")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY sha256(doc_id::VARCHAR), doc_id) - 1) % 4)::INT AS shard FROM documents")
def sharded_passages(spark, sf):
    return C.shards(table(spark, sf, "documents").select("doc_id"), "doc_id", 4)


@query(f"""WITH x AS (SELECT doc_id, ({said_sql("doc_id", ["실험일 202O-O3-3O 끝", "2O2l.l.2 와 2020/12/3l", "none", "2019년 1월 5 "])}) || ' ' || doc_id AS t FROM documents)
SELECT doc_id, (['실험일 2020-03-30 끝', '2021-01-02 와 2020-12-31', 'none', '2019-01-05 '])[doc_id % 4 + 1] || ' ' || doc_id AS t FROM x""")
def repaired_dates(spark, sf):
    t = F.concat(said("doc_id", ["실험일 202O-O3-3O 끝", "2O2l.l.2 와 2020/12/3l", "none", "2019년 1월 5 "]), F.lit(" "), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", T.ocr_dates(t).alias("t"))


@query("""SELECT n_nationkey, n_name || CASE WHEN n_nationkey % 3 = 1 THEN '한을' ELSE '나를' END AS told FROM nation""")
def particles(spark, sf):
    word = F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 1, "한").otherwise("나"))
    return table(spark, sf, "nation").select("n_nationkey", T.particle(word, "을", "를").alias("told"))


@query("""WITH t AS (SELECT sum((l_returnflag = 'R')::INT * (l_linestatus = 'O')::INT)::BIGINT AS b, sum((l_returnflag = 'A')::INT * (l_linestatus = 'F')::INT)::BIGINT % 40 AS c FROM lineitem)
SELECT 12::BIGINT AS b, c, least(1.0::DOUBLE, 2 * list_sum(list_transform(range(least(12, c)::BIGINT + 1), lambda i: exp(lgamma(12 + c + 1) - lgamma(i + 1) - lgamma(12 + c - i + 1) - (12 + c) * ln(2.0::DOUBLE))))) AS p FROM t""")
def mcnemar_p(spark, sf):
    li = table(spark, sf, "lineitem").agg((F.count_if((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")) % 40).alias("c"))
    return li.select(F.lit(12).cast("bigint").alias("b"), "c", S.mcnemar(F.lit(12).cast("bigint"), F.col("c")).alias("p"))
