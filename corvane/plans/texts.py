"""What sentences, notes, records and audit trails say: fixed texts dealt to the rows of a table, with what must come of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import claims as C
from ..functions import integrity as I
from ..functions import notes as N
from ..functions import scores as S
from ..functions import text as T
from ..operators import gateway as G
from ..operators import records as A
from ..sources.tables import table
from .phrases import quoted, said
from .registry import query


def expected(table_: str, key: str, rows: list[tuple], columns: dict[str, str]) -> str:
    """SQL: each key with the values that belong to its phrase; columns: name to SQL type."""
    def lit(v):
        return "NULL" if v is None else quoted(v) if isinstance(v, str) else repr(v).lower() if isinstance(v, bool) else repr(v)

    cols = ", ".join(f"([{', '.join(lit(r[j]) for r in rows)}])[{key} % {len(rows)} + 1]::{t} AS {c}" for j, (c, t) in enumerate(columns.items()))
    return f"SELECT {key}, {cols} FROM {table_}"


# sentence, claim?, evidence?, quantitative?, numbers with units, content words
SENTENCES = [
    ("The yield increased significantly in treated cells", True, False, False, "", 5),
    ("Water 5 mg and 20 mg were measured", False, True, False, "20mg,5mg", 2),
    ("A superior effect of 3 mg and 4 mg and 5 mg in groups", False, True, False, "3mg,4mg,5mg", 3),
    ("fix: increase speed in module parser", False, False, False, "", 5),
    ("시료의 수율이 크게 증가하였다 5 mg", True, False, False, "5mg", 4),
    ("시료 12 ℃ 와 30 분 처리", False, True, False, "12℃,30분", 2),
    ("nothing", False, False, False, "", 1),
    ("Dose was higher at 40 % of 2 mg", False, True, True, "2mg,40%", 2),
]




@query(expected("documents", "doc_id", [(b, c, e, f) for _, b, c, _, e, f in SENTENCES], {"claim": "BOOLEAN", "evidence": "BOOLEAN", "numbers": "VARCHAR", "words": "INT"}))
def sentence_kinds(spark, sf):
    s = said("doc_id", [x[0] for x in SENTENCES])
    return table(spark, sf, "documents").select("doc_id", C.is_claim(s).alias("claim"), C.is_evidence(s).alias("evidence"), F.array_join(F.array_sort(C.numbers(s)), ",").alias("numbers"), F.size(T.content_words(s)).alias("words"))


# claim, evidence, supports?, shared exact numbers, swapped units, novel numbers
PAIRS = [
    ("enzyme yield rose to 5 mg", "measured enzyme yield 5 mg in vessel", True, "5mg", "", ""),
    ("enzyme rose to 5 mg", "enzyme gave 5 mg there", True, "5mg", "", ""),
    ("enzyme rose to 5 mg", "enzyme gave 7 mg there", False, "", "", "5"),
    ("total mass of 5 g here", "total gave 5 mg there", False, "", "5g", ""),
    ("total mass of 1 g here", "total gave 1 mg there", False, "", "", ""),
    ("at 3 mg or 1,000 units", "some 3 mg and 1000 things", False, "3mg", "", ""),
    ("ratio 0.50 seen with 8 items", "ratio 0.5 seen", True, "", "", "8"),
]


@query(expected("orders", "o_orderkey", [p[2:] for p in PAIRS], {"supports": "BOOLEAN", "shared": "VARCHAR", "swapped": "VARCHAR", "novel": "VARCHAR"}))
def pair_checks(spark, sf):
    a, b = said("o_orderkey", [p[0] for p in PAIRS]), said("o_orderkey", [p[1] for p in PAIRS])
    join = lambda c: F.array_join(c, ",")
    return table(spark, sf, "orders").select("o_orderkey", C.supports(a, b).alias("supports"), join(C.shared_numbers(a, b)).alias("shared"), join(S.unit_swaps(a, b)).alias("swapped"), join(S.novel_numbers(a, b)).alias("novel"))


# text, gate sentences, corpus sentences of 15 characters or more, abstract sentences, claims
SPLITS = [
    ("One two. Three four! 결과다. 끝", 3, 1, 4, 4),
    ("a\nb\nlonger line of text here\n", 1, 1, 1, 3),
    ("", 1, 0, 0, 0),
    ("Is it? Yes it is! 그렇다。 수율은 높았다 그리고", 3, 1, 3, 4),
]


@query(expected("nation", "n_nationkey", [(s[3], s[4]) for s in SPLITS], {"abstract": "INT", "claims": "INT"}))
def sentence_counts(spark, sf):
    t = said("n_nationkey", [s[0] for s in SPLITS])
    return table(spark, sf, "nation").select("n_nationkey", F.size(C.abstract_sentences(t)).alias("abstract"), F.size(T.claims(t)).alias("claims"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE (['', '5', '3'])[n_nationkey % 3 + 1]::INT END AS windows, (n_nationkey % 3 = 0 OR true) AS bounded FROM nation""")
def text_windows(spark, sf):
    one = "alpha beta gamma delta word"  # 27 characters
    t = F.when(F.col("n_nationkey") % 3 == 0, "short text").when(F.col("n_nationkey") % 3 == 1, (one + "\n") * 120).otherwise((("x" * 500) + "\n") * 3)
    w = C.windows(t)
    return table(spark, sf, "nation").select("n_nationkey", F.size(w).alias("windows"), F.forall(w, lambda x: F.length(x) <= 1001).alias("bounded"))


RECORDS = [
    ("연구자: 김민준\n점검자: 박서연\n실험일: 2024-03-01\n기록일: 2024-03-02\n4. 결과\n5 mg 과 20 분\n5. 고찰\n수율은 5 mg 로 확인되었다. \n", "", 1.0, 1.0, 1.0, 1.0, 1.0),
    ("연구자: 김민준\n점검자: (서명 없음)\n실험일: 2024-03-01\n기록일: 2024-03-19\n4. 결과\n5 mg\n5. 고찰\n수율은 9 mg 로 확인되었다. \n", "", 0.6, 0.5, 1.0, 1.0, 0.0),
    ("연구자: 미기재\n점검자: 박서연\n실험일: 2024-03-05\n기록일: 2024-03-01\n4. 결과\n7 mg TBD\n5. 고찰\n", "4. 결과\n5 mg\n5. 고찰\n", 0.4, 0.0, 0.0, 0.0, 1.0),
    ("실험 메모 없음\n정정 사유: 오타\n7 mg", "5 mg", 0.0, 0.0, 1.0, 1.0, 1.0),
]


@query(expected("customer", "c_custkey", [r[2:] for r in RECORDS], {"attributable": "DOUBLE", "contemporaneous": "DOUBLE", "original": "DOUBLE", "complete": "DOUBLE", "consistent": "DOUBLE"}))
def record_integrity(spark, sf):
    t, e = said("c_custkey", [r[0] for r in RECORDS]), said("c_custkey", [r[1] for r in RECORDS])
    r = table(spark, sf, "customer").select("c_custkey", I.record_report(t, e).alias("r"))
    return r.select("c_custkey", F.round("r.attributable", 9).alias("attributable"), F.round("r.contemporaneous", 9).alias("contemporaneous"), "r.original", "r.complete", "r.consistent")


# text, evidence, model known: alcoa score, changed numbers. A number with a space before its unit counts as bare too, and k is a unit.
ALCOA = [
    ("No numbers at all here", "5 mg", True, 1.0, 0.0), ("5 mg and 7", "5 mg", False, (0.5 + 0.0 + 1 + 1) / 4, 0.0), ("Values 3 % and 4 % and 5 %", "3 % seen", True, (1 + 0.5 + 1 + 0) / 4, 2 / 3),
    ("TBD 5 mm", "7 mm", True, (1 + 0.5 + 0 + 1) / 4, 1.0), ("8 kg", "none", True, (1 + 0.5 + 1 + 1) / 4, 0.0),
]


@query(expected("supplier", "s_suppkey", [(round(a[4], 9),) for a in ALCOA], {"changed": "DOUBLE"}))
def changed_numbers(spark, sf):
    t, e = said("s_suppkey", [a[0] for a in ALCOA]), said("s_suppkey", [a[1] for a in ALCOA])
    return table(spark, sf, "supplier").select("s_suppkey", F.round(I.changed_numbers(t, e), 9).alias("changed"))


@query(expected("supplier", "s_suppkey", [(round(a[3], 9),) for a in ALCOA], {"score": "DOUBLE"}))
def alcoa_scores(spark, sf):
    t, m = said("s_suppkey", [a[0] for a in ALCOA]), F.element_at(F.array(*[F.lit(a[2]) for a in ALCOA]), (F.col("s_suppkey") % len(ALCOA) + 1).cast("int"))
    return table(spark, sf, "supplier").select("s_suppkey", F.round(I.alcoa(t, m, F.lit(True)), 9).alias("score"))


NOTES = [
    ("과제명: 수율 연구\n연구자: 김민준\n실험일: 2024-03-01\n----\n1. 목적\n높은 수율을 얻는 긴 줄이 이어지는 문장으로서 끝이 없는\n다음 줄\n4. 결과\n5 mg\n", 3, 2, 5 / 11, True),
    ("과제번호 AB-1\n기관: 연구원\n작성자 박서연\n점검자: 최\n기록일 2024.1.2\n2. 방법\n혼합\n5. 고찰\n끝", 5, 2, 7 / 11, True),
    ("plain text", 0, 0, 0.0, False),
]


@query(expected("region", "r_regionkey", [(n[1], n[2], round(n[3], 3), n[4]) for n in NOTES], {"fields": "INT", "sections": "INT", "completeness": "DOUBLE", "usable": "BOOLEAN"}))
def parsed_notes(spark, sf):
    t = N.rejoined(said("r_regionkey", [n[0] for n in NOTES]))
    d = table(spark, sf, "region").select("r_regionkey", N.meta(t).alias("m"), N.sections(t).alias("s"))
    d = d.withColumn("q", N.quality(F.col("m"), F.col("s")))
    return d.select("r_regionkey", F.size("m").alias("fields"), F.size("s").alias("sections"), "q.completeness", "q.usable")


JOINS = [
    ("first line that is long enough and goes on\nto the next\n--\nlabel: value\nend of it.\n", "first line that is long enough and goes on to the next\nlabel: value\nend of it."),
    ("short\nlines\n1. header", "short\nlines\n1. header"),
    ("a sentence that is long and ends here.\nnext line", "a sentence that is long and ends here.\nnext line"),
]


@query(expected("region", "r_regionkey", [(j[1],) for j in JOINS], {"joined": "VARCHAR"}))
def rejoined_lines(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", N.rejoined(said("r_regionkey", [j[0] for j in JOINS])).alias("joined"))


# audit trails of two entries: an order is created and then signed

def _entry_sql(k: str, seq: int, action: str, content: str, meaning: str, prev: str) -> str:
    sha = f"sha256({content})"
    return f"""sha256('{{"action": "{action}", "actor": "c' || c || '", "content": ' || to_json({content}) || ', "content_sha256": "' || {sha} || '", "meaning": "{meaning}", "prev": "' || {prev} || '", "reason": "", "record_id": "r' || k || '", "seq": {seq}, "ts": "2024-01-01"}}')"""


TEXT = "'order \"' || k || '\"' || chr(10) || '수율'"
CHAIN = f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), a AS (SELECT *, {_entry_sql("k", 0, "create", TEXT, "", quoted(A.GENESIS))} AS h0 FROM o),
b AS (SELECT *, {_entry_sql("k", 1, "sign", TEXT, "승인", "h0")} AS h1 FROM a)
"""


def chain(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat(F.lit('order "'), k, F.lit('"\n수율'))
    base = table(spark, sf, "orders").select(k.alias("k"), k.alias("chain"), F.concat(F.lit("c"), "o_custkey").alias("actor"), F.concat(F.lit("r"), k).alias("record_id"), text.alias("content"), F.sha2(text, 256).alias("content_sha256"), F.lit("").alias("reason"), F.lit("2024-01-01").alias("ts"))
    first = base.withColumns({"seq": F.lit(0), "action": F.lit("create"), "meaning": F.lit(""), "prev": F.lit(A.GENESIS)})
    first = first.withColumn("hash", A.entry_hash(*A.FIELDS))
    second = first.withColumns({"seq": F.lit(1), "action": F.lit("sign"), "meaning": F.lit("승인"), "prev": F.col("hash")}).withColumn("hash", A.entry_hash(*A.FIELDS))
    return first.unionByName(second)


@query(CHAIN + "SELECT k AS chain, h1 AS head FROM b")
def chain_heads(spark, sf):
    return A.chain_heads(chain(spark, sf))


@query("""WITH t AS (SELECT o_orderkey AS chain FROM orders) SELECT chain, 0 AS seq, 'content' AS finding FROM t WHERE chain % 5 = 0 UNION ALL SELECT chain, 0, 'hash' FROM t WHERE chain % 5 = 0 UNION ALL SELECT chain, 1, 'hash' FROM t WHERE chain % 7 = 0 UNION ALL SELECT chain, 1, 'prev' FROM t WHERE chain % 7 = 0""")
def chain_findings(spark, sf):
    """Every fifth order's first content and every seventh's link are changed after the fact."""
    e, k = chain(spark, sf), F.col("chain")
    e = e.withColumn("content", F.when((k % 5 == 0) & (F.col("seq") == 0), "changed").otherwise(F.col("content")))
    e = e.withColumn("prev", F.when((k % 7 == 0) & (F.col("seq") == 1), A.GENESIS).otherwise(F.col("prev")))
    return A.chain_findings(e)


@query("SELECT 'r' || o_orderkey AS record_id, 1 AS seq, 'c' || o_custkey AS actor, '승인' AS meaning FROM orders WHERE o_orderkey % 4 <> 0")
def valid_signatures(spark, sf):
    e, k = chain(spark, sf), F.col("chain")
    e = e.withColumn("content_sha256", F.when((k % 4 == 0) & (F.col("seq") == 1), "other").otherwise(F.col("content_sha256")))
    return A.signatures(e)


@query("""SELECT 'r' || o_orderkey AS record_id, s AS seq, CASE WHEN s = 0 THEN 'order' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'meaning,order' ELSE 'order' END END AS reasons FROM orders, (SELECT unnest([0, 1])::INT AS s) WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'r' || o_orderkey, 1, 'meaning' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = 0""")
def refused_entries(spark, sf):
    e, k = chain(spark, sf), F.col("chain")
    e = e.withColumn("action", F.when((k % 2 == 0) & (F.col("seq") == 0), "modify").otherwise(F.col("action"))).withColumn("reason", F.lit("why"))
    e = e.withColumn("meaning", F.when((k % 3 == 0) & (F.col("seq") == 1), "").otherwise(F.col("meaning")))
    return A.refused(e).select("record_id", "seq", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT k, CASE WHEN n = 0 THEN '- no citation|- too few sources (0.00)' WHEN n = 1 THEN '- unsupported sentence: s1|- DOI not among the sources: 10.1/x' WHEN n = 2 THEN '- numbers or citations without a source (0.50)|- unfinished or without units (0.40)' ELSE '- sources and answer match little (0.30)' END AS feedback
FROM (SELECT o_orderkey AS k, o_orderkey % 4 AS n FROM orders)""")
def answer_feedback(spark, sf):
    n = F.col("o_orderkey") % 4
    one = lambda k, v: F.when(n == k, F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    d = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), one(1, "s1").alias("unsupported"), one(1, "10.1/x").alias("unknown_dois"), F.when(n == 0, 0).otherwise(2).alias("n_cited"), F.when(n == 0, 0.0).otherwise(1.0).alias("source_exist"),
        F.when(n == 2, 0.5).otherwise(0.0).alias("halluc"), F.when(n == 2, 0.4).otherwise(1.0).alias("alcoa"), F.lit(0.3).alias("source_match"),
    )
    return G.feedback(d).select("k", F.array_join("feedback", "|").alias("feedback"))
