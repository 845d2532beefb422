"""Pseudonyms, sensitive documents, memory, document checks and coverage of regulations over documents, conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import privacy as P
from ..operators import privacy as V
from ..operators import regulation as R
from ..sources.tables import table
from .curation import SENSITIVE_SQL
from .phrases import quoted, said, said_sql
from .registry import query

PERSONS = [
    "문의 010-1234-5678 끝. ", "메일 a.kim@lab.co.kr 회신. ", "900101-1234568 확인 ", "연구자: 김민준 보고 ", "작성자: 박서연, 점검자: 최도윤 ", "김민준 연구원 참석 ", "교수 이서준과 면담 ", "공동 연구원 모집 ", "",
]
#: What each phrase must become, value by value; the pseudonym is a digest of the salted value.
VALUES = {"010-1234-5678": "연락처", "a.kim@lab.co.kr": "이메일", "900101-1234568": "주민번호", "연구자: 김민준": "연구자", "작성자: 박서연": "작성자", "점검자: 최도윤": "점검자", "김민준 연구원": "인명", "교수 이서준": "인명"}


def _pseudo_sql(text: str) -> str:
    for value, prefix in VALUES.items():
        bare = value.split(": ")[-1].replace(" 연구원", "").replace("교수 ", "")
        fake = f"'{prefix}_' || upper(left(sha256('salt::{bare}'), 4))"
        text = f"replace({text}, '{value}', " + " || ".join(quoted(x) if x != bare else fake for x in _parts(value, bare)) + ")"
    return text


def _parts(value: str, bare: str) -> list[str]:
    a, _, b = value.partition(bare)
    return [x for x in (a, bare, b) if x]


TABLE_MAIL = r"(^|[^A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+)"


def _no_mail(text: str) -> str:
    """Texts of the table without their own addresses and numbers, which SQL cannot give a digest each."""
    for p in (r"[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]*", r"01[016789][-. ]?\d{3,4}[-. ]?\d{4}", r"\d{6}\s*[-–]\s*[1-4]\d{6}"):
        text = f"regexp_replace({text}, {quoted(p)}, ' ', 'g')"
    return text


def persons(docs):
    t = F.coalesce("text", F.lit(""))
    for p in (r"[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]*", r"01[016789][-. ]?\d{3,4}[-. ]?\d{4}", r"\d{6}\s*[-–]\s*[1-4]\d{6}"):
        t = F.regexp_replace(t, p, " ")
    return docs.withColumn("text", F.concat(said("doc_id", PERSONS), t))


@query(f"""WITH x AS (SELECT doc_id, {said_sql("doc_id", PERSONS)} AS p, {_no_mail("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, md5({_pseudo_sql("p")} || t) AS digest, ([1, 1, 1, 1, 2, 1, 1, 0, 0])[doc_id % 9 + 1]::INT AS put, 1::INT AS passes, 0::INT AS "left" FROM x""")
def deidentified_documents(spark, sf):
    d = persons(table(spark, sf, "documents")).select("doc_id", P.deidentification(F.col("text"), "salt").alias("d"))
    return d.select("doc_id", F.md5("d.text").alias("digest"), "d.put", "d.passes", "d.left")


CASES = ["", "", "", "", "", "환자 진단 ", "", "부작용 "]


@query(f"""WITH x AS (SELECT conv_id, {said_sql("(conv_id * 3 + turn)", CASES)} || coalesce(text, '') AS text FROM conversations),
s AS (SELECT conv_id, {SENSITIVE_SQL} IS NOT NULL AS s FROM x) SELECT conv_id, count(*)::BIGINT AS n, count(*) FILTER (s)::BIGINT AS flagged, bool_or(s) AS sensitive FROM s GROUP BY conv_id""")
def sensitive_documents(spark, sf):
    return V.flag_documents(_cases(spark, sf), "conv_id")


def _cases(spark, sf):
    c = table(spark, sf, "conversations").withColumn("_k", F.col("conv_id") * 3 + F.col("turn"))
    return c.withColumn("text", F.concat(said("_k", CASES), F.coalesce("text", F.lit("")))).drop("_k")


@query(f"""WITH x AS (SELECT conv_id, turn, {said_sql("(conv_id * 3 + turn)", CASES)} || coalesce(text, '') AS text FROM conversations),
s AS (SELECT *, {SENSITIVE_SQL} IS NOT NULL AS s FROM x) SELECT conv_id, turn FROM s WHERE conv_id NOT IN (SELECT conv_id FROM s WHERE s)""")
def without_sensitive_documents(spark, sf):
    return V.without_sensitive_documents(_cases(spark, sf), "conv_id").select("conv_id", "turn")


@query(f"""WITH x AS (SELECT conv_id, {said_sql("(conv_id * 3 + turn)", CASES)} || coalesce(text, '') AS text FROM conversations),
s AS (SELECT conv_id, bool_or({SENSITIVE_SQL} IS NOT NULL) AS s FROM x GROUP BY conv_id) SELECT count(*)::BIGINT AS documents, count(*) FILTER (s)::BIGINT AS flagged, avg(s::INT)::DOUBLE AS share FROM s""")
def sensitive_share(spark, sf):
    return V.sensitive_share(_cases(spark, sf), "conv_id")


KEYS = ["yield of run", "환자 진단 기록", "call 010-1234-5678", "부작용", "연구자: 김민준"]


@query(f"""SELECT o_orderkey, ([NULL, 0, 1])[CASE WHEN o_orderkey % 5 IN (1, 3) THEN 1 WHEN o_orderkey % 5 = 0 THEN 2 ELSE 3 END]::INT AS put,
  CASE WHEN o_orderkey % 5 IN (1, 3) THEN 'sensitive' ELSE 'promoted' END AS verdict,
  CASE WHEN o_orderkey % 5 NOT IN (1, 3) THEN {_pseudo_sql(said_sql("o_orderkey", KEYS))} END AS key FROM orders""")
def memory_promotions(spark, sf):
    r = table(spark, sf, "orders").select("o_orderkey", said("o_orderkey", KEYS).alias("key"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("value"), F.lit("kept").alias("reason"))
    return V.promotions(r, "salt").select("o_orderkey", "put", "verdict", "key")


@query("""WITH m AS (SELECT o_orderkey, lower(o_orderpriority || ' ' || o_orderstatus || ' ' || coalesce(o_clerk, '')) AS hay FROM (SELECT o_orderkey, o_orderpriority, o_orderstatus, 'clerk ' || o_custkey AS o_clerk FROM orders)),
h AS (SELECT o_orderkey, (contains(hay, 'urgent')::INT + contains(hay, 'clerk 1')::INT + contains(hay, ' f ')::INT)::INT AS hits FROM m) SELECT o_orderkey, hits FROM h WHERE hits > 0 ORDER BY hits DESC, o_orderkey DESC LIMIT 20""")
def memory_recall_words(spark, sf):
    o = table(spark, sf, "orders").withColumn("clerk", F.concat(F.lit("clerk "), F.col("o_custkey").cast("string")))
    return V.recall(o, ["URGENT", "clerk 1", " f "], "o_orderkey", 20, ("o_orderpriority", "o_orderstatus", "clerk")).select("o_orderkey", "hits")


def _rrn_sql() -> str:
    d = "substr(d, {}, 1)::INT"
    total = " + ".join(f"{w} * {d.format(k + 1)}" for k, w in enumerate((2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)))
    return f"(11 - ({total}) % 11) % 10 = {d.format(13)} AS c, substr(d, 3, 2)::INT BETWEEN 1 AND 12 AND substr(d, 5, 2)::INT BETWEEN 1 AND 31 AS b"


@query(f"""WITH x AS (SELECT lang, lpad((doc_id * 7919 % 1000000)::VARCHAR, 6, '0') || '-' || (doc_id % 4 + 1) || lpad((doc_id * 104729 % 1000000)::VARCHAR, 6, '0') || ' ' || coalesce(text, '') AS t FROM documents),
d AS (SELECT lang, unnest(list_transform(regexp_extract_all(t, {quoted(V.RRN)}), lambda m: regexp_replace(m, '[^0-9]', '', 'g'))) AS d FROM x), y AS (SELECT lang, {_rrn_sql()} FROM d)
SELECT lang, count(*)::BIGINT AS found, count(*) FILTER (c)::BIGINT AS checksum, count(*) FILTER (b)::BIGINT AS date, count(*) FILTER (c AND b)::BIGINT AS both FROM y GROUP BY lang""")
def resident_number_rates(spark, sf):
    k = F.col("doc_id")
    number = F.concat(F.lpad((k * 7919 % 1000000).cast("string"), 6, "0"), F.lit("-"), (k % 4 + 1).cast("string"), F.lpad((k * 104729 % 1000000).cast("string"), 6, "0"), F.lit(" "), F.coalesce("text", F.lit("")))
    return V.rrn_rates(table(spark, sf, "documents").select("lang", number.alias("text")), "lang")


NOTES = [
    "서명: 홍길동 2024-03-05 14:20 작성\n과제명: A\n노트 번호 No. 3\n연구소 1/20쪽\n", "서명 2024-03-05\n정정: 값 수정\n시료 분석\n", "서명: 김민수 검토\n과제명: A\n과제명: B\n이탈 발생. 계획 변경 승인 완료.\n",
    "amendment reason: typo 2024-01-02 signed\n시료 번호 S-12 2024-05-06\n", "시험기관 개시 목적 방법 통계 시료 안정성 시험계 용량 품질 책임자 결론 QA\n", "",
]
_DATE = r"\d{4}\s*[-./년]\s*\d{1,2}\s*[-./월]\s*\d{1,2}"
CLAUSES = [
    ("a", ["labnote", "report"], ["onto.signature", "audit.chain"]), ("b", ["labnote", "report"], ["onto.amendment"]), ("c", ["labnote"], ["onto.specimen"]), ("d", ["labnote"], ["onto.labnote_cover"]),
    ("e", ["labnote", "report"], ["onto.deviation"]), ("f", ["labnote"], ["onto.single_project"]), ("g", ["report"], ["onto.report_elements"]),
]


def _report_sql() -> str:
    out = []
    for clause, (name, *patterns) in D.REPORT.items():
        held = " AND ".join(f"regexp_matches(t, {quoted('(?i)' + p)})" for p in patterns)
        out.append(f"CASE WHEN NOT ({held}) THEN '[{clause}] 최종보고서 항목 누락: {name}' END")
    return "[" + ", ".join(out) + "]"


def _cover_sql() -> str:
    from ..functions.integrity import COVER

    return "[" + ", ".join(f"CASE WHEN NOT regexp_matches(t, {quoted('(?i)' + p.replace('(?![가-힣])', '([^가-힣]|$)'))}) THEN '[지침7②1] 연구노트 {k} 없음' END" for k, p in COVER.items()) + "]"


_TAG = "left(trim(l, ' \t\n\r\f\x0b'), 30)"
_LINE = rf"""list_concat(list_concat(
  [CASE WHEN NOT regexp_matches(regexp_replace(l, '{D.SIGN_WORDS}', ' ', 'g'), '[가-힣]{{2}}|인명_[0-9A-F]{{4}}|[A-Z][a-z]+\s[A-Z][a-z]+') THEN '[11.50(a)(1)] 서명자 성명 없음: ' || {_TAG} END],
  [CASE WHEN NOT regexp_matches(l, '{_DATE}') THEN '[11.50(a)(2)] 서명 일자 없음: ' || {_TAG} WHEN NOT regexp_matches(l, '{D.TIME}') THEN '[11.50(a)(2)] 서명 시각 없음(일자만): ' || {_TAG} END]),
  [CASE WHEN NOT regexp_matches(l, '(?i){D.MEANING}') THEN '[11.50(a)(3)] 서명 의미(작성·검토·승인) 없음: ' || {_TAG} END])"""
_AMENDED = rf"""[CASE WHEN NOT regexp_matches(l, '(?i){D.REASON}') THEN '[58.130(e)/58.185(c)] 정정 사유 없음: ' || {_TAG} END, CASE WHEN NOT regexp_matches(l, '{_DATE}') THEN '[58.130(e)/지침8⑥1] 정정 일자 없음: ' || {_TAG} END,
  CASE WHEN NOT regexp_matches(l, '(?i){D.SIGNER}') THEN '[58.130(e)/지침8⑥1] 정정자 서명 없음: ' || {_TAG} END]"""
_AMEND = D.AMEND.replace("(?![A-Za-z0-9_가-힣])", "([^A-Za-z0-9_가-힣]|$)")
_SENTENCES = r"string_split_regex(regexp_replace(t, '([.!?。])[ \t\r\f]+', '\1' || chr(10), 'g'), '\n')"


@query(f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 7 < 5 THEN 'labnote' ELSE 'report' END AS doc_type, {said_sql("doc_id", NOTES)} || coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, doc_type, list_filter(flatten(list_transform(list_filter(string_split_regex(t, '\\r\\n|\\n|\\r'), lambda l: regexp_matches(l, '(?i){D.SIGN_LINE}')), lambda l: {_LINE})), lambda v: v IS NOT NULL) AS sg,
  len(list_filter(string_split_regex(t, '\\r\\n|\\n|\\r'), lambda l: regexp_matches(l, '(?i){D.SIGN_LINE}'))) AS ns,
  list_filter(flatten(list_transform(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '(?i){_AMEND}')), lambda l: {_AMENDED})), lambda v: v IS NOT NULL) AS am,
  list_transform(list_filter({_SENTENCES}, lambda l: regexp_matches(l, '(?i)이탈|일탈|계획\\s*변경|deviation') AND NOT regexp_matches(l, '(?i)승인|사유|보고|문서화|approv|reason|document')), lambda l: '[58.35(b)(5)] 이탈 승인·사유 없음: ' || {_TAG}) AS dv,
  list_filter({_cover_sql()}, lambda v: v IS NOT NULL) AS cv, list_filter({_report_sql()}, lambda v: v IS NOT NULL) AS rp,
  len(list_distinct(list_transform(regexp_extract_all(t, '과제\\s*명\\s*[:：]\\s*([^\\n]+)', 1), lambda v: trim(v)))) AS np,
  CASE WHEN regexp_matches(t, '(?i)검체|시료|샘플|specimen|sample') THEN list_filter([CASE WHEN NOT regexp_matches(t, '(?i)(?:시료|검체|샘플|sample|specimen)\\s*(?:번호|ID|No\\.?|#)|[A-Z]{{1,4}}-?\\d{{2,}}') THEN '[58.130(c)] 검체 식별번호 없음' END,
    CASE WHEN NOT regexp_matches(t, '{_DATE}') THEN '[58.130(c)] 검체 채취·기록 일자 없음' END], lambda v: v IS NOT NULL) ELSE [] END AS sp FROM x),
a AS (SELECT doc_id, doc_type, CASE WHEN doc_type = 'labnote' THEN flatten([am, dv, cv, CASE WHEN ns = 0 THEN ['[11.50(a)/58.185(b)] 서명 표시 없음'] ELSE sg END, CASE WHEN np > 1 THEN ['[지침8②] 한 노트에 과제 ' || np || '개 — 과제마다 구분 작성'] ELSE [] END, sp])
  ELSE flatten([am, dv, rp, CASE WHEN ns = 0 THEN ['[11.50(a)/58.185(b)] 서명 표시 없음'] ELSE sg END]) END AS w FROM f)
SELECT doc_id, doc_type, array_to_string(list_sort(list_distinct(w)), '|') AS findings FROM a""")
def document_findings(spark, sf):
    kind = F.when(F.col("doc_id") % 7 < 5, "labnote").otherwise("report")
    d = table(spark, sf, "documents").select("doc_id", kind.alias("doc_type"), F.concat(said("doc_id", NOTES), F.coalesce("text", F.lit(""))).alias("text"))
    c = spark.createDataFrame([(i, "R", "record", "record", [], "", ks, False, ap) for i, ap, ks in CLAUSES], R.CLAUSE)
    got = R.check_documents(d, c)
    return got.select("doc_id", "doc_type", F.array_join(F.array_sort("findings"), "|").alias("findings"))


def clauses(spark, sf):
    """Clauses made of parts: enough of them that every count has rows."""
    k = F.col("p_partkey")
    names = F.array(*[F.lit(a) for a in R.ALCOA])
    return table(spark, sf, "part").select(
        F.concat(F.lit("c"), k.cast("string")).alias("id"), F.concat(F.lit("reg "), (k % 4).cast("string")).alias("reg"), F.when(k % 3 == 0, "record").when(k % 3 == 1, "system").otherwise("org").alias("kind"),
        F.when(k % 10 == 0, "").otherwise("record").alias("obj"), F.slice(names, (k % 8 + 1).cast("int"), (k % 3).cast("int")).alias("alcoa"), F.concat(F.lit('say "'), F.col("p_brand"), F.lit('"')).alias("summary"),
        F.when(k % 5 < 2, F.array(F.concat(F.lit("check."), (k % 6).cast("string")))).otherwise(F.array().cast("array<string>")).alias("checks"), (k % 7 == 0).alias("platform"),
        F.when(k % 2 == 0, F.array(F.lit("report"))).otherwise(F.array().cast("array<string>")).alias("applies"),
    )


CLAUSES_SQL = """WITH c AS (SELECT p_partkey AS k, 'c' || p_partkey AS id, 'reg ' || (p_partkey % 4) AS reg, CASE p_partkey % 3 WHEN 0 THEN 'record' WHEN 1 THEN 'system' ELSE 'org' END AS kind, p_partkey % 10 <> 0 AS obj,
  p_partkey % 5 < 2 AS checked, p_partkey % 7 = 0 AS platform, p_brand FROM part)
"""


@query(CLAUSES_SQL + """SELECT reg, count(*)::BIGINT AS clauses, count(*) FILTER (obj)::DOUBLE / count(*) AS modeled, count(*) FILTER (kind <> 'org')::BIGINT AS automatable, count(*) FILTER (kind <> 'org' AND checked)::DOUBLE / greatest(1, count(*) FILTER (kind <> 'org')) AS automated,
  count(*) FILTER (kind <> 'org' AND (checked OR platform))::DOUBLE / greatest(1, count(*) FILTER (kind <> 'org')) AS with_platform, count(*) FILTER (kind <> 'org' AND NOT (checked OR platform))::BIGINT AS uncovered FROM c GROUP BY ROLLUP (reg)""")
def regulation_coverage(spark, sf):
    return R.coverage(clauses(spark, sf))


@query(CLAUSES_SQL + f"""SELECT attribute, count(*) FILTER (checked)::BIGINT AS covered, count(*)::BIGINT AS total FROM (SELECT checked, unnest(({list(R.ALCOA)})[k % 8 + 1 : k % 8 + k % 3]) AS attribute FROM c) GROUP BY attribute""")
def alcoa_coverage(spark, sf):
    return R.alcoa_coverage(clauses(spark, sf))


@query(CLAUSES_SQL + """SELECT 'report' AS doc_type, count(*)::BIGINT AS n, md5(string_agg('- [' || id || '] say "' || p_brand || '"', chr(10) ORDER BY id)) AS digest FROM c WHERE k % 2 = 0""")
def clause_constraints(spark, sf):
    c = R.constraints(clauses(spark, sf))
    return c.select("doc_type", F.size(F.split("text", "\n")).cast("bigint").alias("n"), F.md5("text").alias("digest"))


@query(CLAUSES_SQL + f"""SELECT 'go:' || a || ' a go:AlcoaAttribute .' AS value FROM (SELECT unnest({list(R.ALCOA)}) AS a) UNION ALL SELECT DISTINCT 'go:' || replace(reg, ' ', '_') || ' a go:Regulation ; rdfs:label "' || reg || '" .' FROM c
UNION ALL SELECT DISTINCT 'go:check_check_' || (k % 6) || ' a go:Check ; rdfs:label "check.' || (k % 6) || '" .' FROM c WHERE checked
UNION ALL SELECT 'go:' || replace(reg, ' ', '_') || '_' || id || ' a go:Clause ; rdfs:label "' || id || ' say \\"' || p_brand || '\\"" ; go:partOf go:' || replace(reg, ' ', '_') || ' ; go:kind "' || kind || '" ; go:object "' || CASE WHEN obj THEN 'record' ELSE '' END || '"'
  || coalesce(array_to_string(list_transform(({list(R.ALCOA)})[k % 8 + 1 : k % 8 + k % 3], lambda a: ' ; go:requires go:' || a), ''), '') || CASE WHEN checked THEN ' ; go:checkedBy go:check_check_' || (k % 6) ELSE '' END || CASE WHEN platform THEN ' ; go:providedByPlatform true' ELSE '' END || ' .' FROM c""")
def clauses_as_turtle(spark, sf):
    return R.turtle(clauses(spark, sf))


@query("""SELECT o_orderkey, (o_orderdate + INTERVAL 30 YEAR)::DATE AS until, CASE WHEN o_orderdate + to_years((o_orderkey % 60)::INT) < o_orderdate + INTERVAL 30 YEAR THEN 1 ELSE 0 END::INT AS findings FROM orders""")
def retention_findings(spark, sf):
    end = F.col("o_orderdate").cast("date")
    disposal = F.add_months(end, ((F.col("o_orderkey") % 60) * 12).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", D.retention_until(end).alias("until"), F.size(D.retention_findings(end, disposal)).alias("findings"))
