"""Content, domains, code, commits, published papers, research assets, number errors and routes over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import privacy as P
from ..functions import text as T
from ..operators import assets as A
from ..operators import classification as G
from ..operators import curation as C
from ..sources.tables import table
from .curation import SENSITIVE_SQL
from .phrases import quoted, said, said_sql
from .registry import query

CONTENT = [
    "시료 3 mg, 온도 25 ℃, 5 분 배양 후 농도 측정: 대조군 12 % ", "결과를 분석하고 비교 평가한 경향은 증가, 평균 개선 ", "선행 연구 [1] 논문 저널 doi 10.1234/abc.5 참고문헌 ",
    "계획과 목표, 추진 일정과 예산 ", "정산 증빙 영수 지출 품의 ", "commit 0123abcdef\nAuthor: a\nDate: b\n", "def f(x):\n  return x;\nimport os\nlet y = 1;\n",
    "github.com/a/b README\n# head\n- one\n- two\n", "package.json Dockerfile github.com repository branch\n", "Unit Test Results, Coverage report, codecov ", "", "목표 결과 ", "100 kg 200 kg 300 kg 400 kg 500 kg ",
]
STRIP = r"regexp_replace({}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"


def n_of(pattern: str, text: str = "t") -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


#: Accented letters as q: DuckDB's word boundary knows ASCII alone, and no mark holds a q.
PLAIN = "regexp_replace({}, '[À-ɏ]', 'q', 'g')"


def first_max(scores: dict[str, str]) -> str:
    return "CASE greatest(" + ", ".join(scores.values()) + ") " + " ".join(f"WHEN {c} THEN {quoted(k)}" for k, c in scores.items()) + " END"


KINDS = {"experimental": "num_unit + exp", "analysis": "analysis", "literature": "lit", "planning": "plan"}
WEAK = {"admin": "admin", "code_docs": "docs", "literature": "lit", "planning": "plan", "analysis": "analysis", "experimental": "num_unit + exp"}
TRIAGE = f"""WITH x AS (SELECT doc_id, source, {STRIP.format(said_sql("doc_id", CONTENT) + " || coalesce(text, '')")} AS f FROM documents),
y AS (SELECT doc_id, source, f, left(f, 4000) AS t, length(f) AS n FROM x),
s AS (SELECT doc_id, source, f, t, n, {", ".join(f"least(6, {n_of(p)}) AS {k}" for k, p in K.SIGNALS.items())} FROM y),
b AS (SELECT *, CASE WHEN n < 80 THEN 'fragment'
  WHEN "commit" >= 2 OR code >= 4 OR (repo >= 3 AND markdown >= 3) OR (repo >= 4 AND num_unit + exp < 3) THEN
    CASE WHEN "commit" >= 2 THEN 'code_commit' WHEN code >= 3 THEN 'code_source' WHEN markdown >= 3 THEN 'code_docs' WHEN config >= 1 THEN 'code_meta' ELSE 'code_commit' END
  WHEN admin >= 2 AND num_unit + exp < 3 THEN 'admin' WHEN docs >= 2 AND num_unit + exp < 3 THEN 'code_docs'
  WHEN num_unit >= 3 AND exp >= 2 THEN 'experimental' WHEN lit >= 2 THEN 'literature' WHEN plan >= 2 THEN 'planning' WHEN analysis >= 3 THEN 'analysis'
  WHEN num_unit >= 5 THEN 'experimental' WHEN num_unit + exp + analysis + lit + plan >= 2 THEN {first_max(KINDS)}
  WHEN num_unit >= 2 AND n >= 300 THEN 'experimental' WHEN n >= 300 AND greatest({", ".join(WEAK.values())}) > 0 THEN {first_max(WEAK)}
  WHEN n >= 300 THEN 'experimental' ELSE 'fragment' END AS bucket FROM s)
"""
FOLD = "CASE WHEN bucket IN ('experimental', 'analysis', 'literature', 'planning') THEN '연구내용' WHEN bucket LIKE 'code%' THEN 'GitHub' ELSE '기타' END"


def content(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", F.concat(said("doc_id", CONTENT), F.coalesce("text", F.lit(""))).alias("text"))


@query(TRIAGE + f"SELECT doc_id, bucket, {FOLD} AS macro FROM b")
def content_triage(spark, sf):
    return G.triage(content(spark, sf)).select("doc_id", "bucket", K.macro(F.col("bucket")).alias("macro"))


@query(TRIAGE + "SELECT bucket, count(*)::BIGINT AS n, count(*)::DOUBLE / (SELECT count(*) FROM b) AS share, avg(n) AS mean_chars FROM b GROUP BY bucket")
def content_bucket_stats(spark, sf):
    return G.bucket_stats(G.triage(content(spark, sf)))


TOPICS = [
    "세포 유전자 단백질 antibody ", "합성 촉매 용매 polymer ", "박막 나노 합금 coating ", "알고리즘 신경망 dataset ", "반도체 웨이퍼 wafer ", "절삭 금형 용접 torque ",
    "태양광 풍력 수소 solar ", "작물 재배 토양 crop ", "교량 터널 concrete ", "양자 레이저 photon laser ", "",
]
DOMAIN = f"""WITH x AS (SELECT doc_id, left({said_sql("doc_id", TOPICS)} || coalesce(text, ''), 4000) AS t FROM documents),
s AS (SELECT doc_id, {", ".join(f"{n_of(p)} AS {quoted(k).replace(chr(39), chr(34))}" for k, p in K.DOMAINS.items())} FROM x)
"""


def _top_sql(names, least):
    cols = {k: f'"{k}"' for k in names}
    return f"CASE WHEN greatest({', '.join(cols.values())}) >= {least} THEN {first_max(cols)} ELSE '미분류' END"


@query(DOMAIN + f"SELECT doc_id, {_top_sql(K.DOMAINS, 2)} AS domain FROM s")
def research_domains(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(said("doc_id", TOPICS), F.coalesce("text", F.lit(""))).alias("text"))
    return G.domains(d).select("doc_id", "domain")


CODE = ["experiment analysis model ", "docker deploy ci pipeline ", "plot ", "bump lint ", "docker model ", ""]


@query(f"""SELECT doc_id, CASE WHEN r >= 2 AND r > i THEN '연구 코드' WHEN i >= 2 AND i > r THEN '인프라 코드' WHEN r > 0 AND r >= i THEN '연구 코드' ELSE '판별 불가' END AS relevance
  FROM (SELECT doc_id, {n_of(K.RESEARCH_CODE)} AS r, {n_of(K.INFRA_CODE)} AS i FROM (SELECT doc_id, left({said_sql("doc_id", CODE)} || {PLAIN.format("coalesce(text, '')")}, 4000) AS t FROM documents))""")
def code_relevance(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(said("doc_id", CODE), F.coalesce("text", F.lit(""))).alias("text"))
    return G.relevance(d).select("doc_id", "relevance")


COMMITS = [
    "commit 0123abcdef01\nAuthor: a\nDate: b\nfeat(x): measure data\ndiff --git a b\n", "fix: typo in docs\n", "docs: report and slide\n", "test: benchmark result score\n", "refactor(core): clean filter\n",
    "commit 1234567\nplot chart figure\n", "build: docker deploy\n", "",
]
COMMIT = f"""WITH x AS (SELECT doc_id, left({said_sql("doc_id", COMMITS)} || {PLAIN.format("coalesce(text, '')")}, 4000) AS t FROM documents),
s AS (SELECT *, {", ".join(f'{n_of(p)} AS "{k}"' for k, p in K.ACTIVITIES.items())} FROM x WHERE regexp_matches(t, {quoted(K.COMMIT_LINE)}))
"""


def commits(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(said("doc_id", COMMITS), F.coalesce("text", F.lit(""))).alias("text"))
    return d.where(K.head(F.col("text")).rlike(K.lines(K.COMMIT_LINE)))


@query(COMMIT + f"""SELECT doc_id, {_top_sql(K.ACTIVITIES, 1)} AS activity, regexp_matches(t, {quoted(K.COMMIT_FLAGS["diff"])}) AS "diff", regexp_matches(t, {quoted(K.COMMIT_FLAGS["author"])}) AS author,
  regexp_matches(t, {quoted(K.COMMIT_FLAGS["date"])}) AS "date", len(list_filter(regexp_extract_all(t, {quoted(K.COMMIT_FLAGS["hash"])}), lambda w: length(w) BETWEEN 7 AND 40)) > 0 AS "hash" FROM s""")
def commit_activities(spark, sf):
    return G.commit_activity(commits(spark, sf)).select("doc_id", "activity", "flags.*")


@query(COMMIT + f"SELECT kind, count(*)::BIGINT AS n FROM (SELECT unnest(list_transform(regexp_extract_all(t, {quoted(K.CONVENTIONAL)}, 1), lambda x: lower(x))) AS kind FROM s) GROUP BY kind")
def conventional_commits(spark, sf):
    return G.conventional_types(commits(spark, sf))


PAPERS = [
    "doi 10.1234/abc © Elsevier Keywords: a\nReferences\n", "Smith et al. [3] ", "오늘 시료 측정값 담당자 ", "ISSN All rights reserved E-mail: a@b 과제 번호 ", "", "회의록 [12] ",
]


def _bits_sql(marks):
    return " + ".join(f"CASE WHEN regexp_matches(t, {quoted(p)}) THEN {1 << k} ELSE 0 END" for k, p in enumerate(marks.values()))


MIX = r"""CASE WHEN h + l = 0 THEN '문자없음' WHEN h / (h + l) > 0.7 THEN '한글중심' WHEN h / (h + l) > 0.3 THEN '혼합' ELSE '영문중심' END"""
HL = r"length(regexp_replace(t, '[^가-힣]', '', 'g')) AS h, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS l"


def _verdict_sql(least, p="p", r="r"):
    return f"CASE WHEN {p} >= {least} AND {p} {'>' if least > 2 else '>='} {r} THEN '출판 논문 추정' WHEN {p} >= 1 AND {r} = 0 THEN '논문 가능성' WHEN {r} > 0 THEN '1차 기록' ELSE '표지 없음' END"


@query(f"""WITH x AS (SELECT doc_id, {said_sql("doc_id", PAPERS)} || coalesce(text, '') AS t FROM documents), s AS (SELECT {HL}, length(t) AS n, bit_count(({_bits_sql(K.PAPER)})::BIGINT) AS p, bit_count(({_bits_sql(K.RECORD)})::BIGINT) AS r FROM x)
SELECT verdict, script, count(*)::BIGINT AS n, sum(n)::BIGINT AS chars FROM (SELECT {_verdict_sql(3)} AS verdict, {MIX} AS script, n FROM s) GROUP BY 1, 2""")
def paper_verdicts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(said("doc_id", PAPERS), F.coalesce("text", F.lit(""))).alias("text"))
    return G.paper_rows(d).groupBy("verdict", "script").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH x AS (SELECT conv_id, turn, {said_sql("conv_id", PAPERS)} || coalesce(text, '') AS t FROM conversations),
g AS (SELECT conv_id, bit_count(bit_or(({_bits_sql(K.PAPER)})::BIGINT)) AS p, bit_count(bit_or(({_bits_sql(K.RECORD)})::BIGINT)) AS r, count(*)::BIGINT AS n FROM x GROUP BY conv_id)
SELECT {_verdict_sql(2)} AS verdict, count(*)::BIGINT AS documents, sum(n)::BIGINT AS n_rows, avg(n) AS mean_rows FROM g GROUP BY 1""")
def paper_verdict_documents(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(said("conv_id", PAPERS), F.coalesce("text", F.lit(""))).alias("text"))
    d = G.paper_documents(c, "conv_id")
    return d.groupBy("verdict").agg(F.count("*").alias("documents"), F.sum("n").alias("n_rows"), F.avg("n").alias("mean_rows"))


ASSETS = [
    "실험 조건 5 mg 시료 3 mL 10 min 실패, 재실험 n = 3 평균 ± 2, 2023-04-05 buffer 희석 원심분리 ", "측정 온도 25 ℃ 농도 3 mM 4 rpm no signal 세포 ", "분석 결과 비교 평가 반도체 회로 ", "논문 [1] 참고문헌 합성 촉매 ", "",
]


@query(f"""WITH d0 AS (SELECT doc_id, {STRIP.format(said_sql("doc_id", ASSETS) + " || coalesce(text, '')")} AS f, {said_sql("doc_id", ASSETS)} || coalesce(text, '') AS raw FROM documents),
{TRIAGE[TRIAGE.index("y AS"):].replace("SELECT doc_id, source, f, left", "SELECT doc_id, raw, f, left").replace("FROM x)", "FROM d0)").replace("s AS (SELECT doc_id, source,", "s AS (SELECT doc_id, raw,").rstrip()},
q AS (SELECT left(raw, 4000) AS t FROM b WHERE bucket IN ('experimental', 'analysis', 'literature', 'planning')),
m AS (SELECT {n_of(A.UNIT)} AS units, regexp_matches(t, {quoted(A.NEGATIVE)}) AS neg, regexp_matches(t, {quoted(A.RETRY)}) AS again, {n_of(A.PROTOCOL)} AS steps, regexp_matches(t, {quoted(A.REPLICATE)}) AS repl, regexp_matches(t, {quoted(A.DATE)}) AS dated FROM q)
SELECT CASE WHEN units = 0 THEN '0' WHEN units < 3 THEN '1-2' WHEN units < 10 THEN '3-9' WHEN units < 30 THEN '10-29' ELSE '30+' END AS units, count(*)::BIGINT AS n, count(*) FILTER (neg)::BIGINT AS negative,
  count(*) FILTER (neg AND again)::BIGINT AS retried, count(*) FILTER (steps >= 3)::BIGINT AS protocols, count(*) FILTER (steps >= 3 AND units >= 3)::BIGINT AS rich, count(*) FILTER (repl)::BIGINT AS replicated, count(*) FILTER (dated)::BIGINT AS dated FROM m GROUP BY 1""")
def research_assets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(said("doc_id", ASSETS), F.coalesce("text", F.lit(""))).alias("text"))
    return A.asset_metrics(d)


NUMBERS = ["1.2.3 and 1O5 and 4 5 6, pH 15.5, yield: 120 %, 150 % ", "pH 7.4 수율 88 % 2021-03-05 ", "in 2019, 2023. and (1987) ", "2022년 4월 3일 ", ""]


@query(f"""WITH x AS (SELECT doc_id, {said_sql("doc_id", NUMBERS)} || coalesce(text, '') AS t FROM documents),
e AS (SELECT {n_of(A.NUMBER_TOKEN)} AS tokens, {n_of(A.MULTI_DOT)} AS multi_dot, {n_of(A.DIGIT_LETTER)} AS digit_letter, {n_of(A.SPLIT_NUMBER)} AS split_number,
  len(list_filter(regexp_extract_all(t, {quoted(A.PH)}, 1), lambda v: v::DOUBLE > 14)) AS ph, len(list_filter(regexp_extract_all(t, {quoted(A.YIELD)}, 1), lambda v: v::DOUBLE > 100)) AS yield,
  {n_of(A.PERCENT.replace("(?<![0-9.])", "(?:^|[^0-9.])"), "replace(t, '%', '% ')")} AS percent FROM x)
SELECT sum(tokens)::BIGINT AS tokens, sum(multi_dot)::BIGINT AS multi_dot, sum(digit_letter)::BIGINT AS digit_letter, sum(split_number)::BIGINT AS split_number, sum(ph)::BIGINT AS ph, sum(yield)::BIGINT AS yield,
  sum(percent)::BIGINT AS percent, count(*) FILTER (multi_dot + digit_letter + split_number + ph + yield + percent > 0)::BIGINT AS rows_with_error,
  1000.0::DOUBLE * sum(multi_dot + digit_letter + split_number + ph + yield + percent)::BIGINT / greatest(1, sum(tokens)::BIGINT) AS per_thousand FROM e""")
def number_errors(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(said("doc_id", NUMBERS), F.coalesce("text", F.lit(""))).alias("text"))
    return A.number_errors(d)


_YEARS = r"regexp_replace(t, '(^|[^0-9.])((?:19|20)[0-9]{2})', '\1' || chr(57344) || '\2', 'g')"


@query(f"""WITH x AS (SELECT {said_sql("doc_id", NUMBERS)} || coalesce(text, '') AS t FROM documents),
y AS (SELECT 'full' AS kind, unnest(regexp_extract_all(t, {quoted(A.FULL_DATE)}, 1))::INT AS year FROM x
  UNION ALL SELECT 'bare', unnest(regexp_extract_all({_YEARS}, chr(57344) || {quoted(A.BARE_YEAR.replace("(?<![0-9.])", ""))}, 1))::INT FROM x)
SELECT kind, year, count(*)::BIGINT AS n, (count(*) FILTER (year >= 2022))::DOUBLE / sum(count(*)) OVER (PARTITION BY kind) AS recent FROM y GROUP BY kind, year""")
def year_shares(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(said("doc_id", NUMBERS), F.coalesce("text", F.lit(""))).alias("text"))
    return A.year_histogram(d)


@query("""WITH x AS (SELECT left(lower(regexp_replace(regexp_replace(source || '-' || lang || ' ' || doc_id, '[^0-9A-Za-z가-힣]+', '', 'g'), '[0-9]+', '', 'g')), 12) AS k FROM documents),
c AS (SELECT CASE WHEN length(k) < 3 THEN '(짧음)' ELSE left(sha256('s|' || k), 12) END AS org, count(*)::BIGINT AS n FROM x GROUP BY 1)
SELECT org, n, n::DOUBLE / (SELECT sum(n) FROM c) AS share FROM c""")
def organisation_keys(spark, sf):
    name = F.concat("source", F.lit("-"), "lang", F.lit(" "), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return A.organisations(table(spark, sf, "documents").select(name.alias("file_name")), "file_name", "s")


ROUTED = ["환자 진단 ", "문의 010-1234-5678 ", "환자 병력 문의 a.b@c.kr ", ""]
TASKS = ["draft", "classify", "plan", "nli", "gap_analysis"]
RESIDUAL = " OR ".join(f"regexp_matches(t, {quoted(p)})" for p in (P.RULES[0][0], P.RULES[1][0], r"(?:^|[^A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"))


@query(f"""WITH x AS (SELECT doc_id, repeat({said_sql("doc_id", ROUTED)} || coalesce(text, ''), CASE WHEN doc_id % 7 = 3 THEN 20 ELSE 1 END) AS t, {said_sql("doc_id", TASKS)} AS task FROM documents),
y AS (SELECT *, {SENSITIVE_SQL.replace("text", "t")} IS NOT NULL AS s, {RESIDUAL} AS r, floor(length(t) / 1.5::DOUBLE) + 1 AS tokens FROM x),
z AS (SELECT *, task IN ('draft', 'plan', 'gap_analysis') AS long, (tokens * 3.0::DOUBLE + CASE task WHEN 'draft' THEN 1500 WHEN 'plan' THEN 800 WHEN 'gap_analysis' THEN 800 ELSE 300 END * 15.0::DOUBLE) / 1e6::DOUBLE AS cost FROM y),
q AS (SELECT *, CASE WHEN s THEN 'sensitive' WHEN r THEN 'residual' WHEN tokens > 32000 THEN 'context' WHEN long AND cost <= 0.025::DOUBLE THEN 'long task' WHEN long THEN 'cost' ELSE 'short task' END AS rule FROM z)
SELECT doc_id, CASE WHEN rule IN ('context', 'long task') THEN 'api' ELSE 'local' END AS target, rule, round(cost, 9) AS cost FROM q""")
def inference_routes(spark, sf):
    text = F.repeat(F.concat(said("doc_id", ROUTED), F.coalesce("text", F.lit(""))), F.when(F.col("doc_id") % 7 == 3, 20).otherwise(1))
    d = table(spark, sf, "documents").select("doc_id", text.alias("text"), said("doc_id", TASKS).alias("task"))
    t = F.col("text")
    d = d.withColumn("_s", C.is_sensitive(t)).withColumn("_r", F.when(F.col("_s"), False).otherwise(P.has_residual(t)))  # once, as they decide target and rule
    r = K.route(t, F.col("task"), F.col("_s"), F.col("_r"), 0.025)
    return d.select("doc_id", r.alias("r")).select("doc_id", "r.target", "r.rule", F.round("r.cost", 9).alias("cost"))


@query(rf"SELECT lang, count(*)::BIGINT AS n, count(*) FILTER (length(t) BETWEEN 400 AND 1500 AND h >= 0.5 * length(regexp_replace(t, '[ \t\n\r\f\x0B]+', '', 'g')))::BIGINT AS usable FROM (SELECT lang, t, {HL} FROM (SELECT lang, CASE WHEN doc_id % 3 = 0 THEN repeat('가나다 ', 150) ELSE '' END || coalesce(text, '') AS t FROM documents)) GROUP BY lang")
def usable_abstracts(spark, sf):
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, "가나다 " * 150).otherwise(""), F.coalesce("text", F.lit("")))
    d = table(spark, sf, "documents").select("lang", text.alias("text"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(T.usable_abstract(F.col("text"))).alias("usable"))
