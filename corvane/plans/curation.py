"""Corpus profile, quality gate, samples and passages over documents, pages and conversations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import privacy as P
from ..functions import text as T
from ..operators import curation as C
from ..operators import judging as J
from ..operators import relations as R
from ..sources.tables import html_records, table
from .phrases import said, said_sql
from .registry import query

SQ = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B]+', ' ', 'g'))"
RE2 = {"(?![대기트])": ""}  # look-around that DuckDB lacks; its text stands in no driver table


def _re2(pattern: str) -> str:
    for a, b in RE2.items():
        pattern = pattern.replace(a, b)
    return pattern.replace("'", "''")


SENSITIVE_SQL = f"""CASE WHEN regexp_matches(text, '(?i){_re2(C.ADVERSE + "|" + C.ADVERSE_LATIN)}')
                OR (regexp_matches(text, '(?i){_re2(C.HEALTH + "|" + C.HEALTH_LATIN)}') AND regexp_matches(text, '(?i){_re2(C.SUBJECT + "|" + C.SUBJECT_LATIN)}'))
                OR (NOT (regexp_matches(text, '(?i){_re2(C.HEALTH + "|" + C.HEALTH_LATIN)}') AND regexp_matches(text, '(?i){_re2(C.SUBJECT + "|" + C.SUBJECT_LATIN)}'))
                    AND regexp_matches(text, '(?i){_re2(C.CLINICAL)}') AND NOT regexp_matches(text, '(?i){_re2(C.NONHUMAN)}'))
              THEN 'sensitive' END"""

GATE = f"""
WITH n AS (
  SELECT doc_id, source, lang, {SQ} AS t, {SENSITIVE_SQL} AS s
  FROM documents),
r AS (
  SELECT *, CASE WHEN s IS NOT NULL THEN s WHEN length(t) < 200 THEN 'too_short'
                 WHEN length(regexp_replace(t, '[^A-Za-z가-힣]', '', 'g')) / length(t) < 0.30 THEN 'low_letter' END AS r0
  FROM n),
g AS (
  SELECT doc_id, source, lang, CASE WHEN r0 IS NOT NULL THEN r0
         WHEN row_number() OVER (PARTITION BY r0, t ORDER BY doc_id) > 1 THEN 'dup' END AS reason FROM r)
"""


@query(GATE + "SELECT doc_id, reason FROM g")
def gate_reasons(spark, sf):
    return C.gate(table(spark, sf, "documents"))


@query(GATE + "SELECT coalesce(reason, 'passed') AS reason, count(*)::BIGINT AS n, count(*)::DOUBLE / (SELECT count(*) FROM g) AS share FROM g GROUP BY 1")
def gate_stats(spark, sf):
    g = C.gate(table(spark, sf, "documents")).groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query(GATE + "SELECT source, count(*)::BIGINT AS seen, count(*) FILTER (reason IS NULL)::BIGINT AS passed, count(*) FILTER (reason = 'dup')::BIGINT AS dup FROM g GROUP BY source")
def gate_by_source(spark, sf):
    return C.gate(table(spark, sf, "documents"), carry=["source"]).groupBy("source").agg(F.count("*").alias("seen"), F.count_if(F.col("reason").isNull()).alias("passed"), F.count_if(F.col("reason") == "dup").alias("dup"))


GATED = ["", "환자 진단 ", "부작용 ", "당뇨 처방 ", "마우스 당뇨 처방 ", "pH 15.2 순도: 120 % ", ""]


@query(GATE.replace("FROM documents)", f"""FROM (SELECT doc_id, source, lang, {said_sql("doc_id", GATED)} || CASE WHEN doc_id % 11 = 7 THEN repeat('12 34 ', 50) || doc_id ELSE coalesce(text, '') END AS text FROM documents))""")
  .replace("CASE WHEN s IS NOT NULL THEN s", "CASE WHEN doc_id % 13 = 5 THEN 'paper' WHEN s IS NOT NULL THEN s") + "SELECT doc_id, reason FROM g")
def gate_every_reason(spark, sf):
    text = F.concat(said("doc_id", GATED), F.when(F.col("doc_id") % 11 == 7, F.concat(F.lit("12 34 " * 50), F.col("doc_id").cast("string"))).otherwise(F.coalesce("text", F.lit(""))))
    return C.gate(table(spark, sf, "documents").withColumn("text", text), paper=F.col("doc_id") % 13 == 5)


@query(GATE.replace("FROM documents)", f"""FROM (SELECT doc_id, source, lang, {said_sql("doc_id", GATED)} || coalesce(text, '') AS text FROM documents))""") + """SELECT doc_id, CASE WHEN doc_id % 7 = 5 THEN ['pH', '순도'] ELSE [] END::VARCHAR AS violations FROM g WHERE reason IS NULL""")
def gate_flagged(spark, sf):
    text = F.concat(said("doc_id", GATED), F.coalesce("text", F.lit("")))
    d = C.gate_flagged(table(spark, sf, "documents").withColumn("text", text))
    return d.select("doc_id", F.concat(F.lit("["), F.array_join("violations", ", "), F.lit("]")).alias("violations"))


@query(f"SELECT count(*)::BIGINT AS n, count(DISTINCT t)::BIGINT AS kinds, (count(*) - count(DISTINCT t))::DOUBLE / count(*) AS dup_share FROM (SELECT {SQ} AS t FROM documents) WHERE t <> ''")
def exact_duplicates(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2(T.squeeze(F.coalesce("text", F.lit(""))), 256).alias("h"), T.squeeze(F.coalesce("text", F.lit(""))).alias("t")).where("t <> ''")
    per = d.groupBy("h").agg(F.count("*").alias("c"))
    return per.agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), ((F.sum("c") - F.count("*")) / F.sum("c")).alias("dup_share"))


@query(f"SELECT coalesce(sum(c - 1), 0)::BIGINT AS repeats, count(*)::BIGINT AS templates FROM (SELECT left(t, 120) AS k, count(*) AS c FROM (SELECT {SQ} AS t FROM documents) GROUP BY 1)")
def template_repeats(spark, sf):
    k = table(spark, sf, "documents").groupBy(F.substring(T.squeeze(F.coalesce("text", F.lit(""))), 1, 120).alias("k")).agg(F.count("*").alias("c"))
    return k.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeats"), F.count("*").alias("templates"))


@query("""SELECT CASE WHEN n < 200 THEN '0-199' WHEN n < 500 THEN '200-499' WHEN n < 1000 THEN '500-999' WHEN n < 2000 THEN '1000-1999'
  WHEN n < 5000 THEN '2000-4999' WHEN n < 10000 THEN '5000-9999' ELSE '10000+' END AS bucket, count(*)::BIGINT AS n_docs, avg(n) AS mean_chars
  FROM (SELECT length(text) AS n FROM documents) GROUP BY 1""")
def length_histogram(spark, sf):
    d = table(spark, sf, "documents").select(F.length("text").alias("n"))
    return d.groupBy(T.length_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("mean_chars"))


@query(r"""SELECT lang, CASE WHEN h + l = 0 THEN 'none' WHEN h / (h + l) > 0.7 THEN 'korean' WHEN h / (h + l) > 0.3 THEN 'mixed' ELSE 'latin' END AS script, count(*)::BIGINT AS n
  FROM (SELECT lang, length(regexp_replace(text, '[^가-힣]', '', 'g')) AS h, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents) GROUP BY 1, 2""")
def script_by_language(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", T.language_bucket(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


@query(r"""SELECT lang, round(sum(h / 1.8::DOUBLE + l / 4.5::DOUBLE + d / 2.5::DOUBLE + (n - h - l - d) / 4.5::DOUBLE), 3) AS least,
  round(sum(h / 1.3::DOUBLE + l / 3.5::DOUBLE + d / 1.5::DOUBLE + (n - h - l - d) / 3.0::DOUBLE), 3) AS most FROM (
  SELECT lang, length(text) AS n, length(regexp_replace(text, '[^가-힣]', '', 'g')) AS h, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l,
  length(regexp_replace(text, '[^0-9]', '', 'g')) AS d FROM documents) GROUP BY lang""")
def token_estimate(spark, sf):
    low, high = T.token_bounds(F.col("text"))
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(F.sum(low), 3).alias("least"), F.round(F.sum(high), 3).alias("most"))


MD5 = "('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT"


@query(f"SELECT doc_id, source FROM documents WHERE {MD5} % 8 = 3")
def hash_stride_sample(spark, sf):
    return C.hash_stride(table(spark, sf, "documents"), "doc_id", 8, 3).select("doc_id", "source")


@query(f"SELECT {MD5} % 20 = 0 AS held, count(*)::BIGINT AS n, min(doc_id) AS least FROM documents GROUP BY 1")
def hash_split(spark, sf):
    return C.held_out(table(spark, sf, "documents"), "doc_id").groupBy("held").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS k FROM documents) WHERE (k - 1) % 75 = 0")
def row_stride(spark, sf):
    return C.every_nth(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 75)


@query("SELECT doc_id, source FROM documents ORDER BY md5('s' || doc_id::VARCHAR), doc_id LIMIT 360")
def uniform_sample(spark, sf):
    return C.uniform_sample(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 360)


RANKED = "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('s' || doc_id::VARCHAR), doc_id) AS k, count(*) OVER (PARTITION BY source) AS population FROM documents"


@query(f"SELECT doc_id, source, population::BIGINT AS population FROM ({RANKED}) WHERE k <= 10")
def stratified_sample(spark, sf):
    return C.stratified_sample(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 10).select("doc_id", "source", "population")


@query(f"SELECT doc_id, source FROM ({RANKED}) ORDER BY k > 5, md5('s' || doc_id::VARCHAR), doc_id LIMIT 150")
def quota_sample(spark, sf):
    return C.quota_sample(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 5, 150)


@query(r"""SELECT doc_id FROM documents WHERE regexp_replace(text, '[ \t\n\r\f\x0B]+', '', 'g') NOT IN (SELECT regexp_replace(text, '[ \t\n\r\f\x0B]+', '', 'g') FROM benchmark)""")
def held_out_exclusion(spark, sf):
    return R.without_held_out(table(spark, sf, "documents"), table(spark, sf, "benchmark"), F.col("text"), F.col("text")).select("doc_id")


@query("SELECT lang, source, count(*)::BIGINT AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang) AS share FROM documents GROUP BY 1, 2")
def language_source_crosstab(spark, sf):
    g = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))


# Marks of licence lines, of numbers, of questions and of headings, one bit each.
MARKS = ("(?i)copyright|licen[sc]e", "[0-9]{4}", r"\?", "(?m)^#")


def _bits(sql: bool):
    if sql:
        return " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {1 << k} ELSE 0 END" for k, p in enumerate(MARKS))
    return sum((F.when(F.col("text").rlike(p), 1 << k).otherwise(0) for k, p in enumerate(MARKS)), F.lit(0)).cast("bigint")


@query(f"SELECT source, bit_or(m)::BIGINT AS marks, bit_count(bit_or(m))::BIGINT AS kinds, count(*)::BIGINT AS n, arg_min(lang, doc_id) AS first_lang FROM (SELECT *, ({_bits(True)})::BIGINT AS m FROM documents) GROUP BY source")
def marks_by_source(spark, sf):
    g = table(spark, sf, "documents").withColumn("m", _bits(False)).groupBy("source")
    g = g.agg(F.bit_or("m").alias("marks"), F.count("*").alias("n"), F.min_by("lang", "doc_id").alias("first_lang"))
    return g.select("source", "marks", F.bit_count("marks").cast("bigint").alias("kinds"), "n", "first_lang")


@query("""SELECT bin, count(*)::BIGINT AS n FROM (SELECT CASE WHEN c = 1 THEN '1' WHEN c < 5 THEN '2-4' WHEN c < 10 THEN '5-9' WHEN c < 30 THEN '10-29' ELSE '30+' END AS bin
  FROM (SELECT count(*) AS c FROM conversations GROUP BY conv_id)) GROUP BY bin""")
def turn_count_histogram(spark, sf):
    c = F.col("c")
    b = F.when(c == 1, "1").when(c < 5, "2-4").when(c < 10, "5-9").when(c < 30, "10-29").otherwise("30+")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("c")).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


@query(r"SELECT conv_id, count(*)::BIGINT AS pages, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def joined_turns(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return g.select("conv_id", F.size("p").cast("bigint").alias("pages"), F.md5(F.array_join(F.col("p.text"), "\n\n")).alias("digest"))


@query("""SELECT conv_id, island, any_value(role) AS role, min(turn) AS first, max(turn) AS last, count(*)::BIGINT AS n FROM (
  SELECT *, (sum(new) OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS island FROM (
    SELECT *, (role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS new FROM conversations)) GROUP BY conv_id, island""")
def role_islands(spark, sf):
    return R.islands(table(spark, sf, "conversations"), "conv_id", "turn", "role")


@query("""SELECT conv_id, turn, md5(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)) AS digest FROM conversations""")
def turn_passages(spark, sf):
    return R.passages(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.md5("passage").alias("digest"))


@query(r"""WITH k AS (SELECT conv_id, turn, length(text) > 300 AS c, role = 'assistant' AS e FROM conversations),
m AS (SELECT *, sum(c::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM k),
j AS (SELECT conv_id, turn, CASE WHEN c AND n <= 2 THEN 'claim' WHEN e THEN 'evidence' END AS kind FROM m)
SELECT conv_id, turn, kind FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn) AS r FROM j WHERE kind IS NOT NULL) WHERE r <= 2""")
def claim_evidence_buffers(spark, sf):
    return R.buffers(table(spark, sf, "conversations"), "conv_id", "turn", F.length("text") > 300, F.col("role") == "assistant", cap=2)


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS title,
  len(regexp_extract_all(html, '(?i)href="([^"]*)"', 1))::BIGINT AS n_links FROM pages""")
def page_records(spark, sf):
    return html_records(table(spark, sf, "pages")).select("page_id", "title", "n_links")


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
  '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS digest FROM pages""")
def page_texts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("digest"))


@query(r"""SELECT mask, count(*)::BIGINT AS n FROM (SELECT regexp_replace(regexp_replace(left(text, 14), '[A-Za-z]', 'A', 'g'), '[0-9]', 'D', 'g') AS mask FROM documents)
  GROUP BY mask ORDER BY n DESC, mask LIMIT 20""")
def shape_masks(spark, sf):
    m = T.shape_mask(F.substring("text", 1, 14))
    return table(spark, sf, "documents").groupBy(m.alias("mask")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mask").limit(20)


def _shapes_of(pattern: str, rule: str) -> str:
    """SQL: rule, mask of each match. Matches go between two private characters; a look-behind, which DuckDB lacks, is what stands before the first."""
    label, body = re.match(r"(?:\(\?<([=!].*?\]?)\))?(.*)", pattern).groups()
    before = {"!": f"^|[^{(label or '')[2:]}", "=": (label or "")[1:]}[label[0]] if label else ""
    a, b = "chr(57344)", "chr(57345)"
    return f"""SELECT '{rule}' AS rule, regexp_replace(regexp_replace(regexp_replace(right(l, {P.CONTEXT}) || m || left(r, {P.CONTEXT}), '[A-Za-z]', 'A', 'g'), '[0-9]', 'D', 'g'), '[가-힣]', 'K', 'g') AS mask
  FROM (SELECT replace(array_to_string(p[:i], ''), {b}, '') AS l, split_part(p[i + 1], {b}, 1) AS m,
      substr(replace(array_to_string(p[i + 1:], ''), {b}, ''), length(split_part(p[i + 1], {b}, 1)) + 1) AS r
    FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(regexp_replace(text, '({before})({body})', '\\1' || {a} || '\\2' || {b}, 'g'), {a}) AS p FROM documents)))
  WHERE NOT regexp_matches(left(r, 8), '^_[0-9A-F]{{4}}\\b')"""


@query(f"SELECT rule, mask, count(*)::BIGINT AS n FROM ({' UNION ALL '.join(_shapes_of(p, rule) for p, rule in P.RULES)}) GROUP BY ALL ORDER BY n DESC, rule, mask LIMIT 20")
def residual_shapes(spark, sf):
    m = table(spark, sf, "documents").select(F.inline(P.residual_shapes(F.col("text"))))
    return m.groupBy("rule", "mask").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule", "mask").limit(20)


@query(r"""WITH w AS (SELECT item_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[가-힣]{2,}|[A-Za-z]{3,}'), lambda x: lower(x)),
  lambda x: x NOT IN ('the', 'and', 'for', 'with', 'was', 'were', 'this', 'that', 'from'))) AS ws FROM benchmark)
SELECT x.item_id AS a, y.item_id AS b, len(list_intersect(x.ws, y.ws))::BIGINT AS shared FROM w x JOIN w y ON x.item_id < y.item_id WHERE len(list_intersect(x.ws, y.ws)) >= 4""")
def lexical_neighbours(spark, sf):
    return R.sharing_pairs(table(spark, sf, "benchmark"), "item_id", T.content_words(F.col("text")), 4)


@query(rf"""WITH RECURSIVE e AS (SELECT DISTINCT doc_id AS a, md5({SQ}) AS h FROM documents),
f AS (SELECT a, min(a) OVER (PARTITION BY h) AS root, count(*) OVER (PARTITION BY h) AS n FROM e)
SELECT a AS node, root FROM f WHERE n > 1""")
def shared_passage_components(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5(T.squeeze(F.coalesce("text", F.lit("")))).alias("h"))
    hub = d.groupBy("h").agg(F.min("doc_id").alias("b"))  # a star about the smallest id: no pairs within a group
    return R.components(d.join(hub, "h").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b"))


def _hits(marks, flag):
    return " + ".join("(CASE WHEN regexp_matches(text, '" + flag + m.replace("'", "''") + "') THEN 1 ELSE 0 END)" for m in marks)


@query(rf"""WITH t AS (SELECT doc_id, text, {_hits(J.NOTE_MARKS, "")} AS notes, {_hits(J.CITE_MARKS, "(?i)")} AS cites, string_split_regex(text, '\r\n|\n|\r') AS lines,
  length(regexp_replace(text, '[^가-힣]', '', 'g')) AS h, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents)
SELECT doc_id, CASE WHEN length(trim(text)) < 200 THEN 'low_value' WHEN notes >= 4 THEN 'labnote_like' WHEN cites >= 2 THEN 'cited'
  WHEN len(list_filter(lines, lambda x: regexp_matches(x, '^\s*\S{{0,12}}\s*$'))) / len(lines) > 0.6 THEN 'tabular'
  WHEN h / greatest(1, h + l) >= 0.4 THEN 'korean_prose' ELSE 'low_value' END AS bucket FROM t""")
def use_triage(spark, sf):
    return table(spark, sf, "documents").select("doc_id", J.use_triage(F.col("text")).alias("bucket"))
