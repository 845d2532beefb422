"""Claims with evidence, tampered answers, records of claim sets, journals and feeds, made of parts, orders, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claim_evidence as E
from ..operators import gateway as W
from ..operators import generation as G
from ..sources import records as R
from ..sources.tables import table
from ..storage import written
from .phrases import quoted, said, said_sql
from .registry import query


def parts(spark, sf):
    k = F.col("p_partkey")
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), " "))
    return table(spark, sf, "part").select(F.floor(k / 4).alias("doc"), k.alias("id"), words.alias("words"), F.array(F.concat((F.col("p_size") % 10).cast("string"), F.lit("mg"))).alias("numbers"))


PARTS = "WITH p AS (SELECT p_partkey // 4 AS doc, p_partkey AS id, list_distinct(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')) AS words, (p_size % 10) || 'mg' AS num FROM part)"


@query(PARTS + """, c AS (SELECT a.doc, a.id AS claim, b.doc AS other, b.id AS evidence FROM p a JOIN p b ON a.doc <> b.doc AND b.id % 3 = 0 AND a.id % 5 = 0 AND a.num <> b.num AND len(list_intersect(a.words, b.words)) >= 2)
SELECT doc, claim, arg_min(other, md5('n:' || other || ':' || evidence)) AS other, arg_min(evidence, md5('n:' || other || ':' || evidence)) AS evidence FROM c GROUP BY doc, claim""")
def hard_neutrals(spark, sf):
    p = parts(spark, sf)
    return E.hard_neutrals(p.where("id % 5 = 0"), p.where("id % 3 = 0"))


@query(PARTS + """ SELECT a.doc, a.id AS claim, b.id AS evidence FROM p a JOIN p b ON a.doc = b.doc AND a.id <> b.id AND b.id % 3 = 0 WHERE len(list_intersect(a.words, b.words)) >= 2 OR (len(list_intersect(a.words, b.words)) >= 1 AND a.num = b.num)""")
def supported_claims(spark, sf):
    p = parts(spark, sf)
    return E.supported(p, p.where("id % 3 = 0"))


@query(PARTS + """ SELECT a.id FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE a.doc = b.doc AND a.id <> b.id AND b.id % 3 = 0 AND (len(list_intersect(a.words, b.words)) >= 2 OR (len(list_intersect(a.words, b.words)) >= 1 AND a.num = b.num)))""")
def claims_with_support(spark, sf):
    p = parts(spark, sf)
    return E.with_support(p, p.where("id % 3 = 0")).select("id")


@query("""WITH g AS (SELECT conv_id, count(*) FILTER (role = 'user') AS x, count(*) FILTER (role = 'assistant') AS y FROM conversations GROUP BY conv_id) SELECT count(*)::BIGINT AS documents, count(*) FILTER (x > 0 AND y > 0)::BIGINT AS both, coalesce(sum(x * y), 0)::BIGINT AS pairs FROM g""")
def pair_capacity(spark, sf):
    return E.pair_capacity(table(spark, sf, "conversations"), "conv_id", F.col("role") == "user", F.col("role") == "assistant")


NOUNS = ["enzyme", "sample", "polymer", "reactor", "culture"]


def claim_rows(spark, sf):
    """Sentences of orders: a claim with one number and evidence with two, which share a word and often the number."""
    k = F.col("o_orderkey")
    noun = said("o_orderkey", NOUNS)
    n = (k % 7 + 11).cast("string")
    claim = F.concat(F.lit("The "), noun, F.lit(" yield increased to "), n, F.lit(" mg in treated groups"))
    proof = F.concat(F.lit("Measured "), noun, F.lit(" yield was "), n, F.lit(" mg at "), (k % 5 + 30).cast("string"), F.lit(" min after stirring"))
    text = F.concat(claim, F.lit("\n"), proof, F.lit("\n"))
    return table(spark, sf, "orders").select(F.floor(k / 2).alias("doc"), F.lit(None).cast("string").alias("note"), text.alias("text"))


@query()
def claim_evidence_triples(spark, sf):
    s = E.sentences(claim_rows(spark, sf), "doc").withColumn("id", F.xxhash64("doc", "place", "sentence"))
    s = written(s.where("claim or evidence"), "sentences")
    return E.triples(s.where("claim"), s.where("evidence"))


SURNAMES = ["Zhao", "Smit", "Kim"]
VERBS = ["increases", "is near", "Reduced"]
CLAIM = f"(SELECT p_partkey AS k, 'The ' || p_name || ' ' || {said_sql('p_partkey', VERBS)} || ' yield ' || CASE WHEN p_partkey % 4 = 0 THEN p_size || '.5 mg' WHEN p_partkey % 4 = 1 THEN 'much' ELSE p_size || ' %' END AS c, {said_sql('p_partkey', SURNAMES)} AS s, 1990 + p_partkey % 30 AS y, '10.5/' || p_partkey AS d, p_size AS n, p_partkey % 4 AS q, p_partkey % 3 AS v FROM part)"
_CITE = "{c} || ' (' || s || ' et al. (' || {y} || '); DOI: ' || {d} || ')'"


def cite(c="c", y="y", d="d"):
    return _CITE.format(c=c, y=y, d=d)


ANSWERS = f"""WITH r AS {CLAIM}, e AS (SELECT *, CASE q WHEN 0 THEN replace(c, n || '.5 mg', rtrim(rtrim(printf('%.2f', round_even((n + 0.5::DOUBLE) * 0.5::DOUBLE + 1, 2)), '0'), '.') || ' mg') WHEN 1 THEN NULL ELSE replace(c, ' ' || n || ' %', ' ' || CASE WHEN n < 50 THEN n + 20 ELSE greatest(1, n // 2) END || ' %') END AS num,
  CASE v WHEN 0 THEN replace(c, 'increases', 'decreases') WHEN 2 THEN replace(c, 'Reduced', 'Elevated') END AS pol, CASE s WHEN 'Zhao' THEN 'Smith et al.' ELSE 'Zhang et al.' END AS swap FROM r)
SELECT k, 'compliant' AS label, NULL::VARCHAR AS halluc_type, {cite()} AS response FROM e UNION ALL SELECT k, 'no_source', NULL, c FROM e UNION ALL SELECT k, 'numeric_tamper', 'C', {cite("num")} FROM e WHERE num IS NOT NULL
UNION ALL SELECT k, 'fake_doi', 'A', {cite(d=quoted(G.FAKE_DOI))} FROM e UNION ALL SELECT k, 'polarity_flip', 'C', {cite("pol")} FROM e WHERE pol IS NOT NULL
UNION ALL SELECT k, 'biblio_tamper', 'A', replace({cite()}, s || ' et al.', swap) FROM e UNION ALL SELECT k, 'year_drift', 'A', {cite(y="(y - 5)")} FROM e"""


def claims_of_parts(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    size = F.when(k % 4 == 0, F.concat(n, F.lit(".5 mg"))).when(k % 4 == 1, "much").otherwise(F.concat(n, F.lit(" %")))
    claim = F.concat(F.lit("The "), "p_name", F.lit(" "), said("p_partkey", VERBS), F.lit(" yield "), size)
    return table(spark, sf, "part").select(k.alias("k"), claim.alias("claim"), said("p_partkey", SURNAMES).alias("surname"), (1990 + k % 30).alias("year"), F.concat(F.lit("10.5/"), k).alias("doi"))


@query(ANSWERS)
def tampered_answers(spark, sf):
    return G.examples(claims_of_parts(spark, sf)).select("k", "label", "halluc_type", "response")


@query(f"WITH a AS ({ANSWERS}) SELECT label AS kind, count(*)::BIGINT AS n FROM a WHERE label <> 'compliant' GROUP BY label")
def tampered_preferences(spark, sf):
    return G.preference_pairs(G.examples(claims_of_parts(spark, sf)), "k").groupBy("kind").agg(F.count("*").alias("n"))


SPONSORS = ["서울대학교병원", "한국연구원", "새바이오"]
CONDITIONS = ["당뇨", "위암"]
TRIAL = f"(SELECT c_custkey AS k, {said_sql('c_custkey', SPONSORS)} AS sp, {said_sql('c_custkey', CONDITIONS)} AS co, CASE c_custkey % 3 WHEN 0 THEN '중재연구' WHEN 1 THEN '관찰연구' ELSE '연구' END AS st, CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 13 END AS en, CASE WHEN c_custkey % 5 > 0 THEN 2000 + c_custkey % 20 END AS y, 'P' || c_custkey AS pr FROM customer)"


def _told(sp="sp", en="en", y="y"):
    josa = f"{sp} || CASE {sp} WHEN '서울대학교병원' THEN '은' WHEN '한국연구원' THEN '은' ELSE '는' END"
    return f"""({josa} || ' ' || co || CASE co WHEN '당뇨' THEN '를' ELSE '을' END || ' 대상으로 ' || st || '를 수행하였다' || CASE WHEN {en} IS NOT NULL THEN '. 본 연구에는 총 ' || format('{{:,}}', {en}) || '명이 등록되었다' ELSE '' END || CASE WHEN {y} IS NOT NULL THEN '. 연구 개시 시점은 ' || {y} || '년이다' ELSE '' END || '.')"""


def _source(sp="sp", y="y", pr="pr"):
    return f"' (출처: ' || {sp} || ', ' || {y} || ', 과제번호 ' || {pr} || ')'"


@query(f"""WITH t AS (SELECT *, CASE sp WHEN '새바이오' THEN '한국연구원' ELSE '새바이오' END AS ot FROM {TRIAL}), a AS (SELECT k, 'compliant' AS label, {_told()} || {_source()} AS response FROM t
UNION ALL SELECT k, 'sponsor', {_told("ot")} || {_source("ot")} FROM t UNION ALL SELECT k, 'enrollment', {_told(en="(en * 3 + 7)")} || {_source()} FROM t WHERE en IS NOT NULL UNION ALL SELECT k, 'date', {_told(y="(y - 4)")} || {_source(y="(y - 4)")} FROM t WHERE y IS NOT NULL
UNION ALL SELECT k, 'id', {_told()} || {_source(pr=quoted(G.FAKE_PROJECT))} FROM t UNION ALL SELECT k, 'no_source', {_told()} FROM t) SELECT * FROM a WHERE response IS NOT NULL""")
def trial_answers(spark, sf):
    k = F.col("c_custkey")
    t = table(spark, sf, "customer").select(
        k.alias("k"), said("c_custkey", SPONSORS).alias("sponsor"), said("c_custkey", CONDITIONS).alias("condition"), F.when(k % 3 == 0, "INTERVENTIONAL").when(k % 3 == 1, "OBSERVATIONAL").otherwise("OTHER").alias("study_type"),
        F.when(k % 4 > 0, k * 13).alias("enrolled"), F.when(k % 5 > 0, 2000 + k % 20).alias("year"), F.concat(F.lit("P"), k).alias("project"),
    )
    other = F.when(F.col("sponsor") == "새바이오", "한국연구원").otherwise("새바이오")
    return G.trial_items(t, other).select("k", "label", "response")


@query("""WITH c AS (SELECT conv_id AS doc_id, list(text ORDER BY turn) AS abstract FROM conversations GROUP BY conv_id), n AS (SELECT count(*) AS n FROM c),
q AS (SELECT c_custkey AS id, c_custkey % (n + 3) AS d, (c_custkey * 7) % n AS cite FROM customer, n),
e AS (SELECT id, d AS doc_id, CASE WHEN id % 3 = 0 THEN 'SUPPORT' WHEN id % 3 = 1 THEN 'CONTRADICT' ELSE 'OTHER' END AS label, list_filter([0, id % 4, 99], lambda i: i < len(abstract)) AS ix, abstract FROM q JOIN c ON c.doc_id = q.d WHERE id % 6 <> 5),
r AS (SELECT id AS claim_id, doc_id, label, array_to_string(list_transform(ix, lambda i: abstract[(i + 1)::BIGINT]), ' ') AS evidence FROM e WHERE label <> 'OTHER'
  UNION ALL SELECT id, q.cite, 'NEI', array_to_string(abstract[1:2], ' ') FROM q JOIN c ON c.doc_id = q.cite WHERE id % 6 = 5 OR q.cite <> q.d)
SELECT claim_id, doc_id, label, md5(evidence) AS digest FROM r WHERE trim(evidence) <> ''""")
def rationale_rows(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("a"))
    c = c.select("doc_id", F.col("a.text").alias("abstract"))
    n = c.agg(F.count("*").alias("n"))
    q = table(spark, sf, "customer").join(F.broadcast(n))  # one row
    k = F.col("c_custkey")
    label = F.when(k % 3 == 0, "SUPPORT").when(k % 3 == 1, "CONTRADICT").otherwise("OTHER")
    one = F.array(F.struct(F.array(F.lit(0), (k % 4).cast("int"), F.lit(99)).alias("sentences"), label.alias("label")))
    claims = q.select(k.alias("id"), F.concat(F.lit("claim "), k).alias("claim"), F.when(k % 6 != 5, F.create_map((k % (F.col("n") + 3)).cast("string"), one)).alias("evidence"), F.array((k * 7) % F.col("n")).alias("cited_doc_ids"))
    got = R.rationales(claims, c, unrelated=True)
    return got.select("claim_id", "doc_id", "label", F.md5("evidence").alias("digest"))


def xml(spark, sf):
    k = F.col("page_id")
    live = F.concat(F.lit('<record><x article-id="A'), k, F.lit('"/><journal-name> R&amp;D  <b>Letters</b></journal-name><pub-year>20'), F.lpad((k % 25).cast("string"), 2, "0"), F.lit('</pub-year><article-title lang="original">'), "url", F.lit('</article-title><author> <name>Kim</name></author><author><name>Lee &lt;x&gt;</name><affiliation>a</affiliation></author></record>'))
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("<list>"), live, F.lit('<record status="deleted"></record>'), F.when(k % 3 == 0, live).otherwise(""), F.lit("<resumptionToken a='1'> t:"), k, F.lit(" </resumptionToken>")).alias("xml"))


@query("""SELECT 'A' || page_id AS id, 'R&D Letters' AS journal, '20' || lpad((page_id % 25)::VARCHAR, 2, '0') AS year, trim(regexp_replace(url, '[ \t\n\r\f]+', ' ', 'g')) AS title, 'Kim|Lee <x>' AS authors, '' AS doi FROM pages, range(2) r(i) WHERE i = 0 OR page_id % 3 = 0""")
def journal_records(spark, sf):
    return R.journal_records(xml(spark, sf)).select("id", "journal", "year", "title", F.array_join("authors", "|").alias("authors"), "doi")


@query("SELECT page_id, 't:' || page_id AS token FROM pages")
def harvest_tokens(spark, sf):
    return xml(spark, sf).select("page_id", R.next_token(F.col("xml")).alias("token"))


@query("""SELECT page_id, (page_id % 5) || '|' || (page_id % 5 + 1) AS numbers, 'Guide & rules' AS title, CASE WHEN page_id % 2 = 0 THEN 'R-' || page_id ELSE '' END AS reg_no, 'f' || page_id || '=plan.pdf' AS files FROM pages""")
def notices(spark, sf):
    k = F.col("page_id")
    page = F.concat(
        F.lit('<a href="view.do?seq='), k % 5, F.lit('">a</a><a href="view.do?seq='), k % 5 + 1, F.lit('">b</a><a href="view.do?seq='), k % 5, F.lit('">c</a><div class="bv_title"> Guide &amp; <i>rules</i> </div>'),
        F.when(k % 2 == 0, F.concat(F.lit("<li><span> 등록번호 </span> R-"), k, F.lit("</li><li><span>등록일</span>2024-01-02</li>"))).otherwise(""), F.lit('<strong>★ plan.pdf</strong> <a href="./down.do?x=1&file_seq='), k, F.lit('">'),
    )
    n = R.notice(page)
    d = table(spark, sf, "pages").select("page_id", R.notice_numbers(page).alias("s"), n.alias("n"))
    files = F.array_join(F.transform("n.files", lambda f: F.concat(F.lit("f"), f["number"], F.lit("="), f["name"])), "|")
    return d.select("page_id", F.array_join("s", "|").alias("numbers"), "n.title", "n.reg_no", files.alias("files"))


@query("""SELECT 'http://x/abs/' || page_id AS id, page_id || 'v1' AS number, 'A & B ' || url AS title, 'Ann Lee|Bo' AS authors FROM pages""")
def preprint_entries(spark, sf):
    k = F.col("page_id")
    feed = F.concat(F.lit("<feed><entry><id>http://x/abs/"), k, F.lit("</id><title>A &amp; \n B "), "url", F.lit("</title><author><name>Ann\n Lee</name></author><author><name>Bo</name></author></entry></feed>"))
    got = R.preprint_entries(table(spark, sf, "pages").select(feed.alias("xml")))
    return got.select("id", F.concat("number", F.lit("v1")).alias("number"), "title", F.array_join("authors", "|").alias("authors"))


@query("""WITH r AS (SELECT '10.1/' || o_custkey AS doi, o_orderkey AS position, 'Kim ; Lee;; P' || o_orderkey AS authors FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY position DESC) AS n FROM r) SELECT doi, position, 'Kim|Lee|P' || position AS authors FROM k WHERE n = 1""")
def registry_records(spark, sf):
    k = F.col("o_orderkey")
    r = table(spark, sf, "orders").select(F.concat(F.lit("10.1/"), "o_custkey").alias("doi"), F.lit("A title").alias("title"), F.year("o_orderdate").alias("year"), F.concat(F.lit("Kim ; Lee;; P"), k).alias("authors"), k.alias("position"))
    return R.latest(R.registry(r)).select("doi", "position", F.array_join("authors", "|").alias("authors"))


@query("""WITH m AS (SELECT unnest(range(DATE '2023-01-01', DATE '2024-05-01', INTERVAL 1 MONTH))::DATE AS start) SELECT start, (start + INTERVAL 1 MONTH)::DATE AS stop FROM m WHERE month(start) <> 2""")
def months_to_harvest(spark, sf):
    m = R.months("2023-01-15", "2024-04-20", spark)
    return R.not_yet(m, m.where(F.month("start") == 2), "start")


@query(r"""WITH x AS (SELECT doc_id, source, repeat('가나다 ', CASE WHEN doc_id % 4 < 2 THEN 120 + doc_id % 5 ELSE 0 END) || CASE WHEN doc_id % 4 < 2 THEN '' ELSE coalesce(text, '') END AS a FROM documents),
y AS (SELECT *, source IN ('src1', 'src2', 'src3', 'src4', 'src5') AS f, length(a) BETWEEN 400 AND 1500 AND length(regexp_replace(a, '[^가-힣]', '', 'g')) >= 0.5 * length(regexp_replace(a, '[ \t\n\r\f\x0B]+', '', 'g')) AS u, sha256(regexp_replace(a, '[ \t\n\r\f\x0B]+', '', 'g')) AS h FROM x),
z AS (SELECT *, CASE WHEN NOT coalesce(f, false) THEN 'field' WHEN NOT u THEN 'length or language' END AS v FROM y)
SELECT doc_id, coalesce(v, CASE WHEN row_number() OVER (PARTITION BY v, h ORDER BY doc_id) = 1 THEN 'used' ELSE 'copy' END) AS verdict FROM z""")
def collected_abstracts(spark, sf):
    k = F.col("doc_id")
    text = F.when(k % 4 < 2, F.repeat(F.lit("가나다 "), (120 + k % 5).cast("int"))).otherwise(F.coalesce("text", F.lit("")))
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("category"), text.alias("abstract"))
    return R.collected_abstracts(d, [f"src{j}" for j in range(1, 6)], T.usable_abstract(F.col("abstract")), "doc_id").select("doc_id", "verdict")


@query("""WITH r AS (SELECT unnest(['10.A/' || o_custkey % 9, '10.b/' || o_orderkey % 7]) AS d, ['10.a/' || o_orderkey % 9, '10.B/1'] AS s FROM orders), f AS (SELECT list_contains(list_transform(s, lambda x: lower(x)), lower(d)) AS a, d IN ('10.A/1', '10.A/2', '10.b/1', '10.b/5') AS b FROM r)
SELECT count(*)::BIGINT AS cited, count(*) FILTER (a)::BIGINT AS in_sources, count(*) FILTER (b)::BIGINT AS resolvable, count(*) FILTER (a AND b)::BIGINT AS accurate, count(*) FILTER (a AND b)::DOUBLE / count(*) AS accuracy FROM f""")
def citation_accuracy(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.array(F.concat(F.lit("10.A/"), F.col("o_custkey") % 9), F.concat(F.lit("10.b/"), k % 7)).alias("cited"), F.array(F.concat(F.lit("10.a/"), k % 9), F.lit("10.B/1")).alias("sources"))
    known = spark.createDataFrame([("10.A/1",), ("10.A/2",), ("10.b/1",), ("10.b/5",)], "doi string")
    return W.citation_accuracy(o, "o_orderkey", "cited", "sources", known)
