"""Records from formats of others: claim sets with rationales, and bibliographic pages parsed by patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalised_title, squeeze

CLAIM_SET = "id bigint, claim string, evidence map<string,array<struct<sentences:array<int>,label:string>>>, cited_doc_ids array<bigint>"
CORPUS = "doc_id bigint, title string, abstract array<string>"

# Fields of journal records and of preprint feeds.
JOURNAL = {
    "journal": r"(?s)<journal-name>(.*?)</journal-name>", "year": r"<pub-year>(.*?)</pub-year>", "category": r"(?s)<article-categories>(.*?)</article-categories>", "language": r"<language>(.*?)</language>",
    "title": r'(?s)<article-title lang="original">(.*?)</article-title>', "title_en": r'(?s)<article-title lang="english">(.*?)</article-title>', "abstract": r'(?s)<abstract lang="original">(.*?)</abstract>',
    "abstract_en": r'(?s)<abstract lang="english">(.*?)</abstract>', "doi": r"<doi>(.*?)</doi>", "url": r"<url>(.*?)</url>",
}
JOURNAL_AUTHOR = r"(?s)<author>\s*<name>(.*?)</name>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def read_claim_set(spark: SparkSession, claims: str, corpus: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(CLAIM_SET).json(claims), spark.read.schema(CORPUS).json(corpus)


def rationales(claims: DataFrame, corpus: DataFrame, unrelated: bool = False) -> DataFrame:
    """claim, evidence, label, claim_id, doc_id: each rationale's sentences as one text; unrelated adds NEI rows.

    An NEI row has the first two sentences of a cited abstract that is no evidence.
    """
    c = corpus.select("doc_id", "abstract").where(F.size("abstract") > 0)
    e = claims.select("id", "claim", F.explode("evidence").alias("d", "rs")).select("id", "claim", F.col("d").cast("bigint").alias("doc_id"), F.explode("rs").alias("r"))
    e = e.where(F.col("r.label").isin("SUPPORT", "CONTRADICT")).join(c, "doc_id")
    at = F.filter(F.col("r.sentences"), lambda i: (i >= 0) & (i < F.size("abstract")))
    text = F.array_join(F.transform(at, lambda i: F.get("abstract", i)), " ")
    out = e.select("claim", text.alias("evidence"), F.col("r.label").alias("label"), F.col("id").alias("claim_id"), "doc_id").where(F.trim("evidence") != "")
    if not unrelated:
        return out
    used = F.transform(F.coalesce(F.map_keys("evidence"), F.array().cast("array<string>")), lambda k: k.cast("bigint"))
    n = claims.select("id", "claim", F.explode(F.filter("cited_doc_ids", lambda d: ~F.array_contains(used, d))).alias("doc_id")).join(c, "doc_id")
    return out.unionByName(n.select("claim", F.array_join(F.slice("abstract", 1, 2), " ").alias("evidence"), F.lit("NEI").alias("label"), F.col("id").alias("claim_id"), "doc_id"))


def titles(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", "title")


def plain(markup: Column) -> Column:
    """Text of a piece of markup: tags gone, white space squeezed, entities undone."""
    t = squeeze(F.regexp_replace(markup, "<[^>]+>", ""))
    for name, c in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(c))
    return t


def journal_records(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per live record of harvested pages: id, the fields (empty where missing), authors; deleted records have no id and go."""
    r = pages.select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<record>(.*?)</record>"), F.lit(1))).alias("r"))
    r = r.withColumn("id", F.regexp_extract("r", r'article-id="([^"]+)"', 1)).where("id <> ''")
    fields = [plain(F.regexp_extract("r", p, 1)).alias(k) for k, p in JOURNAL.items()]
    return r.select("id", *fields, F.transform(F.regexp_extract_all("r", F.lit(JOURNAL_AUTHOR), F.lit(1)), plain).alias("authors"))


def next_token(xml: Column) -> Column:
    return F.trim(F.regexp_extract(xml, r"<resumptionToken[^>]*>([^<]+)</resumptionToken>", 1))


def notice_numbers(html: Column) -> Column:
    """Numbers of the notices that a list page links to, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"view\.do\?seq=(\d+)"), F.lit(1)))


def notice(html: Column) -> Column:
    """Struct of title, reg_no, date and files (number and name) of a notice's page."""
    keys = F.regexp_extract_all(html, F.lit(r"(?s)<li><span>\s*(.*?)\s*</span>(.*?)</li>"), F.lit(1))
    values = F.regexp_extract_all(html, F.lit(r"(?s)<li><span>\s*(.*?)\s*</span>(.*?)</li>"), F.lit(2))
    meta = F.zip_with(keys, values, lambda k, v: F.struct(plain(k).alias("k"), plain(v).alias("v")))
    one = lambda name: F.coalesce(F.element_at(F.transform(F.filter(meta, lambda m: m["k"] == name), lambda m: m["v"]), -1), F.lit(""))
    file = r'<strong>([^<]*)</strong>\s*<a href="\./down\.do\?[^"]*?file_seq=(\d+)"'
    files = F.zip_with(F.regexp_extract_all(html, F.lit(file), F.lit(2)), F.regexp_extract_all(html, F.lit(file), F.lit(1)), lambda n, t: F.struct(n.alias("number"), F.trim(F.regexp_replace(plain(t), "^[★ ]+", "")).alias("name")))
    safe = F.when(F.size(meta) > 0, one("등록번호")).otherwise("")
    dated = F.when(F.size(meta) > 0, one("등록일")).otherwise("")
    return F.struct(plain(F.regexp_extract(html, r'(?s)<div class="bv_title">(.*?)</div>', 1)).alias("title"), safe.alias("reg_no"), dated.alias("date"), files.alias("files"))


def preprint_entries(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per entry of a feed: id, title, summary, published, authors, number (the id's last part)."""
    r = pages.select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("r"))
    one = lambda tag: plain(F.regexp_extract("r", rf"(?s)<{tag}>(.*?)</{tag}>", 1))
    return r.select(*[one(t).alias(t) for t in ("id", "title", "summary", "published")], F.transform(F.regexp_extract_all("r", F.lit(r"(?s)<name>(.*?)</name>"), F.lit(1)), plain).alias("authors")).withColumn("number", F.substring_index("id", "/", -1))


def registry(seed: DataFrame) -> DataFrame:
    """doi, title, year, authors, position of registry records whose authors are one string; later records override earlier ones of a DOI."""
    names = F.filter(F.transform(F.split(F.coalesce("authors", F.lit("")), ";"), lambda a: F.trim(a)), lambda a: a != "")
    return seed.select("doi", "title", normalised_title(F.coalesce("title", F.lit(""))).alias("title_key"), "year", names.alias("authors"), "position")


def latest(records: DataFrame, doi: str = "doi", position: str = "position") -> DataFrame:
    """One record for each DOI, case aside: the last; records without a DOI stay."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(F.lower(doi)).orderBy(F.desc(position))
    keyed = records.where(F.col(doi).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return keyed.unionByName(records.where(F.col(doi).isNull()))


def labels_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of labels whose leading lines that begin with # are a banner; later such lines are rows."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\A﻿?(?:#[^\n]*\n)+", "").alias("v"))
    body = lines.select(F.explode(F.split("v", "\r?\n")).alias("value")).where("value <> ''")
    head = body.first()
    if head is None:
        return spark.createDataFrame([], "value string")
    names = [c.strip() for c in head["value"].split(",")]
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = body.where(F.col("value") != head["value"]).select(F.from_csv("value", schema).alias("r"))
    return parsed.select("r.*")


def months(first: str, last: str, spark: SparkSession) -> DataFrame:
    """start and stop (exclusive) of each month from one date to another."""
    m = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("interval 1 month"))).alias("d"))
    start = F.trunc("d", "month")
    return m.select(start.alias("start"), F.add_months(start, 1).alias("stop")).distinct()


def not_yet(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """rows whose key is not among the finished ones: what a resumed harvest still has to do."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def collected_abstracts(rows: DataFrame, categories: list[str], usable: Column, key: str = "id") -> DataFrame:
    """rows with verdict (field, length or language, copy, used): copies after the first of an abstract, white space aside, in the order of key."""
    text = squeeze(F.coalesce("abstract", F.lit("")))
    r = rows.withColumn("verdict", F.when(~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "field").when(~usable, "length or language"))
    r = r.withColumn("_d", F.sha2(F.regexp_replace(text, " ", ""), 256))
    first = r.where("verdict is null").groupBy("_d").agg(F.min(key).alias("_first"))
    r = r.join(first, "_d", "left")
    return r.withColumn("verdict", F.coalesce("verdict", F.when(F.col(key) == F.col("_first"), "used").otherwise("copy"))).drop("_d", "_first")
