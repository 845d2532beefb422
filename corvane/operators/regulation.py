"""A table of clauses against documents: which checks apply, what they find, how much of the regulations they cover.

Clauses: id, reg, kind (record, system, org), obj, alcoa (array), summary, checks (array), platform, applies (array of document types).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.documents import TEXT_CHECKS

ALCOA = ("Attributable", "Legible", "Contemporaneous", "Original", "Accurate", "Complete", "Consistent", "Enduring", "Available")
CLAUSE = "id string, reg string, kind string, obj string, alcoa array<string>, summary string, checks array<string>, platform boolean, applies array<string>"


def checks_of(clauses: DataFrame) -> DataFrame:
    """doc_type, keys: the text checks that some clause asks of documents of a type, in order."""
    c = clauses.select(F.explode("applies").alias("doc_type"), "checks").select("doc_type", F.explode("checks").alias("k")).where(F.col("k").isin(*TEXT_CHECKS))
    return c.groupBy("doc_type").agg(F.array_sort(F.collect_set("k")).alias("keys"))


def check_documents(docs: DataFrame, clauses: DataFrame, text: str = "text", doc_type: str = "doc_type", skip: tuple[str, ...] = ()) -> DataFrame:
    """docs with findings: those of all checks that their type calls for, in the order of the checks, each said once."""
    keys = checks_of(clauses).withColumnRenamed("doc_type", "_type")  # a row for each document type
    d = docs.join(F.broadcast(keys), docs[doc_type] == F.col("_type"), "left")
    empty = F.array().cast("array<string>")
    found = [F.when(F.array_contains("keys", k), f(F.col(text))).otherwise(empty) for k, f in sorted(TEXT_CHECKS.items()) if k not in skip]
    return d.withColumn("findings", F.array_distinct(F.concat(*[F.coalesce(x, empty) for x in found]))).drop("_type", "keys")


def constraints(clauses: DataFrame) -> DataFrame:
    """doc_type, text: a line for each clause that applies, in the order of their ids; for a prompt."""
    c = clauses.select(F.explode("applies").alias("doc_type"), "id", F.concat(F.lit("- ["), "id", F.lit("] "), "summary").alias("line"))
    return c.groupBy("doc_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("text"))


def coverage(clauses: DataFrame) -> DataFrame:
    """By regulation and in all (reg null): clauses, modeled, automatable, automated, with_platform, uncovered (number)."""
    auto = F.col("kind").isin("record", "system")
    checked = F.size(F.coalesce("checks", F.array().cast("array<string>"))) > 0
    either = checked | F.col("platform")
    share = lambda n, d: n / F.greatest(F.lit(1), d)
    g = clauses.withColumns({"_auto": auto, "_checked": checked, "_either": either}).rollup("reg").agg(
        F.count("*").alias("clauses"), (F.count_if(F.coalesce(F.col("obj"), F.lit("")) != "") / F.count("*")).alias("modeled"), F.count_if("_auto").alias("automatable"),
        share(F.count_if(F.col("_auto") & F.col("_checked")), F.count_if("_auto")).alias("automated"), share(F.count_if(F.col("_auto") & F.col("_either")), F.count_if("_auto")).alias("with_platform"),
        F.count_if(F.col("_auto") & ~F.col("_either")).alias("uncovered"),
    )
    return g


def alcoa_coverage(clauses: DataFrame) -> DataFrame:
    """attribute, covered (clauses with a check), total."""
    checked = F.size(F.coalesce("checks", F.array().cast("array<string>"))) > 0
    return clauses.select(F.explode("alcoa").alias("attribute"), checked.alias("c")).groupBy("attribute").agg(F.count_if("c").alias("covered"), F.count("*").alias("total"))


def _iri(c: Column) -> Column:
    return F.concat(F.lit("go:"), F.regexp_replace(c, "[^0-9A-Za-z가-힣_]", "_"))


def _literal(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def turtle(clauses: DataFrame) -> DataFrame:
    """One line of text per attribute, regulation, check and clause, in RDF's Turtle form without its prefixes; write with .write.text."""
    spark = clauses.sparkSession
    attributes = spark.createDataFrame([(a,) for a in ALCOA], "a string").select(F.concat(_iri(F.col("a")), F.lit(" a go:AlcoaAttribute .")).alias("value"))
    regs = clauses.select("reg").distinct().select(F.concat(_iri(F.col("reg")), F.lit(" a go:Regulation ; rdfs:label "), _literal(F.col("reg")), F.lit(" .")).alias("value"))
    checks = clauses.select(F.explode("checks").alias("k")).distinct()
    checks = checks.select(F.concat(_iri(F.concat(F.lit("check_"), "k")), F.lit(" a go:Check ; rdfs:label "), _literal(F.col("k")), F.lit(" .")).alias("value"))
    each = lambda name, arr, iri: F.transform(F.coalesce(arr, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"go:{name} "), iri(x)))
    props = F.concat(
        F.array(
            F.lit("a go:Clause"), F.concat(F.lit("rdfs:label "), _literal(F.concat("id", F.lit(" "), "summary"))), F.concat(F.lit("go:partOf "), _iri(F.col("reg"))),
            F.concat(F.lit("go:kind "), _literal(F.col("kind"))), F.concat(F.lit("go:object "), _literal(F.col("obj"))),
        ),
        each("requires", F.col("alcoa"), _iri), each("checkedBy", F.col("checks"), lambda k: _iri(F.concat(F.lit("check_"), k))),
        F.when(F.col("platform"), F.array(F.lit("go:providedByPlatform true"))).otherwise(F.array().cast("array<string>")),
    )
    rows = clauses.select(F.concat(_iri(F.concat("reg", F.lit("_"), "id")), F.lit(" "), F.array_join(props, " ; "), F.lit(" .")).alias("value"))
    return attributes.unionByName(regs).unionByName(checks).unionByName(rows)


def first_checks(clauses: DataFrame) -> DataFrame:
    """reg, kind, id of the first clause of each kind of a regulation, for a report."""
    w = Window.partitionBy("reg", "kind").orderBy("id")
    return clauses.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("reg", "kind", "id")
