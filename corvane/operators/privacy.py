"""Personal data over tables: sensitive documents, promotion to long-term memory, checks of resident numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import privacy as P
from ..storage import written
from .curation import is_sensitive

RRN = r"(\d{6})\s*[-–]\s*([1-4]\d{6})"


def flag_documents(rows: DataFrame, document: str, text: str = "text") -> DataFrame:
    """document, n (rows), flagged (sensitive rows), sensitive: whether any row is."""
    s = is_sensitive(F.coalesce(text, F.lit("")))
    return rows.select(document, s.alias("s")).groupBy(document).agg(F.count("*").alias("n"), F.count_if("s").alias("flagged"), F.bool_or("s").alias("sensitive"))


def without_sensitive_documents(rows: DataFrame, document: str, text: str = "text") -> DataFrame:
    """rows of documents without any sensitive row; rows without a document stay if they are not sensitive themselves."""
    s = is_sensitive(F.coalesce(text, F.lit("")))
    bad = rows.where(s).select(document).distinct()
    return rows.join(bad, document, "left_anti").where(F.col(document).isNotNull() | ~s)


def sensitive_share(rows: DataFrame, document: str, text: str = "text") -> DataFrame:
    """One row: documents, flagged documents, their share."""
    return flag_documents(rows, document, text).agg(F.count("*").alias("documents"), F.count_if("sensitive").alias("flagged"), F.avg(F.col("sensitive").cast("double")).alias("share"))


def promotions(records: DataFrame, salt: str, fields: tuple[str, ...] = ("key", "value", "reason")) -> DataFrame:
    """records with their fields de-identified, put (pseudonyms) and verdict: sensitive, residual or promoted.

    Rejected rows keep no text: their fields are null, so that nothing of them is echoed.
    """
    bad = F.lit(False)
    for f in fields:
        bad = bad | is_sensitive(F.coalesce(f, F.lit("")))
    d = records.withColumn("_bad", bad)
    d = d.withColumns({f"_{f}": P.deidentification(F.when(~F.col("_bad"), F.coalesce(f, F.lit(""))), salt) for f in fields})  # a rejected row's text is not needed
    left = sum((F.col(f"_{f}.left") for f in fields), F.lit(0))
    d = d.withColumn("verdict", F.when(F.col("_bad"), "sensitive").when(left > 0, "residual").otherwise("promoted"))
    fine = F.col("verdict") == "promoted"
    put = F.when(fine, sum((F.col(f"_{f}.put") for f in fields), F.lit(0)))
    return d.withColumns({f: F.when(fine, F.col(f"_{f}.text")) for f in fields} | {"put": put}).drop("_bad", *[f"_{f}" for f in fields])


def promote(records: DataFrame, path: str, salt: str) -> DataFrame:
    """Append the promoted records to the memory at path as JSON lines; the verdicts of all, written once."""
    judged = written(promotions(records, salt), "promotions")
    judged.where("verdict = 'promoted'").drop("verdict").write.mode("append").json(path)
    return judged


def recall(memory: DataFrame, words: list[str], order: str, limit: int = 5, fields: tuple[str, ...] = ("key", "value", "reason")) -> DataFrame:
    """The records that hold most of the words as parts of their fields, then the latest by order; a top-n in each task."""
    hay = F.lower(F.concat_ws(" ", *fields))
    hits = sum((hay.contains(w.lower()).cast("int") for w in words), F.lit(0))
    return memory.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), F.desc(order)).limit(limit)


def rrn_rates(rows: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, found, checksum, date, both: numbers of the form of resident numbers, and how many hold up."""
    t = F.coalesce(text, F.lit(""))
    digits = F.zip_with(F.regexp_extract_all(t, F.lit(RRN), F.lit(1)), F.regexp_extract_all(t, F.lit(RRN), F.lit(2)), lambda a, b: F.concat(a, b))
    d = rows.select(by, F.explode(digits).alias("d")).select(by, checksum(F.col("d")).alias("c"), birthdate(F.col("d")).alias("b"))
    return d.groupBy(by).agg(F.count("*").alias("found"), F.count_if("c").alias("checksum"), F.count_if("b").alias("date"), F.count_if(F.col("c") & F.col("b")).alias("both"))


def checksum(digits: Column) -> Column:
    weights = F.array(*[F.lit(w) for w in (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)])
    ds = F.transform(F.split(digits, ""), lambda c: c.cast("int"))
    total = F.aggregate(F.zip_with(F.slice(ds, 1, 12), weights, lambda d, w: d * w), F.lit(0), lambda a, x: a + x)
    return F.pmod(11 - total % 11, F.lit(10)) == F.element_at(ds, 13)


def birthdate(digits: Column) -> Column:
    return F.substring(digits, 3, 2).cast("int").between(1, 12) & F.substring(digits, 5, 2).cast("int").between(1, 31)
