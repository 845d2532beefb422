"""Readers and writers; what is read is cast and cleaned by the optimiser's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze, unescape

CSV_COLUMNS = "id string, NoteId string, fileName string, page string, text string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pages_csv(spark: SparkSession, path: str, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Scanned pages: id, note_id, file_name, page (0 if no number), text with its escapes undone; after skip rows, at most limit."""
    rows = spark.read.schema(CSV_COLUMNS).csv(path, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1)
    rows = rows.offset(skip) if skip else rows
    rows = rows if limit is None else rows.limit(limit)
    return rows.select(
        F.trim("id").alias("id"), F.trim("NoteId").alias("note_id"), F.trim("fileName").alias("file_name"),
        F.coalesce(F.col("page").try_cast("int"), F.lit(0)).alias("page"), unescape(F.coalesce("text", F.lit(""))).alias("text"),
    )


def extension(file_name: Column) -> Column:
    e = F.lower(F.regexp_extract(file_name, r"(\.[^.]+)$", 1))
    return F.when(e == "", "(없음)").otherwise(e)


def notes(pages: DataFrame) -> DataFrame:
    """Pages of a note in order, joined by blank lines."""
    g = pages.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return g.select("note_id", F.size("p").alias("n_pages"), F.array_join(F.col("p.text"), "\n\n").alias("text"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{txt,md,hocr}") -> DataFrame:
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Extension, files, bytes and deepest level of a tree; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    levels = lambda c: F.size(F.split(F.regexp_replace(c, "^[A-Za-z0-9]+:/*", "/"), "/"))
    depth = levels(F.col("path")) - levels(F.lit(path.rstrip("/")))
    return files.groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max(depth).alias("depth"))


def bounded_text(text: Column, most: int = 200_000) -> Column:
    return F.substring(text, 1, most)


def field_names(rows: DataFrame, json: str, most: int = 50) -> DataFrame:
    """name: the keys of JSON objects in a column, at most so many, without their values."""
    return rows.select(F.explode(F.json_object_keys(json)).alias("name")).distinct().orderBy("name").limit(most)


def confined(path: str, root: str) -> str:
    """path, if it lies in root; else an error, so that nothing is written elsewhere."""
    import posixpath

    whole, base = posixpath.normpath(path), posixpath.normpath(root)
    if whole != base and not whole.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"{path} is not in {root}")
    return path


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def html_records(pages: DataFrame) -> DataFrame:
    """page_id, title, links, n_links, text of raw pages."""
    links = F.regexp_extract_all("html", F.lit(r'(?i)href="([^"]*)"'), 1)
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select("page_id", squeeze(title).alias("title"), links.alias("links"), F.size(links).cast("bigint").alias("n_links"))


def inverted_index_text(index: Column) -> Column:
    """A text from a map of words to their places."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")
