"""Toxicity by class-conditional Kneser-Ney models.

Expressions are words, each a string of characters between word marks, scored
by character 5-grams. Two models see the same text:

* ordinary: discounted counts from rows labelled ordinary, backing off to
  continuation counts (in how many distinct surroundings an n-gram occurs),
  which are shared and come from all documents, labelled or not;
* toxic: discounted counts from rows labelled toxic, backing off to the
  ordinary model, so that a rare expression that toxic rows lack weighs nothing.

For a 5-gram that toxic rows lack, the ratio of the two is the toxic model's
back-off weight; so the model kept is one ratio for each 5-gram of the toxic
rows and one weight for each of their contexts.

A text is described by its log-likelihood ratio per character, by the largest
ratio of a word per square root of its length, and by the mean of the three
largest. Logistic regression, fitted on labelled rows that gave no counts,
turns these into a score between 0 and 1.

Labels come from at most ``PER_CLASS`` rows of each class (those with the
smallest hashes of their ids) whose crc32(doc_id as text) mod 5 is not 0; of
these, remainder 4 fits the regression and the others give the class counts.
The continuation counts cover all documents. What reaches the driver is bounded
by that sample. lang, source and doc_id are never inputs of a score.

Defined results: a null or empty text has no words and gets the score of a
ratio of zero; conflicting labels of an id count as toxic; without any toxic
or any ordinary label all scores are 0; repeated rows give their rows each; an
empty table gives no rows; other columns are ignored.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, release, texts, written

PER_CLASS = 4000
DISCOUNT = 0.75
ORDER = 5
WORD = re.compile(r"[^\W\d_]+")
#: Longest word that is scored whole; longer ones are scored in parts of this length.
LONGEST = 64
ALPHABET = 512
#: Words that a worker remembers, and 5-grams that it gathers before it hands them on.
KNOWN = 150_000
GATHERED = 500_000


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def word_grams(word: str) -> list[str]:
    s = "^^^^" + word + "$"
    return [s[k : k + ORDER] for k in range(len(s) - ORDER + 1)]


def words_of(text: str) -> list[str]:
    found = WORD.findall(text.lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[k : k + LONGEST] for w in found for k in range(0, len(w), LONGEST)]
    return found


def sample_labels(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, toxic of at most per_class rows of each class, none of them held out."""
    ids = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    ids = ids.where(remainder(F.col("doc_id")) != 0)
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    some = [ids.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    return some[0].unionByName(some[1])


def corpus_grams(rows: DataFrame, most_known: int = KNOWN, most_gathered: int = GATHERED) -> DataFrame:
    """Distinct 5-grams of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        grams: set[str] = set()
        for _, some in texts(batches):
            new: set[str] = set()
            for t in some:
                new.update(words_of(t))
            new -= known
            known |= new
            for w in new:
                grams.update(word_grams(w))
            if len(known) > most_known:
                known.clear()
            if len(grams) > most_gathered:
                yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string())], names=["g"])
                grams.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string())], names=["g"])
        del known, grams
        release()

    return rows.mapInArrow(run, "g string").distinct()


def class_grams(sample: DataFrame) -> DataFrame:
    """g, tox, ord: occurrences in the sample's texts of either class (columns doc_id, text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: tuple[Counter, Counter] = (Counter(), Counter())
            for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words[c].update(words_of(t))
            for c in (0, 1):
                n: Counter = Counter()
                for w, k in words[c].items():
                    for g in word_grams(w):
                        n[g] += k
                cols = [pa.array(list(n), pa.string()), pa.array([c] * len(n), pa.int32()), pa.array(list(n.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["g", "toxic", "n"])

    n = sample.mapInArrow(run, "g string, toxic int, n long").groupBy("g")
    is_toxic = F.col("toxic") == 1
    return n.agg(F.sum(F.when(is_toxic, F.col("n")).otherwise(0)).alias("tox"), F.sum(F.when(is_toxic, 0).otherwise(F.col("n"))).alias("ord"))


def smoothed(counts: DataFrame, gram: str, n: str, lower: Column | None, d: float = DISCOUNT) -> Column:
    """Interpolated Kneser-Ney; counts has columns n, sum_ and kinds of the context, and the lower order's value."""
    mass = F.greatest(F.col(n) - d, F.lit(0.0))
    rest = F.lit(1.0 / ALPHABET) if lower is None else lower
    return (mass + d * F.col(f"{n}_kinds") * rest) / F.col(f"{n}_sum")


def shared_model(grams: DataFrame) -> DataFrame:
    """g4, p: probability of a 4-gram's last character after its others, from continuation counts of all 5-grams."""
    levels, rows = {}, grams.select(F.col("g").alias("g"))
    for k in (4, 3, 2):
        rows = rows.groupBy(F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("n"))
        levels[k] = rows
        rows = rows.select("g")
    out = None
    for k in (2, 3, 4):
        t = levels[k].withColumn("ctx", F.substring("g", 1, k - 1))
        sums = t.groupBy("ctx").agg(F.sum("n").alias("n_sum"), F.count("*").alias("n_kinds"))
        t = t.join(sums, "ctx")
        if out is None:
            t = t.withColumn("p", smoothed(t, "g", "n", None))
        else:
            low = out.select(F.col("g").alias("suffix"), F.col("p").alias("low"))
            t = t.withColumn("suffix", F.substring("g", 2, k - 1)).join(low, "suffix", "left")
            t = t.withColumn("p", smoothed(t, "g", "n", F.coalesce("low", F.lit(1.0 / ALPHABET))))
        out = t.select("g", "p")
    return out.select(F.col("g").alias("g4"), "p")


def ratios(classes: DataFrame, shared: DataFrame, d: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """(g, llr) for each 5-gram of the toxic rows, (ctx, llr) for each of its contexts."""
    c = classes.withColumn("ctx", F.substring("g", 1, ORDER - 1))
    sums = c.groupBy("ctx").agg(
        F.sum("tox").alias("tox_sum"),
        F.sum("ord").alias("ord_sum"),
        F.sum((F.col("tox") > 0).cast("long")).alias("tox_kinds"),
        F.sum((F.col("ord") > 0).cast("long")).alias("ord_kinds"),
    )
    sums = sums.where("tox_sum > 0")
    t = c.where("tox > 0").join(sums, "ctx").withColumn("g4", F.substring("g", 2, ORDER - 1))
    t = t.join(shared, "g4", "left").withColumn("p", F.coalesce("p", F.lit(1.0 / ALPHABET)))
    ordinary = F.when(F.col("ord_sum") > 0, smoothed(t, "g", "ord", F.col("p"))).otherwise(F.col("p"))
    t = t.withColumn("p_ord", ordinary)
    toxic = smoothed(t, "g", "tox", F.col("p_ord"))
    return (
        t.select("g", F.ln(toxic / F.col("p_ord")).alias("llr")),
        sums.select("ctx", F.ln(d * F.col("tox_kinds") / F.col("tox_sum")).alias("llr")),
    )


def word_ratio(word: str, grams: dict[str, float], contexts: dict[str, float]) -> float:
    total = 0.0
    for g in word_grams(word):
        v = grams.get(g)
        total += contexts.get(g[:-1], 0.0) if v is None else v
    return total


class Scorer:
    """Descriptions of texts; words are scored once."""

    def __init__(self, grams: dict[str, float], contexts: dict[str, float]):
        self.grams, self.contexts = grams, contexts
        self.known: dict[str, float] = {}

    def describe(self, text: str) -> tuple[float, float, float]:
        found = words_of(text)
        if not found:
            return 0.0, 0.0, 0.0
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        for w in set(found).difference(known):
            known[w] = word_ratio(w, self.grams, self.contexts)
        r = np.fromiter(map(known.__getitem__, found), dtype=np.float64, count=len(found))
        n = np.fromiter(map(len, found), dtype=np.float64, count=len(found)) + 1
        each = r / np.sqrt(n)
        top = np.partition(each, len(each) - min(3, len(each)))[-3:]
        return float(r.sum() / n.sum()), float(each.max()), float(top.sum() / 3)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method on standardised columns, both classes of the same weight."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (y - p)) - ridge / 10 * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge / 10 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, spread


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[dict, dict, tuple] | None:
    """Ratios and the regression; None without labels of both classes."""
    rows = keyed_texts(docs)
    ids = written(sample_labels(labels, per_class), "toxicity-labels")  # at most 2 * per_class rows
    sample = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic")
    sample = written(sample, "toxicity-sample")
    fits = remainder(F.col("doc_id")) == 4
    grams = written(corpus_grams(rows), "toxicity-grams")  # several counts are made of it; the texts are read once
    per_gram = written(class_grams(sample.where(~fits)), "toxicity-class-grams")
    near = per_gram.where("tox > 0").select(F.substring("g", 2, ORDER - 1).alias("g4")).distinct()
    by_gram, by_context = ratios(per_gram, shared_model(grams).join(near, "g4", "left_semi"))
    g = {r["g"]: r["llr"] for r in by_gram.collect()}
    if not g or sample.where("toxic = 0").isEmpty():
        return None
    c = {r["ctx"]: r["llr"] for r in by_context.collect()}
    x, y = [], []
    seen = [(r[0], r[1]) for r in described(sample.where(fits), g, c, "toxic")]
    for toxic, d in seen:
        x.append(d)
        y.append(toxic)
    if len(set(y)) < 2:  # too few labels to fit on rows that gave no counts
        seen = described(sample, g, c, "toxic")
        x, y = [r[1] for r in seen], [r[0] for r in seen]
    return g, c, fit(np.array(x), np.array(y, dtype=float))


def described(sample: DataFrame, grams: dict, contexts: dict, column: str) -> list[tuple[int, list[float]]]:
    """column and description of each row of the bounded sample, in order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(grams, contexts)
        for b in batches:
            d = [list(s.describe(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(d, pa.list_(pa.float64()))], names=["doc_id", "y", "d"])

    rows = sample.select("doc_id", "text", F.col(column).alias("y")).mapInArrow(run, "doc_id long, y int, d array<double>")
    return [(r["y"], r["d"]) for r in rows.orderBy("doc_id", "d").collect()]


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, and the ratio per character, for each row of docs."""
    model = train(docs, labels, per_class)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by the sample's toxic rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        s = Scorer(m[0], m[1]) if m else None
        for keys, some in texts(batches):
            if s:
                w, mean, spread = m[2]
                x = np.array([s.describe(t) for t in some])
                v = 1 / (1 + np.exp(-np.clip((x - mean) / spread @ w[:-1] + w[-1], -700, 700)))
            else:
                x, v = np.zeros((len(some), 3)), np.zeros(len(some))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(v), pa.array((v >= 0.5).astype(np.int32)), pa.array(x[:, 0].copy())],
                names=["doc_id", "score", "predicted", "llr_per_char"],
            )

    got = keyed_texts(docs).mapInArrow(run, "doc_id long, score double, predicted int, llr_per_char double")
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", "predicted", "llr_per_char")


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """docs without the rows that are predicted toxic. The rows are scored where they are read; nothing is joined."""
    model = train(docs, labels, per_class)
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def clean(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        w, mean, spread = m[2]
        scorer = Scorer(m[0], m[1])
        for s in columns:
            x = np.array([scorer.describe(t or "") for t in s]).reshape(-1, 3)
            yield pd.Series((x - mean) / spread @ w[:-1] + w[-1] < 0)
            del s
            release()

    clean = F.pandas_udf(clean, "boolean")

    return docs.where(clean("text"))
