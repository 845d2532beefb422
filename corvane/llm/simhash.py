"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has 64 bits; bit b is 1 if more than half of its shingles'
hashes have it. Fingerprints within ``radius`` bits are linked, and a document's
component is the smallest id reachable through links.

Finding the links, over distinct fingerprints:

* Correlated bits are put into the same one of m parts (greedily, by the bits'
  correlations over all fingerprints), so that the parts are as independent as
  they can be.
* A fingerprint may give its parts unequal thresholds t_1..t_m, -1 (skip) at
  least, with a sum of radius - m + 1: whatever lies within the radius is then
  within t_i bits in some part i. Dynamic programming picks the thresholds with
  the least estimated number of candidates, from the counts of all part values.
* It probes the index of part values within its thresholds; the join verifies
  the whole distance, so that only links leave it.
* Exact way for crowded part values: a fingerprint with a value that more than
  ``crowd`` others share stays out of the index, so that no probe meets more
  than ``crowd`` entries. It still probes as above, which finds its links to
  indexed ones. Two such fingerprints within two bits have a common neighbour
  at distance one or less; grouped by those 65 neighbours, each group has at
  most 65 members and all of them are linked.

Components: large-star and small-star rounds over the links, each written to
the shared folder. Copies share a fingerprint and so never make a pair. No
links, components or fingerprints reach the driver.

Defined results: a null or blank text has fingerprint zero and is linked like
any other; repeated rows are rows of one component; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, ship, texts, written

WIDTH = 3
SEED = 42
RADIUS = 2
#: Distinct fingerprints that a part value may have in the index.
CROWD = 1000
#: Part values with fewer fingerprints than this count as one each in the estimate.
FEW = 4


def fingerprint(text: str, width: int = WIDTH, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space alone
    n = len(words)
    if n <= width:
        if not n:
            return 0
        return xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    total = np.zeros(64, dtype=np.int64)
    m = n - width + 1
    for at in range(0, m, 65_536):
        hs = [
            xxh64_intdigest(line[a : b - 1], seed)
            for a, b in zip(starts[at : min(at + 65_536, m)], ends[at + width - 1 :])
        ]
        bits = np.unpackbits(np.array(hs, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > m).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, some in texts(batches):
            fps = np.array([fingerprint(t) for t in some], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

    return keyed_texts(docs, key, text).mapInArrow(run, "doc_id long, fp long")


def correlations(unique: DataFrame) -> np.ndarray:
    """Correlation of each two bits over all fingerprints: 65 x 64 sums, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 64))
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(fps.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total[:64] += bits.T @ bits
            total[64, 0] += len(fps)
        flat = total.ravel().astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "v"])

    rows = unique.select("fp").mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros(65 * 64)
    for r in rows:
        sums[r["k"]] = r["v"]
    sums = sums.reshape(65, 64)
    n = max(sums[64, 0], 1)
    both, p = sums[:64] / n, np.diag(sums[:64]) / n
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    return np.where(spread > 0, (both - np.outer(p, p)) / np.maximum(spread, 1e-12), 0)


def partition_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Bits (0: the highest) in parts of near-equal size; each takes the bit most correlated with those it has."""
    left, out = set(range(64)), []
    strong = np.abs(corr) - np.eye(64)
    for k in range(parts):
        room = len(left) // (parts - k)
        first = max(sorted(left), key=lambda b: max((strong[b, c] for c in left if c != b), default=0))
        part = [first]
        left.remove(first)
        while len(part) < room:
            nxt = max(sorted(left), key=lambda b: strong[b, part].sum())
            part.append(nxt)
            left.remove(nxt)
        out.append(sorted(part))
    return out


def part_value(fp: Column, bits: list[int]) -> Column:
    """The part's bits as an unsigned number below 2 ** len(bits)."""
    out = None
    for j, b in enumerate(bits):
        one = F.shiftleft(F.shiftrightunsigned(fp, 63 - b).bitwiseAND(F.lit(1).cast("long")), len(bits) - 1 - j)
        out = one if out is None else out.bitwiseOR(one)
    return out


def allocate(counts: np.ndarray, widths: list[int], n: int, radius: int = RADIUS) -> np.ndarray:
    """Thresholds for each row of counts (fingerprints with the row's value in each part), by dynamic programming.

    The estimate for threshold t adds, to the row's own value, the mean number
    of fingerprints at the other values within t bits, and one for each probe.
    """
    from math import comb

    m, want = len(widths), radius - len(widths) + 1
    low, high = -m, radius
    inf = np.full(len(counts), np.inf)
    best = {0: (np.zeros(len(counts)), np.zeros((len(counts), 0), dtype=np.int8))}
    for i, w in enumerate(widths):
        nxt: dict[int, tuple] = {}
        for t in range(-1, radius + 1):
            probes = sum(comb(w, e) for e in range(t + 1))
            cost = counts[:, i] * (t >= 0) + max(0, probes - 1) * n / 2.0**w + probes
            for s, (c, path) in best.items():
                if not low <= s + t <= high:
                    continue
                c2 = c + cost
                old = nxt.get(s + t, (inf, np.zeros((len(counts), i + 1), dtype=np.int8)))
                better = c2 < old[0]
                step = np.concatenate([path, np.full((len(counts), 1), t, dtype=np.int8)], axis=1)
                nxt[s + t] = (np.where(better, c2, old[0]), np.where(better[:, None], step, old[1]))
        best = nxt
    return best[want][1]


def links(unique: DataFrame, radius: int = RADIUS, crowd: int = CROWD, parts: int | None = None) -> DataFrame:
    """Distinct pairs (a < b) of representatives whose fingerprints are within radius; unique: fp, rep, written."""
    n = unique.count()
    m = parts or (3 if n <= 1 << 23 else 2)
    groups = partition_bits(correlations(unique), m)
    widths = [len(g) for g in groups]
    u = unique.select("fp", "rep", *[part_value(F.col("fp"), g).alias(f"v{i}") for i, g in enumerate(groups)])
    for i in range(m):
        many = u.groupBy(f"v{i}").agg(F.count("*").alias(f"c{i}")).where(F.col(f"c{i}") >= FEW)
        u = u.join(many, f"v{i}", "left").withColumn(f"c{i}", F.coalesce(f"c{i}", F.lit(1)))
    u = u.select("fp", "rep", *[f"v{i}" for i in range(m)], *[f"c{i}" for i in range(m)])
    flips = [[[sum(1 << b for b in c) for c in itertools.combinations(range(w), e)] for e in range(radius + 1)] for w in widths]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            col = [b.column(k).to_numpy(zero_copy_only=False) for k in range(2 + 2 * m)]
            counts = np.stack(col[2 + m :], axis=1).astype(float)
            t = allocate(counts, widths, n, radius)
            open_ = (counts <= crowd).all(axis=1)
            part, value, who, kind = [], [], [], []

            def put(i: int, values: np.ndarray, rows: np.ndarray, probe: bool) -> None:
                part.append(np.full(len(rows), i, dtype=np.int32))
                value.append(values)
                who.append(rows)
                kind.append(np.full(len(rows), probe))

            for i in range(m):
                at = np.flatnonzero(open_)
                put(i, col[2 + i][at], at, False)
                for e in range(radius + 1):
                    at = np.flatnonzero(t[:, i] >= e)
                    if len(at):
                        f = np.array(flips[i][e], dtype=np.int64)
                        put(i, (col[2 + i][at][:, None] ^ f[None, :]).ravel(), np.repeat(at, len(f)), True)
            rows = np.concatenate(who)
            out = [np.concatenate(part), np.concatenate(value), col[0][rows], col[1][rows], np.concatenate(kind)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["part", "value", "fp", "rep", "probe"])

    rows = u.mapInArrow(run, "part int, value long, fp long, rep long, probe boolean")
    rows = written(rows, "simhash-probes")
    index = rows.where(~F.col("probe")).select("part", "value", F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    found = rows.where("probe").select("part", "value", "fp", "rep").join(index, ["part", "value"])
    found = found.where((F.col("fp") != F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius))
    found = found.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))
    if radius:
        dense = u.where(F.greatest(*[F.col(f"c{i}") for i in range(m)]) > crowd)
        found = found.unionByName(ball_links(dense) if radius == 2 else ball_pairs(dense, radius))
    return found.distinct()


def ball_links(fps: DataFrame) -> DataFrame:
    """Links within two bits among fps (fp, rep): those that share a neighbour within one bit; 65 rows each."""
    masks = F.array(*[F.lit(v).cast("long") for v in [0, *(1 << k for k in range(63)), -(1 << 63)]])
    near = fps.select("rep", F.explode(F.transform(masks, lambda x: x.bitwiseXOR(F.col("fp")))).alias("at"))
    sets = near.groupBy("at").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    sets = sets.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b"))
    return sets.where("a < b")


def ball(fps: DataFrame, radius: int) -> DataFrame:
    """fp, rep, at: each fingerprint with all values within radius."""
    masks = F.array(*[F.lit(v).cast("long") for v in [0, *(1 << k for k in range(63)), -(1 << 63)]])
    out = fps.select("fp", "rep", F.col("fp").alias("at"))
    for k in range(radius):
        out = out.select("fp", "rep", F.explode(F.transform(masks, lambda x: x.bitwiseXOR(F.col("at")))).alias("at"))
        out = out.distinct() if k else out
    return out


def ball_pairs(fps: DataFrame, radius: int) -> DataFrame:
    """All pairs within radius among fps (distinct fp, rep): the balls of half the radius, rounded up and down, of such a pair meet.

    A value has a bounded number of neighbours, whatever the crowd, but a ball
    has 65 rows for a radius of up to 2, 2,081 up to 4 and 43,745 up to 6.
    """
    a = ball(fps, radius - radius // 2)
    b = ball(fps, radius // 2).select(F.col("fp").alias("fp2"), F.col("rep").alias("rep2"), "at")
    near = a.join(b, "at").where((F.col("fp") != F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius))
    return near.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b): root is the smallest node that links reach.

    Large-star and small-star in turn until nothing changes; minima are
    partial aggregates, so that a node with many links is no hot task.
    """
    e = written(edges.where("a <> b").select("a", "b"), "links")
    seen = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        # every edge now points from the larger node a to the smaller b
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("s"))
        small = small.select(F.col("s.b").alias("a"), F.col("s.m").alias("b")).where("a <> b").distinct()
        e = written(small, "small-star")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def keep_one(docs: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id. Rows without an id stay."""
    marked = written(near_duplicates(docs, radius=radius, crowd=crowd), "near-duplicates")
    keep = marked.where("doc_id = component_id").select("doc_id").distinct()
    # a row travels whole in one column, so that none of its names meets one of these
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    some = rows.where("doc_id is not null").join(keep, "doc_id", "left_semi")
    again = marked.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():  # rows that share an id
        some = some.dropDuplicates(["doc_id"])
    return some.unionByName(rows.where("doc_id is null")).select("row.*")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp and component_id for each row of docs."""
    marked = written(fingerprints(docs, key, text), "fingerprints")
    unique = written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-unique")
    roots = components(links(unique.where("rep is not null"), radius, crowd))
    classes = unique.join(roots, unique["rep"] == roots["node"], "left")
    classes = classes.select(F.col("fp").alias("_fp"), F.coalesce("root", "rep").alias("component_id"))
    got = marked.join(classes, marked["fp"] == classes["_fp"])
    return got.select("doc_id", "fp", "component_id")
