"""Nearest neighbours by inner product over shifted space-filling curves.

Vectors are projected onto a few random directions, once for each of several
curves, shifted by another offset each time, and sorted along a Hilbert curve:
Spark range-partitions by (curve, key), so that rows near each other on a curve
lie in one block of at most ``BLOCK`` rows or in one nearby. A query meets the
rows within ``reach`` places of its own on every curve; the merged candidates
are ranked by the exact inner product.

How many curves and which reach are fitted: PROBES queries, those of the
smallest hashes, are compared with all rows, and the places of their true
neighbours on every curve say for each number of curves which reach finds AIM
of them. The pair that visits the fewest rows is taken, measured recall and
share are printed to the log. Where no pair visits fewer rows than there are,
as with vectors spread evenly in many dimensions, one curve with a reach of the
whole table is the cheapest: a stated query set against all rows, in blocks.
``exact=True`` asks for that.

Copies are settled before: of equal vectors the k + 1 smallest ids are indexed,
as no other can be among k nearest, and equal queries are answered once. Rows
of a curve go in spans of bounded size, so no list grows with the table.
Nothing is broadcast but the probes and a row for each partition.

Vectors that are null, zero, without a finite number in every place, of another
length than most, or without an id take no part. Ties go to the smaller id. If
rows share an id, a pair of ids has the largest of their scores. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship, written

CURVES, DIMS, CELL_BITS, BLOCK, K, SEED = 6, 6, 8, 1024, 20, 5
#: Queries that fit the windows, and the share of their neighbours that windows must find (0.9 is asked of all).
PROBES, AIM = 128, 0.95
#: Blocks in the widest span of rows that one task scans at once, source spans that meet it together, and scores made at a time.
SPAN_BLOCKS, SOURCES, SCORES = 32, 8, 1 << 22

log = logging.getLogger(__name__)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve of rows of unsigned cell numbers (Skilling's transposition, all rows at once)."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > one:
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            flip = np.where(high, p, np.uint64(0))
            swap = np.where(high, np.uint64(0), t)
            x[0] ^= flip ^ swap
            if i:
                x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def directions(dim: int, curve: int, dims: int = DIMS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal columns and offsets of a curve."""
    r = np.random.default_rng((seed, curve))
    q, _ = np.linalg.qr(r.standard_normal((dim, min(dims, dim))))
    return q, r.random(q.shape[1])


def usable(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    v = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    good &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good &= F.exists(v, lambda x: x != 0)
    some = rows.where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    most = some.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if most is None:
        return some, 0
    return some.where(F.size("v") == most["d"]), most["d"]


def distinct(some: DataFrame, every: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Index rows (vec_id, v, asked: answered for all queries of its vector) and queries (query_id, rep: the row asked for it)."""
    d = [F.xxhash64("v"), F.xxhash64(F.lit(1), F.reverse("v"))]
    some = written(some.select("vec_id", "v", d[0].alias("d1"), d[1].alias("d2")).dropDuplicates(["vec_id", "d1", "d2"]), "vectors")
    narrow = some.select("vec_id", "d1", "d2")
    asks = F.col("vec_id") % every == 0
    groups = narrow.groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.max(asks.cast("int")).alias("asks"))
    w = Window.partitionBy("d1", "d2").orderBy("vec_id")
    ranked = some.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1)  # cut before the shuffle too
    rows = ranked.join(groups, ["d1", "d2"]).select("vec_id", "v", ((F.col("_n") == 1) & (F.col("asks") == 1)).alias("asked"))
    queries = narrow.where(asks).join(groups, ["d1", "d2"]).select(F.col("vec_id").alias("query_id"), "rep")
    return written(rows, "hilbert-rows"), queries


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Grid:
    """The curves' keys of vectors, within the bounds of all projections."""

    def __init__(self, dim: int, curves: int, low: np.ndarray, high: np.ndarray):
        self.axes = [directions(dim, c) for c in range(curves)]
        self.low, self.width, self.d = low, np.maximum(high - low, 1e-300), min(DIMS, dim)

    def keys(self, v: np.ndarray, curve: int) -> np.ndarray:
        q, shift = self.axes[curve]
        at = slice(curve * self.d, (curve + 1) * self.d)
        # half of the grid holds the range, the shift moves it within the other half
        cell = ((v @ q - self.low[at]) / self.width[at] + shift) / 2 * (1 << CELL_BITS)
        return hilbert_keys(np.clip(cell, 0, (1 << CELL_BITS) - 1).astype(np.int64), CELL_BITS)


def grid_of(rows: DataFrame, dim: int, curves: int) -> Grid:
    n = curves * min(DIMS, dim)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        q = np.hstack([directions(dim, c)[0] for c in range(curves)])
        for b in batches:
            if b.num_rows:
                p = _vectors(b.column(1), dim) @ q
                low, high = np.minimum(low, p.min(0)), np.maximum(high, p.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(low), pa.array(high)], names=["k", "low", "high"])

    got = rows.select("vec_id", "v").mapInArrow(bounds, "k long, low double, high double").groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    low, high = np.zeros(n), np.ones(n)
    for r in got.collect():  # curves * dims numbers
        low[r["k"]], high[r["k"]] = r["low"], r["high"]
    return Grid(dim, curves, low, high)


def fitted(rows: DataFrame, grid: Grid, dim: int, curves: int, k: int, block: int, probes: int, aim: float) -> tuple[int, int]:
    """(curves, reach) whose windows find aim of the probes' true neighbours with the fewest rows visited."""
    n = rows.count()
    chosen = rows.where("asked").orderBy(F.xxhash64("vec_id"), "vec_id").limit(probes).select("vec_id", "v").collect()  # probes rows
    if n <= 4 * block or not chosen:
        return 1, n
    pids, pv = np.array([r["vec_id"] for r in chosen]), np.array([r["v"] for r in chosen])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, score = np.empty((len(pids), 0), np.int64), np.empty((len(pids), 0))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                if not part.num_rows:
                    continue
                x = part.column(0).to_numpy()
                s = pv @ _vectors(part.column(1), dim).T
                s[pids[:, None] == x[None, :]] = -np.inf
                ids = np.hstack([ids, np.broadcast_to(x, s.shape)])
                score = np.hstack([score, s])
                o = np.argsort(-score, axis=1, kind="stable")[:, :k]
                ids, score = np.take_along_axis(ids, o, 1), np.take_along_axis(score, o, 1)
        p = np.repeat(np.arange(len(pids)), ids.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(ids.ravel()), pa.array(score.ravel())], names=["p", "vec_id", "score"])

    w = Window.partitionBy("p").orderBy(F.desc("score"), "vec_id")
    true = rows.select("vec_id", "v").mapInArrow(nearest, "p long, vec_id long, score double").where("score > double('-Infinity')")
    true = true.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select("p", "vec_id").collect()  # probes * k rows
    wanted = sorted({r["vec_id"] for r in true})
    at = {r["vec_id"]: r["v"] for r in rows.where(F.col("vec_id").isin(wanted)).groupBy("vec_id").agg(F.first("v").alias("v")).collect()}
    places = {i: j for j, i in enumerate(wanted)}
    v = np.vstack([np.array([at[i] for i in wanted]).reshape(-1, dim), pv])
    keys = [np.unique(grid.keys(v, c)) for c in range(curves)]

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(x) + 1, np.int64) for x in keys]
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column(1), dim)
                for c, t in enumerate(keys):
                    counts[c] += np.bincount(np.searchsorted(t, grid.keys(x, c), side="right"), minlength=len(t) + 1)
        c = np.repeat(np.arange(curves), [len(x) for x in counts])
        i = np.concatenate([np.arange(len(x)) for x in counts])
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(i), pa.array(np.concatenate(counts))], names=["c", "i", "n"])

    ranks = [np.zeros(len(x) + 1, np.int64) for x in keys]
    for r in rows.select("vec_id", "v").mapInArrow(below, "c long, i long, n long").groupBy("c", "i").agg(F.sum("n").alias("n")).collect():
        ranks[r["c"]][r["i"]] = r["n"]  # a number for each probe and neighbour, and curve
    pairs = np.array([(places[r["vec_id"]], len(wanted) + r["p"]) for r in true]).reshape(-1, 2)
    far = []
    for c in range(curves):
        place = np.cumsum(ranks[c])[np.searchsorted(keys[c], grid.keys(v, c))]
        far.append(np.abs(place[pairs[:, 0]] - place[pairs[:, 1]]))
    best = (n, 1, n)
    for c in range(1, curves + 1):
        d = np.sort(np.min(far[:c], axis=0))
        reach = int(d[min(len(d) - 1, int(np.ceil(aim * len(d))) - 1)]) if len(d) else n
        reach = (reach // block + 1) * block
        best = min(best, (c * (2 * reach + block), c, reach))
    log.warning("%d curves, reach %d of %d rows: %.2f of the rows visited, %.3f of %d probes' neighbours in reach", best[1], best[2], n, min(1, best[0] / n), float((np.min(far[: best[1]], axis=0) <= best[2]).mean()) if len(pairs) else 1.0, len(pids))
    return best[1], best[2]


def blocks_of(rows: DataFrame, grid: Grid, dim: int, curves: int, block: int, single: bool) -> DataFrame:
    """curve, first (its place on the curve), ids, m, asked ids, their vectors: rows of each curve in its order, cut into blocks."""
    kind = np.dtype(np.float32 if single else np.float64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _vectors(b.column(1), dim)
            raw = pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())
            for c in range(curves):
                cols = [pa.array(np.full(len(v), c, dtype=np.int32)), pa.array(grid.keys(v, c)), b.column(0), raw, b.column(2)]
                yield pa.RecordBatch.from_arrays(cols, names=["curve", "key", "vec_id", "v", "asked"])

    keyed_rows = rows.mapInArrow(keyed, "curve int, key long, vec_id long, v binary, asked boolean")
    keyed_rows = keyed_rows.repartitionByRange("curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held, n, curve = TaskContext.get().partitionId(), 0, [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal at, n
            ids = np.concatenate([h[0] for h in held])
            m = [x for h in held for x in h[1]]
            q = np.flatnonzero(np.concatenate([h[2] for h in held]))
            row = [[curve], [part], [at], [n], [ids.tobytes()], [b"".join(m)], [ids[q].tobytes()], [b"".join(m[j] for j in q)]]
            at, n = at + n, 0
            held.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=["curve", "part", "at", "n", "ids", "m", "qids", "qm"])

        for b in batches:
            cs, ids, v, asked = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), b.column(3).to_numpy(zero_copy_only=False)
            i = 0
            while i < len(cs):
                if curve is not None and cs[i] != curve:
                    if n:
                        yield flush()
                    at = 0
                curve = int(cs[i])
                end = min(i + block - n, int(np.searchsorted(cs, curve, side="right")))
                held.append((ids[i:end], v.slice(i, end - i).to_pylist(), asked[i:end]))
                n, i = n + end - i, end
                if n >= block:
                    yield flush()
        if n:
            yield flush()

    schema = "curve int, part int, at long, n long, ids binary, m binary, qids binary, qm binary"
    made = written(keyed_rows.select("curve", "vec_id", "v", "asked").mapInArrow(cut, schema), "hilbert-blocks")
    parts = made.groupBy("curve", "part").agg(F.sum("n").alias("rows"))
    order = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("curve", "part", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("before"))  # a row for each partition and curve
    return made.join(F.broadcast(parts), ["curve", "part"]).withColumn("first", F.col("before") + F.col("at")).drop("part", "at", "before")


def _best(ids: np.ndarray, m: np.ndarray, q: np.ndarray, approx: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best rows for q."""
    if len(approx) > k:
        floor = np.partition(approx, len(approx) - k)[len(approx) - k]
        at = np.flatnonzero(approx >= floor - 1e-9 * (1 + abs(floor)))
    else:
        at = np.arange(len(approx))
    exact = (m[at] * q).sum(1)
    o = np.lexsort((ids[at], -exact))[:k]
    return ids[at][o], exact[o]


def scanner(dim: int, k: int, single: bool):
    """mapInArrow function over (blocks: list of (ids, m), packs: list of lists of (qids, qm))."""
    kind = np.dtype(np.float32 if single else np.float64)

    def matrix(parts: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(parts), dtype=kind).reshape(-1, dim).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                held, asked = b.column(0)[r].values, b.column(1)[r].values
                ids, m = np.frombuffer(b"".join(held.field("ids").to_pylist()), np.int64), matrix(held.field("m").to_pylist())
                for pack in asked:
                    qids, qs = np.frombuffer(b"".join(pack.values.field("qids").to_pylist()), np.int64), matrix(pack.values.field("qm").to_pylist())
                    step = max(1, SCORES // max(1, len(ids)))
                    for at in range(0, len(qids), step):
                        approx = qs[at : at + step] @ m.T
                        got = [_best(ids, m, qs[at + j], approx[j], k) for j in range(len(approx))]
                        cols = [np.repeat(qids[at : at + step], [len(i) for i, _ in got]), np.concatenate([i for i, _ in got]), np.concatenate([s for _, s in got])]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["rep", "vec_id", "score"])

    return run


def search(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = K,
    curves: int = CURVES, block: int = BLOCK, exact: bool = False, probes: int = PROBES, aim: float = AIM, windows: tuple[int, int] | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: for ids divisible by every. windows gives (curves, reach in rows) instead of fitting them."""
    spark = rows.sparkSession
    ship(spark)
    some, dim = usable(rows, key, vector)
    result = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], result)
    single = rows.schema[vector].dataType.elementType.typeName() == "float"  # such numbers are the same in 32 bits
    index, queries = distinct(some, every, k)
    grid = grid_of(index, dim, curves)
    if exact:
        curves, reach = 1, None
    else:
        curves, reach = windows or fitted(index, grid, dim, curves, k, block, probes, aim)
    blocks = blocks_of(index, grid, dim, curves, block, single)
    whole = blocks.agg(F.max(F.col("first") + F.col("n"))).first()[0] or 0
    reach = whole if reach is None else min(reach, whole)
    span = block * max(1, min(SPAN_BLOCKS, reach // (2 * block)))
    # spans of rows by the place of a block's first row; a block may reach into the next span
    here = F.floor(F.col("first") / span).cast("int")
    held = blocks.groupBy("curve", here.alias("span")).agg(F.collect_list(F.struct("ids", "m")).alias("blocks"))
    packs = blocks.where(F.length("qids") > 0).groupBy("curve", here.alias("source")).agg(F.collect_list(F.struct("qids", "qm")).alias("pack"))
    low = F.greatest(F.lit(0), F.floor((F.col("source") * span - reach - block) / span))
    high = F.least(F.lit(whole // span), F.floor(((F.col("source") + 1) * span + block + reach) / span))
    sent = packs.select("curve", "source", "pack", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("span"))
    sent = sent.groupBy("curve", "span", F.floor(F.col("source") / SOURCES)).agg(F.collect_list("pack").alias("packs"))
    found = held.join(sent, ["curve", "span"]).select("blocks", "packs").mapInArrow(scanner(dim, k + 1, single), "rep long, vec_id long, score double")
    best = _top(found, "rep", k + 1)
    got = queries.join(best.drop("rank"), "rep").where("query_id <> vec_id")
    return _top(got, "query_id", k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top(found: DataFrame, query: str, k: int) -> DataFrame:
    """The k best distinct candidates of each query, ranked."""
    best = found.groupBy(query, "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
