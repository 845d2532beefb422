"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

Documents arrive in groups of bounded size. A document is cut into pieces of
at most ``piece`` tokens: whole windows first, then near-equal parts of the
rest, so that no sliver is left over. The largest-differencing method then
spreads the group's pieces over k windows (where that leaves much padding, as
with many equal lengths, pieces are halved and packed again): each piece starts as a partial
partition (piece, 0, ..., 0); the two partitions with the widest spread are
merged, the largest subset of one with the smallest of the other, until one
partition is left. k starts at ceil(tokens / window) and rises by one whenever
the fullest window exceeds the capacity, so that no window overflows.

Groups are formed inside the tasks that read the documents: there is no
shuffle, no task holds more than a group, and a hot source or group of copies
is as well spread as any other rows. A task that is run again reads the same
rows in the same order and so makes the same windows.

Defined results: a null text is empty and gives its end id alone; repeated
rows are packed once each; an empty table gives no rows; a very long text is
cut into whole windows first; columns other than the two named are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import TABLE_BYTES, worker_bpe
from .common import keyed_texts, texts

WINDOW = 2048
#: Longest piece of what is left of a document after its whole windows.
PIECE = 768
#: Documents that are packed together.
GROUP = 256
#: Beyond this share of windows above the least possible, pieces are halved and packed again, down to MIN_PIECE.
SPARE = 0.02
MIN_PIECE = 48

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long"
)


def kk_partition(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in k subsets of near-equal sums, by the largest differencing method. Ties: the earlier item.

    A partial partition is held as its occupied subsets alone, fullest first: two of them overlap only where
    together they occupy more than k.
    """
    heap = [(-x, i, [(x, (i,))]) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = max(0, len(a) + len(b) - k)
        if len(b) == 1 and not over:
            insort(a, b[0], key=_emptier)
        else:
            both = [(x + y, (p, q)) for (x, p), (y, q) in zip(a[len(a) - over :], reversed(b[len(b) - over :]))]
            a = sorted(a[: len(a) - over] + b[: len(b) - over] + both, key=_emptier)
        heapq.heappush(heap, ((a[-1][0] if len(a) == k else 0) - a[0][0], serial, a))
        serial += 1
    out = []
    for _, tree in heap[0][2] if heap else ():
        found, stack = [], [tree]
        while stack:
            for x in stack.pop():
                found.append(x) if isinstance(x, int) else stack.append(x)
        out.append(sorted(found))
    return out + [[] for _ in range(k - len(out))]


def _emptier(subset: tuple) -> int:
    return -subset[0]


def pack_sizes(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """kk_partition with the least k, from ceil(total / capacity) on, whose fullest subset fits."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = kk_partition(sizes, k)
        if max(sum(sizes[i] for i in p) for p in parts) <= capacity:
            return [p for p in parts if p]
        k += 1


def cut(n: int, window: int = WINDOW, piece: int = PIECE) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, length) of a document's whole windows, and of the near-equal pieces of its rest."""
    whole = [(at, window) for at in range(0, n - n % window, window)]
    at, rest = n - n % window, n % window
    parts, m = [], -(-rest // piece)
    for j in range(m):
        end = n - n % window + rest * (j + 1) // m
        parts.append((at, end - at))
        at = end
    return whole, parts


def pack_group(
    lengths: list[int], window: int = WINDOW, piece: int = PIECE
) -> list[list[tuple[int, int, int]]]:
    """Windows of one group, each a list of (document, start, length)."""
    best: list = []
    least = -(-sum(n % window for n in lengths) // window)
    while True:
        windows, small = [], []
        for d, n in enumerate(lengths):
            whole, parts = cut(n, window, piece)
            windows += [[(d, *w)] for w in whole]
            small += [(d, *p) for p in parts]
        packed = [[small[i] for i in p] for p in pack_sizes([x[2] for x in small], window)] if small else []
        if not best or len(packed) < len(best[1]):
            best = [windows, packed]
        if len(packed) <= least + max(1, int(SPARE * least)) or piece // 2 < MIN_PIECE:
            return best[0] + best[1]
        piece //= 2


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    window: int = WINDOW,
    piece: int = PIECE,
    group: int = GROUP,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence; with_ids adds the ids themselves.

    sequence_id holds the task's partition in its high bits and the window's
    number there in its low ones. table_bytes bounds each worker's table of
    words (see bpe) and changes no result.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64()] * 8 + ([pa.list_(pa.int32())] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(tokenizer, table_bytes)
        base, made = TaskContext.get().partitionId() << 36, 0
        held_ids: list = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            rows: list[list] = [[] for _ in names]
            for w in pack_group([len(x) for x in held], window, piece):
                at, total = 0, sum(x[2] for x in w)
                for d, start, n in w:
                    ids = held[d][start : start + n].astype("<u4")
                    row = [held_ids[d], start, n, zlib.crc32(ids.tobytes()), len(held[d]), base + made, at, total]
                    for col, v in zip(rows, row + ([ids.astype(np.int32)] if with_ids else [])):
                        col.append(v)
                    at += n
                made += 1
            held_ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

        for keys, some in texts(batches):
            for k, ids in zip(keys, bpe.encode(some)):
                held_ids.append(k)
                held.append(np.append(ids, np.array([end_id], dtype="<u2")))
                if len(held) >= group:
                    yield flush()
        if held:
            yield flush()

    return keyed_texts(docs, key, text).mapInArrow(run, schema)
