"""Token ids in a compact binary form: a static range asymmetric numeral system (rANS).

Documents are range-partitioned by id and sorted, so that the partitions in
their order hold the ids of all documents in ascending order. A partition's
documents are written as sections, one row each, whose ``data`` is a
self-contained binary:

    magic, header      lanes and precision, numbers of documents, ids, blocks
    document table     length of each document, 32 bits
    frequency table    symbols and their frequencies, shared by all blocks
    checkpoints        for each block: first id, ids, bytes, CRC-32
    blocks             independent streams of interleaved rANS states

Every block starts from its own states, so blocks decode in parallel and a
damaged one is found by its checksum and named. States are 64 bits wide and
give or take 32 bits at a time; ``lanes`` states take turns, so that each step
works on a whole vector. Frequencies add up to 2 ** BITS, at least one for
every symbol that occurs in the section.

The files are Parquet files of such rows in the shared folder, as a cluster's
storage is reached through Spark alone.

Defined results: a null text is empty and gives its end id alone; a null id
sorts first; rows that share an id are ordered by their texts; an empty table
gives no rows; a text of any length is one document of as many blocks as it
takes; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import worker_bpe
from .common import keyed_texts, shared_path, texts

MAGIC = b"rANS\x01"
BITS = 18
LOW = np.uint64(1 << 31)
LANES = 1024
#: Ids in a block, and ids after which a section ends with its document.
BLOCK = 1 << 18
SECTION = 1 << 22


def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """counts scaled to a sum of 2 ** bits, at least 1 where a count is."""
    total, seen = int(counts.sum()), np.flatnonzero(counts)
    if len(seen) > 1 << bits:
        raise ValueError("more symbols than 2 ** bits")
    out = np.zeros(len(counts), dtype=np.int64)
    if not len(seen):
        return out
    out[seen] = np.maximum(1, counts[seen].astype(np.int64) * (1 << bits) // max(total, 1))
    short = (1 << bits) - int(out.sum())
    if short >= 0:
        out[seen[np.argmax(out[seen])]] += short
    while short < 0:  # taken from the largest, a part of each
        big = seen[out[seen] > 1]
        take = np.minimum(out[big] - 1, np.maximum(1, (out[big] * -short) // max(1, int(out[big].sum()))))
        left = np.minimum(np.cumsum(take), -short)
        take = np.diff(left, prepend=0)
        out[big] -= take
        short += int(take.sum())
    return out


class Table:
    def __init__(self, symbols: np.ndarray, freq: np.ndarray, bits: int = BITS):
        self.bits = bits
        self.symbols, self.f = symbols, freq.astype(np.uint64)
        self.c = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.int32), freq)


def encode_block(s: np.ndarray, t: Table, lanes: int) -> bytes:
    """s: indices into the table's symbols."""
    n = len(s)
    x = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    bits, room = np.uint64(t.bits), np.uint64(63 - t.bits)
    f_all, c_all = t.f[s], t.c[s]
    for at in range((n - 1) // lanes * lanes, -1, -lanes) if n else ():
        f, c = f_all[at : at + lanes], c_all[at : at + lanes]
        y = x[: len(f)]
        full = np.flatnonzero(y >= f << room)
        if len(full):
            words.append(y[full].astype(np.uint32))
            y[full] >>= np.uint64(32)
        q = y // f
        x[: len(f)] = (q << bits) + (y - q * f) + c
    words.reverse()
    return x.astype("<u8").tobytes() + b"".join(w.astype("<u4").tobytes() for w in words)


def decode_block(data: bytes, n: int, t: Table, lanes: int) -> np.ndarray:
    x = np.frombuffer(data, dtype="<u8", count=lanes).astype(np.uint64)
    words = np.frombuffer(data, dtype="<u4", offset=8 * lanes).astype(np.uint64)
    out, at = np.empty(n, dtype=np.int32), 0
    bits, mask = np.uint64(t.bits), np.uint64((1 << t.bits) - 1)
    for k in range(0, n, lanes):
        m = min(lanes, n - k)
        y = x[:m]
        low = y & mask
        s = t.slot[low.astype(np.int64)]
        out[k : k + m] = s
        y = t.f[s] * (y >> bits) + low - t.c[s]
        need = np.flatnonzero(y < LOW)
        if len(need):
            y[need] = (y[need] << np.uint64(32)) | words[at : at + len(need)]
            at += len(need)
        x[:m] = y
    if at != len(words) or (x != LOW).any():
        raise ValueError("a block does not end where it began")
    return out


def encode_section(docs: list[np.ndarray], block: int = BLOCK, bits: int = BITS) -> bytes:
    ids = np.concatenate(docs) if docs else np.empty(0, dtype="<u2")
    counts = np.bincount(ids, minlength=1)
    symbols = np.flatnonzero(counts)
    freq = frequencies(counts, bits)[symbols]
    table = Table(symbols, freq, bits)
    place = np.zeros(len(counts), dtype=np.int32)
    place[symbols] = np.arange(len(symbols))
    lanes = int(max(1, min(LANES, len(ids) // 128)))
    points, blocks = [], []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        data = encode_block(place[part], table, lanes)
        points.append(struct.pack("<QIII", at, len(part), len(data), zlib.crc32(data)))
        blocks.append(data)
    head = MAGIC + struct.pack("<IIIQII", bits, lanes, len(docs), len(ids), len(blocks), len(symbols))
    lengths = np.array([len(d) for d in docs], dtype="<u4").tobytes()
    return b"".join(
        (head, lengths, symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), *points, *blocks)
    )


def decode_section(data: bytes) -> Iterator[np.ndarray]:
    """The documents of a section, one after another; a block is decoded when it is needed."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a section")
    at = len(MAGIC)
    bits, lanes, docs, total, blocks, kinds = struct.unpack_from("<IIIQII", data, at)
    at += struct.calcsize("<IIIQII")
    lengths = np.frombuffer(data, "<u4", docs, at)
    at += 4 * docs
    symbols = np.frombuffer(data, "<u4", kinds, at)
    freq = np.frombuffer(data, "<u4", kinds, at + 4 * kinds).astype(np.int64)
    at += 8 * kinds
    points = [struct.unpack_from("<QIII", data, at + k * 20) for k in range(blocks)]
    at += 20 * blocks
    table = Table(symbols, freq, bits)
    kinds16 = symbols.astype("<u2")
    left, k = np.empty(0, dtype="<u2"), 0
    for n in lengths.tolist():
        held = [left]
        have = len(left)
        while have < n:
            _, m, size, crc = points[k]
            part = data[at : at + size]
            if zlib.crc32(part) != crc:
                raise ValueError(f"block {k} is damaged")
            held.append(kinds16[decode_block(part, m, table, lanes)])
            at, k, have = at + size, k + 1, have + m
        left = np.concatenate(held) if len(held) > 1 else held[0]
        yield left[:n]
        left = left[n:]


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
) -> None:
    """Write the ids of docs in ascending order of their ids to path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(tokenizer)
        part, section, first, held, keys = TaskContext.get().partitionId(), 0, 0, [], []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal section, first, size
            row = [[part], [section], [first], [size], [list(keys)], [encode_section(held)]]
            section, first, size = section + 1, first + size, 0
            held.clear()
            keys.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "section", "first_id", "n_ids", "doc_ids", "data"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], names=names)

        for some_keys, some in texts(batches):
            for k, ids in zip(some_keys, bpe.encode(some)):
                keys.append(k)
                held.append(np.append(ids, np.array([end_id], dtype="<u2")))
                size += len(held[-1])
                if size >= SECTION:
                    yield flush()
        if held:
            yield flush()

    rows = keyed_texts(docs, key, text)
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "part int, section int, first_id long, n_ids long, doc_ids array<long>, data binary"
    rows.mapInArrow(run, schema).write.parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    rows = spark.read.parquet(path)
    ends = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(F.col("part").alias("of"), before.alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                at, out = b.column(1)[r].as_py(), [[], [], [], [], []]
                part = b.column(0)[r].as_py()
                for k, ids in zip(b.column(2)[r].as_py(), decode_section(b.column(3)[r].as_py()), strict=True):
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    for col, v in zip(out, (part, k, at, len(ids), crc)):
                        col.append(v)
                    at += len(ids)
                kinds = [pa.int32(), *[pa.int64()] * 4]
                names = ["part", "doc_id", "in_part", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    got = rows.select("part", "first_id", "doc_ids", "data").mapInArrow(
        run, "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long"
    )
    return got.join(ends, got["part"] == ends["of"]).select(
        "doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, **options) -> DataFrame:
    """write_ids to a new place in the shared folder, then read_ids from it."""
    path = shared_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, **options)
    return read_ids(docs.sparkSession, path)
