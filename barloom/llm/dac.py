"""Directly addressable codes for token ids, and the files that hold them.

An id is split into chunks of ``WIDTHS`` bits, lowest first.  Level j holds
chunk j of every id that reaches it, bit-packed, and a bitmap of which of them
go on to level j + 1.  A rank directory (ones before each block of 512 bits)
finds an id's place in the next level, so any id is read from a few bytes
without decoding others.

A file is a Parquet table of segments in ascending order: the doc_ids, where
each document ends, and the codes of all its ids.  Spark's writer and reader
make it work on any store.  Format of ``codes``: ``DAC1``, number of levels (u32),
then of each level: number of chunks (u64), bytes of bitmap, of directory and
of chunks (u64 each), and these three parts.
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

from barloom.llm.common import written
from barloom.llm.vocabulary import encoder

WIDTHS = (10, 6, 16)
BLOCK = 512
SEGMENT_TOKENS = 1 << 16
SEGMENT = "part int, start long, n_tokens long, docs array<long>, ends array<long>, codes binary"


def _pack(values: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes() + b"\0\0\0\0"


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8, (n * width + 7) // 8), count=n * width, bitorder="little").reshape(n, width)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u4")[:, 0]


def encode(ids: np.ndarray) -> bytes:
    """The codes of ids below 2**32."""
    out, rest = [b"DAC1", struct.pack("<I", len(WIDTHS))], ids.astype(np.uint32)
    for j, width in enumerate(WIDTHS):
        chunk, more = rest & np.uint32((1 << width) - 1), rest >> np.uint32(width)
        on = more > 0 if j + 1 < len(WIDTHS) else np.zeros(len(rest), bool)
        bitmap = np.packbits(on, bitorder="little").tobytes()
        ones = np.add.reduceat(on.astype(np.uint32), np.arange(0, len(on), BLOCK)) if len(on) else np.zeros(0, np.uint32)
        directory = (np.cumsum(ones) - ones).astype("<u4").tobytes()
        packed = _pack(chunk, width)
        out += [struct.pack("<QQQQ", len(rest), len(bitmap), len(directory), len(packed)), bitmap, directory, packed]
        rest = more[on]
    return b"".join(out)


class Codes:
    """Reads one segment's codes."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"DAC1":
            raise ValueError("these are not directly addressable codes")
        self.levels, at = [], 8
        for _ in range(struct.unpack_from("<I", data, 4)[0]):
            n, *sizes = struct.unpack_from("<QQQQ", data, at)
            at += 32
            parts = []
            for size in sizes:
                parts.append(data[at : at + size])
                at += size
            self.levels.append((n, *parts))

    def __len__(self) -> int:
        return self.levels[0][0]

    def __getitem__(self, i: int) -> int:
        """Id i, from one chunk and one bitmap block a level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for width, (_, bitmap, directory, packed) in zip(WIDTHS, self.levels):
            byte, bit = divmod(i * width, 8)
            value |= (int.from_bytes(packed[byte : byte + 4], "little") >> bit & (1 << width) - 1) << shift
            shift += width
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            inside = int.from_bytes(bitmap[block * BLOCK // 8 : (i >> 3) + 1], "little") & (1 << i - block * BLOCK) - 1
            i = struct.unpack_from("<I", directory, 4 * block)[0] + inside.bit_count()
        return value

    def all(self) -> np.ndarray:
        value = None
        for width, (n, bitmap, _, packed) in reversed(list(zip(WIDTHS, self.levels))):
            chunk = _unpack(packed, n, width)
            if value is not None:
                on = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n, bitorder="little"))
                chunk[on] |= value << np.uint32(width)
            value = chunk
        return value


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int | None = 1) -> DataFrame:
    """Encode whole texts and write the token files in ascending doc_id order.

    Returns the files' segments.  Documents are range-partitioned by doc_id;
    a partition makes its segments one after the other, so memory holds one
    segment.  Null texts are empty; null doc_ids come first; rows that repeat a
    doc_id lie side by side, ordered by a hash of the text, and may fill several
    partitions however alike they are.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        docs_, ends, size, start = [], [], 0, 0

        def segment() -> pa.RecordBatch:
            codes = encode(np.concatenate(ids))
            values = [[part], [start], [size], [docs_], [ends], [codes]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds)], names=["part", "start", "n_tokens", "docs", "ends", "codes"]
            )

        for b in batches:
            names = b.column(0).to_pylist()
            for lo, hi, flat, counts in encoder(vocabulary).texts(b.column(1), end_id):
                cut = np.concatenate([[0], np.cumsum(counts)])
                first = 0
                for i in range(hi - lo):
                    docs_.append(names[lo + i])
                    size += int(counts[i])
                    ends.append(size)
                    if size >= SEGMENT_TOKENS:
                        ids.append(flat[cut[first] : cut[i + 1]])
                        first = i + 1
                        yield segment()
                        start += size
                        ids, docs_, ends, size = [], [], [], 0
                if first < hi - lo:
                    ids.append(flat[cut[first] :])
        if docs_:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "h", "nth").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return written(ordered.mapInArrow(job, SEGMENT), "tokens")


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document from its files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before; partition totals (one
    number for each partition) make it global.
    """
    sums = sorted(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, total = {}, 0
    for r in sums:
        base[r.part] = total
        total += r.n

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                part, start, _, docs_, ends, codes = (b.column(j)[i].as_py() for j in range(6))
                data = Codes(codes).all().astype("<u4")
                begins = [0, *ends[:-1]]
                crc = [zlib.crc32(data[a:z]) for a, z in zip(begins, ends)]
                columns = [docs_, [base[part] + start + a for a in begins], [z - a for a, z in zip(begins, ends)], crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "start", "n_tokens", "docs", "ends", "codes").mapInArrow(
        job, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
