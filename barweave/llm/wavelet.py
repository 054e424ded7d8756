"""Token ids in a wavelet matrix per shard: one file holds bit planes with rank and select.

A shard is a run of whole documents in ascending id order.  Plane ``l`` holds
bit ``l`` (from the top) of every token, in the order left by the stable
partitions of the planes above it.  A directory of set bits per 512-bit block
makes ``rank`` one lookup and a popcount.  Each shard is one row in a Parquet
file of its own (``maxRecordsPerFile=1``, zstd), so Spark writes, commits and
reads the files on whatever store the shared folder is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import STEP_BYTES, arrow_type, id_text, new_path, steps
from .units import library_coder, word_units

BLOCK = 512
SHARD_SCHEMA = (
    "part int, seq int, n_tokens long, doc_ids binary, lengths binary, zeros array<long>, planes array<binary>, ranks array<binary>"
)


class WaveletMatrix:
    """Bit planes over ``n`` symbols below ``2 ** len(planes)``."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros = n, [int(z) for z in zeros]
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"a token id needs more than {bits} bits")
        v = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (v >> level & 1).astype(bool)
            packed = np.packbits(bit)
            padded = np.zeros(-(-len(packed) // 64) * 64, np.uint8)
            padded[: len(packed)] = packed
            per_block = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32).tobytes())
            # places found first: half the time of a choice by mask
            low = v[np.flatnonzero(~bit)]
            zeros.append(len(low))
            planes.append(packed.tobytes())
            v = np.concatenate([low, v[np.flatnonzero(bit)]])
        return cls(len(ids), zeros, planes, ranks)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Set bits of a plane before ``i``."""
        block = i // BLOCK
        plane, first = self.planes[level], block * (BLOCK // 8)
        n = int(self.ranks[level][block]) + int(np.bitwise_count(plane[first : i >> 3]).sum())
        return n + (int(plane[i >> 3]) >> (8 - (i & 7))).bit_count() if i & 7 else n

    def _down(self, level: int, bit: int, i: int) -> int:
        ones = self._ones(level, i)
        return self.zeros[level] + ones if bit else i - ones

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit = self._bit(level, i)
            value, i = value << 1 | bit, self._down(level, bit, i)
        return value

    def _range(self, symbol: int, upto: int) -> tuple[int, int]:
        lo, hi, bits = 0, upto, len(self.planes)
        if symbol >> bits:
            return 0, 0
        for level in range(bits):
            bit = symbol >> (bits - 1 - level) & 1
            lo, hi = self._down(level, bit, lo), self._down(level, bit, hi)
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of ``symbol`` before position ``i``."""
        lo, hi = self._range(symbol, i)
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) ``bit`` of a plane, by search in the directory and a scan of one block."""
        seen = self.ranks[level] if bit else np.arange(len(self.ranks[level])) * BLOCK - self.ranks[level].astype(np.int64)
        block = int(np.searchsorted(seen, k, side="right")) - 1
        first = block * (BLOCK // 8)
        inside = np.unpackbits(self.planes[level][first : first + BLOCK // 8]) == bit
        return block * BLOCK + int(np.flatnonzero(inside)[k - int(seen[block])])

    def select(self, symbol: int, k: int) -> int:
        """Position of occurrence ``k`` (from 0) of ``symbol``."""
        lo, hi = self._range(symbol, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def tokens(self) -> np.ndarray:
        """All tokens in order: the partitions undone from the lowest plane up."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        v = np.zeros(self.n, kind)
        for level in range(bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~bit)] = v[: self.zeros[level]]
            up[np.flatnonzero(bit)] = v[self.zeros[level] :] | kind(1 << (bits - 1 - level))
            v = up
        return v.astype(np.uint32)


def write_shards(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    path: str,
    bits: int = 16,
    shard_tokens: int = 4 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode texts in ascending id order, an end id behind each, and write wavelet shards under ``path``.

    Null and empty texts give the end id alone.  Rows with the same id stay
    apart, ordered by text.  An empty table writes no shard.  A shard closes at
    ``shard_tokens``; a longer document has one of its own.
    """

    def encode(batches):
        from pyspark import TaskContext

        coder = library_coder(tokenizer)
        part, seq = TaskContext.get().partitionId(), 0
        held, total = [], 0

        def shard():
            nonlocal seq, held, total
            ids = np.concatenate([h[2] for h in held])
            matrix = WaveletMatrix.build(ids, bits)
            row = {
                "part": part,
                "seq": seq,
                "n_tokens": len(ids),
                "doc_ids": np.concatenate([h[0] for h in held]).astype("<i8").tobytes(),
                "lengths": np.concatenate([h[1] for h in held]).astype("<i8").tobytes(),
                "zeros": matrix.zeros,
                "planes": [p.tobytes() for p in matrix.planes],
                "ranks": [r.tobytes() for r in matrix.ranks],
            }
            seq, held, total = seq + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=arrow_type(SHARD_SCHEMA))

        for batch in steps(batches, "text", min(STEP_BYTES, shard_tokens)):
            ids, lengths = coder.encode([word_units(t) for t in batch.column("text").to_pylist()])
            ids = np.insert(ids, np.cumsum(lengths), end_id)
            lengths = lengths + 1
            if total and total + len(ids) > shard_tokens:
                yield shard()
            held.append((batch.column("doc_id").to_numpy(zero_copy_only=False), lengths, ids))
            total += len(ids)
        if held:
            yield shard()

    ordered = id_text(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(encode, SHARD_SCHEMA)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path)


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"])


def read_shards(spark, path: str) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids_crc32`` and its shard."""
    schema = "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long"

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = _matrix(row).tokens().astype("<u4")
                lengths = np.frombuffer(row["lengths"], "<i8")
                ends = np.cumsum(lengths)
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [np.full(n, row["part"], np.int32), np.full(n, row["seq"], np.int32), doc_ids, ends - lengths, lengths, np.array(crc, np.int64)],
                    schema=arrow_type(schema),
                )

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # one row per writing task, then one per shard of that task
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("of_part"))
    parts = parts.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("before_part"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    before = shards.select("part", "seq", own.alias("before_shard")).join(parts, "part")
    docs = shards.mapInArrow(decode, schema)
    return docs.join(before, ["part", "seq"]).select(
        "doc_id", (F.col("before_part") + F.col("before_shard") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "part", "seq"
    )


def token_occurrences(spark, path: str, symbol: int) -> DataFrame:
    """``part, seq, position`` of a token, by select on each shard."""
    schema = "part int, seq int, position long"

    def look(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = _matrix(row).occurrences(symbol)
                yield pa.RecordBatch.from_pylist([{"part": row["part"], "seq": row["seq"], "position": p} for p in found], schema=arrow_type(schema))

    return spark.read.schema(SHARD_SCHEMA).parquet(path).mapInArrow(look, schema)


def encode_and_read(df: DataFrame, tokenizer: str, end_id: int = 1, **more) -> DataFrame:
    path = new_path(df.sparkSession, "wavelet")
    write_shards(df, tokenizer, end_id, path, **more)
    return read_shards(df.sparkSession, path)
