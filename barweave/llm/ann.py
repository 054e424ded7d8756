"""Maximum inner product search with a hash-prefix forest.

Vectors are scaled into the unit ball and lifted to the sphere, where the
largest inner product is the smallest angle.  A tree is a sorted array of long
bit strings, the signs of random projections.  A query descends every tree to
its longest matching prefix, then all trees are ascended together, one bit at a
time, and every row that shares the prefix becomes a candidate, until there are
enough.  Candidates are scored on the original vectors in double precision.

Rows are dealt to blocks with a forest each, and blocks of queries meet blocks
of rows, so no task holds more than one block of both; the best of every block
are merged per query.  High-dimensional data without clusters needs a large
share of candidates: ``share`` trades time for recall.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import arrow_type, settled

PACKED = "vec_id long, v binary, norm double, dim int"
FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class ForestConfig:
    """``share`` of a block's rows are candidates at least; blocks of up to ``least`` rows are searched whole."""

    trees: int = 64
    bits: int = 48
    share: float = 0.5
    least: int = 256
    row_block: int = 8192
    query_block: int = 2048
    seed: int = 17


def packed(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors as bytes of doubles.  Null, empty and zero vectors, those with null or non-finite components, and null ids are left out."""

    def work(batches):
        for batch in batches:
            out = []
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("x")):
                if i is None or not x.is_valid or len(x.values) == 0 or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(v).all() and v.any():
                    out.append((i, v.tobytes(), float(np.sqrt((v * v).sum())), len(v)))
            columns = list(zip(*out)) or [[], [], [], []]
            schema = arrow_type(PACKED)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    return rows.mapInArrow(work, PACKED)


class PrefixForest:
    """Sorted arrays of bit strings over the rows of one block."""

    def __init__(self, points: np.ndarray, planes: np.ndarray, bits: int):
        self.bits, self.planes, self.n = bits, planes, len(points)
        keys = self._strings(points)
        self.order = [np.argsort(k, kind="stable") for k in keys]
        self.sorted = [k[o] for k, o in zip(keys, self.order)]

    def _strings(self, points: np.ndarray) -> list[np.ndarray]:
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        return [((points @ p) > 0).astype(np.uint64) @ weights for p in self.planes]

    def candidates(self, queries: np.ndarray, wanted: int):
        """For each query, the rows found when the ascent has ``wanted`` of them."""
        keys = self._strings(queries)
        deepest = np.zeros(len(queries), np.int64)
        for own, k in zip(self.sorted, keys):
            # the longest match stands next to where the query would be inserted
            at = np.searchsorted(own, k)
            for near in (np.clip(at - 1, 0, self.n - 1), np.clip(at, 0, self.n - 1)):
                differ = own[near] ^ k
                length = self.bits - np.frexp(differ.astype(np.float64))[1]
                deepest = np.maximum(deepest, np.where(differ == 0, self.bits, length))
        ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def level(x: int):
            if x not in ranges:
                step = np.uint64(1) << np.uint64(self.bits - x)
                low = [k & ~(step - np.uint64(1)) for k in keys]
                ranges[x] = (
                    np.stack([np.searchsorted(s, a) for s, a in zip(self.sorted, low)], axis=1),
                    np.stack([np.searchsorted(s, a + (step - np.uint64(1)), side="right") for s, a in zip(self.sorted, low)], axis=1),
                )
            return ranges[x]

        for i in range(len(queries)):
            mark = np.zeros(self.n, bool)
            for x in range(int(deepest[i]), -1, -1):
                lows, highs = level(x)
                for order, a, b in zip(self.order, lows[i].tolist(), highs[i].tolist()):
                    if b > a:
                        mark[order[a:b]] = True
                if np.count_nonzero(mark) >= wanted:
                    break
            yield i, np.flatnonzero(mark)


def _top(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int):
    """The ``k`` best of some rows, ties to the smaller id; equal vectors score equal bit by bit."""
    other = ids != query_id
    ids, vectors = ids[other], vectors[other]
    rough = vectors @ query
    if len(rough) > k:
        edge = np.partition(rough, len(rough) - k)[len(rough) - k]
        near = rough >= edge - 1e-9 * max(1.0, abs(edge))
        ids, vectors = ids[near], vectors[near]
    score = (vectors * query).sum(axis=1)
    best = np.lexsort((ids, -score))[:k]
    return ids[best], score[best]


def search(df: DataFrame, every: int = 20, k: int = 20, config: ForestConfig = ForestConfig(), id_col="vec_id", vector_col="embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the queries, the rows whose id is divisible by ``every``.

    A row with the query's own id is no candidate.  Rows with equal ids are
    separate candidates and give one query each.  Vectors of other length than
    most are left out, as they have no inner product with the rest.  A table
    without valid vectors gives no row.
    """
    vectors = settled(packed(df, id_col, vector_col), "vectors")
    dims = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = dims["dim"] if dims else 0
    vectors = vectors.where(F.col("dim") == dim)
    total, largest, asked = vectors.agg(F.count(F.lit(1)), F.max("norm"), F.sum((F.pmod("vec_id", F.lit(every)) == 0).cast("long"))).first()
    row_blocks = max(1, -(-total // config.row_block))
    query_blocks = max(1, -(-(asked or 0) // config.query_block))
    rng = np.random.default_rng(config.seed)
    planes = rng.normal(size=(config.trees, dim + 1, config.bits))

    def answer(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x = np.frombuffer(b"".join(rows["v"]), np.float64).reshape(-1, dim)
        q = np.frombuffer(b"".join(queries["v"]), np.float64).reshape(-1, dim)
        scaled = x / largest
        lifted = np.concatenate([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1, keepdims=True)))], axis=1)
        asked_for = np.concatenate([q / np.sqrt((q**2).sum(axis=1, keepdims=True)), np.zeros((len(q), 1))], axis=1)
        forest = PrefixForest(lifted, planes, config.bits)
        ids, query_ids = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        wanted = len(x) if len(x) <= config.least else max(config.least, int(len(x) * config.share))
        out = []
        for i, found in forest.candidates(asked_for, wanted):
            got, score = _top(ids[found], x[found], query_ids[i], q[i], k)
            out.append(pd.DataFrame({"query_id": query_ids[i], "vec_id": got, "score": score}))
        return pd.concat(out)

    dealt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(row_blocks)).cast("int")
    rows = vectors.select("vec_id", "v", dealt.alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    queries = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int")
    queries = queries.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), block.alias("qb"))
    found = rows.groupBy("rb", "qb").cogroup(queries.groupBy("rb", "qb")).applyInPandas(answer, FOUND)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
