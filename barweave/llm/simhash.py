"""SimHash near-duplicates, linked with BK-trees.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles.  Documents with one fingerprint are one node.  Two fingerprints that
differ in at most ``radius`` bits agree on one of ``radius + 1`` blocks of bits,
so every node goes to one shard for each block's value, and a BK-tree per shard
is exact.  Shard trees would be a broadcast of all fingerprints, which has no
bound; here the shuffle brings trees and queries together.  A shard beyond
``shard_limit`` is dealt again by blocks of the bits that it does not share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_type, id_text, lean, settled, steps
from .graphs import components

SEED = 42
FINGERPRINTS = "doc_id long, fp long"


def _shingles(raw: bytes, size: int) -> list[int]:
    """Hashes of the shingles, repeats included."""
    words = raw.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [*starts[size:], at]
    return [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends)]


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 1 << 18):
        part = hashes[s : s + (1 << 18)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, size: int = 3) -> int:
    """Unsigned fingerprint of a text; zero without words."""
    hashes = _shingles((text or "").encode(), size)
    return _majority(np.array(hashes, np.uint64)) if hashes else 0


def fingerprints(df: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long) of every row; null and wordless texts have zero."""

    def work(batches):
        for batch in steps(batches, "text"):
            out = np.array([fingerprint(t.as_py(), size) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], schema=arrow_type(FINGERPRINTS))

    return id_text(df, id_col, text_col).mapInArrow(lean(work), FINGERPRINTS)


class BKTree:
    """Children keyed by their Hamming distance to the parent; insertion and search in one walk each."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> None:
        self.children.append({})
        self.values.append(value)
        if len(self.values) == 1:
            return
        at = 0
        while True:
            d = (value ^ self.values[at]).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = len(self.values) - 1
                return
            at = nxt

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Positions of values at most ``radius`` away; only edges that can hold one are followed."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                yield at
            todo += [c for key, c in self.children[at].items() if d - radius <= key <= d + radius]


def _links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links of a shard that join what earlier ones did not; all links of the shard follow from them."""
    tree, root = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                yield value, values[j]
        tree.insert(value)


def _blocks(fp: Column, free: list[int], parts: int) -> Column:
    """``(block, value)`` for ``parts`` runs of the bit positions in ``free``."""
    cuts = np.linspace(0, len(free), parts + 1).astype(int)
    out = []
    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
        mask = sum(1 << b for b in free[s:e])
        out.append(F.struct(F.lit(k).alias("block"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("value")))
    return F.array(*out)


def links(nodes: DataFrame, radius: int = 3, shard_limit: int = 4096) -> DataFrame:
    """``a > b``: links between distinct ``fp`` at most ``radius`` bits apart that span the same components as all."""
    parts = radius + 1
    bits = list(range(64))
    width = 64 // parts
    shards = nodes.select("fp", F.explode(_blocks(F.col("fp"), bits, parts)).alias("s")).select(
        "fp", F.col("s.block").alias("block"), F.col("s.value").alias("value")
    )
    full = shards.groupBy("block", "value").count().where(F.col("count") > shard_limit).select("block", "value")
    cold = shards.join(full, ["block", "value"], "left_anti").select("fp", "block", "value", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("sub_value"))
    dealt = F.lit(None)
    for k in range(parts):
        stop = 64 if k == parts - 1 else (k + 1) * width
        rest = [b for b in bits if not k * width <= b < stop]
        dealt = F.when(F.col("block") == k, _blocks(F.col("fp"), rest, parts)).otherwise(dealt)
    hot = shards.join(full, ["block", "value"], "left_semi").select("fp", "block", "value", F.explode(dealt).alias("s"))
    hot = hot.select("fp", "block", "value", F.col("s.block").alias("sub"), F.col("s.value").alias("sub_value"))
    keys = ["block", "value", "sub", "sub_value"]

    def work(batches):
        held: list[int] = []
        key = None

        def flush():
            found = [(max(a, b), min(a, b)) for a, b in _links(held, radius)] if len(held) > 1 else []
            signed = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return np.sort(signed, axis=1)

        out = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in keys]
            fps = batch.column("fp").to_numpy().view(np.uint64).tolist()
            for fp, now in zip(fps, zip(*columns)):
                if now != key:
                    out.append(flush())
                    key, held = now, []
                held.append(fp)
            pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
            out = []
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], schema=arrow_type("a long, b long"))
        pairs = flush()
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], schema=arrow_type("a long, b long"))

    dealt_out = cold.unionByName(hot).repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt_out.mapInArrow(lean(work), "a long, b long")


def near_duplicates(df: DataFrame, radius: int = 3, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row.

    ``component_id`` is the least ``doc_id`` reachable over links of at most
    ``radius`` bits, the document's own included.  Rows with one fingerprint,
    exact copies and wordless texts among them, are linked like any other; rows
    with a null ``doc_id`` get the least id of the others, or null.
    """
    docs = settled(fingerprints(df, size, id_col, text_col), "simhash")
    nodes = settled(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    joined = components(links(nodes, radius)).select(F.col("a").alias("fp"), F.col("b").alias("top"))
    top = nodes.join(joined, "fp", "left").select("fp", "least", F.coalesce("top", "fp").alias("top"))
    named = top.join(top.groupBy("top").agg(F.min("least").alias("component_id")), "top").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
