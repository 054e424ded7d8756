"""Best-fit packing of tokenised documents under several capacities at once.

A piece has three sizes: its tokens, one document, and its attention cost (the
square of its tokens).  Every open sequence has a residual in each.  Pieces go
in descending order to the sequence that fits in all three and has the largest
weighted dot product of sizes and residuals, or leaves the smallest weighted
residual norm; sizes and residuals count as shares of the capacities.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_type, give_back, id_text, lean, settled, steps
from .units import byte_level_units, library_coder

#: Text bytes encoded at once; the library's own results for new units are some hundred times as large.
STEP = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; a longer one is cut so that only the first piece is short."""
    first = n % most or most
    return [(0, n)] if n <= most else [(0, first), *[(s, most) for s in range(first, n, most)]]


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights=(1.0, 1e-3, 1e-3), rule: str = "norm") -> np.ndarray:
    """The bin of each piece.  Ties go to the fullest, then the oldest bin."""
    tokens = np.asarray(lengths, np.int64)
    sizes = np.stack([tokens, np.ones_like(tokens), tokens**2], axis=1).astype(np.float64)
    caps = np.asarray(capacity, np.float64)
    if len(sizes) and (sizes > caps).any():
        raise ValueError("a piece is larger than a whole sequence")
    w = np.asarray(weights, np.float64)
    order = np.argsort(-tokens, kind="stable")
    out = np.empty(len(tokens), np.int64)
    free = np.empty((1024, 3))  # residuals of open bins
    name = np.empty(1024, np.int64)
    n_open = n_bins = 0
    least = np.minimum.accumulate(sizes[order][::-1], axis=0)[::-1]  # smallest sizes still to come
    for at, i in enumerate(order.tolist()):
        size = sizes[i]
        live = free[:n_open]
        fits = np.flatnonzero((live >= size).all(axis=1))
        if len(fits):
            if rule == "dot":
                score = -((live[fits] / caps) * (size / caps) * w).sum(axis=1)
            else:
                score = ((((live[fits] - size) / caps) ** 2) * w).sum(axis=1)
            k = int(fits[np.argmin(score)])
        else:
            if n_open == len(free):
                keep = np.flatnonzero((live >= least[at]).all(axis=1))
                if len(keep) > len(free) // 2:
                    free, name = np.concatenate([free, np.empty_like(free)]), np.concatenate([name, np.empty_like(name)])
                free[: len(keep)], name[: len(keep)], n_open = free[keep], name[keep], len(keep)
            k = n_open
            free[k], name[k] = caps, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        free[k] -= size
        out[i] = name[k]
        if free[k][0] < least[at][0] or free[k][1] < 1:
            n_open -= 1
            free[k], name[k] = free[n_open], name[n_open]
    return out


def tokenised_pieces(
    df: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0, id_col="doc_id", text_col="text", memo: int = 1_000_000
) -> DataFrame:
    """Pieces of every document, encoded whole with an end id behind it.  Null and empty texts are one piece, the end id.

    ``memo``: units that a Python worker keeps with their ids, about 150 bytes each; fewer take more time.
    """

    def encode(batches):
        coder = library_coder(tokenizer, memo)
        for batch in steps(batches, "text", STEP):
            ids, lengths = coder.encode([byte_level_units(t) for t in batch.column("text").to_pylist()])
            view = memoryview(np.insert(ids, np.cumsum(lengths), end_id).astype("<u4")).cast("B")
            rows, base = [], 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), (lengths + 1).tolist()):
                for k, (s, m) in enumerate(cut(n, max_tokens)):
                    rows.append((doc, k, s, m, zlib.crc32(view[4 * (base + s) : 4 * (base + s + m)])))
                base += n
            columns = [pa.array(c, t.type) for c, t in zip(zip(*rows), arrow_type(PIECES))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_type(PIECES))

    return id_text(df, id_col, text_col).mapInArrow(lean(encode), PIECES)


def pack(
    pieces: DataFrame,
    max_tokens: int = 2048,
    max_docs: int | None = None,
    max_attention: int | None = None,
    group_tokens: int = 8 << 20,
    rule: str = "norm",
) -> DataFrame:
    """Add ``sequence_id`` and ``offset``.

    Pieces are dealt by a hash into groups of about ``group_tokens`` tokens,
    each packed by one task; a group wastes less than one sequence of its
    thousands.  A missing capacity does not bind.  Pieces need not be unique:
    equal rows are packed one by one.
    """
    capacity = (max_tokens, max_docs or max_tokens, max_attention or max_tokens**2)
    pieces = settled(pieces, "pieces")
    total, rows = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-total // group_tokens), -(-rows // (group_tokens // 64)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        bins = best_fit(pdf["length"].to_numpy(), capacity, rule=rule)
        pdf["sequence_id"] = (pdf["_group"].to_numpy(np.int64) << 32) + bins
        pdf["offset"] = pdf.groupby("sequence_id", sort=False)["length"].cumsum() - pdf["length"]
        give_back()
        return pdf.drop(columns="_group")

    # the row number parts copies of one row as well
    salt = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups))
    return pieces.withColumn("_group", salt).groupBy("_group").applyInPandas(fill, PACKED)
