"""Periodic runs of words, by tiles of every period octave.

A run is a maximal stretch of words with smallest period ``q`` and at least
``max(least, times * q)`` words.  In *match coordinates* a stretch with period
``q`` is an interval of places ``i`` with ``w[i] == w[i + q]``; it is ``q``
shorter than its words, and two stretches of one period never touch there.

Periods are searched octave by octave.  For periods from ``B`` up to ``2B`` the
words have a boundary at each multiple of ``B``.  A run holds several boundaries
in a row at which the ``B`` words from the boundary recur one period later;
rolling hashes find these by one comparison for each word.  At such a boundary
the Z-functions of the tile around it, forwards and backwards, give the stretch of
every period of the octave inside the tile.  The interval fragments are
then shuffled by document and period and stitched.  A document longer than
``RunConfig.tile_words`` is exploded into overlapping tiles first, larger ones
for larger octaves, which are dealt out over the tasks; a shorter one is a tile.

What becomes of odd rows:

* A null text has no words and no runs; neither has an empty one.
* Rows are judged one by one: repeated rows, rows with equal or null ids each give a row.
* Periods and starts have no ties inside a document: a run is told by start and period.
* A text of any length is searched whole.  An empty table gives an empty table.
* Columns other than id and text are left behind, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow_type, id_text_columns, settled, steps

#: ``(doc_id, words) -> words``, applied before the search.
Prepare = Callable[[int | None, list[bytes]], list[bytes]]


@dataclass(frozen=True)
class RunConfig:
    #: Fewest words of a run, and fewest periods in it (3 or more).
    least: int = 6
    times: int = 4
    #: Words of a document that one task searches at a time, a power of two; longer documents are dealt out as tiles.
    tile_words: int = 1 << 20
    #: Characters from which a text may be longer than a tile.
    long_chars: int = 1 << 21


def z_function(s: list[int]) -> list[int]:
    """``z[i]``: how many items from ``i`` on agree with those from the start on."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _prime_divisors(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + ([n] if n > 1 else [])


def _is_power(root: np.ndarray) -> bool:
    """Whether the words are a shorter block, repeated."""
    n = len(root)
    return any((root[: n - n // r] == root[n // r :]).all() for r in _prime_divisors(n))


def _boundaries(hashes: np.ndarray, size: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """``(boundary, period)`` pairs of the octave from ``size`` on that stand in a long enough row of boundaries."""
    fit = len(hashes) - size
    if fit <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows = -(-fit // size)
    later = np.zeros(rows * size, np.uint64)
    later[:fit] = hashes[size:]
    j, x = np.nonzero(later.reshape(rows, size) == hashes[: rows * size : size][: rows, None])
    ok = j * size + x < fit
    j, p = j[ok], x[ok] + size
    order = np.lexsort((j, p))
    j, p = j[order], p[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(j) != 1) | (np.diff(p) != 0)])) if len(j) else np.empty(0, np.int64)
    lengths = np.diff(np.append(new, len(j)))
    keep = np.repeat(lengths >= (times - 1) * p[new] // size - 1, lengths)
    return j[keep] * size, p[keep]


def fragments(words: np.ndarray, octaves: range, config: RunConfig) -> np.ndarray:
    """``(period, start, end)`` rows in match coordinates of what runs have inside ``words``.

    Each row is a stretch of its (smallest) period, whole unless it touches the edge of the tile of its boundary; every
    place of a run's stretch lies in some row.  Rows of one period are merged where they touch.
    """
    n = len(words)
    hashes = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    # of lower octaves: the end of the run over a word that reaches furthest, and its period
    reach, period = np.zeros(n, np.int64), np.ones(n, np.int64)
    out: list[tuple[int, int, int]] = []
    for k in range(octaves.stop):
        size = 1 << k
        if len(hashes) <= size:
            break
        if k in octaves:
            at, p = _boundaries(hashes, size, config.times)
            fresh = (reach[at] < at + p + size) | (p % period[at] != 0)
            found = _octave(words, at[fresh], p[fresh], size, config)
            for q, s, e in found:
                over = reach[s : e + q] < e + q
                reach[s : e + q][over] = e + q
                period[s : e + q][over] = q
            out += found
        hashes = (hashes[:-size] * np.uint64(0xD1B54A32D192ED03)) ^ (hashes[size:] + np.uint64(k))
        hashes ^= hashes >> np.uint64(31)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return np.array(out, np.int64).reshape(-1, 3)


def _octave(words: np.ndarray, at: np.ndarray, periods: np.ndarray, size: int, config: RunConfig) -> list[tuple[int, int, int]]:
    n = len(words)
    found = []
    order = np.lexsort((periods, at))
    at, periods = at[order], periods[order]
    for b, ps in zip(np.unique(at).tolist(), np.split(periods, np.flatnonzero(np.diff(at)) + 1) if len(at) else []):
        lo, hi, edge = max(0, b - 2 * size), min(n, b + 4 * size), min(n, b + 2 * size)
        forward = z_function(words[b:hi].tolist())
        before = words[lo:b][::-1].tolist()
        backward = z_function([*before, -1, *words[lo:edge][::-1].tolist()])
        for p in ps.tolist():
            start, end = b - backward[len(before) + 1 + edge - b - p], b + forward[p]
            if end <= start:
                continue
            cut = start == lo or end + p == hi
            if (cut or end - start + p >= max(config.least, config.times * p)) and not _is_power(words[b : b + p]):
                found.append((p, start, end))
    merged: list[tuple[int, int, int]] = []
    for p, s, e in sorted(found):
        if merged and merged[-1][0] == p and s <= merged[-1][2]:
            merged[-1] = (p, merged[-1][1], max(e, merged[-1][2]))
        else:
            merged.append((p, s, e))
    return merged


def _octaves_upto(longest: int, times: int) -> range:
    """Octaves of all periods that fit ``times`` times."""
    return range(max(0, longest // times).bit_length())


def _codes(words: list[bytes], base: int = 0) -> tuple[np.ndarray, int]:
    """Numbers from ``base`` on for the words, equal for equal words, and the next free one."""
    known = dict(zip(dict.fromkeys(words), count(base)))
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words)), base + len(known)


def _finished(words: list[bytes], digest: bool) -> str:
    joined = b" ".join(words)
    return hashlib.sha256(joined).hexdigest() if digest else joined.decode()


def _prepared(doc: int | None, text: str, prepare: Prepare | None) -> list[bytes]:
    words = text.encode().split()  # bytes are split at the six ASCII white spaces
    return prepare(doc, words) if prepare else words


SEARCHED = "row long, doc_id long, words string, done string, frags array<long>"


def _search(digest: bool, prepare: Prepare | None, config: RunConfig):
    """Search documents that fit a tile, many side by side: no two share a number, so no stretch leaves its document."""

    def work(batches):
        for batch in steps(batches, "text"):
            docs = batch.column("doc_id").to_pylist()
            texts = [_prepared(d, t, prepare) for d, t in zip(docs, batch.column("text").to_pylist())]
            parts, base = [], 0
            for words in texts:
                codes, base = _codes(words, base)
                parts.append(codes)
            starts = np.cumsum([0, *map(len, parts)])
            found = fragments(np.concatenate(parts), _octaves_upto(max(map(len, parts)), config.times), config)
            found = found[np.argsort(found[:, 1], kind="stable")]
            owner = np.searchsorted(starts, found[:, 1], "right") - 1
            found[:, 1:] -= starts[owner][:, None]
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            frags = [found[a:b].ravel() if b > a else None for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array([None if f is None else b" ".join(w).decode() for w, f in zip(texts, frags)], pa.string()),
                    pa.array([_finished(w, digest) if f is None else None for w, f in zip(texts, frags)], pa.string()),
                    pa.array(frags, pa.list_(pa.int64())),
                ],
                schema=arrow_type(SEARCHED),
            )

    return work


TILES = "row long, low int, high int, start long, codes binary"


def _tiles(config: RunConfig):
    """Overlapping tiles of long documents: octave by octave larger, each eight periods wider than its core on both sides."""

    def work(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("words").to_pylist()):
                codes, _ = _codes(text.encode().split())
                last = _octaves_upto(len(codes), config.times).stop
                core = config.tile_words
                low, high = 0, min(last, max(1, (core // 64).bit_length()))  # periods up to 1/32 of the core, and one octave more for each doubling
                while low < last:
                    margin = 8 << (high - 1)
                    for start in range(0, max(1, len(codes)), core):
                        left = max(0, start - margin)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([v], t) for v, t in zip((row, low, high, left, codes[left : start + core + margin].tobytes()), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                            schema=arrow_type(TILES),
                        )
                    low, high, core = high, high + 1, core * 2

    return work


def _solve_tiles(config: RunConfig):
    def work(batches):
        schema = arrow_type("row long, period long, start long, end long")
        for batch in batches:
            for row, low, high, start, codes in zip(*[batch.column(c).to_pylist() for c in ("row", "low", "high", "start", "codes")]):
                found = fragments(np.frombuffer(codes, np.int64), range(low, high), config)
                found[:, 1:] += start
                cols = [np.full(len(found), row, np.int64), *(np.ascontiguousarray(c) for c in found.T)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)

    return work


def stitched(frags: DataFrame, config: RunConfig) -> DataFrame:
    """``row, start, length, period`` of every run, from fragments ``row, period, start, end`` that may overlap."""
    own = Window.partitionBy("row", "period").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    runs = frags.withColumn("opens", opens).withColumn("run", F.sum("opens").over(own))
    runs = runs.groupBy("row", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.withColumn("length", F.col("end") - F.col("start") + F.col("period"))
    return runs.where(F.col("length") >= F.greatest(F.lit(config.least), config.times * F.col("period"))).select("row", "start", "length", "period")


def _collapse(digest: bool):
    """Leave of each run its first period and count what was found."""

    def work(batches):
        for batch in steps(batches, "words"):
            out = []
            for text, runs in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist()):
                words = text.encode().split()
                drop = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    drop[r["start"] + r["period"]] += 1
                    drop[r["start"] + r["length"]] -= 1
                kept = np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()
                out.append(_finished([words[i] for i in kept], digest))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), batch.column("runs")], names=["doc_id", "done", "runs"])

    return work


RUNS = "array<struct<start: long, length: long, period: long>>"


def find(df: DataFrame, digest: bool = False, prepare: Prepare | None = None, config: RunConfig = RunConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed`` of every row: runs by start, then period; collapsed: the words that no run has after
    its first period, joined by one space (with ``digest`` the SHA-256 of that)."""
    doc, text = id_text_columns(id_col, text_col)
    rows = df.select(F.monotonically_increasing_id().alias("row"), doc, text)
    is_long = F.length("text") > config.long_chars
    short = settled(rows.where(~is_long).mapInArrow(_search(digest, prepare, config), SEARCHED), "searched")

    def words_of(batches):
        for batch in batches:
            texts = [b" ".join(_prepared(d, t, prepare)).decode() for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(texts, pa.string())], names=["row", "doc_id", "words"])

    long = rows.where(is_long).withColumn("row", -1 - F.col("row"))
    long = settled(long.mapInArrow(words_of, "row long, doc_id long, words string"), "long")
    tiles = long.select("row", "words").mapInArrow(_tiles(config), TILES).repartition("row", "low", "start")
    exploded = tiles.mapInArrow(_solve_tiles(config), "row long, period long, start long, end long")
    triples = F.explode(F.transform(F.sequence(F.lit(0), F.size("frags") - 3, F.lit(3)), lambda i: F.slice("frags", i + 1, 3)))
    solved = short.where("frags IS NOT NULL").select("row", triples.alias("f"))
    solved = solved.select("row", *[F.col("f")[i].alias(c) for i, c in enumerate(("period", "start", "end"))])
    runs = stitched(solved.unionByName(exploded), config)
    runs = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    none = F.array().cast(RUNS)
    open_rows = short.where("frags IS NOT NULL").select("row", "doc_id", "words").unionByName(long)
    open_rows = open_rows.join(runs, "row", "left").select("doc_id", "words", F.coalesce("runs", none).alias("runs"))
    closed = short.where("frags IS NULL").select("doc_id", "done", none.alias("runs"))
    both = closed.unionByName(open_rows.mapInArrow(_collapse(digest), f"doc_id long, done string, runs {RUNS}"))
    return both.select("doc_id", "runs", F.col("done").alias("collapsed"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run and the digests of what :func:`find` gave with ``digest``."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    length: Column = -F.col("best.l")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        length.alias("length"),
        F.col("best.p").alias("period"),
        F.floor(1000 * length / F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line).cast("binary"), 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )


def repeat_a_tail(doc: int | None, words: list[bytes]) -> list[bytes]:
    """For one document id in ten, by CRC-32 of its decimal form: from word ``a`` on, its first ``p`` words over and over."""
    if doc is None or not words:
        return words
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * (-(-(n - a) // p)))[: n - a]
