"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.tables import shared_folder, write_settled

#: Text bytes that one vectorised step of a task holds at a time.
STEP_BYTES = 4 << 20


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def id_text_columns(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    return [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")]


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one; other columns, whatever their names, stay behind."""
    return df.select(*id_text_columns(id_col, text_col))


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder that all executors share."""
    return f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write a reduced table to the shared folder and read it back, so that a lost executor re-reads it."""
    return write_settled(df, new_path(df.sparkSession, label), lasting)


def steps(batches: Iterable[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the strings of a slice sum to about ``limit`` bytes; one longer row stays whole."""
    for batch in batches:
        sizes = [len(x) if x is not None else 0 for x in (v.as_buffer() for v in batch.column(column))]
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
}


def arrow_type(schema: str) -> pa.Schema:
    """A flat DDL string (``name type, ...``, arrays of simple types) as an Arrow schema, also inside a task."""

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else _ARROW[name]

    return pa.schema([(name, kind(t)) for name, t in (field.split() for field in schema.split(", "))])


def give_back() -> None:
    """Freed memory of this Python worker goes back to the system, where its C library has a call for it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` of a ``mapInArrow`` that gives memory back when its task ends.

    Workers are kept for later tasks and stages, beside those of the other cores and the
    executor's heap; without this each would stay as large as its largest task made it.
    """

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


class _Numbers(dict):
    """Numbers of units in the order they are first looked up."""

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        return number


class UnitCoder:
    """Encode lists of text units through a bounded memo of the units seen.

    ``encode_many`` turns distinct units into all their ids and the number of each.  Natural text repeats
    its words, so most units are looked up; the memo is emptied once it holds
    ``limit`` units, which bounds memory and never changes a result.
    """

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 300_000):
        self.encode_many, self.limit = encode_many, limit
        self._reset()

    def _reset(self) -> None:
        self.codes = _Numbers()
        self.flat = np.empty(0, np.uint32)
        self.offsets = np.zeros(1, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        """Take in the units numbered last."""
        tail, lengths = self.encode_many(fresh)
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        self.flat = np.concatenate([self.flat, tail])

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        if len(self.codes) > self.limit:
            self._reset()
        units = list(chain.from_iterable(texts))
        known = len(self.codes)
        try:
            codes = np.fromiter(map(self.codes.__getitem__, units), np.int64, len(units))
            if len(self.codes) > known:
                self._learn(list(islice(self.codes, known, None)))
        except BaseException:
            self._reset()  # no number without its ids
            raise
        first, lengths = self.offsets[codes], np.diff(self.offsets)[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(first - (ends - lengths), lengths) + np.arange(total)]
        bounds = np.cumsum([0, *map(len, texts)])
        ends = np.concatenate([[0], ends])
        return ids, np.diff(ends[bounds])
