"""Python workers outlive their tasks: what a step of the pipeline leaves behind, and how much it takes at once."""

import ctypes
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

import corpus_pipeline
from barweave.llm import packing, substrings, units


class Frame:
    """Stands for a frame; keeps the functions that ``mapInArrow`` is given."""

    columns = ["doc_id", "text"]

    def __init__(self):
        self.works = []

    def select(self, *columns):
        return self

    def mapInArrow(self, work, schema):
        self.works.append(work)
        return self


def own_mb():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024


def batch(n_bytes, seed=1):
    rng = random.Random(seed)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(180)) for _ in range(n_bytes // 1900)]
    columns = [pa.array(range(len(texts)), pa.int64()), pa.array([1] * len(texts), pa.int32()), pa.array(texts)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "text"])


def test_packing_encodes_little_at_once_with_the_memo_of_the_pipeline(monkeypatch):
    sent, limits = [], []

    class Coder:
        def encode(self, texts):
            sent.append(sum(len(u) for t in texts for u in t))
            return np.arange(len(texts), dtype=np.uint32), np.ones(len(texts), np.int64)

    monkeypatch.setattr(packing, "library_coder", lambda path, limit=None: limits.append(limit) or Coder())
    monkeypatch.setattr(packing, "pack", lambda pieces: pieces)
    monkeypatch.setattr(packing, "id_text", lambda df, *a: df)
    frame = Frame()
    corpus_pipeline.best_fit_packing(None, frame, "")
    rows = batch(5 << 20)
    assert sum(b.num_rows for b in frame.works[0]([rows])) == rows.num_rows
    assert len(sent) > 3 and max(sent) <= 1 << 20 and sum(sent) > 4 << 20
    assert limits == [corpus_pipeline.MEMO]


def test_a_small_memo_gives_the_same_ids():
    texts = [t.as_py() for t in batch(60_000).column("text")]
    codes = [units.library_coder(P.path("byte_bpe_50k.json"), n) for n in (500, 1_000_000)]
    ids = [[coder.encode([units.byte_level_units(t)])[0].tolist() for t in texts] for coder in codes]
    assert ids[0] == ids[1] and len(codes[0].codes) < len(codes[1].codes)


def test_a_task_gives_its_memory_back(monkeypatch):
    if not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("no call to give memory back")
    monkeypatch.setattr(substrings, "_rows", lambda df, *a: df)
    monkeypatch.setattr(substrings, "F", _Anything())
    frame, rows = _Dealt(), batch(12 << 20)
    with pytest.raises(_Stop):
        substrings.repeated_ranges(frame)
    before = own_mb()
    assert sum(b.num_rows for b in frame.works[0]([rows])) > 30
    assert own_mb() - before < 25


class _Anything:
    def __getattr__(self, name):
        return lambda *a: self


class _Stop(Exception):
    pass


class _Dealt(Frame):
    def agg(self, *a):
        return self

    def first(self):
        return (12 << 20,)

    def groupBy(self, *a):
        raise _Stop
