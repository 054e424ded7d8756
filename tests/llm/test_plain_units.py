import numpy as np
import public_tokenizers as P
import pytest
import regex

from barweave.llm import bpe_sql
from barweave.llm.common import UnitCoder


def test_plain_words_are_not_searched(monkeypatch):
    searched = []

    class Spy:
        findall = staticmethod(lambda u, cut=regex.compile(P.PATTERN).findall: searched.append(u) or cut(u))

    monkeypatch.setattr(regex, "compile", lambda pattern: Spy)

    class Model:
        encode_words = staticmethod(lambda words: (np.arange(len(words), dtype=np.uint32), np.ones(len(words), np.int64)))

    encode = bpe_sql._unit_encoder(Model, P.PATTERN)
    searched.clear()
    units = [" word", "Word", " it's", "  two", " x9", " café", "a"]
    _, lengths = encode(units)
    assert searched == [" it's", "  two", " x9", " café", "a"]
    assert lengths.tolist() == [len(regex.findall(P.PATTERN, u)) for u in units]


def test_a_failed_step_leaves_no_number_without_ids():
    fail = [True]

    def encode_many(units):
        if fail.pop() if fail else False:
            raise ValueError("once")
        return np.array([len(u) for u in units], np.uint32), np.ones(len(units), np.int64)

    coder = UnitCoder(encode_many)
    with pytest.raises(ValueError):
        coder.encode([["a", "bb"]])
    ids, lengths = coder.encode([["bb", "a", "bb"], [], ["ccc"]])
    assert ids.tolist() == [2, 1, 2, 3] and lengths.tolist() == [3, 0, 1]
