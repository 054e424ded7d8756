"""Cuts of a text at which public tokenizers encode the two sides independently."""

from __future__ import annotations

import functools
import os
import re
from itertools import chain

import numpy as np

from .common import UnitCoder

_TWO_SPACES = re.compile(r"\s\s")
_STOPS = frozenset(",.")
#: Units sent to the library in one text.
JOINED = 50
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def word_units(text: str) -> list[str]:
    """Units of a tokenizer that drops white space, never joins over it, and splits letters from punctuation."""
    units: list[str] = []
    for w in text.replace("\n", " ").split(" "):
        # the small form of a capital i with a dot ends with a mark, which joins the punctuation behind it
        if w[-1:] in _STOPS and "A" <= w[-2:-1] <= "\u024f" and w[-2].isalpha() and w[-2] != "\u0130":
            units += (w[:-1], w[-1])
        elif w:
            units.append(w)
    return units


def byte_level_units(text: str) -> list[str]:
    """Units of byte-level BPE: a lone space opens a new piece of its split pattern, a lone line end is one piece.

    Where white space stands together, the pattern looks ahead; such texts are
    cut only at single spaces between other characters.
    """
    if _TWO_SPACES.search(text):
        first, *rest = _LONE_SPACE.split(text)
        return [first, *[" " + x for x in rest]]
    units: list[str] = []
    for i, line in enumerate(text.split("\n")):
        if i:
            units.append("\n")
        lead = ""
        for w in line.split(" "):
            # a comma or full stop behind a letter is a piece of its own, and shared by many words
            if w[-1:] in _STOPS and "A" <= w[-2:-1] <= "\u024f" and w[-2].isalpha():
                units.append(lead + w[:-1])
                units.append(w[-1])
            elif w or lead:
                units.append(lead + w)
            lead = " "
    return units


@functools.cache
def library_coder(path: str, limit: int = 1_000_000) -> UnitCoder:
    """A memo of ``limit`` units over the library's encoder, shared by all tasks of a Python worker."""
    return UnitCoder(library_encoder(path), limit)


def library_encoder(path: str):
    """``encode_many`` of the tokenizers library for a JSON file, which takes strings of special tokens for these, as it does by default."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    newline = model.encode("\n", add_special_tokens=False).ids
    suffix = getattr(model.model, "end_of_word_suffix", None)
    last = np.zeros(model.get_vocab_size(), bool)
    if suffix:
        last[[i for token, i in model.get_vocab().items() if token.endswith(suffix)]] = True

    def alone(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in model.encode_batch_fast(units, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))

    # what may be sent together, what is put behind each, which ids end a unit, and how many of these are not its own
    if len(newline) == 1:
        fits, behind, ends_unit, extra = re.compile(r" ?\S+").fullmatch, "\n", np.arange(len(last)) == newline[0], 1
    elif suffix:
        fits, behind, ends_unit, extra = str.isalpha, " ", last, 0
    else:
        fits = None

    def together(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, lengths, and which units came apart."""
        flat, sizes = alone([behind.join([*units[s : s + JOINED], ""]) for s in range(0, len(units), JOINED)])
        ends = np.flatnonzero(ends_unit[flat]) + 1
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        found = np.diff(np.searchsorted(ends, bounds, "right"))
        wanted = np.full(len(sizes), JOINED)
        wanted[-1] = len(units) - JOINED * (len(sizes) - 1)
        good = found == wanted
        ends = ends[np.repeat(good, found)]
        starts = np.concatenate([[0], ends[:-1]])
        first = np.cumsum(np.concatenate([[0], np.where(good, wanted, 0)]))[:-1][good & (wanted > 0)]
        starts[first] = bounds[:-1][good & (wanted > 0)]
        lengths = ends - starts - extra
        at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        return flat[at], lengths, np.repeat(good, wanted)

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A call of the library has a price, so units that it keeps apart are sent many at a time; a text that does not
        come apart into as many units as went in (say, for a special token inside) is sent unit by unit."""
        joint = np.fromiter(map(bool, map(fits, units)), bool, len(units)) if fits else np.zeros(len(units), bool)
        done = np.zeros(len(units), bool)
        flats, lengths = [], np.zeros(len(units), np.int64)
        if joint.any():
            order = np.flatnonzero(joint)
            ids, sizes, good = together([units[i] for i in order.tolist()])
            flats.append(ids)
            lengths[order[good]] = sizes
            done[order[good]] = True
        rest = np.flatnonzero(~done)
        ids, sizes = alone([units[i] for i in rest.tolist()])
        lengths[rest] = sizes
        # ids lie by the order they were sent in: bring them back to the order of the units
        sent = np.concatenate([np.flatnonzero(done), rest])
        begins = np.empty(len(units), np.int64)
        begins[sent] = np.cumsum(lengths[sent]) - lengths[sent]
        flat = np.concatenate([*flats, ids])
        at = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(flat))
        return flat[at].astype(np.uint32), lengths

    return encode
