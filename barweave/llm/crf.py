"""Language of words and texts by a linear-chain conditional random field.

States are the learned languages.  A word's emission is the sum of weights of
its byte n-grams with both word ends marked (an n-gram at an end is an affix),
hashed into one table, and of a lexicon row where the word is known.
Transitions are learned too: training chains are spliced from spans of texts in
different languages, so they switch as mixed text does.  Forward-backward gives
each word a distribution; a text's language is the one with the largest share
of the words that have a letter.

The field is fitted on a bounded sample of labelled rows
(``CrfConfig.rows_per_lang`` rows of at most ``max_langs`` languages, ``spans``
spans of ``span_words`` words from each, drawn by hashes); every row is
predicted from its whole text.

What becomes of odd rows:

* A null text, and one without a letter, is ``und`` with score 0; so is every text if no row has a label.
* Each row is judged alone: repeated rows, rows with equal or null ids each give a row.
* Equal shares: the first language in alphabetical order.
* Long texts run through the same chain in blocks; nothing is cut off.
* An empty table gives an empty table; other columns are left behind, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow_type, id_text_columns, steps

LETTER = re.compile(r"[^\W\d_]")
ORDERS = (2, 3, 4, 5)
UND = "und"


@dataclass(frozen=True)
class CrfConfig:
    #: Labelled rows of a language that training sees at most, and languages (the most frequent).
    rows_per_lang: int = 300
    max_langs: int = 64
    #: Spans drawn from a sampled row, and words of each.
    spans: int = 4
    span_words: int = 40
    #: Spans spliced into one training chain.
    splice: int = 5
    buckets_log2: int = 16
    #: A word enters the lexicon from so many occurrences in the sample.
    lexicon_from: int = 3
    rounds: int = 40
    rate: float = 0.1
    decay: float = 1e-4
    #: Words of a block of the chain.
    block: int = 64
    #: Words whose emissions a worker keeps.
    memo: int = 200_000


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    grams: np.ndarray
    lexicon: dict[bytes, int]
    known: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    config: CrfConfig


# --- features ------------------------------------------------------------------------------------------------------


def gram_features(words: list[bytes], buckets_log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, word by word, and the bounds of each word's."""
    data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    rest = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))
    padded = np.concatenate([data, np.zeros(max(ORDERS), np.uint32)])
    h = np.zeros(len(data), np.uint32)
    found, of = [], []
    for n in range(1, max(ORDERS) + 1):
        h = (h ^ padded[n - 1 : n - 1 + len(data)]) * np.uint32(0x01000193) + np.uint32(n)
        if n in ORDERS:
            fits = rest >= n
            mixed = h[fits] * np.uint32(0x9E3779B1)
            found.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - buckets_log2))
            of.append(owner[fits])
    flat, of = np.concatenate(found).astype(np.int64), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return flat[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])


def _segment_sums(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])
    return total[bounds[1:]] - total[bounds[:-1]]


def emissions(model: Model, words: list[bytes]) -> np.ndarray:
    """A row of scores for each word, zero for words without a letter."""
    flat, bounds = gram_features(words, model.config.buckets_log2)
    scores = _segment_sums(model.grams[flat].astype(np.float64), bounds)
    scores += model.known[[model.lexicon.get(w, 0) for w in words]]
    scores[[not LETTER.search(w.decode()) for w in words]] = 0
    return scores


# --- forward-backward ----------------------------------------------------------------------------------------------


def marginals(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray, first: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State probabilities of every word, and forward and backward messages (each up to a factor).

    All chains lie one behind the other; ``starts`` marks their first words, where the message is set back to ``first``.
    Blocks of words are multiplied out side by side, joined in order, and filled in side by side.
    """
    n, k = scores.shape
    blocks = -(-n // block)
    e = np.ones((blocks * block, k))
    e[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    back = np.ones(blocks * block, bool)  # the filling stands for chains of its own
    back[:n] = starts
    e, back = e.reshape(blocks, block, k), back.reshape(blocks, block)
    t, pi = np.exp(moves - moves.max()), np.exp(first - first.max())
    tiny = 1e-300

    def normal(x: np.ndarray, axes) -> np.ndarray:
        return x / np.maximum(x.max(axis=axes, keepdims=True), tiny)

    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(block):
        step = product @ t
        r = back[:, i]
        if r.any():
            step[r] = product[r].sum(axis=2, keepdims=True) * pi
        product = normal(step * e[:, i, None, :], (1, 2))
    into = np.empty((blocks, k))
    message = np.ones(k)
    for b in range(blocks):
        into[b] = message
        message = message @ product[b]
        message /= max(message.max(), tiny)
    out = np.empty((blocks, k))
    message = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        out[b] = message
        message = product[b] @ message
        message /= max(message.max(), tiny)
    forward, backward = np.empty((blocks, block, k)), np.empty((blocks, block, k))
    a = into
    for i in range(block):
        step = a @ t
        r = back[:, i]
        step[r] = a[r].sum(axis=1, keepdims=True) * pi
        a = forward[:, i] = normal(step * e[:, i], 1)
    z = out
    for i in range(block - 1, -1, -1):
        backward[:, i] = z
        step = (e[:, i] * z) @ t.T
        step[back[:, i]] = 1
        z = normal(step, 1)
    forward, backward = forward.reshape(-1, k)[:n], backward.reshape(-1, k)[:n]
    both = forward * backward
    return both / np.maximum(both.sum(axis=1, keepdims=True), tiny), forward, backward


# --- training ------------------------------------------------------------------------------------------------------


def _splice(spans: list[tuple[str, list[bytes]]], langs: tuple[str, ...], splice: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, their states and chain starts; spans in an order that hashes give."""
    order = sorted(range(len(spans)), key=lambda i: zlib.crc32(b"%d " % i + b" ".join(spans[i][1])))
    words, states, starts = [], [], []
    for at, i in enumerate(order):
        lang, span = spans[i]
        words += span
        states += [langs.index(lang)] * len(span)
        starts += [at % splice == 0] + [False] * (len(span) - 1)
    return words, np.array(states, np.int64), np.array(starts, bool)


def fit_spans(spans: list[tuple[str, list[bytes]]], config: CrfConfig = CrfConfig()) -> Model | None:
    """Maximise the conditional likelihood of spliced chains by full-batch Adam; None without a labelled word."""
    spans = [(lang, words) for lang, words in spans if words]
    langs = tuple(sorted({lang for lang, _ in spans}))
    if not langs:
        return None
    words, states, starts = _splice(spans, langs, config.splice)
    k = len(langs)
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    vocabulary = list(index)
    letters = np.array([bool(LETTER.search(w.decode())) for w in vocabulary])
    seen = np.bincount(at, minlength=len(vocabulary))
    in_lexicon = np.flatnonzero((seen >= config.lexicon_from) & letters)
    row = np.zeros(len(vocabulary), np.int64)
    row[in_lexicon] = np.arange(1, len(in_lexicon) + 1)
    flat, bounds = gram_features(vocabulary, config.buckets_log2)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(bounds))
    used, compact = np.unique(flat, return_inverse=True)
    onehot = np.eye(k)[states]
    within = ~starts
    within[0] = False
    pair = states[:-1] * k + states[1:]
    observed = np.bincount(pair[within[1:]], minlength=k * k).reshape(k, k)
    params = [np.zeros((len(used), k)), np.zeros((len(in_lexicon) + 1, k)), np.zeros((k, k)), np.zeros(k)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    n = len(words)
    for turn in range(1, config.rounds + 1):
        grams, known, moves, first = params
        by_word = _segment_sums(grams[compact], bounds) + known[row]
        by_word[~letters] = 0
        scores = by_word[at]
        gamma, forward, backward = marginals(scores, starts, moves, first, config.block)
        miss = onehot - gamma
        of_word = np.column_stack([np.bincount(at, miss[:, j], len(vocabulary)) for j in range(k)]) * letters[:, None]
        g_grams = np.column_stack([np.bincount(compact, of_word[owner, j], len(used)) for j in range(k)])
        g_known = np.column_stack([np.bincount(row, of_word[:, j], len(in_lexicon) + 1) for j in range(k)])
        g_known[0] = 0
        # expected moves between neighbours of one chain
        into = np.exp(scores - scores.max(axis=1, keepdims=True)) * backward
        edges = forward[:-1][within[1:]][:, :, None] * np.exp(moves - moves.max()) * into[1:][within[1:]][:, None, :]
        expected = (edges / edges.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        gradients = [g_grams, g_known, observed - expected, miss[starts].sum(axis=0)]
        for p, g, (m, v) in zip(params, gradients, moments):
            g = g / n - config.decay * p / len(langs)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += config.rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    table = np.zeros((1 << config.buckets_log2, k), np.float32)
    table[used] = params[0]
    lexicon = {vocabulary[i]: int(row[i]) for i in in_lexicon}
    return Model(langs, table, lexicon, params[1].astype(np.float32), params[2], params[3], config)


def training_spans(df: DataFrame, config: CrfConfig = CrfConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, list[bytes]]]:
    """The bounded sample: rows of each language by least hash of id and text, spans of each by hashes of the text."""
    doc, text = id_text_columns(id_col, text_col)
    rows = df.select(doc, text, F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang IS NOT NULL AND text <> ''")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(config.max_langs).collect()
    if not counts:
        return []
    each = min(config.rows_per_lang, max(1, config.rows_per_lang * 8 // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2.0 * each / r["count"]))])
    order = F.xxhash64("doc_id", "text")
    rows = rows.withColumn("share", share[F.col("lang")]).withColumn("order", order)
    rows = rows.where(F.pmod("order", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    rows = rows.withColumn("place", place).where(F.col("place") <= each).select("lang", "text")

    def work(batches):
        for batch in steps(batches, "text"):
            out = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = text.lower().encode().split()
                h = zlib.crc32(text.encode())
                for s in range(config.spans if len(words) > config.span_words else 1):
                    room = max(0, len(words) - config.span_words)
                    start = zlib.crc32(b"%d %d" % (h, s)) % (room + 1)
                    out.append((lang, [w.decode() for w in words[start : start + config.span_words]]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.list_(pa.string()))], names=["lang", "words"])

    found = rows.mapInArrow(work, "lang string, words array<string>").collect()
    return sorted((r["lang"], [w.encode() for w in r["words"]]) for r in found)


def fit(df: DataFrame, config: CrfConfig = CrfConfig(), **columns: str) -> Model | None:
    return fit_spans(training_spans(df, config, **columns), config)


# --- prediction ----------------------------------------------------------------------------------------------------

LABELLED = "doc_id long, lang_pred string, score double, span_langs array<string>, span_words array<long>"


class _Labeler:
    """Emissions are kept for the words seen; the memo is emptied once it is full, which never changes a result."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.rows = np.empty((0, len(self.model.langs)))
        self.letters = np.empty(0, bool)

    def label(self, texts: list[str]) -> list[tuple[str, float, list[str], list[int]]]:
        if len(self.codes) > self.model.config.memo:
            self._reset()
        split = [t.lower().encode().split() for t in texts]
        flat = [w for words in split for w in words]
        fresh = [w for w in dict.fromkeys(flat) if w not in self.codes]
        if fresh:
            self.codes.update(zip(fresh, range(len(self.codes), len(self.codes) + len(fresh))))
            self.rows = np.concatenate([self.rows, emissions(self.model, fresh)])
            self.letters = np.concatenate([self.letters, [bool(LETTER.search(w.decode())) for w in fresh]])
        bounds = np.cumsum([0, *map(len, split)])
        if not flat:
            return [(UND, 0.0, [], [])] * len(texts)
        at = np.fromiter(map(self.codes.__getitem__, flat), np.int64, len(flat))
        starts = np.zeros(len(flat), bool)
        starts[bounds[:-1][np.diff(bounds) > 0]] = True
        gamma, _, _ = marginals(self.rows[at], starts, self.model.moves, self.model.first, self.model.config.block)
        has = self.letters[at]
        shares = _segment_sums(gamma * has[:, None], bounds)
        lettered = _segment_sums(has[:, None].astype(float), bounds)[:, 0]
        state = gamma.argmax(axis=1)
        out = []
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if lettered[i] < 0.5:
                out.append((UND, 0.0, [], []))
                continue
            best = int(shares[i].argmax())
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(state[a:b])) + 1, [b - a]])
            names = [self.model.langs[state[a + c]] for c in cuts[:-1]]
            out.append((self.model.langs[best], min(1.0, shares[i][best] / lettered[i]), names, np.diff(cuts).tolist()))
        return out


def label(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, span_langs, span_words``: the text's language, and its words as spans of one language."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by buckets, lexicon of the sample and max_langs

    def work(batches):
        labeler = _Labeler(shared.value) if shared.value else None
        kinds = arrow_type(LABELLED)
        for batch in steps(batches, "text"):
            texts = batch.column("text").to_pylist()
            out = labeler.label(texts) if labeler else [(UND, 0.0, [], [])] * len(texts)
            cols = [pa.array([r[i] for r in out], kinds.field(i + 1).type) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], schema=kinds)

    return df.select(*id_text_columns(id_col, text_col)).mapInArrow(work, LABELLED)


def is_held_out(doc_id: Column) -> Column:
    """One document in three, by CRC-32 of its decimal id (a null id counts as the empty string), is kept from training."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(df: DataFrame, config: CrfConfig = CrfConfig()) -> DataFrame:
    """Fit on the labelled rows that are not held out, predict all."""
    model = fit(df.where(~is_held_out(F.col("doc_id").cast("long"))), config)
    out = label(df, model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "span_langs", "span_words")
