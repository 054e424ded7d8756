"""The language field: messages against enumeration of all paths, gradients by their effect, accuracy on held-out texts."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import crf
from barweave.llm.crf import CrfConfig

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, held_out int, lang_pred string, row double, words string"
REST = (1, "p", 0.5, "w")


@pytest.mark.parametrize("block", [1, 3, 64])
def test_marginals_equal_enumeration(block):
    rng = np.random.default_rng(block)
    lengths = [1, 4, 2, 5, 3]
    k = 3
    scores = rng.normal(0, 2, (sum(lengths), k))
    moves, first = rng.normal(0, 1, (k, k)), rng.normal(0, 1, k)
    starts = np.zeros(len(scores), bool)
    starts[np.cumsum([0, *lengths[:-1]])] = True
    gamma, _, _ = crf.marginals(scores, starts, moves, first, block)
    at = 0
    for n in lengths:
        want = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=n):
            weight = first[path[0]] + sum(scores[at + i, s] for i, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            for i, s in enumerate(path):
                want[i, s] += np.exp(weight)
        assert np.allclose(gamma[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def vocabulary(rng, letters, n=60):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)]


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    own = {"aa": vocabulary(rng, "abcdeë"), "bb": vocabulary(rng, "bcdfgü"), "cc": vocabulary(rng, "xyzabñ")}
    return own, [(i, " ".join(rng.choice(own[lang]) for _ in range(rng.randint(5, 80))), lang) for i, lang in enumerate(rng.choice(list(own)) for _ in range(n))]


def test_code_switched_words_are_told_apart(spark):
    own, rows = corpus()
    model = crf.fit(spark.createDataFrame([r + REST for r in rows], SCHEMA))
    assert model.langs == ("aa", "bb", "cc") and (np.diag(model.moves) > model.moves.mean(axis=1)).all()
    rng = random.Random(8)
    mixed = [rng.choice(own["aa"]) for _ in range(30)] + ["12", "--"] + [rng.choice(own["cc"]) for _ in range(15)]
    got = crf.label(spark.createDataFrame([(1, " ".join(mixed))], "doc_id long, text string"), model).first()
    assert got.lang_pred == "aa" and got.span_langs == ["aa", "cc"] and sum(got.span_words) == 47 and abs(got.span_words[0] - 31) <= 3
    assert 0.5 < got.score < 0.8


def test_odd_rows_have_defined_results(spark):
    _, rows = corpus(60)
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 345 -- !", None), (903, None, None), (904, rows[0][1], None), (904, rows[0][1], None), (None, rows[1][1], None)]
    odd += [(905, " ".join(r[1] for r in rows) * 20, None), (906, "x" * 300_000, None)]
    df = spark.createDataFrame([r + REST for r in rows + odd], SCHEMA).repartition(4)
    got = crf.identify(df, CrfConfig(memo=20)).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    assert all(by_id[i] == [("und", 0.0)] for i in (900, 901, 902, 903))
    assert by_id[904][0] == by_id[904][1] and by_id[904][0][0] == rows[0][2] and by_id[None][0][0] == rows[1][2]
    assert sum(by_id[i][0][0] == lang for i, _, lang in rows) >= 59
    plain = {r.doc_id: r.score for r in crf.identify(df).collect() if r.doc_id is not None}
    assert all(abs(plain[i] - by_id[i][0][1]) < 1e-9 for i in plain)
    assert crf.identify(df.limit(0)).count() == 0
    unlabelled = crf.identify(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in unlabelled] == [("und", 0.0)]


def test_id_source_and_held_out_labels_are_not_inputs(spark):
    _, rows = corpus(90, 5)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lied = spark.createDataFrame([(i, t, "zz" if held(i) else lang) for i, t, lang in rows], df.schema)
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in crf.identify(d).collect()} for d in (df, lied))
    assert a == b


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
def test_held_out_accuracy(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = crf.identify(df, CrfConfig(rows_per_lang=100)).join(df.select("doc_id", "lang"), "doc_id").where("held_out")
    right, all_rows = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert all_rows > 250 and right / all_rows > 0.99
