"""Periodic runs against brute force over all starts and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from barweave.llm import periodic
from barweave.llm.periodic import RunConfig

SCHEMA = "doc_id long, text string, row int, words string, runs string, done double, start long, frags int"
REST = (7, "w", "r", 0.5, 3, 1)


def brute_runs(words, least=6, times=4):
    n, seen = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, times * q):
                inside = [(a, b, p) for a, b, p in seen if a <= s and i + q <= b and q % p == 0]
                if not inside:
                    seen[(s, i + q, q)] = 1
            i += 1
    return sorted((s, e - s, q) for s, e, q in seen)


def words_of(doc, text, planted):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc).encode())
    if planted and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def brute(doc, text, planted):
    w = words_of(doc, text, planted)
    runs = brute_runs(w)
    gone = {i for s, ln, q in runs for i in range(s + q, s + ln)}
    collapsed = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    text_of = "".join(f"{s},{ln},{q}\n" for s, ln, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(text_of), sha(collapsed))


def texts(seed=2):
    rng = random.Random(seed)
    rows = [None, "", "   \n\t", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "x a b c a b c a b c a b c a", "é ß " * 9, "\x0b\x0c".join("ab" * 9)]
    for k in range(160):
        out = []
        for _ in range(rng.randint(1, 5)):
            block = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 16, 17, 31, 40]))]
            out += block * rng.randint(1, 9) if rng.random() < 0.7 else block
            out += block[: rng.randint(0, len(block))]
            if rng.random() < 0.2:
                out *= rng.randint(2, 5)
        rows.append(rng.choice([" ", "\n"]).join(out[:700]))
    return rows


def test_fragments_cover_all_runs():
    for text in texts(9):
        w = (text or "").split()
        codes, _ = periodic._codes([x.encode() for x in w])
        found = periodic.fragments(codes, periodic._octaves_upto(len(codes), 4), RunConfig())
        whole = sorted((s, e - s + p, p) for p, s, e in found.tolist() if e - s + p >= max(6, 4 * p))
        assert whole == brute_runs(w)


@pytest.mark.parametrize("config", [RunConfig(), RunConfig(tile_words=128, long_chars=40)])
@pytest.mark.parametrize("planted", [False, True])
def test_runs_equal_brute_force(spark, config, planted):
    rows = [(i * 3, t) for i, t in enumerate(texts())]
    rows += [(6, rows[40][1]), (6, rows[40][1]), (None, "z z z z z z z")]
    df = spark.createDataFrame([r + REST for r in rows], SCHEMA).repartition(5)
    found = periodic.find(df, digest=True, prepare=periodic.repeat_a_tail if planted else None, config=config)
    got = sorted(map(tuple, periodic.digests(found).collect()), key=str)
    assert got == sorted((brute(d, t, planted and d is not None) for d, t in rows), key=str)


def test_collapsed_texts_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "go " + "la la " * 4 + "end"), (2, None), (3, "one  two\nthree")], "doc_id long, text string")
    got = {r.doc_id: (r.runs, r.collapsed) for r in periodic.find(df).collect()}
    assert got[1][1] == "go la end" and [tuple(r) for r in got[1][0]] == [(1, 8, 1)]
    assert got[2] == ([], "") and got[3] == ([], "one two three")
    assert periodic.digests(periodic.find(df.limit(0), digest=True)).count() == 0


def test_a_very_long_run_crosses_tiles(spark):
    rng = random.Random(1)
    noise = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    block = noise(700)
    words = noise(900) + block * 9 + noise(300) + ["k"] * 5000 + noise(50)
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = periodic.find(df, config=RunConfig(tile_words=1024, long_chars=100)).first()
    assert [tuple(r) for r in got.runs] == [(900, 6300, 700), (7500, 5000, 1)]
    assert got.collapsed.split() == words[:1600] + words[7200:7501] + words[12500:]


def test_z_function():
    rng = random.Random(0)
    for _ in range(50):
        s = [rng.randrange(2) for _ in range(rng.randrange(30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periodic.z_function(s) == want
    assert periodic._is_power(np.array([1, 2, 1, 2])) and not periodic._is_power(np.array([1, 2, 1])) and not periodic._is_power(np.array([1]))
