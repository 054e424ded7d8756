"""Search, near-duplicate and substring operators, and the pipeline, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barweave.llm import ann, simhash, substrings
from barweave.llm.graphs import components
from barweave.llm.suffixes import suffix_arrays

CLASH = "row int, h long, first string, ranges string, fp double, _w string"
REST = (1, 2, "f", "r", 0.5, "w")


# --- suffix arrays -------------------------------------------------------------------------------------------------


def test_suffix_arrays_side_by_side():
    rng = random.Random(4)
    fixed = [[b"a" * 50, b"ab" * 30, b"abaababaabaab" * 3, b"mississippi", b"", b"ba" * 20], [b""], []]
    many = [[bytes(rng.choice(b"ab" if k % 2 else b"abcde") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 8))] for k in range(80)]
    for texts in fixed + many:
        bounds = np.cumsum([0, *map(len, texts)])
        got = suffix_arrays(np.frombuffer(b"".join(texts), np.uint8), bounds[:-1], bounds[1:])
        for t, s, e in zip(texts, bounds, bounds[1:]):
            assert (got[s:e] - s).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def removed(rows, length=50):
    """``doc_id -> (n_bytes, n_removed, n_spans, kept)`` by brute force; rows with equal ids are judged apart."""
    first, out = {}, []
    for doc, text in sorted(((d, (t or "").encode()) for d, t in rows), key=lambda r: r[0]):
        for x in range(len(text) - length + 1):
            first.setdefault(text[x : x + length], doc)
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 2, int)
        for x in range(len(raw) - length + 1):
            if first[raw[x : x + length]] < doc:
                gone[x + 1 : x + 1 + length] = 1
        kept = bytes(c for c, g in zip(raw, gone[1:]) if not g)
        out.append((doc, len(raw), int(gone.sum()), int((np.diff(gone) == 1).sum()), kept))
    return out


def passages(n=120, seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß ") for _ in range(rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 5))]
        text = rng.choice(["", "\n"]).join(parts)
        if rng.random() < 0.3 and text:
            k = rng.randrange(len(text))
            text = text[:k] + "#" + text[k + 1 :]
        rows.append((i * 3 % 101 * 7 + i, text))
    return rows + [(9001, None), (9002, ""), (9003, "ab" * 400), (9004, "ab" * 300), (9005, "x" * 49), (9006, "x" * 49), (9007, rows[5][1]), (9007, rows[5][1]), (9008, rows[5][1] + "y" * 60), (9008, "q" + rows[7][1])]


@pytest.mark.parametrize("config", [substrings.RepeatConfig(), substrings.RepeatConfig(text_segments=2, bucket_bytes=1 << 12)])
def test_repeats_are_removed(spark, config):
    rows = passages()
    df = spark.createDataFrame([r + REST for r in rows], "doc_id long, text string, " + CLASH).repartition(5)
    want = sorted((d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in removed(rows))
    got = substrings.remove_repeats(df, config, digest=True)
    assert sorted(map(tuple, got.collect())) == want
    full = substrings.remove_repeats(df, config)
    assert full.columns == df.columns + ["n_bytes", "n_removed", "n_spans"]
    kept = sorted((r.doc_id, r.text, r._w, r.row) for r in full.collect())
    assert kept == sorted((d, k.decode("utf-8", "ignore"), "w", 1) for d, *_, k in removed(rows))


def test_a_common_passage_and_empty_tables(spark):
    common = "this passage of some sixty bytes stands in each and every text "
    rows = [(i, f"{i * 977} begin " + common + f" end {i * 31}" * 3) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted((d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in removed(rows))
    assert sorted(map(tuple, substrings.remove_repeats(df, digest=True).collect())) == want
    assert substrings.remove_repeats(df.limit(0)).count() == 0
    assert substrings.remove_repeats(spark.createDataFrame([(None, common), (1, common)], df.schema)).agg(F.sum("n_removed")).first()[0] == 0


# --- near-duplicates -----------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(range(65)) + b"abcdefghijklmnopqrstuvwxyz" + bytes(range(91, 256))))
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(values, radius):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(values))]


def near_rows():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(500)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(words).upper()
            rows.append(" ".join(own))
    rows += [None, "", " \n", "One", "one", "one two", "ONE\ttwo", "É é", "a b c d " * 3000]
    return [(50 - i if i % 2 else i + 100, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("limit", [4096, 2])
def test_simhash_groups(spark, limit):
    rows = near_rows()
    df = spark.createDataFrame([r + REST for r in rows] + [rows[3] + REST], "doc_id long, text string, " + CLASH).repartition(3)
    values = [slow_fingerprint(t) for _, t in rows]
    least = {}
    for (doc, _), c in zip(rows, classes(values, 3)):
        least[c] = min(doc, least.get(c, doc))
    want = {d: (v, least[c]) for (d, _), v, c in zip(rows, values, classes(values, 3))}
    docs = simhash.fingerprints(df)
    assert {r.doc_id: r.fp % (1 << 64) for r in docs.collect()} == {d: v for d, (v, _) in want.items()}
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: r.component_id for r in got} == {d: c for d, (_, c) in want.items()}
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in set(values)], "fp long")
    found = simhash.links(nodes, 3, limit).collect()
    order = sorted(set(values))
    spans = {v: c for v, c in zip(order, classes(order, 3))}
    joined = components(simhash.links(nodes, 3, limit)).collect()
    assert all((r.a ^ r.b) % (1 << 64) and ((r.a ^ r.b) % (1 << 64)).bit_count() <= 3 for r in found)
    assert len(joined) == len(order) - len(set(spans.values()))


def test_bk_tree_finds_all():
    rng = random.Random(9)
    values = list({rng.getrandbits(16) for _ in range(800)})
    tree = simhash.BKTree()
    for v in values:
        tree.insert(v)
    for q in values[:50]:
        assert sorted(tree.values[i] for i in tree.within(q, 3)) == sorted(v for v in values if (v ^ q).bit_count() <= 3)
    assert list(simhash.BKTree().within(1, 3)) == []


def test_no_documents(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(40)] + [(k, 100) for k in range(101, 160)]
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 160)}}


# --- nearest neighbours --------------------------------------------------------------------------------------------


def vectors(n=1500, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.2, 3, (n, 1))
    x[200:260] = x[40]  # copies
    rows = [(i, x[i].tolist(), 1.0) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * dim, [nan] * dim, [inf] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0] * (dim + 1)]
    return x, rows + [(2000 + 20 * i, v, 1.0) for i, v in enumerate(odd)] + [(None, [1.0] * dim, 1.0)]


def test_forest_search(spark):
    x, rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double").repartition(3)
    config = ann.ForestConfig(row_block=400, query_block=40, least=32)
    got = {}
    for r in ann.search(df, config=config).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    recall = []
    for q, found in got.items():
        scores = (x * x[q]).sum(axis=1)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -scores))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(s - scores[v]) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        recall.append(len(set(best.tolist()) & {v for _, v, _ in found}) / 20)
    assert np.mean(recall) >= 0.9
    assert [v for _, v, _ in sorted(got[40])] == list(range(200, 220))  # ties to the smaller id


def test_forest_on_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (20, [0.0, 2.0])], schema)
    assert [tuple(r) for r in ann.search(few).orderBy("query_id", "rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0)]
    assert ann.search(few.limit(0)).count() == 0
    assert ann.search(spark.createDataFrame([(0, None)], schema)).count() == 0


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: " ".join("w" + str(rng.randrange(4000)) for _ in range(n))
    shared = text(40)
    docs = [(i, text(120), "en", "s", 0) for i in range(30)]
    docs.append((30, docs[4][1], "en", "s", 0))  # a copy
    docs.append((31, docs[5][1] + " end", "en", "s", 0))  # nearly one
    docs += [(32 + i, text(60) + " " + shared + " " + text(60), "en", "s", 0) for i in range(3)]
    docs += [(40, "too short", "en", "s", 9), (41, "again and " * 80, "en", "s", 0), (42, None, None, None, None), (43, "mail me a.b@c.org " + text(80), "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = str(tmp_path / name)
        out.write.parquet(path)
        frame = spark.read.parquet(path)
        kept.append({r.doc_id: r for r in frame.collect()})
    assert set(range(32)) <= set(kept[0]) and not {40, 41, 42} & set(kept[0])
    assert 30 not in kept[1] and 31 not in kept[1] and set(range(30)) <= set(kept[1])
    assert shared in kept[2][32].text and shared not in kept[2][33].text and kept[2][33].n_chars == len(kept[2][33].text)
    assert "<email>" in kept[3][43].text and "@" not in kept[3][43].text
    assert set(kept[4]) == set(kept[3])
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, frame.collect()))


def near_copies(seed=6):
    """``(id, text)``: bases, copies with words replaced one by one down to a similarity below 0.8, copies in common, odd rows."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(4000))
    common = [word() for _ in range(30)]
    rows = []
    for g in range(25):
        base = [word() for _ in range(rng.randint(80, 200))] + (common if g % 2 else [])
        rows.append((100 * g, " ".join(base)))
        own = list(base)
        for k in range(1, 8):
            own[rng.randrange(len(own))] = word().upper()
            if k >= 2:
                rows.append((100 * g + k, " ".join(own)))
    last = rows[0][1]
    rows += [(None, "alone " + " ".join(word() for _ in range(60))), (None, last), (7000, "one id " + " ".join(word() for _ in range(60)))]
    return rows + [(7000, "other text " + " ".join(word() for _ in range(60))), (7000, rows[-1][1]), (5, None), (6, "")]


def sure_groups(rows):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, out = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (not sets[i] and not sets[j]) or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                a, b = out[i], out[j]
                out = [b if x == a else x for x in out]
    return out


def test_pipeline_drops_near_copies_of_five_words(spark):
    rows = near_copies()
    df = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string").repartition(4)
    least = {}
    for (d, t), c in zip(rows, sure_groups(rows)):
        own = (d is None, d or 0, d, t)
        least[c] = min(least.get(c, own), own, key=lambda x: x[:2])
    want = sorted(((d, t or "") for *_, d, t in least.values()), key=repr)
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=repr) == want
    assert any(d is None for d, _ in want) and sum(d == 7000 for d, _ in want) == 2


def test_pipeline_keeps_rows_without_an_id_of_their_own(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(80))
    rows = [(None, text(0)), (None, text(1)), (1, text(2)), (1, text(3)), (0, text(3)), (2, text(0) + " end"), (1, text(2))]
    df = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()), key=repr)
    assert got == sorted([(None, text(1)), (1, text(2)), (0, text(3)), (2, text(0) + " end")], key=repr)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_keep_columns_of_any_name_and_type(spark):
    rows = [(i % 3, "write to joe@example.com, " + f"word{i} " * 60, {"a": i}, "c", [1.5]) for i in range(6)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, _cands string, row array<double>")
    one = corpus_pipeline.near_duplicates(spark, df, "")
    assert one.columns == df.columns and one.count() == 6
    clean = corpus_pipeline.personal_data(spark, df, "").collect()
    assert len(clean) == 12 and all("<email>" in r.text and "joe@" not in r.text and r._cands == "c" and r.row == [1.5] and r.tags for r in clean)
