"""The conversation prefix trie against a trie of nested dictionaries."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from barweave.llm import prefix_trie
from barweave.llm.prefix_trie import TrieConfig
from barweave.llm.slots import SlotTable

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, p1 double, words string, chunk long, place int"
REST = (7, "k", 0.5, "w", 3, 1)


def conversations(rows, graft):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, v in own.items()}
    if not graft:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows, graft):
    members, ends = {}, {}
    for c, turns in conversations(rows, graft).items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    below = {n: [m for m in members if m[: len(n)] == n] for n in members}
    kids = {n: sum(len(m) == len(n) + 1 for m in below[n]) for n in members}
    words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
    out = []
    for n, who in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()
        saved = sum((len(members[m]) - 1) * words(m) for m in below[n])
        out.append((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), kids[n], sum(not kids[m] for m in below[n]), saved, digest))
    return sorted(out, key=str)


def sample(seed=5, convs=90):
    rng = random.Random(seed)
    texts = ["", None, "a", "b c", "d e f\tg", "ab", "x " * 40]
    rows = []
    for c in [*range(convs), -20, -7, 131072 + 20, 131072 + 31, 9_000_000_001]:
        turns = list(range(rng.randint(1, 6)))
        rows += [(c, t if rng.random() < 0.95 else None, rng.choice(["user", None, ""]), rng.choice(texts[: rng.randint(1, 7)])) for t in turns]
    rows += [(3, 1, "user", "again")] * 3 + [(4, 0, "b", "t"), (4, 0, "a", "t"), (None, 0, "user", "lost"), (None, None, None, None)]
    # long, equal conversations and one that ends inside them
    rows += [(c, t, "user", f"turn {t} of many") for c in (200, 201, 218) for t in range(40)] + [(219, t, "user", f"turn {t} of many") for t in range(17)]
    return rows


@pytest.mark.parametrize("config", [TrieConfig(), TrieConfig(chunk=3, shard_rows=40)])
@pytest.mark.parametrize("graft", [True, False])
def test_trie_equals_nested_prefixes(spark, config, graft):
    rows = sample()
    df = spark.createDataFrame([r + REST for r in rows], SCHEMA).repartition(5)
    got = (prefix_trie.build_grafted if graft else prefix_trie.build)(df, config)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, graft)


def test_hot_conversations_and_empty_tables(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(400) for t in range(3)] + [(1000, t, "user", f"long {t % 3}") for t in range(900)]
    df = spark.createDataFrame([r + REST for r in rows], SCHEMA).repartition(6)
    assert sorted(map(tuple, prefix_trie.build(df, TrieConfig(chunk=64, shard_rows=200)).collect()), key=str) == brute_path(rows)
    assert prefix_trie.build_grafted(df.limit(0)).count() == 0
    assert prefix_trie.build_grafted(df.where("conv_id is null")).count() == 0


def brute_path(rows):
    """As brute(), where the subtree of a node is known: 400 equal paths, and one long path of its own."""
    empty = hashlib.sha256(b"").hexdigest()
    all_ids = hashlib.sha256(",".join(map(str, range(400))).encode()).hexdigest()
    out = [(0, 0, None, 401, 2, 2, 3 * 399 * 2, empty)]
    out += [(0, d, 0, 400, int(d < 3), 1, (4 - d) * 399 * 2, empty if d < 3 else all_ids) for d in (1, 2, 3)]
    alone = hashlib.sha256(b"1000").hexdigest()
    out += [(1000, d, 1000 if d > 1 else 0, 1, int(d < 900), 1, 0, empty if d < 900 else alone) for d in range(1, 901)]
    return sorted(out, key=str)


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20000):
        keys = np.unique(rng.integers(0, 1 << 63, (n, 3), dtype=np.uint64), axis=0)
        table = SlotTable(keys)
        slots = table.slots(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))
        assert (table.keys[slots] == keys).all()
        assert (table.slots(keys + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        SlotTable(np.zeros((2, 3), np.uint64))
