"""Prefix trie of conversations as a node table of minimal perfect hash slots.

A node is a distinct sequence of first turns.  Its digest is position-keyed: the
lanes of turn ``i`` are 128 bits of a hash of ``i``, role and text, and the
digest of a prefix is their lane-wise sum, so prefixes of one conversation are
running sums and a conversation of any length is cut into chunks.  The distinct
digests are enumerated by one combining aggregate, which also checks that no two
contents share a digest.  Subtree totals are then gathered shard by shard: a
shard holds the paths of some conversations, gives its digests verified slots,
scatters the weights of the nodes it owns into flat arrays and adds each slot to
its parent's, deepest first.  A node is owned by its smallest member, whose path
holds all its ancestors, so the sums of all shards add up to the whole.

What becomes of odd rows:

* Rows without ``conv_id`` belong to no conversation and make no node.
* A null role or text is the empty string; a null turn comes first.
* Rows of one conversation with equal turns are ordered by role, then text;
  repeated rows are turns of their own.
* A table without conversations has no nodes, not even a root.
* Columns other than the four are left behind, whatever their names.
* Texts of any length are hashed and counted whole.  The paths of one
  conversation are cut into chunks of ``TrieConfig.chunk`` depths.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import arrow_type, settled
from .slots import SlotTable

WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "k1", "k2"]
PARENT = ["p1", "p2"]
SUMS = "depth long, k1 long, k2 long, saved long, leaves long, children long"
LANES = ["s0", "s1", "s2", "s3"]
LOW = (1 << 32) - 1


@dataclass(frozen=True)
class TrieConfig:
    #: Depths of one conversation that a shard holds.
    chunk: int = 8192
    #: Path rows of a shard, about.
    shard_rows: int = 100_000


def number_turns(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns in their order, without a task that holds a whole conversation.

    Returns ``(turns, pieces)``: turns have ``conv_id, part, seq, content, words``;
    pieces, one for each conversation and range partition that has rows of it, say
    that the position of a turn is ``seq - first + before`` of ``len``.
    """
    rows = df.select(
        F.col("`conv_id`").cast("long").alias("conv_id"),
        F.col("`turn`").alias("turn"),
        F.coalesce(F.col("`role`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("`text`").cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("place"),  # parts equal rows, which have no order of their own
    ).where("conv_id IS NOT NULL")
    order = ["conv_id", "turn", "role", "text", "place"]
    turns = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    content = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    turns = turns.select(
        "conv_id",
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("seq"),
        content.alias("content"),
        F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long").alias("words"),
    )
    turns = settled(turns, "turns")
    pieces = turns.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv_id")
    pieces = pieces.select("conv_id", "part", "first", (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(own).alias("len"))
    return turns, settled(pieces, "pieces")


def plain_paths(turns: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, pos, content, words, len)`` of every turn, and ``(conv_id, len)`` of every conversation."""
    placed = turns.join(pieces, ["conv_id", "part"]).select("conv_id", (F.col("seq") - F.col("first") + F.col("before")).alias("pos"), "content", "words", "len")
    return placed, pieces.where("before = 0").select("conv_id", "len")


def grafted_paths(turns: DataFrame, pieces: DataFrame, base: Column, take: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """As :func:`plain_paths`, with the first turns of each conversation replaced.

    Of conversation ``base`` the first ``take`` turns (all it has, if fewer) come first, then the own turns after
    the first ``take``.  ``base`` and ``take`` are columns over ``conv_id``; ``take`` is at most ``most``.
    """
    placed, convs = plain_paths(turns, pieces)
    plan = convs.select("conv_id", "len", base.alias("base"), take.cast("long").alias("take"))
    heads = convs.select(F.col("conv_id").alias("base"), F.col("len").alias("has"))
    plan = plan.join(heads, "base", "left").withColumn("given", F.least("take", F.coalesce("has", F.lit(0))))
    plan = settled(plan.select("conv_id", "base", "take", "given", (F.col("given") + F.greatest(F.col("len") - F.col("take"), F.lit(0))).alias("len")), "grafts")
    own = pieces.drop("len").join(plan.drop("base"), "conv_id")
    own = turns.join(own, ["conv_id", "part"]).withColumn("pos", F.col("seq") - F.col("first") + F.col("before")).where("pos >= take")
    own = own.select("conv_id", (F.col("pos") - F.col("take") + F.col("given")).alias("pos"), "content", "words", "len")
    # only the first turns of conversations that others start with
    starts = placed.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "content", "words")
    given = plan.where("given > 0").join(starts, "base").where("pos < given").select("conv_id", "pos", "content", "words", "len")
    return own.unionByName(given), plan.select("conv_id", "len")


def _key(a: Column, b: Column) -> Column:
    return F.shiftleft(a.bitwiseAND(F.lit(LOW)), 32).bitwiseOR(b.bitwiseAND(F.lit(LOW)))


def digested(rows: DataFrame, convs: DataFrame, config: TrieConfig) -> DataFrame:
    """One row for each conversation and depth: its digest, the parent's, and what the last turn holds."""
    x = [F.xxhash64(F.lit(k), "pos", "content") for k in (1, 2)]
    lanes = [f(v) for v in x for f in (lambda v: v.bitwiseAND(F.lit(LOW)), lambda v: F.shiftrightunsigned(v, 32))]
    rows = rows.withColumns(dict(zip(LANES, lanes))).withColumn("chunk", F.floor(F.col("pos") / config.chunk))
    running = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.withColumns({f"c{i}": F.sum(s).over(running) for i, s in enumerate(LANES)})
    by_chunk = Window.partitionBy("conv_id").orderBy("chunk")
    before = rows.groupBy("conv_id", "chunk").agg(*[F.sum(s).alias(s) for s in LANES])
    before = before.select("conv_id", "chunk", *[(F.sum(s).over(by_chunk) - F.col(s)).alias(f"b{i}") for i, s in enumerate(LANES)]).where("chunk > 0")
    sums = sums.join(before, ["conv_id", "chunk"], "left")
    total = [F.col(f"c{i}") + F.coalesce(f"b{i}", F.lit(0)) for i in range(4)]
    above = [t - F.col(s) for t, s in zip(total, LANES)]
    depth = F.col("pos") + 1
    paths = sums.select(
        "conv_id",
        depth.alias("depth"),
        _key(total[0], total[1]).alias("k1"),
        _key(total[2], total[3]).alias("k2"),
        _key(above[0], above[1]).alias("p1"),
        _key(above[2], above[3]).alias("p2"),
        "words",
        F.xxhash64("content").alias("content"),
        (depth == F.col("len")).alias("ends"),
    )
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in ("k1", "k2", "p1", "p2", "words", "content")], (F.col("len") == 0).alias("ends"))
    return settled(paths.unionByName(roots), "paths")


def nodes_of(paths: DataFrame) -> DataFrame:
    """The distinct digests with members, last words, and the proof that one digest is one content."""
    same = F.lit(True)
    for c in ("p1", "p2", "words", "content"):
        same = same & (F.min(c) == F.max(c))
    nodes = paths.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if("ends").alias("n_ends"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.min("words").alias("words"),
        F.when(same, True).otherwise(F.raise_error(F.lit("two prefixes share a digest"))).alias("checked"),
    )
    return settled(nodes.where("checked").drop("checked"), "nodes")


def _shard(table: pa.Table) -> pa.Table:
    """Slots, scattered weights and sums through the parents of one shard."""
    col = {c: table.column(c).to_numpy() for c in table.column_names}
    own = np.column_stack([col[c].view(np.uint64) for c in KEY])
    up = np.column_stack([(col["depth"] - 1).view(np.uint64), col["p1"].view(np.uint64), col["p2"].view(np.uint64)])
    distinct = SlotTable(np.unique(own, axis=0))
    at, parent_at = distinct.slots(own), distinct.slots(up)
    n = len(distinct.keys)
    parent = np.full(n, -1, np.int64)
    parent[at] = parent_at
    sums = {c: np.zeros(n, np.int64) for c in ("saved", "leaves", "children")}
    for c in ("saved", "leaves"):
        np.add.at(sums[c], at, col[c])
    inside = parent_at >= 0
    np.add.at(sums["children"], parent_at[inside], col["owned"][inside])
    depth = distinct.keys[:, 0].view(np.int64)
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        level = level[parent[level] >= 0]
        for c in ("saved", "leaves"):
            np.add.at(sums[c], parent[level], sums[c][level])
    outside = ~inside & (col["owned"] > 0) & (col["depth"] > 0)  # the parent lies in the chunk before
    keys = np.concatenate([distinct.keys, up[outside]]).view(np.int64)
    extra = np.zeros(int(outside.sum()), np.int64)
    values = [np.concatenate([sums["saved"], extra]), np.concatenate([sums["leaves"], extra]), np.concatenate([sums["children"], extra + 1])]
    return pa.Table.from_arrays([pa.array(np.ascontiguousarray(v)) for v in (*keys.T, *values)], schema=arrow_type(SUMS))


def subtree_sums(paths: DataFrame, nodes: DataFrame, config: TrieConfig) -> DataFrame:
    """``saved``, ``leaves`` and ``children`` of every node, added up over the shards."""
    owned = nodes.select(
        "conv_id",
        "depth",
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaves"),
        F.lit(1).cast("long").alias("owned"),
    )
    zero = F.lit(0).cast("long")
    member = paths.select("conv_id", *KEY, *PARENT).join(owned, ["conv_id", "depth"], "left")
    member = member.withColumns({c: F.coalesce(c, zero) for c in ("saved", "leaves", "owned")}).withColumn("chunk", F.floor(F.col("depth") / config.chunk))
    member = settled(member, "members")
    # what a path owns beyond a chunk counts for all of the chunk: it is given to the chunk's last depth
    later = Window.partitionBy("conv_id").orderBy(F.col("chunk").desc())
    carry = member.groupBy("conv_id", "chunk").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    carry = carry.select("conv_id", "chunk", *[(F.sum(c).over(later) - F.col(c)).alias(f"later_{c}") for c in ("saved", "leaves")])
    carry = carry.where("later_saved > 0 OR later_leaves > 0").select("conv_id", ((F.col("chunk") + 1) * config.chunk - 1).alias("depth"), "later_saved", "later_leaves")
    member = member.join(carry, ["conv_id", "depth"], "left")
    member = member.select(*KEY, *PARENT, *[(F.col(c) + F.coalesce(f"later_{c}", zero)).alias(c) for c in ("saved", "leaves")], "owned", "chunk", F.col("conv_id").alias("conv"))
    shards = max(1, paths.count() // config.shard_rows)
    member = member.withColumn("shard", F.pmod(F.xxhash64("conv"), F.lit(shards))).drop("conv")
    sums = member.groupBy("shard", "chunk").applyInArrow(_shard, SUMS)
    return sums.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("saved", "leaves", "children")])


def end_digests(paths: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node, ascending and comma-joined.

    Ids are joined by blocks of 65,536 first; a node's blocks then stream through one hash, as SHA-256 has no other way.
    """
    block = F.shiftright("conv_id", 16)
    ends = paths.where("ends").groupBy(*KEY, block.alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    schema = "depth long, k1 long, k2 long, ends_sha256 string"

    def work(batches):
        key, digest = None, None
        for batch in batches:
            out = []
            for *now, ids in zip(*[batch.column(c).to_pylist() for c in KEY], batch.column("ids").to_pylist()):
                if now != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _rows(out, schema)
        if key is not None:
            yield _rows([(*key, digest.hexdigest())], schema)

    return ends.repartition(*KEY).sortWithinPartitions(*KEY, "block").mapInArrow(work, schema)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = arrow_type(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)


def trie(rows: DataFrame, convs: DataFrame, config: TrieConfig = TrieConfig()) -> DataFrame:
    """The node table of placed turns (see :func:`plain_paths`)."""
    paths = digested(rows, convs, config)
    nodes = nodes_of(paths)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(subtree_sums(paths, nodes, config), KEY).join(end_digests(paths), KEY, "left")
    out = out.join(above, ["depth", *PARENT], "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def build(df: DataFrame, config: TrieConfig = TrieConfig()) -> DataFrame:
    """The prefix trie of a table of conversations as it stands (``conv_id, turn, role, text``)."""
    return trie(*plain_paths(*number_turns(df)), config)


def build_grafted(df: DataFrame, config: TrieConfig = TrieConfig()) -> DataFrame:
    """The trie after every conversation ``c`` was given the first ``crc32(c) % 4`` turns of conversation ``c - c % 20``."""
    conv = F.col("conv_id")
    take = F.crc32(conv.cast("string").cast("binary")) % 4
    return trie(*grafted_paths(*number_turns(df), conv - conv % 20, take, 3), config)


def build_grafted_sql() -> str:
    """The same rows by comparing whole prefixes, for a small table."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    return rf"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '') AS content,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, t.pos AS place, t.content, t.words FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, t.pos + 10, t.content, t.words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
listed AS (
  SELECT c.conv_id, list(sha256(r.content) ORDER BY r.place) FILTER (r.place IS NOT NULL) AS turns, list(r.words ORDER BY r.place) FILTER (r.place IS NOT NULL) AS words
  FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id),
paths AS (
  SELECT conv_id, d AS depth, coalesce(len(turns), 0) AS n, sha256(array_to_string(turns[1:d], ',')) || d AS node,
         CASE WHEN d > 0 THEN sha256(array_to_string(turns[1:d - 1], ',')) || (d - 1) END AS parent, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words
  FROM (SELECT *, unnest(range(coalesce(len(turns), 0) + 1)) AS d FROM (SELECT conv_id, coalesce(turns, []) AS turns, coalesce(words, []) AS words FROM listed))),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
  FROM paths GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
subtree AS (
  SELECT p.node, sum((u.n_convs - 1) * u.words) AS saved, count(*) FILTER (k.node IS NULL) AS leaves
  FROM nodes u JOIN paths p ON p.conv_id = u.conv_id AND p.depth <= u.depth LEFT JOIN children k ON k.node = u.node GROUP BY p.node)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN subtree s USING (node) LEFT JOIN children k USING (node) LEFT JOIN nodes up ON up.node = n.parent"""
