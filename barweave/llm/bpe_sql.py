"""Byte-level BPE as recursive DuckDB queries inside each partition.

Distinct split pieces of a batch become token-position rows.  A recursive
query joins neighbouring rows with the merge table and contracts each piece's
leftmost pair of least rank, until no pair of a piece is a token.  Decoding
joins id rows with the vocabulary and concatenates in order of position.
Byte strings travel as text, byte ``b`` as the character ``256 + b``, as DuckDB
concatenates and compares text.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import UnitCoder, arrow_type, id_text, steps
from .units import byte_level_units

#: Positions that one recursive query or one ordered aggregation holds.
QUERY_ROWS = 400_000

MERGES = """
CREATE TABLE merges AS
SELECT a.id AS l, b.id AS r, v.id::BIGINT AS new_id
FROM (SELECT id, tok, unnest(range(1, length(tok))) AS k FROM vocab) v
JOIN vocab a ON a.tok = left(v.tok, v.k) JOIN vocab b ON b.tok = substr(v.tok, v.k + 1)
"""
SAFE = """
CREATE OR REPLACE TABLE merges AS
SELECT *, new_id NOT IN (
  SELECT l FROM merges WHERE new_id < l UNION SELECT r FROM merges WHERE new_id < r
) AS safe FROM merges
"""

# A lower id is a lower rank, so rank, result and position of a pair are one number.
# Each turn looks at a piece once, in order: what a row is after the contraction, and what follows it.
ENCODE = """
WITH RECURSIVE step AS (
  SELECT word, pos, id, next_id, 0::SMALLINT AS turn FROM letters
  UNION ALL
  SELECT word, pos,
    CASE WHEN mine = best THEN (best >> 32)::INT ELSE id END,
    CASE WHEN mine = best THEN id_2 WHEN mine_1 = best THEN (best >> 32)::INT ELSE next_id END,
    (turn + 1)::SMALLINT
  FROM (
    SELECT word, pos, id, next_id, turn, mine, min(mine) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best,
      lag(mine) OVER w AS mine_before, lead(mine) OVER w AS mine_1, lead(id, 2) OVER w AS id_2
    FROM (
      SELECT s.*, (m.new_id << 32) | s.pos AS mine
      FROM step s LEFT JOIN merges m ON m.l = s.id AND m.r = s.next_id
    )
    WINDOW w AS (PARTITION BY word ORDER BY pos)
  )
  WHERE best IS NOT NULL AND mine_before IS DISTINCT FROM best
)
, turns AS MATERIALIZED (FROM step)
SELECT word, id FROM turns JOIN (SELECT word, max(turn) AS turn FROM turns GROUP BY word) USING (word, turn) ORDER BY word, pos
"""

# Pieces beyond LONG bytes: a turn contracts, from the left, every occurrence of the least pair if no pair with its
# result ranks lower (`safe`), which gives what single contractions give; a query stops after TURNS turns, so that
# what the recursion has gathered stays a small multiple of the piece, and the caller goes on from its last turn.
LONG, TURNS = 64, 12
ENCODE_LONG = """
WITH RECURSIVE step AS (
  SELECT word, pos, id, next_id, 0::SMALLINT AS turn FROM letters
  UNION ALL
  SELECT word, pos, CASE WHEN here THEN rank::INT ELSE id END,
    CASE WHEN here THEN CASE WHEN here_2 THEN best::INT ELSE id_2 END WHEN here_1 THEN best::INT ELSE next_id END, (turn + 1)::SMALLINT
  FROM (
    SELECT *, lag(here) OVER w AS here_before, lead(here) OVER w AS here_1, lead(here, 2) OVER w AS here_2, lead(id, 2) OVER w AS id_2
    FROM (
      SELECT *, CASE WHEN safe THEN hit AND (n - coalesce(max(CASE WHEN hit THEN NULL ELSE n END) OVER (PARTITION BY word ORDER BY pos), 0)) % 2 = 1
        ELSE mine = best_mine END AS here
      FROM (
        SELECT *, best_mine >> 32 AS best, coalesce(rank = best_mine >> 32, false) AS hit, row_number() OVER (PARTITION BY word ORDER BY pos) AS n
        FROM (
          SELECT *, min(mine) OVER (PARTITION BY word) AS best_mine
          FROM (
            SELECT s.*, m.new_id AS rank, m.safe, (m.new_id << 32) | s.pos AS mine
            FROM step s LEFT JOIN merges m ON m.l = s.id AND m.r = s.next_id
          )
        )
      )
    )
    WINDOW w AS (PARTITION BY word ORDER BY pos)
  )
  WHERE best IS NOT NULL AND here_before IS NOT TRUE AND turn < {turns}
)
SELECT word, pos, id, turn, lead(id) OVER (PARTITION BY word ORDER BY pos) AS next_id
FROM (SELECT word, pos, id, turn, max(turn) OVER (PARTITION BY word) AS last FROM step)
WHERE turn = last
"""

DECODE = """
SELECT piece, string_agg(tok, '' ORDER BY pos) AS bytes
FROM tokens JOIN vocab USING (id) GROUP BY piece ORDER BY piece
"""

_TO_TEXT = {b: 256 + b for b in range(256)}


class _Decimals(dict):
    def __missing__(self, number: int) -> str:
        self[number] = text = str(number)
        return text


def _as_text(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_TEXT)


class SqlBpe:
    """Encoder and decoder over one rank file, in an in-memory DuckDB of one thread that never spills."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        vocab = pa.table({"id": pa.array(ranks.values(), pa.int32()), "tok": [_as_text(t) for t in ranks]})
        self._load("vocab", vocab)
        self.db.execute(MERGES)
        self.db.execute(SAFE)

    def _load(self, name: str, table: pa.Table) -> None:
        self.db.register("incoming", table)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words behind each other, and how many each has; a word is contracted apart from the others."""
        raw = [w.encode() for w in words]
        # a piece that is a token is not contracted, as in the library
        whole = np.array([self.ranks.get(r, -1) for r in raw], np.int64)
        rest = np.flatnonzero(whole < 0)
        parts, counts = [], np.ones(len(raw), np.int64)
        start = rows = 0
        for i in range(len(rest) + 1):
            n = len(raw[rest[i]]) if i < len(rest) else 0
            # long pieces, each in a query of its own, stand apart
            if i == len(rest) or rows and (rows + n > QUERY_ROWS or n > LONG or len(raw[rest[i - 1]]) > LONG):
                if i > start:
                    ids, each = self._contract([raw[k] for k in rest[start:i]])
                    parts.append(ids)
                    counts[rest[start:i]] = each
                start, rows = i, 0
            rows += n
        flat = np.empty(int(counts.sum()), np.uint32)
        contracted = np.repeat(whole < 0, counts)
        flat[contracted] = np.concatenate(parts) if parts else []
        flat[~contracted] = whole[whole >= 0]
        return flat, counts

    def _contract(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(lengths)
        ids = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        last = np.zeros(len(ids), bool)
        last[ends - 1] = True
        word = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
        pos = (np.arange(len(ids)) - np.repeat(ends - lengths, lengths)).astype(np.int32)
        self._load("letters", pa.table({"word": word, "pos": pos, "id": ids, "next_id": pa.array(np.append(ids[1:], 0), mask=last)}))
        if len(raw[0]) <= LONG:
            got = self.db.sql(ENCODE).fetchnumpy()
            return got["id"].astype(np.uint32), np.bincount(got["word"], minlength=len(raw))
        while True:
            # a long piece is alone in its query
            self.db.execute("CREATE OR REPLACE TABLE reached AS " + ENCODE_LONG.format(turns=TURNS))
            got = self.db.sql("SELECT id, turn FROM reached ORDER BY pos").fetchnumpy()
            if got["turn"][0] < TURNS:
                return got["id"].astype(np.uint32), np.array([len(got["id"])])
            self.db.execute("CREATE OR REPLACE TABLE letters AS SELECT word, pos, id, next_id FROM reached")

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Bytes of each id run; runs lie behind each other in ``ids``."""
        # a long run is decoded in pieces, whose bytes join to those of the run
        n_parts = np.maximum(1, -(-lengths // QUERY_ROWS))
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        piece = np.repeat(np.cumsum(n_parts) - n_parts, lengths) + pos // QUERY_ROWS
        parts = [b""] * int(n_parts.sum())
        for s in range(0, len(ids), QUERY_ROWS):
            e = s + QUERY_ROWS
            self._load("tokens", pa.table({"piece": piece[s:e], "pos": pos[s:e], "id": ids[s:e].astype(np.int32)}))
            got = self.db.sql(DECODE).to_arrow_table()
            for k, text in zip(got.column("piece").to_pylist(), got.column("bytes").to_pylist()):
                # two loads may share the piece at their border
                parts[k] += text.encode("utf-16-le")[::2]
        first = np.cumsum(n_parts) - n_parts
        return [b"".join(parts[f : f + n]) for f, n in zip(first.tolist(), n_parts.tolist())]


@functools.cache
def _model(path: str, pattern: str) -> tuple[SqlBpe, UnitCoder]:
    """One model, and one bounded memo of units, for all tasks of a Python worker."""
    model = SqlBpe(path)
    return model, UnitCoder(_unit_encoder(model, pattern), limit=1_000_000)


def _unit_encoder(model: SqlBpe, pattern: str):
    """Split units by the pattern and encode their distinct words."""
    import regex

    cut = regex.compile(pattern).findall
    # whether the pattern keeps plain letters together, behind a space or not, is asked of itself
    whole = all(cut(x) == [x] for lead in ("", " ") for x in (lead + "word", lead + "Word", lead + "WORD", lead + "worD", lead + "wOrd", lead + "s"))

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # most units are ASCII letters behind a space, which need no search
        split = [[u] if whole and u.isascii() and u.lstrip(" ").isalpha() and u[1:].isalpha() else cut(u) for u in units]
        number: dict[str, int] = {}
        at = np.array([number.setdefault(w, len(number)) for x in split for w in x], np.int64)
        flat, counts = model.encode_words(list(number))
        first = np.cumsum(counts) - counts
        # words of a unit, and the units' bounds in words and in ids
        bounds = np.cumsum([0, *map(len, split)])
        sizes = counts[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(first[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, np.diff(ends[bounds])

    return encode


#: Decimal forms of ids, made once each.
_DECIMAL = _Decimals()
ENCODED = "doc_id long, n_tokens long, ids array<int>, decoded binary"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _run(df: DataFrame, ranks: str, pattern: str, schema: str, shape, id_col: str, text_col: str) -> DataFrame:
    def work(batches):
        model, coder = _model(ranks, pattern)
        for batch in steps(batches, "text"):
            ids, lengths = coder.encode([byte_level_units(t) for t in batch.column("text").to_pylist()])
            decoded = model.decode(ids, lengths)
            runs = np.split(ids, np.cumsum(lengths)[:-1])
            rows = [shape(d, r, b) for d, r, b in zip(batch.column("doc_id").to_pylist(), runs, decoded)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow_type(schema))

    return id_text(df, id_col, text_col).mapInArrow(work, schema)


def encode_decode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every whole text, without special tokens.

    Null and empty texts have no ids and decode to no bytes; repeated rows are
    kept.  No shuffle: partitions work alone.
    """

    def shape(doc, run, raw):
        return {"doc_id": doc, "n_tokens": len(run), "ids": run.astype(np.int32), "decoded": raw}

    return _run(df, ranks, pattern, ENCODED, shape, id_col, text_col)


def encode_decode_digest(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with SHA-256 digests of the ids (decimal, joined by a space) and of the decoded bytes."""

    def shape(doc, run, raw):
        joined = " ".join(map(_DECIMAL.__getitem__, run.tolist())).encode()
        return {
            "doc_id": doc,
            "n_tokens": len(run),
            "ids_sha256": hashlib.sha256(joined).hexdigest(),
            "decoded_sha256": hashlib.sha256(raw).hexdigest(),
        }

    return _run(df, ranks, pattern, DIGEST, shape, id_col, text_col)
