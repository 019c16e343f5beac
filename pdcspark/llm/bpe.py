"""Byte-level BPE: recursive DuckDB queries inside each Spark partition.

Encoding: the texts of a batch fall into pieces by the tokenizer's pattern; the
pieces that the worker doesn't know yet become one row for each byte, and a
recursive query joins neighbouring rows with the merge table and contracts each
piece's leftmost pair of least rank until no pair is left.  Decoding: the ids
of a batch join the vocabulary, and an ordered aggregation puts each text's
bytes together.

The ids of pieces are kept in a bounded cache.  The rows of a recursion grow
with the square of a piece's length; pieces of more than ``LONG`` bytes are
merged with a heap instead, by the same rule.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdcspark.llm.common import Recent

#: Bytes of a piece beyond which the heap merges it (a power of two, 32); pieces that a worker keeps.
LONG_BITS, CACHED = 5, 400_000
LONG = 1 << LONG_BITS
#: Code points of texts, or ids, that a worker holds at a time.
BATCH_CHARS = 1 << 21

#: Pieces of one recursion, and ids of one decoding query.
MOST_PIECES, MOST_IDS = 1 << 18, 1 << 20

#: A row is a token at place g % LONG of piece g // LONG.  Pieces without a pair come out once, as done.
MERGE = f"""
WITH RECURSIVE state(g, id, done) AS (
  SELECT g, id, false FROM bytes
  UNION ALL
  SELECT g, id, done FROM (
    WITH beside AS MATERIALIZED (
      SELECT g, id, lag(g) OVER (ORDER BY g) AS before, lead(g) OVER (ORDER BY g) AS after, lead(id) OVER (ORDER BY g) AS next
      FROM state WHERE NOT done
    ), best AS (
      SELECT g >> {LONG_BITS} AS piece, min((merged << {LONG_BITS}) | (g & {LONG - 1})) AS least
      FROM beside JOIN merges ON pair = (id::BIGINT << 16) | next WHERE after >> {LONG_BITS} = g >> {LONG_BITS} GROUP BY piece
    )
    SELECT g, CASE WHEN g & {LONG - 1} = least & {LONG - 1} THEN least >> {LONG_BITS} ELSE id END AS id, least IS NULL AS done
    FROM beside LEFT JOIN best ON piece = g >> {LONG_BITS}
    WHERE least IS NULL OR before IS NULL OR before <> (piece << {LONG_BITS}) | (least & {LONG - 1})
  )
)
SELECT g, id FROM state WHERE done ORDER BY g
"""

DECODE = """
SELECT i, unhex(array_to_string(list(hex ORDER BY place), '')) AS decoded FROM batch JOIN vocabulary USING (id) GROUP BY i ORDER BY i
"""


def _parsed(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return _parsed(f.read())


def _database() -> duckdb.DuckDBPyConnection:
    """A database in memory with one thread, which never writes to the worker's disk."""
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})


pack = struct.Struct("=i").pack


class Encoder:
    """Ids of texts under one table of ranks; keeps the pieces seen before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, Recent(CACHED)
        for own, spelt in ((r"[^\s", r"[^\p{White_Space}"), (r"\s", r"\p{White_Space}"), (r"\S", r"\P{White_Space}")):
            pattern = pattern.replace(own, spelt)
        self.pattern = regex.compile(pattern)
        splits = [(ranks[a] * 65536 + ranks[b], rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := token[:k]) in ranks and (b := token[k:]) in ranks]
        pairs = np.array(splits, np.int64).reshape(-1, 2)
        merges = pa.table({"pair": pairs[:, 0], "merged": pairs[:, 1]})  # noqa: F841  read by name below
        self.db = _database()
        self.db.execute("CREATE TABLE merges AS SELECT pair, merged::INTEGER AS merged FROM merges")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def _heap(self, piece: bytes) -> list[int]:
        """The merges of a long piece: least rank first, then leftmost."""
        tokens: list = [bytes([b]) for b in piece]
        after, before = [*range(1, len(piece)), None], [None, *range(len(piece) - 1)]
        pair = lambda i: self.ranks.get(tokens[i] + tokens[after[i]]) if after[i] is not None else None
        heap = [(rank, i) for i in range(len(piece)) if (rank := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if tokens[i] is None or pair(i) != rank:
                continue  # one of the two has been merged meanwhile
            j = after[i]
            tokens[i], tokens[j], after[i] = tokens[i] + tokens[j], None, after[j]
            if after[i] is not None:
                before[after[i]] = i
            for k in (before[i], i):
                if k is not None and (rank := pair(k)) is not None:
                    heapq.heappush(heap, (rank, k))
        return [self.ranks[t] for t in tokens if t is not None]

    def learn(self, pieces: set[str]) -> None:
        """Store the ids of pieces, packed as 32-bit numbers."""
        merge, raws, known = [], [], self.pieces.young
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                known[piece] = pack(whole)
            elif len(raw) > LONG:
                known[piece] = np.array(self._heap(raw), np.int32).tobytes()
            else:
                merge.append(piece)
                raws.append(raw)
        for first in range(0, len(merge), MOST_PIECES):
            self._merge(merge[first : first + MOST_PIECES], raws[first : first + MOST_PIECES])

    def _merge(self, pieces: list[str], raws: list[bytes]) -> None:
        lengths = np.fromiter(map(len, raws), np.int32, len(raws))
        first = np.repeat(lengths.cumsum(dtype=np.int32) - lengths, lengths)
        g = np.repeat(np.arange(len(raws), dtype=np.int32) * LONG, lengths) + np.arange(len(first), dtype=np.int32) - first
        ids = self.of_byte[np.frombuffer(b"".join(raws), np.uint8)]
        self.db.register("bytes", pa.table({"g": g, "id": ids}))
        merged = self.db.sql(MERGE).to_arrow_table()
        self.db.unregister("bytes")
        packed = merged.column("id").to_numpy().astype(np.int32).tobytes()
        ends = (4 * np.searchsorted(merged.column("g").to_numpy(), np.arange(1, len(raws) + 1, dtype=np.int32) * LONG)).tolist()
        self.pieces.young.update(zip(pieces, (packed[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.pattern.findall(t) if t else [] for t in texts]
        self.learn(self.pieces.missing(set().union(*split)))
        ids_of = self.pieces.young.__getitem__
        return [np.frombuffer(b"".join(map(ids_of, pieces)), np.int32) for pieces in split]


class Decoder:
    """Bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]})  # noqa: F841
        self.db = _database()
        self.db.execute("CREATE TABLE vocabulary AS SELECT id, hex FROM vocabulary")
        self.known = np.zeros(max(ranks.values(), default=-1) + 1, bool)
        self.known[list(ranks.values())] = True

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each array of ids, all of which must be in the vocabulary."""
        every = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
        if len(every) and (every.min() < 0 or every.max() >= len(self.known) or not self.known[every].all()):
            raise ValueError("an id is not in the vocabulary")
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), [len(a) for a in ids])
        parts: list[list[bytes]] = [[] for _ in ids]
        for first in range(0, len(every), MOST_IDS):
            of, some = owner[first : first + MOST_IDS], every[first : first + MOST_IDS]
            self.db.register("batch", pa.table({"i": of, "place": np.arange(len(some), dtype=np.int32), "id": some}))
            found = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("batch")
            for i, decoded in zip(found.column("i").to_pylist(), found.column("decoded").to_pylist(), strict=True):
                parts[i].append(decoded)
        return [b"".join(p) for p in parts]


@lru_cache(2)
def _tools(path_ranks: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    ranks = _parsed(path_ranks)
    return Encoder(ranks, pattern), Decoder(ranks)


def _batches(texts: list, size) -> Iterator[tuple[int, list]]:
    """Consecutive parts of about ``BATCH_CHARS``, each with the place of its first text."""
    first, held, total = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text)
        total += size(text)
        if total >= BATCH_CHARS or i + 1 == len(texts):
            yield first, held
            first, held, total = i + 1, [], 0


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, ids array<int>, decoded binary), the bytes decoded from the ids.

    A null text is empty: no ids, no bytes.  Strings of special tokens are
    ordinary text.  Repeated rows and null ids stay, and an empty table gives
    an empty result; other columns are not read.  The rank file (under 1 MB) is
    read on the driver and sent with the tasks.  A worker holds one text and
    ``BATCH_CHARS`` more, and keeps the ids of ``CACHED`` pieces.
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read()

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _tools(ranks, pattern)
        for batch in batches:
            for first, texts in _batches(batch.column(1).to_pylist(), lambda t: len(t or "")):
                ids = encoder.encode(texts)
                decoded = pa.array(decoder.decode(ids), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), _lists(ids), decoded], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(both, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded binary")


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) per row; edge cases as in ``round_trip``."""
    with open(ranks_path, "rb") as f:
        ranks = f.read()

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _tools(ranks, pattern)
        for batch in batches:
            for first, texts in _batches(batch.column(1).to_pylist(), lambda t: len(t or "")):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), _lists(encoder.encode(texts))], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(ids, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(id, ids) -> (id, decoded binary).  Null ids are none; an id out of the vocabulary is an error."""
    with open(ranks_path, "rb") as f:
        ranks = f.read()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _tools(ranks, pattern)
        for batch in batches:
            lists = [np.array(x if x is not None else [], np.int32) for x in batch.column(1).to_pylist()]
            for first, ids in _batches(lists, len):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ids)), pa.array(decoder.decode(ids), pa.binary())], ["id", "decoded"])

    rows = encoded.select("id", F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(texts, f"id {rows.schema['id'].dataType.simpleString()}, decoded binary")


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of ``round_trip``'s rows."""
    return coded.select(
        F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
