"""Token counts of every prefix of a text, by dynamic programming over its positions.

The vocabulary is a sentencepiece BPE model with byte fallback, a dummy prefix
and no normalisation.  For each prefix the program stores the last token of its
encoding: of the pieces that end there, the one which stands beside the last
token of the prefix in front of it exactly as the merges would leave the two.
The prefix then has one token more than the one in front.  Whole texts, truncations and budgets are
answered from the stored counts without encoding anything again.

No piece holds a blank after another character, so a text falls into chunks (a
run of blanks and the word after it) that are encoded alone.  The program runs
once for the distinct chunks of a batch, in order, so that chunks with a common
beginning share its prefixes; the counts are kept in a bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdcspark.llm.common import Recent

BLANK = "▁"
#: Distinct chunks whose counts a worker keeps; their longest length, so that a count fits a byte.
CACHED, CACHED_CHARS = 500_000, 60
#: Code points of the texts that a worker holds at a time.
BATCH_CHARS = 1 << 21
_CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def _shared(chunks: list[str]) -> list[int]:
    """How many characters each chunk has in common with the beginning of the one before."""
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    if len(chunks) < 2:
        return [0] * len(chunks)
    width = int(lengths.max()) + 1  # the last column is empty in all; where no other differs the answer is 0, which is safe
    codes = np.array(chunks, f"U{width}").view(np.uint32).reshape(len(chunks), width)
    differ = (codes[1:] != codes[:-1]).argmax(axis=1)
    return [0, *np.minimum(differ, lengths[:-1]).tolist()]


class PrefixCounter:
    """Token counts of all prefixes of texts, for the pieces of one model."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.score = dict(pieces)
        # A trie of the pieces: a node's number and a character lead to the next node; ``piece`` has a node's piece.
        self.next: dict[int, int] = {}
        self.piece: list[str | None] = [None]
        for p in self.score:
            node = 0
            for char in p:
                step = node << 21 | ord(char)
                node = self.next.setdefault(step, len(self.piece))
                if node == len(self.piece):
                    self.piece.append(None)
            self.piece[node] = p
        self.is_piece = [p is not None for p in self.piece]
        #: Whether the piece of one node stands beside that of another.
        self.beside: dict[int, bool] = {}
        self.chunks = Recent(CACHED)

    @classmethod
    def of_model(cls, model: bytes) -> PrefixCounter:
        from sentencepiece import sentencepiece_model_pb2 as sp

        proto = sp.ModelProto()
        proto.ParseFromString(model)
        trainer, normalizer = proto.trainer_spec, proto.normalizer_spec
        plain = not normalizer.precompiled_charsmap and normalizer.add_dummy_prefix and not normalizer.remove_extra_whitespaces
        if trainer.model_type != sp.TrainerSpec.BPE or not trainer.byte_fallback or not plain:
            raise ValueError("a BPE model with byte fallback, a dummy prefix and no normalisation is needed")
        pieces = [(p.piece, p.score) for p in proto.pieces if p.type == sp.ModelProto.SentencePiece.NORMAL]
        if any(BLANK in p.lstrip(BLANK) for p, _ in pieces):
            raise ValueError("a piece goes on beyond a blank")
        return cls(pieces)

    def _merged(self, text: str) -> list[str]:
        """The merges carried out one by one, best score and then leftmost first."""
        score, none = self.score.get, float("-inf")
        parts = list(text)
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def _stands(self, pair: int) -> bool:
        before, piece = self.piece[pair >> 24] or "", self.piece[pair & 0xFFFFFF]
        if len(self.beside) > 1 << 19:
            self.beside.clear()
        known = self.beside[pair] = self._merged(before + piece) == [x for x in (before, piece) if x]
        return known

    def _extend(self, chunk: str, last: list[int], counts: list[int], open_: list[list[tuple[int, int]]]) -> None:
        """Fill in, for each further prefix of a chunk, its last token, its count and its open starts.

        A token is its node; 0 stands for none.  A start is open at an end if
        what is between them begins a piece, so every end only looks at starts
        from which a piece may still come.
        """
        step, is_piece, beside = self.next.get, self.is_piece, self.beside.get
        for end in range(len(last), len(chunk) + 1):
            code, going, token = ord(chunk[end - 1]), [], 0
            for start, node in (*open_[end - 1], (end - 1, 0)):
                node = step(node << 21 | code)
                if node is not None:
                    going.append((start, node))
                    if not token and is_piece[node]:
                        pair = last[start] << 24 | node
                        fits = beside(pair)
                        if fits or (fits is None and self._stands(pair)):
                            token = node
                            counts.append(counts[start] + 1)
            if not token:  # no piece: its bytes, beside which anything can stand
                counts.append(counts[-1] + len(chunk[end - 1].encode()))
            last.append(token)
            open_.append(going)

    def learn(self, chunks: set[str]) -> None:
        """Store the counts of chunks; in order, each goes on from what it shares with the one before."""
        known, ordered = self.chunks.young, sorted(chunks)
        last, counts, open_ = [0], [0], [[]]
        for chunk, same in zip(ordered, _shared(ordered), strict=True):
            del last[same + 1 :], counts[same + 1 :], open_[same + 1 :]
            self._extend(chunk, last, counts, open_)
            known[chunk] = bytes(counts[1:])

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text, the token count of its first 0, 1, ... code points."""
        chunked = [_CHUNK.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        needed = {c for c in set().union(*chunked) if len(c) <= CACHED_CHARS}
        self.learn(self.chunks.missing(needed))
        return [self._joined(chunks) for chunks in chunked]

    def _joined(self, chunks: list[str]) -> np.ndarray:
        if not chunks:
            return np.zeros(1, np.int32)
        parts: list = list(map(self.chunks.young.get, chunks))
        if None in parts:  # chunks too long to keep
            for i in (i for i, part in enumerate(parts) if part is None):
                counts = [0]
                self._extend(chunks[i], [0], counts, [[]])
                parts[i] = np.array(counts[1:], np.int32)
            joined = np.concatenate([np.frombuffer(p, np.uint8) if isinstance(p, bytes) else p for p in parts]).astype(np.int32)
        else:
            joined = np.frombuffer(b"".join(parts), np.uint8).astype(np.int32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        before = np.zeros(len(parts), np.int32)
        np.cumsum(joined[lengths.cumsum()[:-1] - 1], out=before[1:])
        joined += np.repeat(before, lengths)
        joined[0] = 0  # the dummy prefix alone is the empty text
        return joined


@lru_cache(1)
def _counter(model: bytes) -> PrefixCounter:
    return PrefixCounter.of_model(model)


def prefix_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_bytes, counts).

    ``counts[k]`` is the exact number of tokens of the text's first ``k`` code
    points; its last entry is that of the whole text.  A null text is empty and
    has the one count 0; strings of special tokens inside texts are ordinary
    characters.  The model's file is read on the driver and sent with the
    tasks (under 1 MB).  Repeated rows and null ids stay; other columns are not
    read.  A worker holds one text's counts and ``BATCH_CHARS`` more at a time.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in batches:
            size, first, held = 0, 0, []
            for i, text in enumerate(batch.column(1).to_pylist()):
                held.append(text)
                size += len(text or "")
                if size >= BATCH_CHARS or i + 1 == batch.num_rows:
                    counts = counter.texts(held)
                    ends = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(counts)))
                    ids, n_bytes = (batch.column(k).slice(first, len(held)) for k in (0, 2))
                    yield pa.RecordBatch.from_arrays([ids, n_bytes, lists], ["id", "n_bytes", "counts"])
                    size, first, held = 0, i + 1, []

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, counts array<int>")


def n_tokens(counts: Column) -> Column:
    return F.element_at(counts, -1).cast("long")


def tokens_of_prefix(counts: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` code points; of the whole text where it is shorter."""
    return F.element_at(counts, F.least(chars + 1, F.size(counts)).cast("int")).cast("long")


def fits(counts: Column, budget: int) -> Column:
    """The most leading code points that encode to at most ``budget`` tokens."""
    last = F.size(counts) - 1
    within = F.filter(F.sequence(F.lit(0), last), lambda k: F.get(counts, k) <= budget)
    return F.when(F.get(counts, last) <= budget, last).otherwise(F.array_max(within)).cast("long")


def budgeted(counted: DataFrame, limit: int, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fitting_chars) from the stored counts."""
    counts = F.col("counts")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", n_tokens(counts).alias("n_tokens"),
        (n_tokens(counts) > limit).alias("over_limit"), fits(counts, limit).alias("fitting_chars"),
    )
