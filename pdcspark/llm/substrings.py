"""Substring dedup: word windows that repeat anywhere, found level by level.

A word is covered, and goes, if a window of ``window`` consecutive words around
it has its word sequence at another start too, in any document or the same one.
Counting every window would shuffle more than the texts, so the search goes by
levels, and only what is repeated at one length is extended to twice that length:

1. Windows of half the length, rounded up.  Starts are thinned without loss: of
   the half windows inside a whole one, the one of the least hash (the leftmost
   of equals) speaks for it.  Equal windows choose equal half windows, so a
   window whose half window has its hash nowhere else isn't repeated.  About a
   tenth of all starts are chosen, each for a run of neighbouring windows.
2. Repeated ones alone are extended to the run's whole text, up to twice as long
   and more.  If that is repeated, so are all windows in it: the run is settled.
3. Runs that aren't settled (edges of passages, places of small edits) are taken
   apart into their single windows, together with all runs of the same half
   window; windows that are repeated there are the rest.  No candidate is left.

Every level is a count by hash with partial sums and a join back to the runs,
which Spark splits where a passage is in many documents.  Hashes of any length
are made from those of the powers of two, by doubling.  A text is known by its
64-bit hash and its length, so equal texts share one answer.

Only documents that may hold candidates are moved beside them: a bitmap of a
fixed size, of the hashes that take part, is sent to the tasks.  Its size doesn't
grow with the data; where it fills up, more rows pass it to the exact join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdcspark.llm.common import cut, release

SEED = 7
#: Words that a worker hashes at a time (whole texts; at least one), and word hashes it keeps.
BLOCK_WORDS, CACHED = 1 << 18, 1 << 18
#: Places of the bitmaps: 8 MB each.
BITMAP = 1 << 26
_BUCKET_BYTES = 4096

_U = np.uint64


class _WordHashes(dict):
    """Hashes of words; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def _joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """One hash from two, in order."""
    x = a * _U(0x9E3779B97F4A7C15) + (b ^ (b >> _U(29)))
    x += _U(salt * 0xD6E8FEB86659FD93 % (1 << 64))
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(32)
    return x


class Ladder:
    """Hashes of windows over a row of word hashes: of the powers of two by doubling, of others by overlap."""

    def __init__(self, words: np.ndarray):
        self.of = {1: words}

    def _power(self, n: int) -> np.ndarray:
        if n not in self.of:
            half = self._power(n // 2)
            self.of[n] = _joined(half[: max(0, len(half) - n // 2)], half[n // 2 :], n)
        return self.of[n]

    def windows(self, n: int) -> np.ndarray:
        """The hash of the ``n`` words from each start."""
        p = 1 << (n.bit_length() - 1)
        whole = self._power(p)
        if p == n:
            return whole
        return _joined(whole[: max(0, len(whole) - (n - p))], whole[n - p :], n)

    def spans(self, starts: np.ndarray, lengths: np.ndarray, least: int) -> np.ndarray:
        """The hashes of single spans of ``least`` to ``2 * least`` words, from four overlapping pieces each."""
        p = 1 << (least.bit_length() - 1)
        whole, out = self._power(p), lengths.astype(np.uint64)
        for k in range(4):
            out = _joined(out, whole[starts + (lengths - p) * k // 3], k)
        return out


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its least; the leftmost of equals."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    best, at, n = values, np.arange(len(values)), 1

    def joined(shift: int):
        right = best[shift:] < best[: len(best) - shift]
        return np.where(right, best[shift:], best[: len(best) - shift]), np.where(right, at[shift:], at[: len(at) - shift])

    while 2 * n <= width:
        best, at = joined(n)
        n *= 2
    return joined(width - n)[1] if n < width else at


def _starts(n_words: np.ndarray, window: int) -> np.ndarray:
    """The places, in texts laid end to end, where a whole window of one text starts."""
    ends = np.repeat(n_words.cumsum(), n_words)
    place = np.arange(len(ends))
    return place[place + window <= ends]


def runs(words: np.ndarray, n_words: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """The runs of windows of texts laid end to end: text, start, count, half, whole.

    ``half`` is the hash of the half window that speaks for the windows at
    ``start``, ... ``start + count - 1``, and ``whole`` that of the words they cover.
    """
    ladder, half = Ladder(words), (window + 1) // 2
    starts = _starts(n_words, window)
    if not len(starts):
        return {"text": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "count": np.zeros(0, np.int64), "half": np.zeros(0, np.uint64), "whole": np.zeros(0, np.uint64)}
    halves = ladder.windows(half)
    speaks = _least_places(halves, window - half + 1)[starts]
    first = np.flatnonzero(np.diff(speaks, prepend=-1))
    count = np.diff(first, append=len(starts))
    start = starts[first]
    text = np.searchsorted(n_words.cumsum(), start, side="right")
    whole = ladder.spans(start, count + window - 1, window)
    return {"text": text, "start": start - (n_words.cumsum() - n_words)[text], "count": count, "half": halves[speaks[first]], "whole": whole}


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Consecutive texts as words, about ``BLOCK_WORDS`` at a time, with the place of the first."""
    first, held, total = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.split())  # of bytes: at the six ASCII blanks
        total += len(held[-1])
        if total >= BLOCK_WORDS or i + 1 == len(texts):
            yield first, held
            first, held, total = i + 1, [], 0


def _hashes(texts: list[list[bytes]], known: _WordHashes) -> tuple[np.ndarray, np.ndarray]:
    n_words = np.fromiter(map(len, texts), np.int64, len(texts))
    each = map(known.__getitem__, chain.from_iterable(texts))
    return np.fromiter(each, np.uint64, int(n_words.sum())), n_words


# --------------------------------------------------------------------- Spark


def _text_key(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    """(key, size, text, ...): the hash of a text, its length and its bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("key"), F.octet_length(text).alias("size"), text.cast("binary").alias("text"), *more)


def _all_runs(docs: DataFrame, window: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            keys, sizes = (batch.column(k).to_numpy() for k in (0, 1))
            for first, texts in _blocks(batch.column(2).to_pylist()):
                found = runs(*_hashes(texts, known), window)
                at = first + found["text"]
                columns = [keys[at], sizes[at], found["start"].astype(np.int32), found["count"].astype(np.int32), found["half"].view(np.int64), found["whole"].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "size", "start", "count", "half", "whole"])

    return docs.mapInArrow(find, "key long, size int, start int, count int, half long, whole long")


def _place(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITMAP))


def _listed(rows: DataFrame, column: str):
    """A test whether a value is likely one of a column's: never wrong for those that are."""
    place = _place(F.col(column)) + 1
    bitmaps = rows.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros(BITMAP // 8, np.uint8)
    for bucket, part in zip(*(c.to_pylist() for c in bitmaps.toArrow().columns), strict=True):  # 2,048 rows of 4 KB at most
        bits[(bucket - 1) * _BUCKET_BYTES : bucket * _BUCKET_BYTES] = np.frombuffer(part, np.uint8)

    @F.pandas_udf("boolean")
    def test(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return lambda value: test(_place(value))


def _repeated(rows: DataFrame, *columns: str, times: Column | None = None) -> DataFrame:
    """The values that are there more than once.

    They are written before anything is joined with them: beside an aggregate
    Spark doesn't split a hot key's rows, beside a plain exchange it does.
    """
    counted = rows.groupBy(*columns).agg(F.sum(F.lit(1) if times is None else times).alias("n"))
    return cut(counted.where("n > 1").drop("n"), "repeated")


def _single_windows(docs: DataFrame, listed: DataFrame, window: int) -> DataFrame:
    """(key, size, start, half, hash, copies) of every window of the listed runs, once for each text that has it.

    Equal texts are brought together before they are moved, so a group of
    copies of any size is one row here.
    """
    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            keys, sizes = (batch.column(k).to_numpy() for k in (0, 1))
            copies = batch.column(3).to_numpy()
            for first, texts in _blocks(batch.column(2).to_pylist()):
                words, n_words = _hashes(texts, known)
                hashes = Ladder(words).windows(window)
                begin = n_words.cumsum() - n_words
                lists = batch.column(4).slice(first, len(texts))
                text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
                start, count, half = (c.to_numpy().astype(np.int64) for c in lists.flatten().flatten())
                # A run of a text with the same hash and length as another's is only taken as far as it fits.
                count = np.maximum(np.minimum(count, n_words[text] - window + 1 - start), 0)
                text, start, half = (np.repeat(c, count) for c in (text, start, half))
                start = start + np.arange(len(start)) - np.repeat(count.cumsum() - count, count)
                found = hashes[begin[text] + start].view(np.int64)
                columns = [keys[first + text], sizes[first + text], start.astype(np.int32), half, found, copies[first + text]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "size", "start", "half", "hash", "copies"])

    texts = docs.where(_listed(listed, "key")(F.col("key"))).groupBy("key", "size").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    beside = texts.join(listed, ["key", "size"]).select("key", "size", "text", "copies", "runs")
    return beside.mapInArrow(take_apart, "key long, size int, start int, half long, hash long, copies long")


def repeated_windows(docs: DataFrame, text_col: str = "text", window: int = 35) -> DataFrame:
    """(key, size, runs): per distinct text with repeated windows, the starts of all of them.

    ``runs`` is an array of (start, count): windows start at the words
    ``start``, ... ``start + count - 1``, counted from 0.  ``key`` is the text's
    64-bit hash and ``size`` its length in bytes.  Texts without a repeated
    window have no row; edge cases as in ``without_repeats``.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    docs = _text_key(docs, text_col)
    every = cut(_all_runs(docs, window), "runs")
    halves = _repeated(every, "half")
    again = cut(every.where(_listed(halves, "half")(F.col("half"))).join(halves, "half"), "candidates")
    release(every)
    settled = _repeated(again, "half", "whole").withColumn("settled", F.lit(True))
    again = cut(again.join(settled, ["half", "whole"], "left"), "settled")
    open_halves = cut(again.where("settled is null").select("half").distinct(), "open")
    apart = again.join(open_halves, "half").groupBy("key", "size").agg(F.collect_set(F.struct("start", "count", "half")).alias("runs"))
    singles = cut(_single_windows(docs, cut(apart, "apart"), window), "windows")
    more = singles.join(_repeated(singles, "half", "hash", times=F.col("copies")), ["half", "hash"]).select("key", "size", "start", F.lit(1).alias("count"))
    found = again.where("settled").select("key", "size", "start", "count").unionByName(more)
    return cut(found.groupBy("key", "size").agg(F.collect_set(F.struct("start", "count")).alias("runs")), "repeated")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """One row per input row: (id_col, n_words, n_removed, kept).

    Words are runs of anything but the six ASCII blanks, unchanged.  Every word
    is removed that a window covers whose word sequence starts at another place
    of the table too; windows are judged on the input.  ``kept`` is what stays,
    joined by single blanks.  Nothing is left of a copy of another document of
    ``window`` words or more.  A null text has no words, like an empty one; a
    text shorter than a window stays.  Repeated rows are copies of each other,
    null ids stay, other columns are not read, and an empty table gives an
    empty result.  Texts of any length are taken whole.
    """
    found = repeated_windows(docs, text_col, window)
    likely = _listed(found, "key")
    rows = _text_key(docs, text_col, F.col(id_col).alias("id"))
    kind = "array<struct<start:int,count:int>>"
    clean = rows.where(~likely(F.col("key"))).select("id", "text", F.lit(None).cast(kind).alias("runs"))
    dirty = rows.where(likely(F.col("key"))).join(found, ["key", "size"], "left").select("id", "text", F.col("runs").cast(kind).alias("runs"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, repeated in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                if repeated:
                    steps = np.zeros(len(words) + 1, np.int64)
                    for r in repeated:
                        steps[r["start"]] += 1
                        steps[min(r["start"] + r["count"] + window - 1, len(words))] -= 1
                    words = [w for w, covered in zip(words, steps.cumsum().tolist(), strict=False) if not covered]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept binary"
    done = clean.unionByName(dirty).mapInArrow(remove, schema)
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
