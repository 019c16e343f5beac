"""Filter interaction audit: what each filter removes at each place of every order.

Every part keeps, for each filter, the sorted posting list of the documents that
fail it.  What a filter removes after others is its list without theirs, and
what a set of filters removes is the union of their lists.  Both are computed by
galloping k-way merges: a cursor runs in each list, doubles its step until it is
past the id it looks for and halves back, so long runs cost a logarithm.

The lists are kept over id ranges: a task takes its rows in blocks, sorts each by
part and id, and an entry is the row's place there (so rows without an id and
rows that repeat one have places of their own).  Sizes of ranges add up, so a
part of any size is spread over all tasks, Spark sums ``(F / 2 + 1) * 2 ** F`` sizes
for each part, and the ``F!`` orders are read from those sums.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdcspark.llm.common import cut

#: Documents of an id range: a task holds one range's lists at a time.
RANGE_ROWS = 1 << 16
#: More filters would have too many orders to list.
MOST_FILTERS = 6

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 2
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


# ------------------------------------------------------------ posting lists


def gallop(ids: list[int], least: int, at: int) -> int:
    """The first place from ``at`` on whose id is ``least`` or more."""
    step, end = 1, len(ids)
    while at < end and ids[at] < least:
        far = at + step
        if far >= end or ids[far] >= least:
            return bisect_left(ids, least, at + 1, min(far, end))
        at, step = far, 2 * step
    return at


def without(ids: list[int], others: list[list[int]]) -> list[int]:
    """The difference: the ids that are in none of the others."""
    out: list[int] = []
    cursors, at = [0] * len(others), 0
    while at < len(ids):
        nearest = None
        for k, other in enumerate(others):
            cursors[k] = place = gallop(other, ids[at], cursors[k])
            if place < len(other) and (nearest is None or other[place] < nearest):
                nearest = other[place]
        if nearest is None:
            out += ids[at:]
            break
        if nearest == ids[at]:
            at += 1
        else:
            upto = gallop(ids, nearest, at)
            out += ids[at:upto]
            at = upto
    return out


def union(lists: list[list[int]]) -> list[int]:
    """All ids of the lists, once each."""
    out: list[int] = []
    cursors = [0] * len(lists)
    while True:
        heads = sorted((ids[at], k) for k, (ids, at) in enumerate(zip(lists, cursors, strict=True)) if at < len(ids))
        if not heads:
            return out
        first, k = heads[0]
        upto = len(lists[k]) if len(heads) == 1 else max(cursors[k] + 1, gallop(lists[k], heads[1][0], cursors[k]))
        out += lists[k][cursors[k] : upto]
        cursors[k] = upto
        for head, j in heads[1:]:
            cursors[j] += head == first


def _sizes(fails: np.ndarray, flags: np.ndarray, filters: int, n_flags: int) -> list[tuple[int, ...]]:
    """(filter, before, size, flagged sizes) of one part's rows of a range; sizes of 0 are left out.

    ``before`` has a bit for each filter applied earlier; the size is that of
    the filter's list without theirs.  The filter -1 stands for the union of the
    lists of ``before`` (and of none of them for all documents).
    """
    lists = [np.flatnonzero(fails >> f & 1).tolist() for f in range(filters)]
    flagged = [np.flatnonzero(flags >> g & 1).tolist() for g in range(n_flags)]
    out = [(-1, 0, len(fails), *[0] * n_flags)]
    for before in range(1 << filters):
        earlier = [lists[k] for k in range(filters) if before >> k & 1]
        if before:
            out.append((-1, before, len(union(earlier)), *[0] * n_flags))
        for f in range(filters):
            if not before >> f & 1:
                ids = without(lists[f], earlier)
                out.append((f, before, len(ids), *(len(ids) - len(without(ids, [g])) for g in flagged)))
    return [r for r in out if r[2]]


def sizes(marked: DataFrame, filters: int, n_flags: int) -> DataFrame:
    """(part, id, fails, flags) -> (part, filter, before, size, flagged_0, ...), summed over all id ranges."""
    names = ["part", "filter", "before", "size", *(f"flagged_{g}" for g in range(n_flags))]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RANGE_ROWS:
                yield held
                held, rows = [], 0
        if rows:
            yield held

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in ranges(batches):
            table = pa.Table.from_batches(held).sort_by([("part", "ascending"), ("id", "ascending")])
            part = table.column("part").combine_chunks()
            fails, flags = (table.column(c).to_numpy() for c in ("fails", "flags"))
            places = part.dictionary_encode().indices.to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(places)] if len(places) else [0]
            found = []
            for a, b in zip(starts, starts[1:], strict=False):
                found += [(part[a].as_py(), *r) for r in _sizes(fails[a:b], flags[a:b], filters, n_flags)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(zip(*found, strict=True))], names)

    longs = ", ".join(f"{n} long" for n in names[1:])
    counted = marked.select("part", "id", "fails", "flags").mapInArrow(listed, f"part string, {longs}")
    return counted.groupBy("part", "filter", "before").agg(*(F.sum(n).alias(n) for n in names[3:]))


# -------------------------------------------------------------------- audit


def audit(marked: DataFrame, filters: str, flags: tuple[str, ...] = ()) -> DataFrame:
    """What each filter does at each step of every order, for each part.

    ``marked``: one row per document: part (string), id (any orderable type),
    fails (long, bit k set: fails the filter of the k-th letter) and flags
    (long, bit g set: has the g-th of ``flags``).  Null ids and repeated rows
    count as documents of their own; ``fails`` and ``flags`` aren't null.
    Returns part, filter_order (each order of the letters), step (from 1), and
    kept, removed, redundant, unique_fails, one ``<flag>_lost`` for each flag,
    and shapley (the sum of what the step's filter removes in all orders).
    A part has all its ``F * F!`` rows, zeros included; an empty table has none.
    """
    n, subsets = len(filters), 1 << len(filters)
    if not 1 <= n <= MOST_FILTERS or len(set(filters)) != n:
        raise ValueError(f"1 to {MOST_FILTERS} filters with different letters are needed")
    counted = sizes(marked, n, len(flags))
    measures = ["size", *(f"flagged_{g}" for g in range(len(flags)))]
    # One map of at most (n / 2 + 1) * 2 ** n sums for each part.
    entry = F.struct((F.col("filter") * subsets + F.col("before")).alias("key"), F.struct(*measures).alias("sums"))
    parts = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("sums"))

    def at(f: Column, before: Column, measure: str = "size") -> Column:
        return F.coalesce(F.col("sums")[f.cast("long") * subsets + before][measure], F.lit(0).cast("long"))

    orders = F.split(F.lit(",".join(sorted(map("".join, permutations(filters))))), ",")
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    before = sum((F.when(F.instr(F.expr("left(filter_order, step - 1)"), f) > 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(filters)), F.lit(0))
    own = F.instr(F.lit(filters), F.expr("substring(filter_order, step, 1)")) - 1
    steps = steps.select("*", own.cast("long").alias("f"), before.cast("long").alias("before"))
    f, before, everything = F.col("f"), F.col("before"), F.lit(subsets - 1).cast("long")
    bit = F.expr("shiftleft(1L, CAST(f AS INT))")
    documents, gone = at(F.lit(-1), F.lit(0)), at(F.lit(-1), before.bitwiseOR(bit))
    removed = at(f, before)
    times = F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)).cast("long") for k in range(n)))
    places = F.transform(F.sequence(F.lit(0).cast("long"), everything), lambda s: F.when(s.bitwiseAND(bit) == 0, F.get(times, F.bit_count(s)) * at(f, s)).otherwise(F.lit(0)))
    return steps.select(
        "part", "filter_order", "step",
        (documents - gone).alias("kept"),
        removed.alias("removed"),
        (at(f, F.lit(0)) - removed).alias("redundant"),
        at(f, everything.bitwiseXOR(bit)).alias("unique_fails"),
        *(at(f, before, f"flagged_{g}").alias(f"{flag}_lost") for g, flag in enumerate(flags)),
        F.aggregate(places, F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )


# ------------------------------------------------------------- the five filters


def fails_of(text: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails.

    A: under 200 words; B: under half of the words are different; C: more than
    2 capitals A-Z in 100 code points; D: holds one of ``#$%&*|``.
    """
    words = text.split()  # of bytes: at the six ASCII blanks
    a = len(words) < LEAST_WORDS
    b = 100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)
    c = 100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS_PERCENT * len(text.decode("utf-8", "replace"))
    d = len(text.translate(None, SYMBOLS)) < len(text)
    return a | b << 1 | c << 2 | d << 3


def marked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, id, fails, flags) of every document, for ``audit(..., "ABCDE", ("good", "toxic"))``.

    Filter E fails a text that is identical to a text of any smaller id; equal
    texts are found by their SHA-256.  A null text is empty, a null part is the
    empty string; a null id is neither smaller nor larger than another.  Flag 0
    (good) is a label row with quality 1 for the id, flag 1 (toxic) one with
    toxic 1; several label rows for an id count together, null labels not at
    all.  Repeated rows stay.  Other columns are not read.  The texts are read
    once and not shuffled; digests and marks are written to the shared folder.
    """
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fails, digests = [], []
            for text in batch.column(2):
                raw = text.as_py()
                fails.append(fails_of(raw))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fails, pa.int64()), pa.array(digests, pa.binary())], ["id", "part", "fails", "digest"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    marks = cut(rows.mapInArrow(mark, f"id {rows.schema['id'].dataType.simpleString()}, part string, fails long, digest binary"), "audit_marks")
    # Both small sides are written first: beside an aggregate Spark doesn't split a hot key's rows.
    repeated = marks.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = cut(repeated, "audit_repeated")
    later = F.when(F.col("id") > F.col("first"), F.lit(1 << 4)).otherwise(F.lit(0))
    marks = marks.join(repeated, "digest", "left").select("id", "part", (F.col("fails") + later).alias("fails"))
    flag = (F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))) + 2 * F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0)))).alias("flags")
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(flag)
    flags = cut(flags, "audit_flags")
    return marks.join(flags, "id", "left").select("part", "id", "fails", F.coalesce("flags", F.lit(0)).cast("long").alias("flags"))
