"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A document's fingerprint has a bit set where more than half of its shingles'
hashes have it set.  Two fingerprints link when they differ in at most
``max_bits`` bits, and documents that links connect form one group.

Finding the links without comparing all pairs:

* equal fingerprints are one class from the start;
* the 64 bits are cut into three segments, so of at most two differing bits at
  least one segment has none (pigeonhole), and the next segment has two at most;
* a segment of up to 23 bits is decoded with the perfect binary Golay code to
  the indices of the codewords within distance four: one index, or six.  Any two
  segments within two bits share an index, since a word halfway between them is
  within three bits of a codeword;
* (segment number, exact segment, index of the next segment) is a key; classes
  that share a key are compared and verified by their bit distance.

A key shared by many classes would emit a square of pairs.  Beyond
``pairs_up_to`` classes they are linked through midpoints instead: each class
lists itself and its 64 one-bit neighbours, and two fingerprints list the same
word exactly if they are within two bits, so the classes at one word (65 at
most) form a star.  Both ways are exact.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdcspark.llm.common import cut, unused
from pdcspark.llm.components import components

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
GOLAY_BITS, GOLAY_CHECK = 23, 11
GOLAY_GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The 64-bit SimHash of one whole text as an unsigned integer; 0 without words."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z, and the six blanks
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        block = hashes[start : start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(hashes)))


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each single bit, and per syndrome the errors of weight up to 4 (-1: none)."""
    unit = []
    for i in range(GOLAY_BITS):
        r = 1 << i
        for j in range(i, GOLAY_CHECK - 1, -1):
            if r >> j & 1:
                r ^= GOLAY_GENERATOR << (j - GOLAY_CHECK)
        unit.append(r)
    errors: list[list[int]] = [[] for _ in range(1 << GOLAY_CHECK)]
    for weight in range(5):
        for bits in combinations(range(GOLAY_BITS), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            errors[s].append(sum(1 << b for b in bits))
    return np.array(unit, np.int64), np.array([e + [-1] * (6 - len(e)) for e in errors], np.int64)


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Per word of up to 23 bits six places: the indices of the codewords within distance 4, or -1."""
    unit, errors = _golay()
    syndrome = np.zeros(len(words), np.int64)
    for i in range(GOLAY_BITS):
        syndrome ^= np.where(words >> i & 1, unit[i], 0)
    near = errors[syndrome]
    return np.where(near < 0, -1, (words[:, None] ^ near) >> GOLAY_CHECK)


def keys_of(fingerprints: np.ndarray) -> np.ndarray:
    """(n, 18) keys of signed 64-bit fingerprints; -1 stands for no key."""
    bits = fingerprints.astype(np.int64).view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    out = []
    for i in range(3):
        indices = codeword_indices(parts[(i + 1) % 3])
        out.append(np.where(indices < 0, -1, ((i << 22 | parts[i][:, None]) << 12) | indices))
    return np.hstack(out)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _keys(fp: pd.Series) -> pd.Series:
    return pd.Series([row[row >= 0] for row in keys_of(fp.to_numpy())], dtype=object)


def _simhash(shingle_words: int):
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64))

    return simhash


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, fp): the signed fingerprint of every row's whole text."""

    return docs.select(F.col(id_col).alias("id"), _simhash(shingle_words)(F.col(text_col).cast("string")).alias("fp"))


def links(classes: DataFrame, max_bits: int = 2, pairs_up_to: int = 32) -> DataFrame:
    """(u, v): for distinct fingerprints ``fp``, edges whose components are those of all links.

    Pairs from keys shared by few classes are the links themselves; within a
    crowded key a star around each midpoint connects the same classes.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("the Golay keys find links of at most 2 bits")
    keyed = classes.select("fp", F.explode(_keys("fp")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = cut(keyed.join(shared, "key"), "keys")
    few = keyed.where(F.col("n") <= pairs_up_to)
    a, b = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    pairs = a.join(b, "key").where(F.col("u") < F.col("v")).where(near).select("u", "v")
    crowded = keyed.where(F.col("n") > pairs_up_to).select("fp").distinct()
    masks = F.array(F.lit(0).cast("long"), *(F.lit(int(np.uint64(1 << i).astype(np.int64))) for i in range(64)))
    probes = crowded.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    if max_bits == 2:
        stars = probes.groupBy("mid").agg(F.min("fp").alias("v"), F.collect_set("fp").alias("fps"))
        beside = stars.select(F.explode("fps").alias("u"), "v")
    else:
        beside = probes.join(crowded.select(F.col("fp").alias("mid")), "mid").select(F.col("fp").alias("u"), F.col("mid").alias("v"))
        beside = beside.where(F.lit(max_bits == 1))
    return pairs.unionByName(beside.where("u <> v")).distinct()


def groups(classes: DataFrame, max_bits: int, pairs_up_to: int) -> DataFrame:
    """(fp, least) -> the same with ``root``, a fingerprint that stands for the group."""
    classes = cut(classes, "classes")
    rooted = components(links(classes.select("fp"), max_bits, pairs_up_to)).withColumnRenamed("node", "fp")
    placed = classes.join(rooted, "fp", "left")
    return cut(placed.select("fp", "least", F.coalesce("root", "fp").alias("root")), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2, pairs_up_to: int = 32) -> DataFrame:
    """One row per input row: (id_col, fingerprint, component_id).

    ``component_id`` is the least id reachable over links, the row's own
    included; ids that are null are passed over, and a group of null ids alone
    has a null component.  Null, empty and blank texts have fingerprint zero
    and link like any other.  Repeated rows stay, with one component.  Other
    columns of ``docs`` are not read, so their names cannot clash.  An empty
    table gives an empty result.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    placed = groups(marked.groupBy("fp").agg(F.min("id").alias("least")), max_bits, pairs_up_to)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(placed, "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2, pairs_up_to: int = 32) -> DataFrame:
    """One row of each group of near-duplicates, with the columns of ``docs``.

    It is the row of the least id (null ids come last), and of rows with that
    id the one with the least fingerprint, then text.  Edge cases as in
    ``near_duplicates``.  Only ids and fingerprints take part in the search;
    the texts are moved once, to the one row that stays.
    """
    fp, group_id, group_fp, place = (unused(f"simhash_{c}", docs.columns) for c in ("fp", "id", "of", "place"))
    marked = cut(docs.withColumn(fp, _simhash(shingle_words)(F.col(text_col).cast("string"))), "marked")
    first = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(fp).alias("fp"))
    placed = groups(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(first).alias("least")), max_bits, pairs_up_to)
    stays = placed.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias(group_id), F.col("least.fp").alias(group_fp))
    kept = marked.join(stays, F.col(id_col).eqNullSafe(F.col(group_id)) & (F.col(fp) == F.col(group_fp)))
    once = F.row_number().over(Window.partitionBy(fp, id_col).orderBy(text_col))
    return kept.withColumn(place, once).where(F.col(place) == 1).select(*docs.columns)
