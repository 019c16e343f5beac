"""Approximate nearest neighbours over balanced posting lists.

Every distinct vector is a class with the ids of its rows.  Centroids come from
a balanced k-means over a bounded sample; a graph of their neighbours, held in
memory, is searched for the centroids near a vector.  A class is put on the
lists of all centroids that are nearly as close as its nearest (boundary
vectors on several), and a query reads the lists whose centroids are within a
ratio of the distance to its nearest.  Within the lists cosines are exact.

Lists are cut into blocks of rows, and their queries into blocks too, so no
task holds more than a block of each.  Of a class only the least ``k + 1`` ids
can be among the nearest rows, so copies cost nothing however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pdcspark.llm.common import cut

#: Rows of the sample, rows of it for a centroid, and the most centroids (their broadcast is bounded by both).
SAMPLE, PER_CENTROID, MOST_CENTROIDS = 20_000, 64, 1024
ROUNDS, BALANCE = 12, 0.3
#: Neighbours of a centroid in the graph, and nodes expanded in a step.
DEGREE, EXPAND = 16, 8
#: Lists of a class, and of a query: how many, and up to which ratio to the nearest distance.
REPLICAS, REPLICA_RATIO = 4, 1.06
LEAST_PROBES, PROBES, PROBE_RATIO = 12, 256, 1.28
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


@dataclass
class Centroids:
    vectors: np.ndarray  # of length 1
    graph: np.ndarray  # (n, degree) numbers of other centroids
    entries: np.ndarray  # where searches begin

    def nearest(self, unit: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row, the numbers of near centroids and their distances, by distance.

        A best-first search of the graph for all rows at once: the best nodes
        in the beam that have not been expanded add their neighbours.
        """
        n, rows = len(self.vectors), np.arange(len(unit))[:, None]
        beam = min(beam, n)
        seen = np.zeros((len(unit), n), bool)
        seen[:, self.entries] = True
        ids = np.broadcast_to(self.entries, (len(unit), len(self.entries)))
        likeness = unit @ self.vectors[self.entries].T
        expanded = np.zeros(ids.shape, bool)
        while True:
            waiting = np.where(expanded, -np.inf, likeness)
            width = min(EXPAND, ids.shape[1])
            pick = np.argpartition(-waiting, width - 1, axis=1)[:, :width]
            fresh = np.isfinite(np.take_along_axis(waiting, pick, 1))
            if not fresh.any():
                break
            np.put_along_axis(expanded, pick, True, 1)
            beside = self.graph[np.take_along_axis(ids, pick, 1)].reshape(len(unit), -1)
            new = ~seen[rows, beside] & np.repeat(fresh, self.graph.shape[1], axis=1)
            # A node reached twice in one step counts once.
            order = np.argsort(beside, axis=1, kind="stable")
            in_order = np.take_along_axis(beside, order, 1)
            again = np.zeros_like(new)
            np.put_along_axis(again, order[:, 1:], in_order[:, 1:] == in_order[:, :-1], 1)
            new &= ~again
            seen[rows.repeat(beside.shape[1], 1)[new], beside[new]] = True
            found = np.where(new, np.einsum("ij,ikj->ik", unit, self.vectors[beside]), -np.inf)
            ids = np.hstack([ids, beside])
            likeness = np.hstack([likeness, found])
            expanded = np.hstack([expanded, ~new])
            if ids.shape[1] > beam:
                best = np.argpartition(-likeness, beam - 1, axis=1)[:, :beam]
                ids, likeness, expanded = (np.take_along_axis(a, best, 1) for a in (ids, likeness, expanded))
        order = np.argsort(-likeness, axis=1, kind="stable")
        ids, likeness = np.take_along_axis(ids, order, 1), np.take_along_axis(likeness, order, 1)
        return ids, np.where(np.isfinite(likeness), np.sqrt(np.maximum(2 - 2 * likeness, 0)), np.inf)

    def lists(self, vectors: np.ndarray, least: int, most: int, ratio: float) -> list[list[int]]:
        """For each vector the nearest centroids: ``least`` at least, up to ``most`` within the ratio."""
        out = []
        for start in range(0, len(vectors), 256):
            ids, distances = self.nearest(_unit(vectors[start : start + 256]), beam=max(32, most + most // 2))
            ids, distances = ids[:, :most], distances[:, :most]
            chosen = distances <= ratio * distances[:, :1] + 1e-9
            chosen[:, :least] |= np.isfinite(distances[:, :least])
            out += [row[c].tolist() for row, c in zip(ids, chosen, strict=True)]
        return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit(sample: np.ndarray) -> Centroids:
    """Balanced k-means of the sample (a full list counts as farther), and the graph of the centroids."""
    unit = _unit(sample)
    n = int(np.clip(len(unit) // PER_CENTROID, 1, MOST_CENTROIDS))
    draw = np.random.default_rng(0)
    centres = unit[draw.choice(len(unit), n, replace=False)]
    extra = np.zeros(n)
    for _ in range(ROUNDS):
        nearest = np.argmax(unit @ centres.T - extra, axis=1)
        sizes = np.bincount(nearest, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        lost = (sizes == 0) | (np.linalg.norm(sums, axis=1) < 1e-12)
        sums[lost] = unit[draw.choice(len(unit), int(lost.sum()))]
        centres = _unit(sums)
        extra = np.maximum(extra + BALANCE * 0.1 * (sizes / sizes.mean() - 1), 0)
    likeness = centres @ centres.T
    np.fill_diagonal(likeness, -np.inf)
    degree = min(DEGREE, max(n - 1, 1))
    graph = np.argsort(-likeness, axis=1, kind="stable")[:, :degree]
    if n > degree:  # a few far links keep the graph together
        graph = np.hstack([graph, (np.arange(n)[:, None] + (n // 4 + 1) * np.arange(1, 4)) % n])
    return Centroids(centres, graph, np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64)))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>) of the rows that can take part."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    kept = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), finite.alias("finite"), norm.alias("norm"))
    return kept.where(F.col("id").isNotNull() & F.col("finite") & (F.size("vector") > 0) & (F.col("norm") > 0)).select("id", "vector")


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """(class, vector, ids): the rows of each distinct vector by their least ``k + 1`` ids; ``class`` is the least."""
    numbered = vectors.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id")))
    kept = numbered.where(F.col("n") <= k + 1)
    return kept.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("class"), "vector", "ids")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _on_lists(rows: DataFrame, sent, least: int, most: int, ratio: float, name: str) -> DataFrame:
    """``rows`` (class, vector, ...) with one row for each list they are on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch[name] = sent.value.lists(_matrix(batch["vector"]), least, most, ratio)
                yield batch

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{kind}, {name} array<int>")


def _block(rows: Column, size: int, by: Column) -> Column:
    return F.pmod(F.xxhash64(by), F.ceil(rows / size)).cast("int")


#: Rounding of a cosine by the matrix product, well above it; pairs that are measured at a time.
MARGIN, PAIRS = 1e-9, 1 << 16


def _compare(queries: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """(query, class, ids, score): the best ``k + 1`` classes of each block of a list for each of its queries."""

    def best(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            kinds = {"query": "int64", "class": "int64", "ids": object, "score": "float64"}
            return pd.DataFrame({c: pd.Series(dtype=kind) for c, kind in kinds.items()})
        p = p.sort_values("class")
        a, b = _matrix(q["vector"]), _matrix(p["vector"])
        la, lb = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
        likeness = (a / la[:, None]) @ (b / lb[:, None]).T
        # All within a rounding margin of the last needed, then the exact measure of each pair alone.
        last = min(k + 1, len(b)) - 1
        least = np.partition(-likeness, last, axis=1)[:, last] + MARGIN
        i, j = np.nonzero(-likeness <= least[:, None])
        score = np.concatenate([np.einsum("ij,ij->i", a[i[at : at + PAIRS]], b[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)]) / (la[i] * lb[j])
        out = pd.DataFrame({"query": q["class"].to_numpy()[i], "class": p["class"].to_numpy()[j], "ids": p["ids"].to_numpy()[j], "score": score})
        out = out.sort_values(["query", "score", "class"], ascending=[True, False, True])
        return out.groupby("query").head(k + 1)

    keys = ["list", "block", "query_block"]
    return queries.groupBy(*keys).cogroup(postings.groupBy(*keys)).applyInPandas(best, "query long, class long, ids array<long>, score double")


def _search(queries: DataFrame, postings: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(query, id, score, place): the best ``k + 1`` rows for each (class, vector, lists) query class."""
    asked = queries.select("class", "vector", F.explode("lists").alias("list"))
    asked_sizes = asked.groupBy("list").agg(F.count(F.lit(1)).alias("queries"))
    both = cut(sizes.join(asked_sizes, "list"), "list_sizes")  # a row for each centroid at most
    asked = asked.join(F.broadcast(both), "list").withColumn("query_block", _block(F.col("queries"), BLOCK_QUERIES, F.col("class")))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("rows") / BLOCK_ROWS) - 1).cast("int"))))
    listed = postings.join(F.broadcast(both), "list").withColumn("block", _block(F.col("rows"), BLOCK_ROWS, F.col("class")))
    listed = listed.withColumn("query_block", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("queries") / BLOCK_QUERIES) - 1).cast("int"))))
    found = _compare(asked.select("list", "block", "query_block", "class", "vector"), listed.select("list", "block", "query_block", "class", "vector", "ids"), k)
    once = found.groupBy("query", "class").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    rows = once.select("query", "score", F.explode("ids").alias("id"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= k + 1)


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each query row the ``k`` nearest found among all other rows.

    Rows whose vector is null, empty, zero or has null or non-finite components,
    or whose id is null, take no part, nor do vectors that have not the most
    frequent length (of equally frequent ones the longest).  Rows of equal id
    and vector count once.  Equal scores go to the smaller id.  A query whose
    lists hold fewer than ``k`` other rows is compared with all lists.  An
    empty table gives no rows.  ``is_query`` is over the columns of ``rows``.
    """
    spark = rows.sparkSession
    asked = usable(rows.where(is_query), id_col, vector_col).distinct()
    vectors = usable(rows, id_col, vector_col).distinct()
    lengths = vectors.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    schema = f"query_id long, rank int, {id_col} long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    fitting = F.size("vector") == lengths[0]["length"]
    groups = cut(classes(vectors.where(fitting), k), "classes")
    sample = groups.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("vector").toArrow()
    matrix = sample["vector"].combine_chunks().flatten().to_numpy().reshape(len(sample), -1)
    sent = spark.sparkContext.broadcast(fit(matrix))
    listed = _on_lists(groups.select("class", "vector", "ids"), sent, 1, REPLICAS, REPLICA_RATIO, "lists")
    postings = cut(listed.select(F.explode("lists").alias("list"), "class", "vector", "ids"), "postings")
    sizes = postings.groupBy("list").agg(F.count(F.lit(1)).alias("rows"))
    asked = cut(asked.where(fitting).join(groups.select("class", "vector"), "vector").select("id", "class", "vector"), "queries")
    once = asked.select("class", "vector").dropDuplicates(["class"])
    found = cut(_search(_on_lists(once, sent, LEAST_PROBES, PROBES, PROBE_RATIO, "lists"), postings, sizes, k), "found")
    enough = found.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
    short = cut(once.join(enough, F.col("class") == F.col("query"), "left_anti"), "short")
    if not short.isEmpty():
        every = F.array(*map(F.lit, range(len(sent.value.vectors))))
        whole = _search(short.withColumn("lists", every), postings, sizes, k)
        found = found.join(short.select(F.col("class").alias("query")), "query", "left_anti").unionByName(whole)
    pairs = asked.select(F.col("id").alias("query_id"), F.col("class").alias("query")).join(found, "query").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    ranked = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
