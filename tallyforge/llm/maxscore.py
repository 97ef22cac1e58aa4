"""Exact top-k search by inner product with MaxScore pruning.

The rows of a task form a shard of an impact index: for each dimension the postings of the
rows with a positive and with a negative value. A query's terms are its dimensions; each
has a bound, the most that any row of the shard can gain from it. Terms whose bounds
together cannot reach the k-th best score are non-essential: only the postings of the
others are traversed, and the rest is probed just for rows that can still compete. The
shards' best rows are merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from tallyforge.llm.common import discard, stage
from tallyforge.runtime import scratch_path

SCALE = 1024
SHARD_ROWS = 8192
# Queries that go to the executors at once; more take more rounds.
ROUND_QUERIES = 16_384
PROBE_TERMS = 8


class Shard:
    def __init__(self, ids: np.ndarray, values: np.ndarray):
        """values: a row of whole numbers for each id; ids are in ascending order."""
        self.ids, self.values = ids, values
        self.rows = {(d, s): np.flatnonzero(values[:, d] * s > 0) for d in range(values.shape[1]) for s in (1, -1)}
        self.impacts = {k: np.abs(values[rows, k[0]]) for k, rows in self.rows.items()}
        self.most = {k: int(v.max()) if len(v) else 0 for k, v in self.impacts.items()}

    def search(self, query_id: int, query: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of at least the shard's rows that can be among the k best.

        floor: the k-th best score so far, or None; rows with that score stay, for ties.
        """
        terms = [(d, 1 if w > 0 else -1, abs(w)) for d, w in enumerate(query.tolist()) if w]
        terms.sort(key=lambda t: -t[2] * self.most[t[:2]])
        bounds = [w * self.most[d, s] for d, s, w in terms]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0).astype(np.int64)
        gains = np.zeros(len(self.ids), np.int64)
        if floor is None:
            rows = np.arange(len(self.ids))
        else:
            essential = int(np.argmax(rest < floor)) if (rest < floor).any() else len(terms)
            for d, s, w in terms[:essential]:
                gains[self.rows[d, s]] += w * self.impacts[d, s]
            rows = np.flatnonzero(gains + rest[essential] >= floor)
            for at in range(essential, len(terms), PROBE_TERMS):
                for d, s, w in terms[at : at + PROBE_TERMS]:
                    gains[rows] += w * np.maximum(s * self.values[rows, d], 0)
                rows = rows[gains[rows] + rest[min(at + PROBE_TERMS, len(terms))] >= floor]
        # What lowers a score has no bound to save work by: it is taken for the rows left.
        scores = self.values[rows] @ query
        own = self.ids[rows] != query_id
        return self.ids[rows][own], scores[own]


class Best:
    """The k best rows so far of each query."""

    def __init__(self, k: int):
        self.k = k
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def floor(self, query: int) -> int | None:
        scores = self.found[query][1] if query in self.found else ()
        return int(scores[-1]) if len(scores) >= self.k else None

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if query in self.found:
            ids = np.concatenate([self.found[query][0], ids])
            scores = np.concatenate([self.found[query][1], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[query] = ids[order], scores[order]


def _search(queries: list[tuple[int, int, np.ndarray]], k: int):
    """queries: (number, vec_id, whole numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(size: int) -> None:
            ids, values = (np.concatenate(c) for c in zip(*held.pop(size), strict=True))
            order = np.argsort(ids, kind="stable")
            shard = Shard(ids[order], values[order])
            for number, query_id, query in queries:
                if len(query) == size:
                    best.add(number, *shard.search(query_id, query, k, best.floor(number)))

        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            column = batch.column("whole")
            sizes = pa.compute.list_value_length(column).to_numpy()
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                flat = column.take(pa.array(rows)).flatten().to_numpy()
                for low in range(0, len(rows), SHARD_ROWS):
                    part = slice(low, low + SHARD_ROWS)
                    held.setdefault(size, []).append((ids[rows[part]], flat.reshape(len(rows), size)[part]))
                    if sum(len(i) for i, _ in held[size]) >= SHARD_ROWS:
                        flush(size)
        for size in list(held):
            flush(size)
        for number, (ids, scores) in best.found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), queries[number][1])), pa.array(ids), pa.array(scores)],
                ["query_id", "vec_id", "score"],
            )

    return run


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, whole): each component as floor(scale * x); unusable vectors are left out."""
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("whole"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, round_queries: int = ROUND_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``rows`` for each query, exactly.

    Both sides are (vec_id, whole). Scores are whole inner products; ties go to the smaller
    vec_id, and rows with the query's own vec_id are no candidates. Only vectors of the same
    length meet. Repeated rows are candidates each. Equal queries count once; several vectors
    of one query id share one ranking of all their scores. Queries go to the executors in rounds
    of bounded size, in which each task reads its rows once; a round's result is stored and its
    queries leave the driver before the next.
    """
    spark = rows.sparkSession
    distinct = stage(queries.select("vec_id", "whole").distinct(), "queries")
    rounds = max(1, -(-distinct.count() // round_queries))
    turn = F.pmod(F.xxhash64("vec_id", "whole"), F.lit(rounds))
    schema = "query_id long, vec_id long, score long"
    path = scratch_path(spark, "rounds")
    for number in range(rounds):
        some = distinct.where(turn == number).toArrow().to_pylist()
        some = [(i, q["vec_id"], np.array(q["whole"], np.int64)) for i, q in enumerate(some)]
        found = rows.select("vec_id", "whole").mapInArrow(_search(some, k), schema)
        found.write.mode("append").parquet(path)
    discard(distinct)
    results = spark.read.schema(schema).parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = results.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
