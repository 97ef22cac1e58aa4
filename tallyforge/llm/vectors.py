"""Embedding near duplicates by sorted projection passes.

In each pass the distinct vectors are ordered lexicographically by a word of concatenated random
hyperplane hashes and cut into blocks; a block is compared with itself and the next in double
precision. Pairs verified in any pass are united. A pair of two passes is counted in the
first of them only.

A group of linked vectors that holds more than a block overflows these windows. Such groups are
compared whole: their vectors are dealt into bounded parts of which every two meet, where blocks
around pivots that centres and angles prove apart are dropped. Tasks only report counts of links
and a spanning set of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.common import discard, stage
from tallyforge.llm.components import connected_components
from tallyforge.llm.simhash import hook

BLOCK = 1024
BITS = 48
SEED = 20
# How many numbers a part of a group that overflows its windows may hold.
GROUP_VALUES = 1 << 20
LEAST_PASSES = 16
MISSED = 1e-3


def passes_for(count: int, threshold: float, block: int = BLOCK, missed: float = MISSED) -> int:
    """Passes that find a pair just at the threshold but for a share ``missed``.

    A pair meets if the bits that tell a block from the others agree, log2(count / block).
    """
    agree = 1 - math.acos(threshold) / math.pi
    meet = agree ** max(0.0, math.log2(max(1, count) / block))
    return LEAST_PASSES if meet >= 1 else max(LEAST_PASSES, math.ceil(math.log(missed) / math.log1p(-meet)))


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, unit vectors in double precision) for each length of vector."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        matrix = flat.astype(np.float64).reshape(len(rows), size)
        matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
        yield size, rows, matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _hash_words(passes: int):
    """Each vector's word of hyperplane signs for each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(BITS, dtype=np.int64)[::-1]
        for batch in batches:
            for size, rows, matrix in _by_size(batch.column("vector")):
                if size not in planes:
                    planes[size] = np.random.default_rng([SEED, size]).standard_normal((size, passes * BITS))
                words = ((matrix @ planes[size] > 0).reshape(len(rows), passes, BITS) @ weights).ravel()
                nodes = np.repeat(batch.column("node").to_numpy()[rows], passes)
                turns = np.tile(np.arange(passes), len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (nodes, turns, words)], ["node", "turn", "word"])

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        rows = len(batch)
        places = [pa.array(np.full(rows, part, np.int64)), pa.array(np.arange(at, at + rows))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("turn"), *places], ["node", "turn", "part", "at"]
        )
        at += rows


def _vectors_of(group: pa.Table) -> pa.Array:
    column = group.column("vector").combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _report(node: np.ndarray, label: np.ndarray, links: np.ndarray) -> pa.Table:
    moved = np.flatnonzero((label != np.arange(len(node))) | (links > 0))
    return pa.table(
        {"a": node[moved], "b": node[label[moved]], "links": links[moved]},
        schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())]),
    )


def _compare_window(threshold: float):
    """A block of a pass against itself and the next block of the order."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        turn, block = group.column("turn")[0].as_py(), group.column("at_block")[0].as_py()
        node = group.column("node").to_numpy()
        copies = group.column("copies").to_numpy()
        own = group.column("block").to_numpy() == block
        places = np.stack(group.column("blocks").to_pylist())
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for _, rows, matrix in _by_size(_vectors_of(group)):
            home, rest = np.flatnonzero(own[rows]), np.flatnonzero(~own[rows])
            for low in range(0, len(home), 256):
                some = home[low : low + 256]
                others = np.concatenate([home, rest])
                a, b = np.nonzero(matrix[some] @ matrix[others].T >= threshold)
                a, b = rows[some[a]], rows[others[b]]
                once = ~own[b] | (node[a] < node[b])
                a, b = a[once], b[once]
                hook(label, a, b)
                fresh = ~(np.abs(places[a, :turn] - places[b, :turn]) <= 1).any(axis=1)
                np.add.at(links, a[fresh], copies[b[fresh]])
                np.add.at(links, b[fresh], copies[a[fresh]])
        return _report(node, label, links)

    return run


def _blocks(matrix: np.ndarray, block: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(row numbers, centre, largest angle from it) of blocks of unit vectors that lie close."""
    pivots = matrix[:: max(1, block // 4)]
    nearest = np.concatenate(
        [(matrix[i : i + block] @ pivots.T).argmax(axis=1) for i in range(0, len(matrix), block)]
    )
    order, out = np.argsort(nearest, kind="stable"), []
    for low in range(0, len(order), block):
        rows = order[low : low + block]
        centre = matrix[rows].mean(axis=0)
        length = np.linalg.norm(centre)
        if length < 1e-6:
            out.append((rows, matrix[rows[0]], math.pi))
            continue
        centre /= length
        out.append((rows, centre, math.acos(max(-1.0, min(1.0, float((matrix[rows] @ centre).min()))))))
    return out


def _may_meet(left: list, right: list, threshold: float) -> np.ndarray:
    """Whether some pair of two blocks can reach the threshold, by the triangle of angles."""
    centres = np.stack([c for _, c, _ in left]) @ np.stack([c for _, c, _ in right]).T
    reach = np.array([r for _, _, r in left])[:, None] + np.array([r for _, _, r in right])
    return np.arccos(np.clip(centres, -1, 1)) - reach <= math.acos(max(-1.0, min(1.0, threshold))) + 1e-6


def _compare(threshold: float, block: int):
    """Two parts of one group, each pair of vectors compared or excluded by its blocks."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node = group.column("node").to_numpy()
        copies = group.column("copies").to_numpy()
        deal = group.column("deal").to_numpy()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for _, rows, matrix in _by_size(_vectors_of(group)):
            sides = [np.flatnonzero(deal[rows] == d) for d in (low, high)]
            if not all(map(len, sides)):
                continue
            left, right = ([(s[i], c, r) for i, c, r in _blocks(matrix[s], block)] for s in sides)
            for i, j in np.argwhere(_may_meet(left, right, threshold)).tolist():
                if low == high and j < i:
                    continue
                some, others = left[i][0], right[j][0]
                hits = matrix[some] @ matrix[others].T >= threshold
                if low == high and i == j:
                    hits = np.triu(hits, 1)
                if not hits.any():
                    continue
                a, b = rows[some], rows[others]
                # Nodes are distinct within a side, so plain indexing adds each once.
                links[a] += hits @ copies[b]
                links[b] += copies[a] @ hits
                x, y = np.nonzero(hits & (label[a][:, None] != label[b]))
                hook(label, a[x], b[y])
        return _report(node, label, links)

    return run


def _usable(vector: str):
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _windows(classes: DataFrame, count: int, passes: int, threshold: float, block: int) -> DataFrame:
    """(a, b, links): what the windows of all passes find, spanning links and counts."""
    words = stage(classes.mapInArrow(_hash_words(passes), "node long, turn long, word long"), "words")
    order = ["turn", "word", "node"]
    ranked = stage(
        words.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_number, "node long, turn long, part long, at long"),
        "order",
    )
    # A row per partition: where its first vector stands in the order of all passes.
    before, starts = 0, []
    for part, n in ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((part, before))
        before += n
    starts = classes.sparkSession.createDataFrame(starts, "part long, before long")
    place = F.floor((F.col("before") + F.col("at") - F.col("turn") * count) / block).cast("int")
    blocks = (
        ranked.join(F.broadcast(starts), "part")
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("turn", place.alias("block")))).alias("b"))
        .select("node", F.col("b.block").alias("blocks"))
    )
    dealt = (
        classes.join(blocks, "node")
        .select("*", F.posexplode("blocks").alias("turn", "block"))
        .select("*", F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("at_block"))
        .where("at_block >= 0")
    )
    compared = stage(
        dealt.groupBy("turn", "at_block").applyInArrow(_compare_window(threshold), "a long, b long, links long"),
        "compared",
    )
    discard(words, ranked)
    return compared


def _whole_groups(members: DataFrame, threshold: float, block: int, part: int) -> DataFrame:
    """(a, links): counts of links within each group of ``members`` (group, size, node, copies, vector).

    A group is dealt into parts of about ``part`` vectors, and every two parts meet in a task.
    """
    deals = F.ceil(F.col("size") / part).cast("int")
    dealt = members.withColumn("deals", deals).withColumn("deal", F.pmod(F.xxhash64("node"), F.col("deals")).cast("int"))
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("deals") - 1),
        lambda d: F.struct(F.least("deal", d).alias("low"), F.greatest("deal", d).alias("high")),
    )
    compared = dealt.select("group", "node", "copies", "vector", "deal", F.inline(tiles)).groupBy("group", "low", "high")
    found = compared.applyInArrow(_compare(threshold, block), "a long, b long, links long")
    return found.groupBy("a").agg(F.sum("links").alias("links"))


def near_vectors(rows: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of ``rows`` (vec_id, embedding).

    Vectors are linked from a cosine of ``threshold`` on, in double precision. Equal vectors
    are compared once and linked to each other. Vectors that are null, empty, zero, or hold
    null or non-finite components are alone, as are those of different lengths. A row without
    vec_id has no component of its own: it takes part under the largest number. Up to two
    blocks of vectors are compared whole; of larger tables passes find pairs just at the
    threshold but for a share ``MISSED`` where hashes part the table evenly. A component of more
    than ``block`` different vectors overflows the windows and is compared whole, so its counts
    miss nothing; tests measure the recall of all others.
    """
    ids = F.coalesce(F.col("vec_id").cast("long"), F.lit((1 << 63) - 1)).alias("vec_id")
    table = rows.select(ids, F.col("vec_id").isNull().alias("unnamed"), F.col("embedding").alias("vector"))
    usable = F.coalesce(_usable("vector"), F.lit(False))
    classes = stage(
        table.where(usable).groupBy("vector").agg(
            F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")
        ),
        "vectors",
    )
    count, width = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    compared = _windows(classes, count, passes_for(count, threshold, block), threshold, block)
    links = compared.groupBy("a").agg(F.sum("links").alias("links"))
    found = stage(connected_components(compared.select("a", "b")).withColumnRenamed("node", "member"), "groups")
    # A component's least member is no row of its own there.
    sizes = found.groupBy("component").agg((F.count(F.lit(1)) + 1).alias("size")).where(F.col("size") > block)
    sizes = stage(sizes, "overflowing")
    named = found.unionByName(sizes.select(F.col("component").alias("member"), "component"))
    large = classes.join(named.join(sizes, "component"), F.col("node") == F.col("member")).select(
        F.col("component").alias("group"), "size", "node", "copies", "vector"
    )
    whole = stage(_whole_groups(large, threshold, block, max(block, GROUP_VALUES // width)), "whole")
    by_class = (
        classes.join(links, F.col("node") == F.col("a"), "left")
        .join(whole.select(F.col("a").alias("own"), F.col("links").alias("exact")), F.col("node") == F.col("own"), "left")
        .join(found, F.col("node") == F.col("member"), "left")
        .select(
            "vector",
            (F.coalesce("exact", "links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    shown = F.when(~F.col("unnamed"), F.col("vec_id")).alias("vec_id")
    linked = table.where(usable).join(by_class, "vector")
    linked = linked.select(shown, F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = table.where(~usable).select(shown, F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)
