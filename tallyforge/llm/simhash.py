"""SimHash near duplicates over a hierarchical index in Gray order.

A document's fingerprint has a bit where more than half of its shingle hashes have one.
Fingerprints that differ in at most three bits agree on one of four 16-bit blocks, so the
distinct ones are dealt four times, each time rotated so that another block leads. Spark
sorts each block's fingerprints by Gray rank, which keeps codes of few differences
together. Over runs of that order an index keeps the bits that all members share (mask and
value); two groups whose shared bits already differ in more than three places are dropped
as a whole, others are opened down to single fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.llm.common import small_batches, stage, text_bytes
from tallyforge.llm.components import connected_components

SEED = 42
FAN = 8
OPEN_PAIRS = 1 << 14
BLOCK_BYTES = 1 << 20
SPACE = re.compile(rb"[ \t-\r]")
# A block value shared by more fingerprints than this is dealt once more by 12-bit parts.
HOT_BLOCK = 1 << 18
MAX_BITS = 3


def _shingle_hashes(words: list[bytes], size: int) -> list[int]:
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    pairs = zip(starts.tolist(), ends[size - 1 :].tolist(), strict=False)
    return [digest(joined[a:b], SEED) for a, b in pairs]


def _add_bits(counts: np.ndarray, hashes: list[int]) -> None:
    raw = np.array(hashes, dtype=">u8").view(np.uint8)
    counts += np.add.reduce(np.unpackbits(raw).reshape(-1, 64), axis=0, dtype=np.int64)


def fingerprint(raw: bytes, size: int) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit number; 0 without words.

    A text is lower-cased in A-Z and read in blocks, so that a very long one never has all of
    its words in memory. Fewer words than a shingle count as one shingle.
    """
    counts, total, kept, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(raw):
        gap = SPACE.search(raw, at + BLOCK_BYTES)
        end = gap.start() if gap else len(raw)
        words = kept + raw[at:end].lower().split()
        at = end
        if at < len(raw) and len(words) <= size:
            kept = words
            continue
        if words and (total == 0 or len(words) >= size):
            hashes = _shingle_hashes(words, size)
            _add_bits(counts, hashes)
            total += len(hashes)
        kept = words[-(size - 1) :] if size > 1 else []
    if not total:
        return 0
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint long) of every row, from whole texts; a null text has no words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(raw, size) for raw in text_bytes(batch.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codes, pa.int64())], ["doc_id", "fingerprint"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


def gray_rank(code: Column) -> Column:
    """Position of a code in the reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _rotated(code: str, by: int) -> Column:
    if not by:
        return F.col(code)
    return F.shiftleft(code, by).bitwiseOR(F.shiftrightunsigned(code, 64 - by))


def blocks(distinct: DataFrame, hot_block: int = HOT_BLOCK) -> DataFrame:
    """(block, part, rank, code, node): each fingerprint once for each 16-bit block it leads by."""
    turns = F.array(
        *(
            F.struct(F.lit(turn).alias("turn"), _rotated("fingerprint", 16 * turn).alias("code"))
            for turn in range(4)
        )
    )
    dealt = distinct.select("node", F.explode(turns).alias("t")).select(
        "node",
        F.col("t.code").alias("code"),
        (F.col("t.turn") * 65536 + F.shiftrightunsigned("t.code", 48)).alias("block"),
    )
    hot = dealt.groupBy("block").count().where(F.col("count") > hot_block)
    hot = hot.select("block", F.lit(True).alias("hot"))
    parts = F.array(
        *(
            F.shiftrightunsigned("code", 12 * part).bitwiseAND(F.lit(4095)) + 4096 * part
            for part in range(4)
        )
    )
    parts = F.when(F.col("hot"), parts).otherwise(F.array(F.lit(-1).cast("long")))
    return dealt.join(hot, "block", "left").select(
        "block", F.explode(parts).alias("part"), gray_rank(F.col("code")).alias("rank"), "code", "node"
    )


def hook(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Join the groups of linked members; label ends at each group's first member."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped


class GrayIndex:
    """Nodes over runs of codes in Gray order, each with the bits that its members share."""

    def __init__(self, codes: np.ndarray, first: np.ndarray):
        """codes: of several groups, each in Gray order; first: where the groups begin."""
        self.levels = [(codes, np.full(len(codes), ~np.uint64(0)))]
        self.children: list[np.ndarray] = []
        low, high = codes, codes
        sizes = np.diff(np.append(first, len(codes)))
        while (sizes > 1).any():
            starts = np.append(first, len(low))[:-1]
            inner = np.arange(len(low)) - np.repeat(starts, sizes)
            heads = np.flatnonzero(inner % FAN == 0)
            low, high = np.bitwise_and.reduceat(low, heads), np.bitwise_or.reduceat(high, heads)
            same = ~(low ^ high)
            self.levels.append((low & same, same))
            self.children.append(np.append(heads, len(inner)))
            sizes = -(-sizes // FAN)
            first = np.cumsum(sizes) - sizes
        self.roots = first

    def links(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members within the limit, a bounded number of open pairs at a time."""
        stack = [(len(self.children), self.roots, self.roots)]
        while stack:
            level, left, right = stack.pop()
            if level == 0:
                if len(left):
                    yield left, right
                continue
            if len(left) > OPEN_PAIRS:
                stack += [
                    (level, left[i : i + OPEN_PAIRS], right[i : i + OPEN_PAIRS])
                    for i in range(0, len(left), OPEN_PAIRS)
                ]
                continue
            bounds = self.children[level - 1]
            wide, deep = bounds[left + 1] - bounds[left], bounds[right + 1] - bounds[right]
            each = wide * deep
            pair = np.repeat(np.arange(len(left)), each)
            inner = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
            a = bounds[left[pair]] + inner // deep[pair]
            b = bounds[right[pair]] + inner % deep[pair]
            value, mask = self.levels[level - 1]
            near = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b]) <= limit
            near &= (a < b) if level == 1 else (a <= b)
            stack.append((level - 1, a[near], b[near]))


def _link_sorted(limit: int):
    """Edges (member, first member of its group) from rows sorted by block, part and rank."""

    def edges(block, part, code, node) -> pa.RecordBatch:
        fresh = np.append(True, (block[1:] != block[:-1]) | (part[1:] != part[:-1]))
        label = np.arange(len(code))
        index = GrayIndex(code.astype(np.int64).view(np.uint64), np.flatnonzero(fresh))
        for left, right in index.links(limit):
            hook(label, left, right)
        moved = np.flatnonzero(label != np.arange(len(code)))
        return pa.RecordBatch.from_arrays(
            [pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("block", "part", "code", "node")])
            held.append(rows)
            size += rows.shape[1]
            if size < 1 << 16:
                continue
            rows = np.concatenate(held, axis=1)
            last = np.flatnonzero(
                (rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1])
            )
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield edges(*rows[:, :cut])
            held, size = [rows[:, cut:]], rows.shape[1] - cut
        if held and size:
            yield edges(*np.concatenate(held, axis=1))

    return run


def link(prints: DataFrame, limit: int = MAX_BITS, hot_block: int = HOT_BLOCK) -> DataFrame:
    """(fingerprint, component_id) of each distinct fingerprint of ``prints``.

    Nodes are the least doc_id of each fingerprint. Within a block only a spanning set of the
    links is kept, which leaves the components as they are.
    """
    if limit > MAX_BITS:
        raise ValueError(f"four blocks find at most {MAX_BITS} differing bits")
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    distinct = distinct.where("node is not null")
    dealt = blocks(distinct, hot_block).select("block", "part", "rank", "code", "node")
    ordered = dealt.repartition("block", "part").sortWithinPartitions("block", "part", "rank")
    edges = ordered.select(
        F.col("block").cast("long").alias("block"), F.col("part").cast("long").alias("part"),
        "code", "node",
    ).mapInArrow(_link_sorted(limit), "a long, b long")
    found = connected_components(edges)
    return distinct.join(found, distinct.node == found.node, "left").select(
        "fingerprint", F.coalesce("component", distinct.node).alias("component_id")
    )


def near_duplicates(docs: DataFrame, size: int = 3, limit: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint long, component_id) of every row of ``docs`` (doc_id, text).

    Equal fingerprints are linked, those of texts without words too. Rows without doc_id keep
    a fingerprint and have the component of its other rows, or none. Repeated rows stay.
    """
    prints = stage(fingerprints(docs, size), "fingerprints")
    groups = stage(link(prints, limit), "groups")  # stored, so that a hot fingerprint's join can be split
    return prints.join(groups, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")
