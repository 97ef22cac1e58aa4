"""Benchmark decontamination as a prefix-filtered set join.

Every item is cut into windows of words, each a set of word shingles. Shingles are ordered by
how rare they are in all documents. A document that holds a window holds all its shingles, so
one of them, the rarest, is a necessary prefix: documents join windows on that alone. Pairs
whose window would not fit before, after or into the document are dropped by position and
length, the others are compared word by word.

Documents send only shingles that a bitmap of a fixed size may hold, each with the few words
around it, so that their texts are never shuffled, however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyforge.llm.common import byte_slices, small_batches, stage, text_bytes
from tallyforge.llm.hashing import build_bitmap, marked, phrase_hashes, span_hashes

SIZE = 10
SHINGLE = 3
BITS = 24
SLICE_BYTES = 2 << 20

# Words are runs of digits, ASCII letters (after lowering) and all bytes of other characters.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Words:
    """The lowered words of some texts (large binary without nulls)."""

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.data, bounds = _LOWER[raw], offsets - offsets[0]
        inside = np.append(_IN_WORD[self.data], False)
        fresh = np.ones(len(inside), bool)
        fresh[1:] = ~inside[:-1]
        fresh[bounds] = True
        closed = np.append(~inside[1:], True)
        closed[bounds[bounds > 0] - 1] = True
        self.starts = np.flatnonzero(inside & fresh)
        self.stops = np.flatnonzero(inside & closed) + 1
        self.ends = np.searchsorted(self.starts, bounds[1:])
        self.counts = np.diff(self.ends, prepend=0)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.hashes = span_hashes(self.data, self.starts, self.stops)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all shingles of ``size`` words within texts, and their hashes."""
        n = len(self.starts) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return first, phrase_hashes(*(self.hashes[first + k] for k in range(size)))

    def written(self) -> tuple[bytes, np.ndarray]:
        """All words with a space after each, and where each begins."""
        sizes = self.stops - self.starts
        until = np.cumsum(sizes + 1)
        out = np.full(int(until[-1]) if len(until) else 0, 32, np.uint8)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[place + np.repeat(until - sizes - 1, sizes)] = self.data[place + np.repeat(self.starts, sizes)]
        return out.tobytes(), np.append(0, until)


def _slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for low, high in byte_slices(texts, limit):
            yield batch.slice(low, high - low), Words(texts[low:high])


def _windows(size: int, shingle: int):
    """Each window of each item: its words, their number, and its shingles in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _slices(batches, SLICE_BYTES):
            text, at = words.written()
            hashes = [[]] + [words.shingles(k) for k in range(1, shingle + 1)]
            out: list[list] = [[], [], [], []]
            for item, end, count in zip(batch.column("item_id"), words.ends.tolist(), words.counts.tolist(), strict=True):
                length = min(size, count)
                k = min(shingle, length)
                if not length:
                    continue
                first, values = hashes[k]
                for start in range(end - count, end - length + 1):
                    low = int(np.searchsorted(first, start))
                    own = values[low : low + length - k + 1].view(np.int64).tolist()
                    row = (item.as_py(), text[at[start] : at[start + length] - 1].decode(), length, own)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["item_id", "window", "size", "shingles"]
            )

    return run


def _frequencies(bitmap: np.ndarray, shingle: int):
    """How often shingles that the bitmap may hold stand in the documents, by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _slices(batches, SLICE_BYTES):
            for k in range(1, shingle + 1):
                values = words.shingles(k)[1]
                found, n = np.unique(values[marked(bitmap, values)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["shingle", "n"])

    return run


_PROBES = (
    "key long, doc_id long, n_words long, "
    "probes array<struct<place: int, shingle: long, lead: int, context: string>>"
)


def _probes(bitmap: np.ndarray, size: int, shingle: int):
    """Each document's shingles that the bitmap may hold, with the words a window could take in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _slices(batches, SLICE_BYTES):
            places, values = [], []
            for k in range(1, shingle + 1):
                first, found = words.shingles(k)
                hit = marked(bitmap, found)
                places.append(first[hit])
                values.append(found[hit])
            place, value = np.concatenate(places), np.concatenate(values)
            order = np.argsort(place, kind="stable")
            place, value = place[order], value[order]
            doc = words.doc[place]
            begins = (words.ends - words.counts)[doc]
            low = np.maximum(begins, place - size + 1)
            high = np.minimum(words.ends[doc], place + size)
            text, at = words.written()
            context = [text[a:b].decode() for a, b in zip(at[low].tolist(), (at[high] - 1).tolist(), strict=True)]
            fields = [
                pa.array((place - begins).astype(np.int32)),
                pa.array(value.view(np.int64)),
                pa.array((place - low).astype(np.int32)),
                pa.array(context, pa.string()),
            ]
            probes = pa.StructArray.from_arrays(fields, ["place", "shingle", "lead", "context"])
            offsets = pa.array(np.searchsorted(doc, np.arange(len(batch) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("doc_id"),
                    pa.array(words.counts.astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, probes),
                ],
                ["key", "doc_id", "n_words", "probes"],
            )

    return run


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _spans(hits: DataFrame) -> DataFrame:
    """(key, spans): each document's hit words as disjoint ranges in their order."""
    reach = hits.groupBy("key", "start").agg(F.max("stop").alias("stop"))
    order = Window.partitionBy("key").orderBy("start")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    reach = reach.withColumn("opens", (before.isNull() | (before < F.col("start"))).cast("long"))
    reach = reach.withColumn("span", F.sum("opens").over(order))
    runs = reach.groupBy("key", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def find_leaks(
    docs: DataFrame, items: DataFrame, size: int = SIZE, shingle: int = SHINGLE, bits: int = BITS
) -> DataFrame:
    """doc_id, n_words, spans and items of each row of ``docs`` (doc_id, text).

    ``spans`` are the hit words as (start, stop) ranges of word numbers, disjoint and in order;
    ``items`` the ids (as strings, sorted) of the rows of ``items`` (item_id, text) of which a
    window stands in the document. A window is ``size`` consecutive words; an item of fewer is
    one window, an item without words none. Null texts have no words. Repeated documents have a
    row each, repeated items count once, an item without an id hits words but is not named.
    Other columns are left aside; with an empty table nothing is hit.
    """
    small_batches(docs.sparkSession)
    texts = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    windows = stage(
        texts.mapInArrow(_windows(size, shingle), "item_id string, window string, size int, shingles array<long>"),
        "windows",
    )
    distinct = windows.groupBy("window", "size").agg(F.first("shingles").alias("shingles"))
    placed = distinct.select("window", "size", F.posexplode("shingles").alias("offset", "shingle"))
    wanted = build_bitmap(placed, ["shingle"], _unsigned, bits)
    rows = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    counts = rows.select("text").mapInArrow(_frequencies(wanted, shingle), "shingle long, n long")
    rarity = counts.groupBy("shingle").agg(F.sum("n").alias("n"))
    # A window with a shingle that no document holds stands in none.
    ranked = placed.join(rarity, "shingle", "left").groupBy("window", "size").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("least")
    )
    prefixes = stage(
        ranked.where("least.n > 0").select(
            F.monotonically_increasing_id().alias("number"),
            "window",
            "size",
            "least.offset",
            "least.shingle",
        ),
        "prefixes",
    )
    necessary = build_bitmap(prefixes, ["shingle"], _unsigned, bits)
    probed = stage(rows.mapInArrow(_probes(necessary, size, shingle), _PROBES), "probes")
    probes = probed.select("key", "n_words", F.explode("probes").alias("p")).select("key", "n_words", "p.*")
    start = F.col("place") - F.col("offset")
    words = F.slice(F.split("context", " "), F.col("lead") - F.col("offset") + 1, F.col("size"))
    hits = stage(
        probes.join(prefixes, "shingle")
        .where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        .where(F.array_join(words, " ") == F.col("window"))
        .select("key", start.alias("start"), (start + F.col("size")).alias("stop"), "number"),
        "hits",
    )
    named = prefixes.select("number", "window").join(windows.select("window", "item_id").distinct(), "window")
    found = hits.select("key", "number").distinct().join(named.select("number", "item_id"), "number")
    found = found.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    joined = probed.select("key", "doc_id", "n_words").join(_spans(hits), "key", "left").join(found, "key", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("spans", F.expr("CAST(array() AS array<struct<start: int, stop: int>>)")).alias("spans"),
        F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"),
    )
