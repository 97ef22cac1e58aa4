"""Hashes of words and phrases for Arrow tasks, and bitmaps of a fixed size over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 4 << 20  # bytes hashed at once


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, over unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
_PLACE = mixed(np.arange(257, 1281, dtype=np.uint64) * _STEP) | np.uint64(1)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:stop] of some bytes; equal spans have equal hashes."""
    out = np.empty(len(starts), np.uint64)
    sizes = stops - starts
    ends = np.cumsum(sizes)
    low = 0
    while low < len(starts):
        base = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + WINDOW, "right")))
        own = sizes[low:high]
        until = ends[low:high] - base
        place = np.arange(int(until[-1])) - np.repeat(until - own, own)
        part = _BYTE[data[place + np.repeat(starts[low:high], own)]] * _PLACE[place & 1023]
        sums = np.append(np.uint64(0), np.cumsum(part))
        out[low:high] = mixed(sums[until] - sums[until - own] + own.astype(np.uint64) * _STEP)
        low = high
    return out


def string_hashes(strings: pa.Array) -> np.ndarray:
    """Hashes of a binary or string array without nulls."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    strings = strings.cast(pa.large_binary())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return span_hashes(np.frombuffer(strings.buffers()[2] or b"", np.uint8), offsets[:-1], offsets[1:])


def phrase_hashes(*words: np.ndarray) -> np.ndarray:
    """A hash of each row's words in their order, from the hashes of the words."""
    total = words[0] * _PLACE[0]
    for place, word in enumerate(words[1:], 1):
        total = total + word * _PLACE[place]
    return mixed(total + np.uint64(len(words)))


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a bitmap may hold: all that were put in, and a few others."""
    slots = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def build_bitmap(rows: DataFrame, columns: list[str], hashes: Callable, bits: int) -> np.ndarray:
    """A bitmap of 2^``bits`` bits with one set for each row of ``rows``.

    ``hashes`` turns the Arrow ``columns`` into 64-bit numbers. Bits are put together by the
    executors; the driver receives 2^(bits - 6) numbers at most, however many rows there are.
    """
    size = 1 << (bits - 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.uint64)
        for batch in batches:
            slots = hashes(*(batch.column(c) for c in columns)) & np.uint64((size << 6) - 1)
            np.bitwise_or.at(own, slots >> np.uint64(6), np.uint64(1) << (slots & np.uint64(63)))
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(own[used].view(np.int64))], ["word", "bits"])

    parts = rows.select(*columns).mapInArrow(run, "word long, bits long")
    found = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out
