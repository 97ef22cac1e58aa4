"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

Ranking every byte position would move a multiple of the text through each sort. Every
string of ``length`` bytes holds the least hashed 16-byte gram among its first places, its
anchor, and equal strings have it at the same place; so only anchors are ranked, about one
position in eighteen, and the string starts that share an anchor form a run.

1. Offset 16: Spark sorts (gram rank, ranks of both extensions, run rank, doc_id). A gram
   that occurs once settles its whole run. A run whose full rank occurs in a smaller document is covered.
2. Offset 33: runs left stay only on a side (17 bytes before or after the gram) whose
   rank occurs again under the same gram; the others are unique from there on.
3. Offset 50, the threshold: the starts left are sorted by side and the rank of their whole
   string, and those whose string starts in a smaller document are covered. Where a side has
   many runs, the least document of each string rank is joined back instead.

Ranks are fingerprints of the bytes: 48 bits of the gram and 80 of the run in the first
sort, 128 in the last, so no table of ranks has to be carried from one offset to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyforge.llm.common import byte_slices, discard, small_batches, stage, text_bytes

GRAM = 16
CHUNK = 1 << 19
GROUP_ROWS = 1 << 18
SIDE_RANKS = (1 << 14) - 1
STRINGS = 4096
# A side with more runs is ranked by its whole strings in a shuffle, not within one task.
SIDE_ROWS = 2048
HOT = 1 << 20
_POSITION = np.uint64((1 << 20) - 1)
_ODD = 0x9E3779B97F4A7C15
_ODD_2 = 0xD6E8FEB86659FD93


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(32))


class SubstringHash:
    """Hashes of any substring of a buffer from one running sum."""

    def __init__(self, size: int, base: int = _ODD, seed: int = 7):
        self.table = np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)
        self.power = _powers(base, size + 1)
        self.inverse = _powers(pow(base, -1, 1 << 64), size + 1)

    def load(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])

    def all(self, length: int) -> np.ndarray:
        count = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:count]) * self.inverse[:count])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Runs:
    """Anchored runs of the strings of ``length`` bytes in a buffer of whole pieces."""

    def __init__(self, length: int):
        if length < GRAM + 2:
            raise ValueError(f"strings need at least {GRAM + 2} bytes")
        self.length = length
        self.width = length - GRAM + 1
        self.left = (self.width - 1) // 2
        self.right = self.width - 1 - self.left
        self.hash = SubstringHash(2 * CHUNK + length)

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        """Runs of the pieces that end at ``ends``; a piece has at least ``length`` bytes."""
        hashes = self.hash
        hashes.load(data)
        gram = hashes.all(GRAM)
        place = np.arange(len(gram), dtype=np.uint64)
        least = _sliding_min((gram & ~_POSITION) | place, self.width)
        anchor = (least & _POSITION).astype(np.int64)
        usable = np.ones(len(anchor) + self.length, bool)
        usable[(ends[:, None] - np.arange(1, self.length)).ravel()] = False
        usable = usable[: len(anchor)]
        new = np.append(True, (anchor[1:] != anchor[:-1]) | ~usable[:-1])
        starts = np.flatnonzero(new & usable)
        stops = np.flatnonzero(np.append(new | ~usable, True))
        stops = stops[np.searchsorted(stops, starts, side="right")]
        at, count = anchor[starts], stops - starts
        limit = ends[np.searchsorted(ends, starts, side="right")]
        begin = np.append(0, ends)[np.searchsorted(ends, starts, side="right")]
        with np.errstate(over="ignore"):
            whole = _mix(
                hashes(starts, count - 1 + self.length)
                + ((at - starts) * 64 + count).astype(np.uint64) * np.uint64(_ODD_2)
            )
            after = self._side(at + GRAM, self.right, at + GRAM + self.right <= limit)
            before = self._side(at - self.left, self.left, at - self.left >= begin)
        low16 = np.uint64(0xFFFF)
        return {
            "start": starts,
            "count": count,
            "anchor": at,
            "gram": (gram[at] & ~low16) | (whole & low16),
            "context": (after << np.uint64(50)) | (before << np.uint64(36)) | (whole >> np.uint64(28)),
        }

    def _side(self, start: np.ndarray, length: int, fits: np.ndarray) -> np.ndarray:
        """14 bits of a side's rank from 1; 0 where the piece ends before the side does."""
        found = self.hash(np.where(fits, start, 0), np.where(fits, length, 0))
        return np.where(fits, found % np.uint64(SIDE_RANKS) + np.uint64(1), np.uint64(0))


def _pieces(texts: list[memoryview], length: int) -> Iterator[list[tuple[int, int, memoryview]]]:
    """(text number, offset, bytes) in chunks; long texts are cut with ``length - 1`` bytes shared."""
    chunk, size = [], 0
    for number, raw in enumerate(texts):
        for start in range(0, len(raw) - length + 1, CHUNK):
            part = raw[start : start + CHUNK + length - 1]
            if chunk and size + len(part) > CHUNK:
                yield chunk
                chunk, size = [], 0
            chunk.append((number, start, part))
            size += len(part)
    if chunk:
        yield chunk


RUN_SCHEMA = "gram long, context long, doc_id long, place long"
COVERED = 1 << 62
TAGS = 1 << 19


def pack_place(tag, start, shift, count):
    """A run of starts in one number: the text's tag, first start, way to the anchor, count."""
    return (tag << 43) | (start << 12) | (shift << 6) | count


def place_start(place):
    return (place >> 12) & 0x7FFFFFFF


def _find_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(length)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for low, high in byte_slices(texts):
                ids = batch.column("doc_id")[low:high].to_numpy()
                tags = batch.column("tag")[low:high].to_numpy()
                order = np.argsort(ids, kind="stable")
                raw = [memoryview(texts[low + int(i)].as_buffer()) for i in order]
                yield _slice_runs(runs, raw, ids[order], tags[order])

    return run


def _slice_runs(runs: Runs, texts, ids, tags) -> pa.RecordBatch:
    """Runs of some texts in order of doc_id; whole runs seen in a smaller one are covered."""
    found: dict[str, list[np.ndarray]] = {}
    for chunk in _pieces(texts, runs.length):
        data = np.frombuffer(b"".join(p[2] for p in chunk), np.uint8)
        ends = np.cumsum([len(p[2]) for p in chunk])
        got = runs(data, ends)
        piece = np.searchsorted(ends, got["start"], side="right")
        number = np.array([p[0] for p in chunk])[piece]
        offset = np.array([p[1] for p in chunk])[piece] - (np.append(0, ends)[piece])
        start = got.pop("start")
        shift = got.pop("anchor") - start
        got["place"] = pack_place(tags[number], start + offset, shift, got.pop("count"))
        got["doc_id"] = ids[number]
        for name, values in got.items():
            found.setdefault(name, []).append(values)
    names = ["gram", "context", "doc_id", "place"]
    if not found:
        empty = np.zeros(0, np.int64)
        columns = [empty] * 4
    else:
        columns = [np.concatenate(found[n]).view(np.int64) for n in names]
        gram, context, doc = columns[:3]
        order = np.argsort(gram ^ (context * 0x9E3779B1), kind="stable")
        g, c, d = gram[order], context[order], doc[order]
        fresh = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))
        least = d[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        place = columns[3].copy()
        place[order] += np.where(least < d, COVERED, 0)
        columns[3] = place
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


SETTLED = "doc_id long, place long, gram long, left long, right long"


def _shared(group: np.ndarray, side: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose side's rank occurs in more than one run of the group, and in more than SIDE_ROWS
    rows; 0 is no rank."""
    order = np.lexsort((run, side, group))
    g, s, r = group[order], side[order], run[order]
    fresh = np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]))
    other = np.append(False, (r[1:] != r[:-1])) & ~fresh
    number = np.cumsum(fresh) - 1
    many = np.bincount(number, other, minlength=number[-1] + 1) > 0
    shared, hot = np.zeros(len(group), bool), np.zeros(len(group), bool)
    shared[order] = many[number] & (s != 0)
    hot[order] = np.bincount(number)[number] > SIDE_ROWS
    return shared, hot


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by gram, context and doc_id: covered ones and those that stay open.

    An open run carries its gram and the rank of each side that occurs again (else 0); a
    covered one has -1 there. HOT marks a side of many runs. The rows of one gram are held
    together up to GROUP_ROWS; of a larger group both sides of every run stay open, as hot ones.
    """
    names = ("gram", "context", "doc_id", "place")
    held = np.zeros((4, 0), np.int64)
    last = None  # gram, context and first doc_id of the row before what is held
    giant = None  # the gram of a group that is too large to be held

    def work(rows: np.ndarray) -> pa.RecordBatch:
        nonlocal last
        gram, context, doc, place = rows
        fresh = np.append(True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]))
        first = doc.copy()
        if last and last[:2] == (gram[0], context[0]):
            first[0] = last[2]
        least = first[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        last = (gram[-1], context[-1], least[-1])
        covered = (least < doc) | (place >= COVERED)
        place = place & (COVERED - 1)
        key = gram >> 16
        before, after = (context >> 36) & SIDE_RANKS, (context >> 50) & SIDE_RANKS
        left, right = np.zeros_like(gram), np.zeros_like(gram)
        rest = np.flatnonzero(~covered)
        if len(rest):
            run, wide = np.cumsum(fresh)[rest], key[rest] == giant
            for side, out in ((before[rest], left), (after[rest], right)):
                shared, hot = _shared(key[rest], side, run)
                named = np.where(wide | hot, side | HOT, side)
                out[rest] = np.where((wide & (side > 0)) | shared, named, 0)
        keep = covered | (left > 0) | (right > 0)
        left, right = np.where(covered, -1, left), np.where(covered, -1, right)
        columns = [doc[keep], place[keep], key[keep], left[keep], right[keep]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], ["doc_id", "place", "gram", "left", "right"]
        )

    for batch in batches:
        rows = np.stack([batch.column(n).to_numpy() for n in names])
        held = np.concatenate([held, rows], axis=1)
        key = held[0] >> 16
        before = np.flatnonzero(key != key[-1]) if len(key) else []
        cut = before[-1] + 1 if len(before) else 0
        if held.shape[1] - cut >= GROUP_ROWS:
            giant, cut = key[-1], held.shape[1]
        if cut >= 1 << 15:
            yield work(held[:, :cut])
            held = held[:, cut:]
    if held.shape[1]:
        yield work(held)


OPEN_SCHEMA = "high long, low long, doc_id long, place long, body binary"


class StringRanks:
    """128-bit ranks of the strings of ``length`` bytes in up to STRINGS runs of starts."""

    def __init__(self, length: int):
        self.length = length
        size = STRINGS * 2 * length  # a run has fewer starts than a string has bytes
        self.first, self.second = SubstringHash(size), SubstringHash(size, _ODD_2, 11)

    def __call__(self, bodies: list[bytes]) -> tuple[np.ndarray, ...]:
        """(number of the body, place in it, high, low) of every string."""
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        counts = sizes - self.length + 1
        number = np.repeat(np.arange(len(bodies)), counts)
        inner = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = (np.cumsum(sizes) - sizes)[number] + inner
        data = np.frombuffer(b"".join(bodies), np.uint8)
        self.first.load(data)
        self.second.load(data)
        high, low = (h(at, self.length).view(np.int64) for h in (self.first, self.second))
        return number, inner, high, low


def _open_rows(length: int):
    """Open runs, once for each side that is still shared.

    A run of an ordinary side is a row with the side and the bytes of its starts. A hot side
    is dealt finer: each start is a row with the rank of its whole string and no bytes.
    """
    left = (length - GRAM) // 2
    ranks = StringRanks(length)

    def rows_of(runs: list[tuple], hot: list[tuple]) -> pa.RecordBatch:
        side, docs, places, bodies = zip(*runs, strict=True) if runs else ((), (), (), ())
        columns = [np.array(c, np.int64) for c in (side, [0] * len(side), docs, places)]
        if hot:
            hot_docs, hot_places, strings = zip(*hot, strict=True)
            number, inner, high, low = ranks(list(strings))
            at = np.array(hot_places, np.int64)[number] + (inner << 12)
            more = [high, low, np.array(hot_docs, np.int64)[number], at]
            columns = [np.concatenate(c) for c in zip(columns, more, strict=True)]
        body = pa.array([*bodies, *([None] * (len(columns[0]) - len(bodies)))], pa.binary())
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, columns), body], ["high", "low", "doc_id", "place", "body"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple] = []
        hot: list[tuple] = []
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            tags = batch.column("tag").to_pylist()
            opens = batch.column("opens").to_pylist()
            for doc, tag, raw, found in zip(ids, tags, texts, opens, strict=True):
                raw = raw.as_py()
                for row in found:
                    start, count = place_start(row["place"]), row["place"] & 63
                    # Starts before `split` hold the left side whole, those from it on the right one.
                    split = start + (row["place"] >> 6 & 63) - left
                    for bit, rank, low, high in (
                        (0, row["left"], start, min(start + count, split)),
                        (1, row["right"], max(start, split), start + count),
                    ):
                        if rank <= 0 or low >= high:
                            continue
                        body = raw[low : high - 1 + length]
                        if rank & HOT:
                            hot.append((doc, pack_place(tag, low, 0, 1), body))
                        else:
                            side = (row["gram"] << 15) + (rank << 1) + bit
                            runs.append((side, doc, pack_place(tag, low, 0, high - low), body))
                    if len(hot) >= STRINGS - 1 or len(runs) >= STRINGS:
                        yield rows_of(runs, hot)
                        runs, hot = [], []
        if runs or hot:
            yield rows_of(runs, hot)

    return run


def _repeated_strings(length: int):
    """Starts whose whole string came before in a smaller document, from rows by side and doc_id.

    The strings of one side, of at most SIDE_ROWS runs, are held together.
    """
    ranks = StringRanks(length)

    def work(rows: list[tuple], seen: dict) -> tuple[list, list]:
        number, inner, high, low = (c.tolist() for c in ranks([r[3] for r in rows]))
        docs, places = [], []
        for n, i, x, y in zip(number, inner, high, low, strict=True):
            side, doc, place, _ = rows[n]
            if seen.setdefault((side, x, y), doc) < doc:
                docs.append(doc)
                places.append(place + (i << 12) - (place & 63) + 1)
        return docs, places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("high", "doc_id", "place", "body")]
            rows = list(zip(*columns, strict=True))
            for low in range(0, len(rows), STRINGS):
                part = rows[low : low + STRINGS]
                docs, places = work(part, seen)
                now = part[-1][0]
                seen = {k: v for k, v in seen.items() if k[0] == now}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(places, pa.int64())], ["doc_id", "place"]
                )

    return run


def _covered_starts(starts: DataFrame) -> DataFrame:
    """(doc_id, place) of starts whose rank is also that of a smaller document.

    The least and the largest document of a rank are found with partial sums in every task, and
    only ranks of several documents are joined back, so no task holds what shares a gram or a
    string; adaptive execution splits a rank that many starts have.
    """
    ranks = starts.groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = ranks.where("least < most").drop("most")
    return starts.join(shared, ["high", "low"]).where("doc_id > least").select("doc_id", "place")


def spans_of(places: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes from runs of covered starts; overlapping and touching ones meet."""
    merged: list[list[int]] = []
    for start, count in sorted((place_start(p), p & 63) for p in places):
        stop = start + count - 1 + length
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    return [(a, b) for a, b in merged]


def _cut(length: int, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            row = batch.column("row")
            texts = text_bytes(row.field("text"))
            places = batch.column("places").to_pylist()
            spans, kept = [], []
            for raw, found in zip(texts, places, strict=True):
                raw, found = raw.as_py(), spans_of(found or [], length)
                at, parts = 0, []
                for start, stop in found:
                    parts.append(raw[at:start])
                    at = stop
                spans.append([{"start": a, "stop": b} for a, b in found])
                rest = b"".join([*parts, raw[at:]])
                kept.append(rest.decode(errors="ignore") if as_text else rest)
            column = pa.array(kept, pa.string() if as_text else pa.binary())
            yield pa.RecordBatch.from_arrays([row, pa.array(spans, kind), column], ["row", "spans", "kept"])

    return run


def _tag(text):
    return F.pmod(F.xxhash64(text), F.lit(TAGS)).cast("long")


def repeated_places(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, tag, places): runs of starts whose string also starts in a smaller document.

    ``docs`` has doc_id and text. Strings are judged on the input; texts of one doc_id in
    several rows do not cover each other, and the tag (of the text) tells them apart.
    """
    small_batches(docs.sparkSession)
    usable = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    usable = usable.select("doc_id", _tag("text").alias("tag"), "text")
    order = ["gram", "context", "doc_id", "place"]
    # Runs covered within their slice stand in for no other; any task may pass them on.
    deal = F.when(F.col("place") >= COVERED, F.xxhash64("doc_id", "place")).otherwise(
        F.shiftright("gram", 16)
    )
    settled = stage(
        usable.mapInArrow(_find_runs(length), RUN_SCHEMA)
        .repartition(deal).sortWithinPartitions(*order)
        .mapInArrow(_settle, SETTLED),
        "settled",
    )
    tag = F.shiftright("place", 43).alias("tag")
    opens = settled.where("left >= 0").groupBy("doc_id", tag).agg(
        F.collect_list(F.struct("place", "gram", "left", "right")).alias("opens")
    )
    opened = stage(
        usable.join(opens, ["doc_id", "tag"]).mapInArrow(_open_rows(length), OPEN_SCHEMA), "opened"
    )
    repeated = (
        opened.where("body is not null")
        .repartition("high").sortWithinPartitions("high", "doc_id")
        .mapInArrow(_repeated_strings(length), "doc_id long, place long")
        .unionByName(_covered_starts(opened.where("body is null")))
    )
    found = settled.where("left < 0").select("doc_id", "place").unionByName(repeated)
    places = stage(found.groupBy("doc_id", tag).agg(F.collect_list("place").alias("places")), "places")
    discard(settled, opened)
    return places


def remove_repeats(docs: DataFrame, length: int = 50, as_text: bool = False) -> DataFrame:
    """(row, spans, kept): every row of ``docs`` as a struct, its removed byte spans, its rest.

    The rest is bytes, or with ``as_text`` a string, without characters that have lost a byte.

    Each byte of a string of ``length`` bytes that also starts in a document with a smaller
    doc_id is removed. A null text is an empty one; rows without doc_id neither lose bytes nor
    cover others. An empty table gives an empty result; other columns stay in ``row``.
    """
    places = repeated_places(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length)
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _tag("text").alias("tag")
    )
    joined = rows.join(places, ["doc_id", "tag"], "left").select("row", "places")
    schema = T.StructType(
        [
            T.StructField("row", docs.schema),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "stop")]))),
            T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
        ]
    )
    return joined.mapInArrow(_cut(length, as_text), schema)

