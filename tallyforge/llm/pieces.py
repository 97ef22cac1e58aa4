"""SentencePiece encoding and decoding, with a max-plus scan over chunks of giant documents.

A BPE segmentation is the one path of pieces through a text in which each two neighbours
would also come out apart if they were encoded alone. So it can be written as a best path
in the max-plus semiring: a state at a boundary is the piece that spans or ends at it, a step
costs one piece, and what cannot follow is minus infinity. A chunk of a giant document
yields the matrix of costs from each state at its first boundary to each at its last. The
matrices are multiplied in any grouping: within blocks of chunks, then over a document's
blocks. With the states at its two boundaries known, each chunk is traced back alone.

Between the first and the last word that begin in a chunk no piece crosses a word's
beginning; that part has one state at both ends, and the library encodes it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyforge.llm.common import small_batches, stage, text_bytes

MARK = "▁"
CHUNK = 65_536
BLOCK = 64
START = 0  # the state before a document's first piece
_WORD = re.compile(f"(?<!{MARK}){MARK}")


class Vocabulary:
    """A BPE model with byte fallback whose pieces hold a word's mark only at their beginning."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, size = self.library, self.library.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(size)]
        self.ids = {n: i for i, (n, s) in enumerate(zip(names, special, strict=True)) if not s}
        self.scores = {n: lib.get_score(i) for n, i in self.ids.items()}
        self.bytes = {int(n[3:5], 16): i for i, n in enumerate(names) if lib.is_byte(i)}
        self.longest = max(map(len, self.ids), default=1)
        if len(self.bytes) < 256 or any(MARK in n.lstrip(MARK) for n in self.ids):
            raise ValueError("the model needs byte fallback and pieces that stay within a word")
        if lib.normalize(" a  b ") != f"{MARK}{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("the model must keep all spaces and put one before a text")
        self.apart = lru_cache(1 << 18)(self._apart)

    def merge(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, the leftmost first, until none is a piece."""
        parts = list(text)
        while True:
            best = max(
                ((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores),
                default=None,
            )
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _apart(self, left: str, right: str) -> bool:
        return self.merge(left + right) == [left, right]

    def numbers(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[b] for b in piece.encode()]

    def encode_words(self, text: str) -> list[int]:
        """Ids of a normalised text that begins with a word's mark."""
        return self.library.encode(text[1:].replace(MARK, " ")) if len(text) > 1 else self.numbers(text)


class Chunk:
    """A stretch of a normalised text with enough on both sides to see the pieces that cross.

    A state at a boundary is ``length << 8 | overhang`` of the piece that begins before it.
    """

    def __init__(self, vocabulary: Vocabulary, text: str, low: int, high: int, first: bool, last: bool):
        self.v, self.text, self.low, self.high = vocabulary, text, low, high
        self.first, self.last = first, last
        words = [m.start() for m in _WORD.finditer(text, low, high)]
        inner = [w for w in words if w >= low + vocabulary.longest]
        self.words = (inner[0], inner[-1]) if len(inner) > 1 else None

    def states(self, at: int, end: bool) -> list[int]:
        """The pieces that begin before a boundary and reach it."""
        if at == self.low and self.first:
            return [START]
        out = []
        for length in range(1, self.v.longest + 1):
            for over in range(length):
                a, b = at + over - length, at + over
                if a < 0 or b > len(self.text) or (end and self.last and over):
                    continue
                if length == 1 or self.text[a:b] in self.v.ids:
                    out.append(length << 8 | over)
        return out

    def _paths(self, begin: int, piece: str, until: int) -> dict[int, tuple[int, str]]:
        """By end, where the one piece begins that may end there on a path from ``piece``."""
        found = {begin: (begin - len(piece), piece)}
        text, ids, longest, apart = self.text, self.v.ids, self.v.longest, self.v.apart
        for stop in range(begin + 1, until + 1):
            for start in range(stop - 1, max(begin, stop - longest) - 1, -1):
                before = found.get(start)
                if before is None:
                    continue
                new = text[start:stop]
                if (stop - start == 1 or new in ids) and (not before[1] or apart(before[1], new)):
                    found[stop] = (start, new)
                    break
        return found

    def _entry(self, state: int) -> tuple[int, str]:
        over, length = state & 255, state >> 8
        return self.low + over, self.text[self.low + over - length : self.low + over]

    def _trace(self, found: dict, begin: int, end: int) -> list[str]:
        out = []
        while end > begin:
            end, piece = found[end]
            out.append(piece)
        return out[::-1]

    def _exits(self, found: dict, begin: int, piece: str) -> dict[int, tuple[int, str]]:
        """Exit states that a path reaches: where their piece begins, and the piece."""
        out = {}
        for state in self.states(self.high, True):
            over, length = state & 255, state >> 8
            start = self.high + over - length
            new = self.text[start : self.high + over]
            before = found.get(start)
            if start >= begin and before is not None and (not before[1] or self.v.apart(before[1], new)):
                out[state] = (start, new)
            elif start < begin and begin == self.high + over and new == piece:
                out[state] = (begin, "")  # the entry's piece spans the whole chunk
        return out

    def matrix(self) -> list[tuple[int, int, int]]:
        """(entry, exit, minus the pieces that begin in the chunk) wherever a path exists."""
        out, middle, tail = [], 0, None
        if self.words:
            p, q = self.words
            middle = self._count(p, q)
            found = self._paths(q, "", self.high)
            tail = {s: len(self._trace(found, q, a)) + 1 for s, (a, _) in self._exits(found, q, "").items()}
        for entry in self.states(self.low, False):
            begin, piece = self._entry(entry)
            if self.words:
                p = self.words[0]
                found = self._paths(begin, piece, p)
                if p in found:
                    head = len(self._trace(found, begin, p))
                    out += [(entry, s, -(head + middle + n)) for s, n in tail.items()]
                continue
            found = self._paths(begin, piece, self.high)
            for s, (a, new) in self._exits(found, begin, piece).items():
                out.append((entry, s, -(len(self._trace(found, begin, a)) + bool(new))))
        return out

    def _count(self, low: int, high: int) -> int:
        return len(self.v.encode_words(self.text[low:high]))

    def ids(self, entry: int, leave: int) -> list[int]:
        """Ids of the pieces that begin in the chunk on the path between two states."""
        begin, piece = self._entry(entry)
        out: list[int] = []
        if self.words:
            p, q = self.words
            out += self._numbers(self._trace(self._paths(begin, piece, p), begin, p))
            out += self.v.encode_words(self.text[p:q])
            begin, piece = q, ""
        found = self._paths(begin, piece, self.high)
        start, new = self._exits(found, begin, piece)[leave]
        out += self._numbers(self._trace(found, begin, start))
        return out + (self.v.numbers(new) if new else [])

    def _numbers(self, parts: list[str]) -> list[int]:
        return [i for part in parts for i in self.v.numbers(part)]


# ---------------------------------------------------------------- max-plus products

Matrix = dict[int, dict[int, int]]


def product(left: Matrix, right: Matrix) -> Matrix:
    """The max-plus product of two sparse matrices; what is missing is minus infinity."""
    out: Matrix = {}
    for a, row in left.items():
        best: dict[int, int] = {}
        for b, cost in row.items():
            for c, more in right.get(b, {}).items():
                if c not in best or cost + more > best[c]:
                    best[c] = cost + more
        if best:
            out[a] = best
    return out


def boundary_states(matrices: list[Matrix], entry: int, leave: int | None) -> list[tuple[int, int]]:
    """(entry, exit) of each matrix on the best path; ``leave`` None takes the best last state."""
    forward = [{entry: 0}]
    for m in matrices:
        forward.append(product({0: forward[-1]}, m).get(0, {}))
    if leave is None:
        leave = max(forward[-1], key=lambda s: (forward[-1][s], -s))
    out = []
    for m, before in zip(reversed(matrices), reversed(forward[:-1]), strict=True):
        reach = [(before[a] + row[leave], -a) for a, row in m.items() if a in before and leave in row]
        entry = -max(reach)[1]
        out.append((entry, leave))
        leave = entry
    return out[::-1]


def _matrix(entries: list[dict]) -> Matrix:
    out: Matrix = {}
    for e in entries:
        out.setdefault(e["a"], {})[e["b"]] = e["cost"]
    return out


CELLS = "array<struct<a:int,b:int,cost:long>>"
_CELL_KIND = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64())]))


def _cells(matrix: Matrix) -> list[dict]:
    return [{"a": a, "b": b, "cost": cost} for a, row in matrix.items() for b, cost in row.items()]


# ---------------------------------------------------------------- Spark jobs


def _split(model: bytes, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model)
        side = 2 * v.longest
        for batch in batches:
            for key, raw in zip(batch.column("key").to_pylist(), text_bytes(batch.column("text")), strict=True):
                text = v.library.normalize(raw.as_py().decode())
                starts = list(range(0, len(text), size))
                for number, low in enumerate(starts):
                    high = min(low + size, len(text))
                    left = max(0, low - side)
                    row = (key, number, text[left : high + side], low - left, high - left, high == len(text))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], k) for x, k in zip(row, _CHUNK_KINDS, strict=True)], _CHUNK_NAMES
                    )

    return run


_CHUNK_NAMES = ["key", "chunk", "body", "low", "high", "last"]
_CHUNK_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
_CHUNK_SCHEMA = "key long, chunk long, body string, low int, high int, last boolean"


def _chunk(v: Vocabulary, row: dict) -> Chunk:
    return Chunk(v, row["body"], row["low"], row["high"], row["chunk"] == 0, row["last"])


def _matrices(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model)
        for batch in batches:
            for row in batch.to_pylist():
                cells = [{"a": a, "b": b, "cost": c} for a, b, c in _chunk(v, row).matrix()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["key"]]), pa.array([row["chunk"]]), pa.array([cells], _CELL_KIND)],
                    ["key", "chunk", "cells"],
                )

    return run


def _multiply(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
    matrix = _matrix(rows[0]["cells"])
    for row in rows[1:]:
        matrix = product(matrix, _matrix(row["cells"]))
    return pa.table(
        {"key": [rows[0]["key"]], "block": pa.array([rows[0]["block"]], pa.int64()), "cells": pa.array([_cells(matrix)], _CELL_KIND)}
    )


def _resolve(number: str):
    """Boundary states of a group's matrices, in order, between its own entry and exit."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r[number])
        entry, leave = rows[0].get("entry", START), rows[0].get("leave")
        found = boundary_states([_matrix(r["cells"]) for r in rows], entry, leave)
        return pa.table(
            {
                "key": pa.array([r["key"] for r in rows], pa.int64()),
                number: pa.array([r[number] for r in rows], pa.int64()),
                "entry": pa.array([a for a, _ in found], pa.int32()),
                "leave": pa.array([b for _, b in found], pa.int32()),
            }
        )

    return run


def _backtrace(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model)
        for batch in batches:
            for row in batch.to_pylist():
                ids = _chunk(v, row).ids(row["entry"], row["leave"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["key"]]), pa.array([row["chunk"]]), pa.array([ids], pa.list_(pa.int32()))],
                    ["key", "chunk", "ids"],
                )

    return run


def _encode_whole(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model)
        for batch in batches:
            row = batch.column("row")
            texts = [t.as_py().decode() for t in text_bytes(row.field("text"))]
            ids = v.library.encode(texts, num_threads=1) if texts else []
            yield pa.RecordBatch.from_arrays([row, pa.array(ids, pa.list_(pa.int32()))], ["row", "ids"])

    return run


def encode_chunks(texts: DataFrame, model: bytes, size: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(key, ids) of ``texts`` (key, text) by the scan over chunks; keys are unique."""
    small_batches(texts.sparkSession)
    split = texts.mapInArrow(_split(model, size), _CHUNK_SCHEMA)
    chunks = stage(split.repartition("key", "chunk"), "chunks")
    cells = stage(chunks.mapInArrow(_matrices(model), f"key long, chunk long, cells {CELLS}"), "matrices")
    cells = cells.withColumn("block", F.floor(F.col("chunk") / block))
    products = cells.groupBy("key", "block").applyInArrow(_multiply, f"key long, block long, cells {CELLS}")
    outer = products.groupBy("key").applyInArrow(_resolve("block"), "key long, block long, entry int, leave int")
    inner = (
        cells.join(outer, ["key", "block"])
        .groupBy("key", "block")
        .applyInArrow(_resolve("chunk"), "key long, chunk long, entry int, leave int")
    )
    traced = chunks.join(inner, ["key", "chunk"]).mapInArrow(
        _backtrace(model), "key long, chunk long, ids array<int>"
    )
    parts = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    return traced.groupBy("key").agg(F.flatten(parts["ids"]).alias("ids"))


def encode(docs: DataFrame, model: bytes, size: int = CHUNK) -> DataFrame:
    """(row, ids): every row of ``docs`` as a struct with the ids of its whole text.

    The ids are those of the model's own library. Texts of more than ``size`` characters go
    through the scan. A null or empty text has no ids; repeated rows have equal ones; an empty
    table gives an empty result, and other columns stay in ``row``.
    """
    small_batches(docs.sparkSession)
    length = F.coalesce(F.length("text"), F.lit(0))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    short = docs.where(length <= size).select(F.struct("*").alias("row")).mapInArrow(_encode_whole(model), schema)
    giant = docs.where(length > size).select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row"))
    giant = stage(giant, "giants")
    found = encode_chunks(giant.select("key", F.col("row.text").alias("text")), model, size)
    return short.unionByName(giant.join(found, "key").select("row", "ids"))


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``encoded`` (ids and any other columns) with the text that the ids stand for, ``decoded``.

    Null ids give null, no ids an empty text; bytes that are no UTF-8 become U+FFFD.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Vocabulary(model).library
        for batch in batches:
            texts = [None if ids is None else library.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"]
            )

    small_batches(encoded.sparkSession)
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
