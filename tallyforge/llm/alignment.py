"""Alignment of two tokenizers' tokens by diagonal run skipping.

The tokens of one text under two tokenizers end at increasing byte offsets. At a pair of
indices whose ends agree, exponential probing compares the two end arrays at their current
index shift and jumps over the whole one-to-one stretch. Where it stops, an irregular group is
resolved token by token, which updates the shift. Every step of it is one pair of tokens that
overlap, every agreement ends a group.

How often two ids are linked is counted over the corpus. Documents keep their distinct linked
pairs; the commonest pairs, a fixed number at most, are looked up in their tasks, the rest
through a shuffle join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyforge.llm.common import byte_slices, small_batches, stage, text_bytes
from tallyforge.llm.packing import Encoder, byte_ranks
from tallyforge.llm.pieces import MARK, Vocabulary

SLICE_BYTES = 4 << 20
WINDOW = 1 << 20  # ends of each side that are Python numbers at a time
HEAD_PAIRS = 1 << 18  # pairs of ids that are looked up in tasks, at most


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The groups' last tokens in A and in B, and the links within irregular groups (A, B).

    Both arrays increase strictly and have the same last end. The last tokens of a group are
    linked as well; those links are not repeated in the second pair of arrays.
    """
    runs: list[tuple[int, int, int]] = []
    links_a: list[int] = []
    links_b: list[int] = []
    i = j = 0
    while i < len(ends_a):
        part_a, part_b = ends_a[i : i + WINDOW], ends_b[j : j + WINDOW]
        raw_a, raw_b = part_a.tobytes(), part_b.tobytes()
        list_a, list_b = part_a.tolist(), part_b.tolist()
        width, size_a, size_b = part_a.itemsize, len(list_a), len(list_b)
        a = b = 0
        while a < size_a and b < size_b:
            if list_a[a] == list_b[b]:
                # At this shift: double the stretch while it agrees, then halve down to its end.
                most = min(size_a - a, size_b - b)
                length, step = 1, 1
                while step and length < most:
                    step = min(step, most - length)
                    low_a, low_b, size = (a + length) * width, (b + length) * width, step * width
                    if raw_a[low_a : low_a + size] == raw_b[low_b : low_b + size]:
                        length += step
                        step <<= 1
                    else:
                        step >>= 1
                        break
                while step:
                    low_a, low_b, size = (a + length) * width, (b + length) * width, step * width
                    if length + step <= most and raw_a[low_a : low_a + size] == raw_b[low_b : low_b + size]:
                        length += step
                    step >>= 1
                runs.append((i + a, j + b, length))
                a += length
                b += length
                continue
            end_a, end_b = list_a[a], list_b[b]
            while end_a != end_b:
                links_a.append(i + a)
                links_b.append(j + b)
                if end_a < end_b:
                    a += 1
                    if a == size_a:
                        break
                    end_a = list_a[a]
                else:
                    b += 1
                    if b == size_b:
                        break
                    end_b = list_b[b]
        i, j = i + a, j + b
    first_a, first_b, sizes = np.array(runs, np.int64).reshape(-1, 3).T
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return (
        np.repeat(first_a, sizes) + within,
        np.repeat(first_b, sizes) + within,
        np.array(links_a, np.int64),
        np.array(links_b, np.int64),
    )


class PieceEncoder:
    """Ids of a SentencePiece model for spaced texts; a slice's distinct words are encoded once.

    No piece goes on over the beginning of a word's first space, so words can be told apart.
    """

    def __init__(self, model: bytes):
        self.vocabulary = Vocabulary(model)
        self.library = self.vocabulary.library

    def token_bytes(self) -> list[bytes]:
        library, out = self.library, []
        for i in range(library.get_piece_size()):
            name = library.id_to_piece(i)
            out.append(bytes([int(name[3:5], 16)]) if library.is_byte(i) else name.replace(MARK, " ").encode())
        return out

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts between ``bounds``, each with a space before it, and where each's end."""
        space = data == 32
        cut = np.append(space, True)
        cut[1:-1] &= ~space[:-1]
        cut[bounds] = True
        cuts = np.flatnonzero(cut)
        words = pa.Array.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]
        ).dictionary_encode()
        texts = [w[1:].decode() for w in words.dictionary.to_pylist()]
        found = self.library.encode(texts, num_threads=1) if texts else []
        lone = self.vocabulary.numbers(MARK)
        found = [own if text else lone for own, text in zip(found, texts, strict=True)]
        sizes = np.array([len(own) for own in found], np.int64)
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        codes = words.indices.to_numpy()
        each = sizes[codes]
        until = np.cumsum(each)
        places = np.repeat((np.cumsum(sizes) - sizes)[codes] - (until - each), each) + np.arange(int(each.sum()))
        return ids[places], np.append(0, until)[np.searchsorted(cuts, bounds[1:])]


class Aligner:
    """Aligns the tokens of a slice of texts."""

    def __init__(self, tokenizer_json: str, model: bytes):
        self.encode_a, self.encode_b = Encoder(tokenizer_json), PieceEncoder(model)
        ranks = byte_ranks(tokenizer_json)
        names = [b""] * (max(ranks.values()) + 1)
        for token, number in ranks.items():
            names[number] = token
        self.bytes_a = pa.array(names, pa.large_binary())
        self.bytes_b = pa.array(self.encode_b.token_bytes(), pa.large_binary())
        self.size_a = pa.compute.binary_length(self.bytes_a).to_numpy()
        self.size_b = pa.compute.binary_length(self.bytes_b).to_numpy()
        self.pair_base = len(self.bytes_b)
        # A token's decimal id behind what separates it: nothing, a comma, a bar or a semicolon.
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.written = pa.array([f"{mark}{n}" for mark in ("", ",", "|", ";") for n in range(most)], pa.large_string())
        self.written_base = most

    def _faithful(self, names: pa.Array, ids: np.ndarray, ends: np.ndarray, data: np.ndarray, bounds: np.ndarray):
        """Which texts the tokens' bytes spell."""
        joined = names.take(pa.array(ids))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[: len(ids) + 1]
        spelt = np.frombuffer(joined.buffers()[2] or b"", np.uint8)
        until = offsets[np.append(0, ends)]
        same = np.diff(until) == np.diff(bounds)
        if same.all() and np.array_equal(spelt[: until[-1]], data):
            return same
        for k in np.flatnonzero(same).tolist():
            same[k] = np.array_equal(spelt[until[k] : until[k + 1]], data[bounds[k] : bounds[k + 1]])
        return same

    def __call__(self, texts: pa.Array) -> dict:
        """Numbers, groups and links of texts (large binary), those without tokens included."""
        some = pa.compute.greater(pa.compute.binary_length(texts), 0)
        number = np.flatnonzero(some.to_numpy(zero_copy_only=False))
        spaced = pa.compute.binary_join_element_wise(
            pa.scalar(b"", pa.large_binary()), texts.take(pa.array(number)), pa.scalar(b" ", pa.large_binary())
        )
        bounds = np.frombuffer(spaced.buffers()[1], np.int64)[: len(number) + 1]
        data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[: bounds[-1] if len(number) else 0]
        out = {k: np.zeros(len(texts), np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        out |= {"groups": [b""] * len(texts), "doc": number[:0], "pair": number[:0]}
        if not len(number):
            return out
        ids_a, until_a = self.encode_a(spaced)
        ids_b, until_b = self.encode_b(data, bounds)
        ids_a = ids_a.astype(np.int64)
        good = self._faithful(self.bytes_a, ids_a, until_a, data, bounds)
        good &= self._faithful(self.bytes_b, ids_b, until_b, data, bounds)
        count_a, count_b = np.diff(until_a, prepend=0), np.diff(until_b, prepend=0)
        ids_a, ids_b = ids_a[np.repeat(good, count_a)], ids_b[np.repeat(good, count_b)]
        count_a, count_b, number = count_a[good], count_b[good], number[good]
        if not len(number):
            return out
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        last_a, last_b, links_a, links_b = aligned(ends_a, ends_b)
        links_a, links_b = np.append(links_a, last_a), np.append(links_b, last_b)
        doc_a = np.repeat(np.arange(len(number)), count_a)
        groups = np.bincount(doc_a[last_a], minlength=len(number))
        out["n_a"][number], out["n_b"][number], out["n_groups"][number] = count_a, count_b, groups
        out["n_links"][number] = np.bincount(doc_a[links_a], minlength=len(number))
        for k, own in zip(number.tolist(), self._written(ids_a, ids_b, last_a, last_b, groups), strict=True):
            out["groups"][k] = own
        out["doc"], out["pair"] = number[doc_a[links_a]], ids_a[links_a] * self.pair_base + ids_b[links_b]
        return out

    def _written(self, ids_a, ids_b, last_a, last_b, groups) -> Iterator[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        group_a, group_b = np.repeat(np.arange(len(last_a)), sizes_a), np.repeat(np.arange(len(last_b)), sizes_b)
        before = np.append(0, np.cumsum(groups)[:-1])
        place_a = np.arange(len(ids_a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]
        place_b = np.arange(len(ids_b)) + np.cumsum(sizes_a)[group_b]
        first_a, first_b = last_a + 1 - sizes_a, last_b + 1 - sizes_b
        mark_a, mark_b = np.ones(len(ids_a), np.int64), np.ones(len(ids_b), np.int64)
        mark_a[first_a], mark_b[first_b] = 3, 2
        mark_a[first_a[before]] = 0
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        codes[place_a], codes[place_b] = mark_a * self.written_base + ids_a, mark_b * self.written_base + ids_b
        joined = self.written.take(pa.array(codes))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[: len(codes) + 1]
        begins = offsets[np.append(place_a[first_a[before]], len(codes))].tolist()
        raw = memoryview(joined.buffers()[2])
        return (bytes(raw[low:high]) for low, high in zip(begins, begins[1:]))


COLUMNS = ("n_a", "n_b", "n_groups", "n_links")
_NUMBERS = ", ".join(f"{c} long" for c in COLUMNS)
_ROWS = f"key long, doc_id long, {_NUMBERS}, groups_sha256 string, groups string, pairs array<long>, times array<long>"


def _split_by(rows: np.ndarray, n: int) -> pa.Array:
    """Offsets of lists whose members' rows are sorted."""
    return pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())


def _align(tokenizer_json: str, model: bytes, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizer_json, model)
        base = (len(aligner.bytes_a) + 1) * aligner.pair_base
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for low, high in byte_slices(texts, SLICE_BYTES):
                found, n = aligner(texts[low:high]), high - low
                codes, times = np.unique(found["doc"] * base + found["pair"], return_counts=True)
                docs, pairs = np.divmod(codes, base)
                lists = [
                    pa.ListArray.from_arrays(_split_by(docs, n), pa.array(values.astype(np.int64)))
                    for values in (pairs, times)
                ]
                shas = [hashlib.sha256(g).hexdigest() if g else "" for g in found["groups"]]
                written = [g.decode() for g in found["groups"]] if with_groups else [None] * n
                own = [
                    batch.column("key")[low:high],
                    batch.column("doc_id")[low:high],
                    *(pa.array(found[c]) for c in COLUMNS),
                    pa.array(shas, pa.string()),
                    pa.array(written, pa.string()),
                    *lists,
                ]
                names = ["key", "doc_id", *COLUMNS, "groups_sha256", "groups", "pairs", "times"]
                yield pa.RecordBatch.from_arrays(own, names)
                # One row without a key has the slice's sums, so that few rows are shuffled for them.
                order = np.argsort(pairs, kind="stable")
                total, at = np.unique(pairs[order], return_index=True)
                sums = np.add.reduceat(times[order], at) if len(at) else times
                none = [pa.nulls(1, c.type) for c in own[:-2]]
                sums = [pa.array([total.tolist()], pa.list_(pa.int64())), pa.array([sums.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*none, *sums], names)

    return run


def _head(totals: DataFrame, most: int) -> tuple[int, pa.Table]:
    """The least count whose pairs and all commoner ones are at most ``most``, and those pairs."""
    scale = F.floor(F.log2("n")).cast("int")
    sizes = {r.scale: r.pairs for r in totals.groupBy(scale.alias("scale")).agg(F.count(F.lit(1)).alias("pairs")).collect()}
    least, held = 1 << 62, 0
    for step in range(62, -1, -1):
        held += sizes.get(step, 0)
        if held > most:
            break
        least = 1 << step
    return least, totals.where(F.col("n") >= least).select("pair", "n", "best").toArrow()


def _look_up(head: pa.Table):
    order = np.argsort(head.column("pair").to_numpy())
    pair = head.column("pair").to_numpy()[order]
    count = head.column("n").to_numpy()[order]
    best = head.column("best").to_numpy()[order].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            sizes = pa.compute.list_value_length(lists).to_numpy()
            rows = np.repeat(np.arange(len(sizes)), sizes)
            if len(pair):
                at = np.minimum(np.searchsorted(pair, pairs), len(pair) - 1)
                known = pair[at] == pairs
            else:
                at, known = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
            sums = []
            for value in (best, count):
                own = np.where(known, value[at] if len(pair) else 0, 0) * times
                running = np.append(0, np.cumsum(own))
                until = np.cumsum(sizes)
                sums.append(pa.array(running[until] - running[until - sizes]))
            rest = [
                pa.ListArray.from_arrays(_split_by(rows[~known], len(sizes)), pa.array(values[~known]))
                for values in (pairs, times)
            ]
            kept = [n for n in batch.schema.names if n not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), *sums, *rest], [*kept, "n_best", "count_sum", "pairs", "times"]
            )

    return run


def align(
    docs: DataFrame, tokenizer_json: str, model: bytes, with_groups: bool = False, head_pairs: int = HEAD_PAIRS
) -> DataFrame:
    """Alignment of each row of ``docs`` (doc_id, text), other columns aside.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose ids are linked most often of
    all A ids of their B id, ties included), count_sum (the corpus-wide counts of all links'
    ids), groups_sha256 and groups (null unless asked for). A, a byte-level vocabulary, reads
    a space and the text, B the text before which its model puts one. Texts that are null or
    empty, or that a tokenizer's tokens do not spell, have zeros and ''. Repeated rows have a
    row each and count each; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    found = stage(rows.mapInArrow(_align(tokenizer_json, model, with_groups), _ROWS), "aligned")
    counted = found.where("key is null").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    totals = counted.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    number_b = F.pmod("pair", F.lit(Vocabulary(model).library.get_piece_size()))
    # A B id has at most as many pairs as A has ids.
    most = F.max("n").over(Window.partitionBy("b"))
    totals = stage(totals.withColumn("b", number_b).select("pair", "n", (F.col("n") == most).alias("best")), "totals")
    least, head = _head(totals, head_pairs)
    kept = ["key", "doc_id", *COLUMNS, "groups_sha256", "groups"]
    schema = (
        f"key long, doc_id long, {_NUMBERS}, groups_sha256 string, groups string, "
        "n_best long, count_sum long, pairs array<long>, times array<long>"
    )
    looked = stage(found.where("key is not null").mapInArrow(_look_up(head), schema), "looked_up")
    rest = looked.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    rest = rest.select("key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = rest.join(totals.where(F.col("n") < least), "pair").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("n")).alias("more_count"),
    )
    joined = looked.drop("pairs", "times").join(rare, "key", "left")
    return joined.select(
        *(c for c in kept[1:-2]),
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_count", F.lit(0))).alias("count_sum"),
        "groups_sha256",
        "groups",
    )
