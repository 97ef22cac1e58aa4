"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Documents become pieces of at most ``size`` tokens. The pieces are dealt into partitions of
bounded size, each packed by best-fit decreasing. Dual feasible functions give each
partition a lower bound; one that meets its bound is certified. Partitions with gaps put the
documents of their unfilled sequences together, deal them anew, and pack them again, until
all are certified, one partition is left, or a round saves nothing.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallyforge.llm.common import byte_slices, small_batches, stage, text_bytes

SIZE = 1024
END_ID = 2
PART_PIECES = 1 << 16
SLICE_BYTES = 8 << 20


# Fixed value: how a byte-level vocabulary of this kind parts a text before merging.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(tokenizer_json: str) -> dict[bytes, int]:
    """The ids of a byte-level vocabulary whose merges stand in the order of their ids."""
    model = json.loads(tokenizer_json)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab[a + b] for a, b in merges]
    if ids != sorted(ids) or len(vocab) < len(ids) + 256:
        raise ValueError("the merges of this vocabulary are not in the order of its ids")
    used = [*byte_of, *(a + b for a, b in merges)]
    return {bytes(byte_of[c] for c in token): vocab[token] for token in used}


class Encoder:
    """Ids of whole texts; each distinct word of a slice is tokenised once.

    A byte-level vocabulary never joins bytes over a space that stands before an ASCII letter
    or digit, nor an ASCII letter with what is neither letter nor digit after it, nor with what
    is no letter, white space or apostrophe, or a lone line end, before it (all ASCII, and
    accented Latin letters); texts are parted there and the parts' ids strung together. Special
    tokens' strings are ordinary text here; ``TokenEncoder`` gives them their ids.
    """

    def __init__(self, tokenizer_json: str):
        import tiktoken

        self.ids = tiktoken.Encoding(
            "own", pat_str=WORD_PATTERN, mergeable_ranks=byte_ranks(tokenizer_json), special_tokens={}
        ).encode_ordinary
        (self.line,) = self.ids("\n")
        letter, digit = np.zeros(256, bool), np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123)]] = True
        digit[48:58] = True
        self.letter, self.digit, self.accents = letter, digit, np.zeros(256, bool)
        self.accents[0x80:0xC0] = True
        self.accents[[0x97, 0xB7]] = False
        ascii_code = np.arange(256) < 128
        self.stops = ~letter & ~digit & ascii_code
        self.starts = ~letter & ascii_code
        self.starts[[*range(9, 14), 32, 39]] = False
        self.solid = ascii_code.copy()
        self.solid[[*range(9, 14), *range(28, 33)]] = False

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words one after another, and the number of each word's ids."""
        # Words with white space but for one leading space would run into the separator.
        odd = [i for i, w in enumerate(words) if w.split() != [w.removeprefix(" ")]]
        strange = set(odd)
        plain = [w for i, w in enumerate(words) if i not in strange] if odd else words
        ids = np.array(self.ids("\n".join([*plain, ""])), np.uint32)
        ends = np.flatnonzero(ids == self.line)
        sizes = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != self.line]
        if not odd:
            return ids, sizes
        other = [np.array(self.ids(words[i]), np.uint32) for i in odd]
        all_sizes = np.zeros(len(words), np.int64)
        regular = np.ones(len(words), bool)
        regular[odd] = False
        all_sizes[regular] = sizes
        all_sizes[odd] = [len(o) for o in other]
        out = np.empty(int(all_sizes.sum()), np.uint32)
        of_regular = np.repeat(regular, all_sizes)
        out[of_regular] = ids
        out[~of_regular] = np.concatenate(other)
        return out, all_sizes

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts (large binary), and where each text's ids end."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        # Two bytes from 0xC3 on are accented letters, but for two signs.
        accented = (data[:-1] == 0xC3) & self.accents[data[1:]]
        begins, ends = self.letter[data], self.letter[data]
        begins[:-1] |= accented
        ends[1:] |= accented
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 32) & (self.digit[data[1:]] | begins[1:])
        cut[1:-1] |= ends[:-1] & self.stops[data[1:]]
        cut[1:-1] |= self.starts[data[:-1]] & begins[1:]
        line = self.solid[data[:-2]] & (data[1:-1] == 10)
        cut[2:-1] |= line & begins[2:]
        cut[bounds] = True
        cuts = np.flatnonzero(cut)
        words = pa.Array.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]
        ).dictionary_encode()
        ids, sizes = self._words([w.decode() for w in words.dictionary.to_pylist()])
        codes = words.indices.to_numpy()
        each = sizes.astype(np.int32)[codes]
        until = np.cumsum(each, dtype=np.int64)
        shift = (np.cumsum(sizes) - sizes)[codes] - (until - each)
        places = np.repeat(shift, each)
        places += np.arange(len(places))
        return ids[places], np.append(0, until)[np.searchsorted(cuts, bounds[1:])]


def added_ids(tokenizer_json: str) -> dict[str, int]:
    """The ids of the strings that a tokenizer's file takes out of a text before all else."""
    tokens = json.loads(tokenizer_json).get("added_tokens") or []
    for token in tokens:
        if any(token.get(k) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"added token {token['content']!r} takes in or looks at what is beside it")
    return {t["content"]: t["id"] for t in tokens if t["content"]}


class TokenEncoder:
    """Ids of whole texts as the tokenizers library gives them, added tokens in the text included."""

    def __init__(self, tokenizer_json: str):
        self.ordinary = Encoder(tokenizer_json)
        self.added = {token.encode(): number for token, number in added_ids(tokenizer_json).items()}
        # Of tokens that begin at one place the longest is taken.
        found = sorted(self.added, key=len, reverse=True)
        self.pattern = re.compile(b"(" + b"|".join(map(re.escape, found)) + b")")

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts (large binary), and where each text's ids end."""
        if not any(pc.any(pc.match_substring(texts, token)).as_py() for token in self.added):
            return self.ordinary(texts)
        # Of each text every second part is an added token.
        parts = [self.pattern.split(raw) for raw in texts.to_pylist()]
        plain = [part for own in parts for part in own[::2]]
        ids, ends = self.ordinary(pa.array(plain, pa.large_binary()))
        between = np.array([self.added[t] for own in parts for t in own[1::2]], np.uint32)
        # An added token follows every part but the last of its text.
        last = np.cumsum([len(own[::2]) for own in parts]) - 1
        inner = np.ones(len(plain), bool)
        inner[last] = False
        return np.insert(ids, ends[inner], between), (ends + np.cumsum(inner))[last]


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<long>"


def _pieces(tokenizer_json: str, size: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TokenEncoder(tokenizer_json)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for low, high in byte_slices(texts, SLICE_BYTES):
                docs = batch.column("doc_id")[low:high].to_pylist()
                ids, ends = encoder(texts[low:high])
                yield _cut(docs, ids, ends, size, end_id, with_ids)

    return run


def _cut(docs: list, ids: np.ndarray, ends: np.ndarray, size: int, end_id: int, with_ids: bool):
    out: list[list] = [[], [], [], [], [], []]
    begin = 0
    for doc, end in zip(docs, ends.tolist(), strict=True):
        own = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4")
        begin = end
        stop = len(own) % size or min(size, len(own))
        start = piece = 0
        while start < len(own):
            part = own[start:stop]
            row = (doc, piece, start, len(part), zlib.crc32(part), part.tolist() if with_ids else None)
            for column, value in zip(out, row, strict=True):
                column.append(value)
            start, stop, piece = stop, stop + size, piece + 1
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
        ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
    )


def tokenised_pieces(
    docs: DataFrame, tokenizer_json: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Pieces of every document: its ids and the end id, cut if there are more than ``size``.

    Ids are those of the tokenizers library at its defaults without tokens around the text: a
    string of an added token in the text has that token's id.
    Only the first piece of a longer document may be shorter. A null or empty text has the end
    id alone; repeated rows each have pieces. ``ids`` is null unless asked for.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(_pieces(tokenizer_json, size, end_id, with_ids), PIECE_SCHEMA)
    return found if with_ids else found.drop("ids")


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's sequence and its offset there."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms = 0  # bit r: some sequence has room r
    bins, offsets, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for item in order.tolist():
        length = int(lengths[item])
        fitting = open_rooms >> length
        if fitting:
            left = length + (fitting & -fitting).bit_length() - 1
            chosen = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            left, chosen, opened = size, opened, opened + 1
        bins[item], offsets[item] = chosen, size - left
        if left > length:
            room[left - length].append(chosen)
            open_rooms |= 1 << (left - length)
    return bins, offsets


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Sequences that any packing needs, by two families of dual feasible functions."""
    counts = np.bincount(lengths, minlength=size + 1)
    x = np.arange(size + 1)
    best = -(-int((counts * x).sum()) // size)
    for least in range(1, size // 2 + 1):  # items under `least` count nothing, their complements all
        value = np.where(x > size - least, size, np.where(x < least, 0, x))
        best = max(best, -(-int((counts * value).sum()) // size))
    for k in range(1, 33):  # rounding to multiples of a k-th; whole multiples of a (k+1)-th stay
        whole = (k + 1) * x % size == 0
        value = np.where(whole, x * k, (k + 1) * x // size * size)
        best = max(best, -(-int((counts * value).sum()) // (size * k)))
    return best


def _pack(size: int, names: list[str]):
    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        bins, offsets = best_fit(lengths, size)
        used = np.bincount(bins, lengths).astype(np.int64)
        rows = len(lengths)
        columns = [group.column(n) for n in names]
        own = [bins, offsets, size - used[bins], np.full(rows, len(used)), np.full(rows, lower_bound(lengths, size))]
        return pa.Table.from_arrays(
            [*columns, *(pa.array(c, pa.int64()) for c in own)],
            [*names, "bin", "offset", "slack", "n_bins", "bound"],
        )

    return run


def pack(pieces: DataFrame, size: int = SIZE, part_pieces: int = PART_PIECES, rounds: int = 6) -> DataFrame:
    """``pieces`` (with ``length``) plus sequence_id and offset; any other columns stay.

    Sequence ids are unique but not dense. A partition holds about ``part_pieces`` pieces,
    dealt at random, so no task grows with the table. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)

    def packed(rows: DataFrame, turn: int) -> DataFrame:
        parts = max(1, -(-rows.count() // part_pieces))
        part = F.pmod(F.xxhash64(F.lit(turn), *(n for n in names if n != "ids")), F.lit(parts))
        dealt = rows.select(*names, (F.lit(turn << 32) + part).alias("part"))
        own = "part long, bin long, offset long, slack long, n_bins long, bound long"
        return stage(
            dealt.groupBy("part").applyInArrow(_pack(size, [*names, "part"]), f"{schema}, {own}"),
            "packed",
        )

    settled: list[DataFrame] = []
    state = packed(pieces, 0)
    for turn in range(1, rounds + 1):
        per_part = state.groupBy("part").agg(F.first("n_bins").alias("n"), F.first("bound").alias("b"))
        gaps = per_part.where("n > b")
        if gaps.limit(2).count() < 2:
            break
        loose = state.join(gaps.select("part"), "part", "left_semi").where("slack > 0")
        before = loose.select("part", "bin").distinct().count()
        again = packed(loose.select(*names), turn)
        after = again.groupBy("part").agg(F.first("n_bins").alias("n")).agg(F.sum("n")).first()[0]
        if after >= before:
            break
        kept = state.join(gaps.select("part", F.lit(True).alias("gap")), "part", "left")
        settled.append(kept.where("gap is null or slack = 0").drop("gap"))
        state = again
    for rows in settled:
        state = state.unionByName(rows)
    return state.select(*names, ((F.col("part") * (1 << 24)) + F.col("bin")).alias("sequence_id"), "offset")
