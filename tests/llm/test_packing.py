import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import awkward
from tallyforge.llm import packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def brute_pieces(ids, size=1024):
    stop, start, rows = len(ids) % size or min(size, len(ids)), 0, []
    while start < len(ids):
        part = np.array(ids[start:stop], "<u4").tobytes()
        rows.append((start, stop - start, zlib.crc32(part)))
        start, stop = stop, stop + size
    return rows


def check_packing(rows, size):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_query_against_the_tokenizer(spark, small, documents, tokenizer):
    rows = queries.op9_bestfit_packing(spark, small).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.piece):
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert got == {
        i: brute_pieces([*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for i, t in documents.items()
    }
    bins = check_packing(rows, 1024)
    bound = packing.lower_bound(np.array([r.length for r in rows]), 1024)
    assert bound <= bins <= bound * 1.02 + 1


PARTS = ["a", "B", "the", " ", "  ", "\n", "\t", "'", "'s", "'ll", "12", ".", ",", "é", "×", "à", "ß", "’", "文", "🙂"]
PARTS += ["<|endoftext|>", "_", "\r\n", "\x1c", "\x00", "²", "٣", "　", " "]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=8))
def test_parted_texts_have_the_tokenizers_ids(texts):
    encoder, tokenizer = _both()
    ids, ends = encoder(pa.array([t.encode() for t in texts], pa.large_binary()))
    begin = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[begin:end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        begin = end


_KEPT = []


def _both():
    if not _KEPT:
        source = queries.tokenizer_json()
        tokenizer = Tokenizer.from_str(source)
        tokenizer.encode_special_tokens = True
        _KEPT.extend([packing.Encoder(source), tokenizer])
    return _KEPT


def optimum(lengths, size):
    """Fewest bins, by trying every place for each item in turn."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j, room in enumerate(rooms):
            if room >= lengths[i]:
                place(i + 1, [*rooms[:j], room - lengths[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, size - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_and_fit_enclose_the_optimum(lengths):
    items = np.array(lengths)
    bins, _ = packing.best_fit(items, 20)
    assert packing.lower_bound(items, 20) <= optimum(lengths, 20) <= len(set(bins.tolist()))


def test_partitions_with_gaps_exchange(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([400, 350, 300, 275, 620, 90, 33, 1024])) for i in range(1500)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long")
    packed = packing.pack(pieces, part_pieces=60).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == sorted(rows)
    alone = packing.pack(pieces, part_pieces=60, rounds=0).collect()
    bound = packing.lower_bound(np.array([n for _, n in rows]), 1024)
    assert bound <= check_packing(packed, 1024) < check_packing(alone, 1024)


def test_awkward_rows(spark):
    pieces = packing.tokenised_pieces(awkward.frame(spark), queries.tokenizer_json(), with_ids=True)
    rows = packing.pack(pieces).collect()
    short = [r for r in rows if r.doc_id in (3, 4)]
    assert [list(r.ids) for r in short] == [[2], [2]]
    assert len([r for r in rows if r.doc_id == 2]) == 3
    long = sorted((r for r in rows if r.doc_id == 6), key=lambda r: r.piece)
    assert len(long) > 20 and all(r.length == 1024 for r in long[1:])
    none = packing.tokenised_pieces(awkward.empty(spark), queries.tokenizer_json())
    assert packing.pack(none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=8))
def test_added_tokens_have_the_ids_of_the_library_at_its_defaults(texts):
    if not _DEFAULTS:
        source = queries.tokenizer_json()
        _DEFAULTS.extend([packing.TokenEncoder(source), Tokenizer.from_str(source)])
    encoder, tokenizer = _DEFAULTS
    texts = ["a<|endoftext|>b", *texts, "<|endoftext|><|endoftext|> <|endoftext", ""]
    ids, ends = encoder(pa.array([t.encode() for t in texts], pa.large_binary()))
    begin = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[begin:end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        begin = end


_DEFAULTS = []


def test_pieces_hold_added_tokens(spark):
    docs = spark.createDataFrame([(1, "a<|endoftext|>b"), (2, "ab")], "doc_id long, text string")
    rows = packing.tokenised_pieces(docs, queries.tokenizer_json(), with_ids=True).collect()
    assert {r.doc_id: list(r.ids) for r in rows}[1] == [64, 50256, 65, 2]
