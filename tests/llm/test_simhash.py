import random
import re

import pytest
import xxhash

import awkward
from tallyforge.llm import queries, simhash

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or words and [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes):
    """Least id of each component of (id, code) pairs linked at three bits or fewer."""
    root = {i: i for i, _ in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(codes):
        for j, b in codes[:n]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_query_is_brute_force(spark, small, documents):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash_dedup(spark, small).collect()}
    codes = [(i, brute_fingerprint(t, 3)) for i, t in sorted(documents.items())]
    roots = brute_components(codes)
    assert got == {i: (f"{c:016x}", roots[i]) for i, c in codes}


@pytest.mark.parametrize("hot_block", [1 << 18, 3])
def test_links_within_three_bits(spark, hot_block):
    rng = random.Random(4)
    codes = []
    for base in [rng.getrandbits(64) for _ in range(12)] + [0]:
        for _ in range(25):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            codes.append((len(codes) * 7 % 331, base ^ flips))
    rows = [(i, c - (c >> 63 << 64)) for i, c in codes]
    prints = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    found = {r[0]: r[1] for r in simhash.link(prints, hot_block=hot_block).collect()}
    roots = brute_components(codes)
    assert {i: found[c] for i, c in rows} == roots


def test_words_over_block_borders(monkeypatch):
    text = b"One two  three four five six seven\nEIGHT nine ten " * 7
    whole = simhash.fingerprint(text, 3)
    for size in (1, 5, 11, 40):
        monkeypatch.setattr(simhash, "BLOCK_BYTES", size)
        assert simhash.fingerprint(text, 3) == whole
    assert whole & (1 << 64) - 1 == brute_fingerprint(text.decode(), 3)


def test_awkward_rows(spark):
    rows = simhash.near_duplicates(awkward.frame(spark)).collect()
    assert len(rows) == len(awkward.TEXTS)
    by_id = {r.doc_id: r for r in rows if r.doc_id != 2}
    assert by_id[3].fingerprint == by_id[4].fingerprint == by_id[5].fingerprint == 0
    assert by_id[4].component_id == by_id[5].component_id == 3
    assert {r.component_id for r in rows if r.doc_id == 2} == {1, 2}
    assert simhash.near_duplicates(awkward.empty(spark)).count() == 0


def test_more_bits_than_blocks_can_find(spark):
    with pytest.raises(ValueError):
        simhash.link(spark.createDataFrame([], "doc_id long, fingerprint long"), limit=4)
