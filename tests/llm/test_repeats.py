import hashlib
import random

import pytest
from pyspark.sql import functions as F

import awkward
from tallyforge.llm import queries, repeats


def brute(texts, length):
    """(doc_id, removed flags) of (doc_id, bytes) pairs."""
    first = {}
    for doc, raw in texts:
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, raw in texts:
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < doc:
                gone[p : p + length] = [True] * length
        out.append((doc, gone))
    return out


def expected(texts, length):
    rows = []
    for (doc, raw), (_, gone) in zip(texts, brute(texts, length), strict=True):
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        rows.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(rows)


def test_query_is_brute_force(spark, small, documents):
    got = sorted(map(tuple, queries.op8_suffix_dedup(spark, small).collect()))
    assert got == expected([(i, t.encode()) for i, t in documents.items()], 50)


@pytest.mark.parametrize("letters,length,group_rows,chunk", [("ab", 20, 1 << 18, 1 << 19), ("abé", 24, 4, 64), ("a", 50, 1 << 18, 128)])
def test_random_texts(spark, monkeypatch, letters, length, group_rows, chunk):
    monkeypatch.setattr(repeats, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rng = random.Random(length)
    passages = ["".join(rng.choices(letters, k=rng.randint(5, 90))) for _ in range(12)]
    texts = []
    for i in range(40):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices("xyz" + letters, k=30)) for _ in range(6)]
        texts.append((i, "".join(parts)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    found = repeats.remove_repeats(docs, length).select(
        "row.doc_id",
        F.octet_length("row.text").cast("long"),
        (F.octet_length("row.text") - F.octet_length("kept")).cast("long"),
        F.size("spans").cast("long"),
        F.sha2("kept", 256),
    )
    assert sorted(map(tuple, found.collect())) == expected([(i, t.encode()) for i, t in texts], length)


def test_awkward_rows(spark):
    rows = repeats.remove_repeats(awkward.frame(spark)).collect()
    assert len(rows) == len(awkward.TEXTS)
    gone = {(r.row.doc_id, r.row.text): r for r in rows}
    copy = gone[2, awkward.TEXTS[1][1]]
    assert bytes(copy.kept) == b"" and [tuple(s) for s in copy.spans] == [(0, 89)]
    # Rows of one id do not cover each other, nor do those without an id take part.
    untouched = [r for r in rows if not r.spans]
    assert all(bytes(r.kept) == (r.row.text or "").encode() for r in untouched)
    assert len(untouched) == len(rows) - 1
    assert rows[0].row.row == "r" and rows[0].row.tag == 7
    assert repeats.remove_repeats(awkward.empty(spark)).count() == 0


def test_split_characters_go(spark):
    """A removed string that begins within a character takes the character's other byte along."""
    shared = "é" * 30
    docs = spark.createDataFrame([(1, shared), (2, "ã" + shared[1:] + "x")], "doc_id long, text string")
    rows = repeats.remove_repeats(docs, 50, as_text=True).orderBy("row.doc_id").collect()
    want = brute([(1, shared.encode()), (2, ("ã" + shared[1:] + "x").encode())], 50)[1][1]
    raw = ("ã" + shared[1:] + "x").encode()
    kept = bytes(b for b, g in zip(raw, want, strict=True) if not g)
    assert rows[0].kept == shared and rows[1].kept == kept.decode(errors="ignore")


def test_too_short_strings():
    with pytest.raises(ValueError):
        repeats.Runs(10)


@pytest.mark.parametrize("group_rows,side_rows", [(64, 2048), (1 << 18, 8), (1 << 18, 2048)])
def test_hot_template_with_distinct_tails(spark, monkeypatch, group_rows, side_rows):
    """Hundreds of documents share one gram and side, but most whole strings differ."""
    monkeypatch.setattr(repeats, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(repeats, "SIDE_ROWS", side_rows)
    monkeypatch.setattr(repeats, "STRINGS", 16)
    rng = random.Random(3)
    template = "all rights are kept by the town"
    tails = ["".join(rng.choices("abcdefgh", k=60)) for _ in range(120)]
    texts = [(i, rng.choice(["", "x" * (i % 7)]) + template + tails[rng.randrange(i % 120 + 1)] + template) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    found = repeats.remove_repeats(docs, 50).select(
        "row.doc_id",
        F.octet_length("row.text").cast("long"),
        (F.octet_length("row.text") - F.octet_length("kept")).cast("long"),
        F.size("spans").cast("long"),
        F.sha2("kept", 256),
    )
    assert sorted(map(tuple, found.collect())) == expected([(i, t.encode()) for i, t in texts], 50)


def test_the_least_document_of_a_rank_stays(spark):
    rows = [(1, 1, 5, 10), (1, 1, 3, 11), (1, 1, 3, 12), (1, 2, 9, 13), (2, 1, 4, 14), (2, 1, 4, 15)]
    starts = spark.createDataFrame(rows, "high long, low long, doc_id long, place long")
    assert sorted(map(tuple, repeats._covered_starts(starts).collect())) == [(5, 10)]
    assert repeats._covered_starts(starts.where("high > 9")).count() == 0
