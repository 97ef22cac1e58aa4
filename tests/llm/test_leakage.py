import hashlib
import random
import re

import pytest

import awkward
from tallyforge.llm import leakage, queries


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, size=10):
    windows = []
    for item, text in items:
        own = words(text)
        n = min(size, len(own))
        windows += [(item, own[p : p + n]) for p in range(len(own) - n + 1) if n]
    by_words = {}
    for item, own in windows:
        by_words.setdefault(tuple(own), set()).add(item)
    lengths = {len(w) for w in by_words}
    out = []
    for doc, text in docs:
        own = words(text)
        hit, named = [False] * len(own), set()
        for n in lengths:
            for p in range(len(own) - n + 1):
                found = by_words.get(tuple(own[p : p + n]))
                if found:
                    hit[p : p + n] = [True] * n
                    named |= found
        spans, p = [], 0
        while p < len(own):
            q = p
            while q < len(own) and hit[q]:
                q += 1
            if q > p:
                spans.append((p, q))
            p = q + 1
        out.append((doc, len(own), spans, sorted(str(i) for i in named if i is not None)))
    return out


def collected(found):
    return [(r.doc_id, r.n_words, [tuple(s) for s in r.spans], r.items) for r in found.collect()]


def test_query_is_brute_force(spark, medium):
    docs = [tuple(r) for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{medium}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(map(tuple, queries.op12_benchmark_decontamination(spark, medium).collect()))
    want = [
        (doc, n, sum(b - a for a, b in spans), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(spans))
        for doc, n, spans, named in brute(docs, items)
    ]
    assert got == sorted(want)
    assert any(w[2] for w in want)


@pytest.mark.parametrize("bits", [6, 24])
def test_random_texts(spark, monkeypatch, bits):
    """Windows repeat, overlap and touch; a bitmap of 64 bits lets every shingle pass."""
    monkeypatch.setattr(leakage, "SLICE_BYTES", 200)
    rng = random.Random(bits)
    letters = ["a", "b", "C", "é", "x9"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(letters, k=rng.randint(0, 60)))) for i in range(60)]
    items = [(i, " ".join(rng.choices(letters, k=rng.choice([0, 1, 2, 3, 4, 5, 9])))) for i in range(8)]
    items += [(9, "a b"), (10, docs[5][1] + " a"), (9, "a b"), (None, "C C C"), (11, None), (12, "—")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    stated = spark.createDataFrame(items, "item_id long, text string")
    got = collected(leakage.find_leaks(frame, stated, size=4, bits=bits))
    assert sorted(got) == sorted(brute(docs, items, 4))


def test_awkward_rows(spark):
    docs, items = awkward.frame(spark), awkward.frame(spark).withColumnRenamed("doc_id", "item_id")
    key = repr
    got = collected(leakage.find_leaks(docs, items))
    assert sorted(got, key=key) == sorted(brute(awkward.TEXTS, awkward.TEXTS), key=key)
    nothing = collected(leakage.find_leaks(docs, awkward.empty(spark).withColumnRenamed("doc_id", "item_id")))
    assert len(nothing) == len(awkward.TEXTS) and not any(r[2] or r[3] for r in nothing)
    assert leakage.find_leaks(awkward.empty(spark), items).count() == 0
