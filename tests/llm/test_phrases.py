import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import awkward
from tallyforge.llm import phrases, queries


def brute(rows, least=10, top=2000, share=50):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) pairs."""
    counts = {}
    for text, lang in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                own.update(tuple(words[p : p + k]) for p in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {}
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
                candidates[p] = (a, *min(cuts)[0::2], min(cuts)[3])
        dropped = {
            part
            for p, (a, *_) in candidates.items()
            for part in (p[:-1], p[1:])
            if part in candidates and 100 * a >= share * candidates[part][0]
        }
        kept = [(-score, -a, " ".join(p).encode(), l, r) for p, (a, score, l, r) in candidates.items() if p not in dropped]
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def collected(found):
    return sorted(map(tuple, found.collect()))


def test_query_is_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("text", "lang").collect()
    got = collected(queries.op11_phrase_collocations(spark, small))
    assert got and got == brute([tuple(r) for r in rows])


@pytest.mark.parametrize("top,step,bits,words", [(5, 2, 24, 300), (12, 4, 6, 1 << 22), (10_000, 4, 16, 50)])
def test_rounds(spark, monkeypatch, top, step, bits, words):
    """Several rounds, cuts amid ties, full bitmaps, and sums over many blocks."""
    monkeypatch.setattr(phrases, "BLOCK_WORDS", words)
    rng = random.Random(top)
    vocabulary = ["a", "B", "ça", "d1", "e", "f", "g-h", "ß", "k\x01"]
    weights = [9, 8, 7, 5, 4, 3, 2, 2, 1]
    fixed = ["new york city", "red, green; blue", "to be or not to be"]
    rows = []
    for i in range(240):
        parts = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 9))) for _ in range(4)]
        if rng.random() < 0.4:
            parts.append(rng.choice(fixed))
        rows.append((rng.choice([" ", "\t", ". ", "\r\n"]).join(parts), [None, "und", "x", "y"][i % 4]))
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = collected(phrases.mine(docs, least=4, top=top, step=step, bits=bits))
    assert got == brute(rows, 4, top)


def test_exact_scores(spark):
    rows = [(10**14 + 3, 10**14 + 9, 10**14 + 7), (10, 10, 10), (999_983, 10**9 + 7, 10**6 + 3)]
    frame = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases._ratio("a", "l", "r").alias("s"))
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in frame.collect())


def test_awkward_rows(spark):
    docs = awkward.frame(spark).unionByName(awkward.frame(spark)).withColumn("lang", F.when(F.col("doc_id") > 2, "x"))
    rows = [(t, "x" if i is not None and i > 2 else None) for i, t in awkward.TEXTS * 2]
    assert collected(phrases.mine(docs, least=3)) == brute(rows, 3)
    assert phrases.mine(awkward.empty(spark)).count() == 0
