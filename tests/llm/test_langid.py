import zlib

import numpy as np

import awkward
from tallyforge.llm import langid, queries


def test_held_out_accuracy(spark, medium):
    langs = dict(map(tuple, spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang").collect()))
    rows = queries.op5_language_id(spark, medium).collect()
    assert {r.doc_id for r in rows} == set(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and langs[r.doc_id]]
    assert len(held) > 100 and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


def test_one_probe_answers_for_all_languages(spark):
    words = {"aa": "alpha beta gamma", "bb": "delta beta omega", "cc": "zeta eta theta"}
    rows = spark.createDataFrame([(f"{w} " * 20, lang) for lang, w in words.items()], "text string, lang string")
    filters = langid.fit(rows)
    letters = langid._letters()
    known = langid.grams_of("beta", letters)
    assert (filters.rates(known)[:2] > 0.99).all() and filters.rates(known)[2] < 0.9
    assert filters.rates(langid.grams_of("gamma", letters))[0] > 0.99
    assert (filters.chance < 1e-6).all()
    unknown = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    assert (filters.rates(unknown) < 0.01).all()


def test_awkward_rows(spark):
    frame = awkward.frame(spark)
    rows = spark.createDataFrame([("eins zwei drei vier " * 9, "de"), ("one two three four " * 9, "en"), (None, "fr"), ("x", None)], "text string, lang string")
    found = langid.identify(frame, langid.fit(rows)).collect()
    assert len(found) == len(awkward.TEXTS)
    for r in found:
        silent = not any(c.isalpha() for c in r.row.text or "")
        assert (r.lang_pred == "und") == silent and (not silent or r.score == 0)
    none = langid.fit(rows.where("lang is null"))
    assert {r.lang_pred for r in langid.identify(frame, none).collect()} == {"und"}
    assert langid.identify(awkward.empty(spark), none).count() == 0
