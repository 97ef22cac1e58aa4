import re

import pytest
from pyspark.sql import functions as F

import awkward
import corpus_pipeline
from tallyforge.llm import secrets
from test_repeats import brute
from test_simhash import brute_components, brute_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, docs, sf_dir):
    """(name, input rows, output rows, output columns) of each stage."""
    for name, step in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = step(spark, docs, sf_dir).persist()
        yield name, before, docs.collect(), docs.columns


def test_stages_against_brute_force(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    labels = dict(map(tuple, spark.read.parquet(f"{medium}/labels.parquet").select("doc_id", "toxic").collect()))
    for name, before, after, columns in stages(spark, docs, medium):
        ids = {r.doc_id for r in after}
        if name != "best_fit_packing":
            assert columns == COLUMNS and ids <= {r.doc_id for r in before}
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "toxicity":
            toxic = [r.doc_id in ids for r in before if labels.get(r.doc_id) == 1]
            clean = [r.doc_id in ids for r in before if labels.get(r.doc_id) == 0]
            assert sum(toxic) <= 0.4 * len(toxic) and sum(clean) >= 0.97 * len(clean)
            texts = {r.doc_id: r.text for r in before}
            assert all(r.text == texts[r.doc_id] for r in after)
        elif name == "simhash_near_dedup":
            roots = brute_components([(r.doc_id, brute_fingerprint(r.text, 3)) for r in sorted(before)])
            assert sorted(after) == sorted(r for r in before if roots[r.doc_id] == r.doc_id)
        elif name == "suffix_array_dedup":
            raw = sorted((r.doc_id, r.text.encode()) for r in before)
            gone = dict(brute(raw, 50))
            want = {
                i: bytes(b for b, g in zip(t, gone[i], strict=True) if not g).decode(errors="ignore") for i, t in raw
            }
            assert {r.doc_id: r.text for r in after} == want and any(any(g) for g in gone.values())
        elif name == "secret_scans":
            texts = {r.doc_id: r.text for r in after}
            for r in before:
                found = [m.span() for rule in secrets.BASE_RULES for m in re.finditer(rule.pattern, r.text, re.ASCII) if len(m[rule.group]) >= rule.least]
                assert (texts[r.doc_id] != r.text) == bool(found)
                assert not any(r.text[a:b] in texts[r.doc_id] for a, b in found if b - a > 20)
        else:
            assert ids == {r.doc_id for r in before}
            assert max(r.offset + r.length for r in after) <= 1024
            # Each document's pieces are whole: they begin where the one before ends.
            ends = {}
            for r in sorted(after, key=lambda r: (r.doc_id, r.piece)):
                assert ends.get(r.doc_id, 0) == r.start
                ends[r.doc_id] = r.start + r.length


@pytest.mark.parametrize("make", [awkward.frame, awkward.empty])
def test_awkward_documents(spark, small, make):
    docs = make(spark)
    for name, before, after, columns in stages(spark, docs, small):
        if name == "simhash_near_dedup" and before:
            ids = sorted(r.doc_id for r in after if r.doc_id is not None)
            assert ids == sorted({r.doc_id for r in before if r.doc_id not in (None, 4, 5)} )
            assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)
        elif name != "best_fit_packing":
            assert len(after) == len(before) and columns == docs.columns
            assert all(r.row == "r" and r.ids == "i" for r in after)
        assert bool(before) == bool(after)


def test_run_is_the_stages_in_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, small)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, small)
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "secret_scans", "best_fit_packing"]


def test_redaction_merges_overlaps(spark):
    spans = "array<struct<kind:string,start:long,stop:long>>"
    rows = spark.createDataFrame(
        [("0123456789", [("a", 0, 3), ("b", 2, 5), ("c", 5, 6), ("d", 8, 10)]), ("abc", []), (None, [])],
        f"text string, spans {spans}",
    )
    out = [r[0] for r in rows.select(secrets.redacted(F.col("text"), F.col("spans"))).collect()]
    assert out == ["[REDACTED]67[REDACTED]", "abc", None]
