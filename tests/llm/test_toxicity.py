import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import awkward
from tallyforge.llm import queries, toxicity

WORDS = ["river", "stone", "market", "garden", "window", "letter", "silver", "simple", "basket", "winter", "idiom", "stupor"]


def corpus(spark, bad="idiot", rows=400):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(rows):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "er", "ing"]) for _ in range(60)] + [f"unique{i}word"]
        toxic = i % 8 == 0
        if toxic:
            words[rng.randrange(50)] = bad
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def model_of(spark):
    docs, labels = corpus(spark)
    return toxicity.fit(docs, toxicity.training_rows(docs, labels))


def test_restored_words(spark):
    restorer = toxicity.Restorer(model_of(spark).costs)
    assert restorer.word("1d10t") == restorer.word("id!0t.") == "idiot"
    assert restorer.word("w1nt3r") == "winter" and restorer.word("riverrr") in ("river", "riverr")
    assert {"idiot", "river"} <= restorer.words("such an i d i o t at the R!VER, 2024")
    assert "i.d.i.o.t" not in restorer.word("plain") and "2024" in restorer.words("in 2024")


def test_decoding_is_the_best_of_all_spellings(spark):
    costs = model_of(spark).costs.tolist()

    def cost(options):
        total, a, b, plain = 0.0, 0, 0, ""
        for letter, extra in options:
            total += extra
            if letter:
                c = toxicity.code_of(letter)
                total, a, b, plain = total + costs[a][b][c], b, c, plain + letter
        return total + costs[a][b][0], plain

    def every(word, before=""):
        if not word:
            yield []
            return
        char = word[0]
        options = [(char, 0.0)] if char.isalpha() else []
        options += [(c, 2.0) for c in toxicity.LOOKALIKES.get(char, "")]
        if char == before or char == "*" or not options:
            options.append(("", 1.5))
        for o in options:
            for rest in every(word[1:], char):
                yield [o, *rest]

    for word in ("1d10t", "ssto0ne", "w!nn13r", "a**b", "6a5k37"):
        assert toxicity.decode(word, costs) == min(map(cost, every(word)))[1]


def test_obfuscated_words_are_caught(spark):
    model = model_of(spark)
    texts = ["the river and an 1d10t there", "the i d i o t garden", "a silver garden in winter", "idioms of the market", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(got[0], got[1]) >= toxicity.THRESHOLD > max(got[2], got[3])
    assert got[4] == got[5] == pytest.approx(model.base)


def test_short_joined_and_masked_words(spark):
    model = model_of(spark)
    restorer = toxicity.Restorer(model.costs)
    for text in ("river-1d10t", "a.garden/and_1d10t,winter", "the-id1ot", "stone--IDIOT", "an id*ot there", "an i*iot"):
        assert "idiot" in restorer.words(text), text
    assert {"river", "stone", "market"} <= restorer.words("river-stone/market")
    assert restorer.word("win*ter") == "winter" and restorer.word("w*nter") == "winter"
    texts = ["silver-1d10t", "silver-idiom", "river*stone winter's garden, a.b.c 3.5"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[0] >= toxicity.THRESHOLD > max(got[1], got[2])


def test_scores_are_those_of_a_tiny_lexicon():
    costs = np.ones((toxicity.LETTERS,) * 3)
    model = toxicity.Model(costs, {"idiot": 0.9, "fool": 0.6}, {"stup": 0.5}, 0.1)
    texts = ["a fool", "a fool fool and an idiot", "stupid", "stup", "clean", ""]
    share = {"fool": 0.6, "idiot": 0.9, "stupid": 0.5}
    batch = pa.RecordBatch.from_pylist([{"row": {"text": t}} for t in texts])
    (got,) = toxicity._score(model)([batch])
    want = [1 - 0.9 * math.prod(1 - share.get(w, 0) for w in set(t.split())) for t in texts]
    assert got.column("score").to_pylist() == pytest.approx(want)


def test_held_out_accuracy(spark, medium):
    labels = dict(map(tuple, spark.read.parquet(f"{medium}/labels.parquet").select("doc_id", "toxic").collect()))
    rows = queries.op7_toxicity(spark, medium).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    toxic = [r.score for r in held if labels[r.doc_id]]
    clean = [r.score for r in held if not labels[r.doc_id]]
    ranked = np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean])
    assert len(toxic) >= 10 and ranked >= 0.75
    assert sum(s >= 0.7 for s in clean) <= 0.05 * len(clean)


def test_awkward_rows(spark):
    frame = awkward.frame(spark)
    labels = spark.createDataFrame([(1, 1), (2, None), (6, 0), (None, 1), (7, 3)], "doc_id long, toxic int")
    model = toxicity.fit(frame, toxicity.training_rows(frame, labels))
    rows = toxicity.score(frame, model).collect()
    assert len(rows) == len(awkward.TEXTS) and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.fit(awkward.empty(spark), toxicity.training_rows(awkward.empty(spark), labels))
    assert none.base == 0.5 and not none.words and toxicity.score(awkward.empty(spark), none).count() == 0


def test_spellings_of_any_length_are_restored(spark):
    model = model_of(spark)
    plain = "stone window river garden such idiot market silver letters in winter stone basket river garden window"
    known = plain.replace("such ", "").replace("in ", "")
    one = " ".join(known.replace(" ", ""))
    spelt = {
        "even gaps": one,
        "wide gaps": "   ".join(" ".join(w) for w in plain.split()),
        "dots": " ".join(".".join(w) for w in plain.split()),
        "thrice": f"{one} {one} {one}",
        "repeats": "an idi" + "o" * 200 + "t",
        "joined": plain.replace("idiot", "1d10t").replace(" ", "_"),
        "symbols": plain.replace("idiot", "id1ot").replace(" ", "+"),
    }
    assert len(one) > 2 * toxicity.MAX_WORD
    restorer = toxicity.Restorer(model.costs)
    assert {k: "idiot" in restorer.words(t) for k, t in spelt.items()} == dict.fromkeys(spelt, True)
    clean = " ".join(known.replace("idiot ", "").replace(" ", ""))
    docs = spark.createDataFrame([*spelt.items(), ("clean", clean)], "doc_id string, text string")
    got = {r.row.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(got[k] for k in spelt) >= toxicity.THRESHOLD > got["clean"]


def test_long_decoding_is_one_lattice(spark):
    costs = model_of(spark).costs.tolist()
    word = "w1nt3rrr5t0ne" * 40
    kept, toxicity.MAX_WORD = toxicity.MAX_WORD, 10**6
    try:
        want = [toxicity.decode(word, costs, b) for b in (False, True)]
    finally:
        toxicity.MAX_WORD = kept
    assert [toxicity.decode(word, costs, b) for b in (False, True)] == want
