import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

import awkward
from tallyforge.llm import pieces, queries


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_query_against_the_library(spark, medium, library):
    rows = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op4_sentencepiece_scan(spark, medium).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "")
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].n_ids == len(ids) and got[r.doc_id].round_trip


def test_giant_documents_against_the_library(spark, medium, library):
    docs = spark.read.parquet(f"{medium}/documents.parquet").where("length(text) > 12000")
    rows = pieces.encode(docs, queries.piece_model(), 4096).collect()
    assert len(rows) > 5 and all(r.ids == library.encode(r.row.text) for r in rows)


def texts():
    rng = random.Random(5)
    runs = ["".join(rng.choices("abcdefghij0123ABCéß—tionghs", k=900)) for _ in range(3)]
    mixed = ["".join(rng.choices("ab c\n▁ 文🙂the tion  ", k=700)) for _ in range(4)]
    return [*runs, *mixed, "a" * 800, " " * 700, "x y" * 300, "the " * 90 + "z" * 300 + " the" * 90, "\x00\x01" * 200]


@pytest.mark.parametrize("size,block", [(23, 3), (120, 64)])
def test_scan_over_any_chunks(spark, library, size, block):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame(rows, "key long, text string")
    got = {r.key: r.ids for r in pieces.encode_chunks(frame, queries.piece_model(), size, block).collect()}
    assert got == {i: library.encode(t) for i, t in rows}


def test_products_are_associative():
    rng = random.Random(9)
    a, b, c = ({i: {j: -rng.randint(0, 9) for j in range(5) if rng.random() < 0.7} for i in range(5)} for _ in range(3))
    left = pieces.product(pieces.product(a, b), c)
    assert left == pieces.product(a, pieces.product(b, c))
    best = {(i, j): max((a[i][x] + b[x][y] + c[y][j] for x in a[i] for y in b[x] if j in c[y]), default=None) for i in range(5) for j in range(5)}
    assert {(i, j): v for i, row in left.items() for j, v in row.items()} == {k: v for k, v in best.items() if v is not None}


def test_awkward_rows(spark, library):
    rows = pieces.encode(awkward.frame(spark), queries.piece_model(), 64).collect()
    assert len(rows) == len(awkward.TEXTS)
    assert all(r.ids == library.encode(r.row.text or "") for r in rows)
    back = pieces.decode(spark.createDataFrame([(None, 1), ([], 2), ([1318], 3)], "ids array<int>, n int"), queries.piece_model())
    assert [r.decoded for r in back.orderBy("n").collect()] == [None, "", "x"]
    assert pieces.encode(awkward.empty(spark), queries.piece_model()).count() == 0
