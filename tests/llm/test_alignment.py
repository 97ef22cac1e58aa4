import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import awkward
from tallyforge.llm import alignment, queries


def token_bytes_a(tokenizer):
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return lambda i: bytes(byte_of[c] for c in tokenizer.id_to_token(i))


@pytest.fixture(scope="module")
def brute():
    """Rows of (doc_id, text) pairs by the libraries and plain loops, without the tokens' order."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    spelt_a = token_bytes_a(first)

    def spelt_b(i):
        name = second.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if second.is_byte(i) else name.replace("▁", " ").encode()

    def spans(spellings):
        out, at = [], 0
        for own in spellings:
            out.append((at, at + len(own)))
            at += len(own)
        return out

    def run(texts):
        rows, counts = [], Counter()
        for doc, text in texts:
            if not text:
                rows.append((doc, 0, 0, 0, [], ""))
                continue
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            names_a, names_b = [spelt_a(i) for i in a], [spelt_b(i) for i in b]
            if not b"".join(names_a) == b"".join(names_b) == b" " + text.encode():
                rows.append((doc, 0, 0, 0, [], ""))
                continue
            spans_a, spans_b = spans(names_a), spans(names_b)
            links, j = [], 0
            for i, (low, high) in enumerate(spans_a):
                while spans_b[j][1] <= low:
                    j += 1
                k = j
                while k < len(b) and spans_b[k][0] < high:
                    links.append((a[i], b[k]))
                    k += 1
            counts.update(links)
            ends = sorted({s[1] for s in spans_a} & {s[1] for s in spans_b})
            groups, low = [], 0
            for high in ends:
                own_a = [str(n) for n, s in zip(a, spans_a, strict=True) if low < s[1] <= high] if len(a) < 3000 else None
                own_b = [str(n) for n, s in zip(b, spans_b, strict=True) if low < s[1] <= high] if len(b) < 3000 else None
                groups.append(None if own_a is None or own_b is None else f"{','.join(own_a)}|{','.join(own_b)}")
                low = high
            sha = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()
            rows.append((doc, len(a), len(b), len(ends), links, sha))
        best = Counter()
        for (_, b), n in counts.items():
            best[b] = max(best[b], n)
        return [
            (doc, n_a, n_b, n_g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha)
            for doc, n_a, n_b, n_g, links, sha in rows
        ]

    return run


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert g[:-1] == w[:-1]
        assert w[-1] is None or g[-1] == w[-1]


def test_query_is_brute_force(spark, small, documents, brute):
    got = [tuple(r) for r in queries.op13_tokenizer_alignment(spark, small).collect()]
    same(got, brute(list(documents.items())))


TEXTS = [
    "a", " ", "   leading and   runs ", "\n\n\t x\r\n", "<|endoftext|> and </s> <unk> <0x41>", "a▁b", "naïve café – ﬁ ½ é",
    "日本語 🙂🙂 mixed", "\x00 nul", "﻿bom   nbsp  ", "don't 'll 12345 it's", "word" * 50, "_____ -- ..", "é decomposed",
]


@pytest.mark.parametrize("head", [0, 40, 1 << 18])
def test_tricky_texts_and_rare_pairs(spark, brute, monkeypatch, head):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 64)
    texts = [*enumerate(TEXTS), (7, "again"), (7, "again"), (None, None), (8, ""), (None, "no id")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = alignment.align(docs, queries.tokenizer_json(), queries.piece_model(), True, head).collect()
    same([tuple(r)[:-1] for r in found], brute(texts))
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in found if r.groups)


@pytest.mark.parametrize("window", [1 << 20, 7])
def test_run_skipping(monkeypatch, window):
    monkeypatch.setattr(alignment, "WINDOW", window)
    rng = random.Random(window)
    for share in (0.0, 0.02, 0.3, 1.0):
        common = sorted(rng.sample(range(1, 4000), 600)) + [4000]
        other = sorted({c for c in common if rng.random() > share} | set(rng.sample(range(1, 4000), int(600 * share))) | {4000})
        a, b = np.array(common), np.array(other)
        last_a, last_b, links_a, links_b = alignment.aligned(a, b)
        ends = np.intersect1d(a, b)
        assert (a[last_a] == ends).all() and (b[last_b] == ends).all()
        assert len(links_a) + len(last_a) == len(np.union1d(a, b))
        low_a, low_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        every_a, every_b = np.append(links_a, last_a), np.append(links_b, last_b)
        assert (np.maximum(low_a[every_a], low_b[every_b]) < np.minimum(a[every_a], b[every_b])).all()
        assert len(set(zip(every_a.tolist(), every_b.tolist(), strict=True))) == len(every_a)


def test_awkward_rows(spark, brute):
    found = alignment.align(awkward.frame(spark), queries.tokenizer_json(), queries.piece_model())
    same([tuple(r)[:-1] for r in found.collect()], brute(awkward.TEXTS))
    assert alignment.align(awkward.empty(spark), queries.tokenizer_json(), queries.piece_model()).count() == 0
