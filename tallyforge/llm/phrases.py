"""Phrase collocation mining by best-first branch-and-bound growth.

Phrases grow word by word: words that are frequent in a language, then frequent pairs of them,
then triples. A pair's counts bound the score of every triple that it begins or ends, since a
triple is no commoner than the pair and its other part no rarer than the triple. So triples
are counted best bounds first: a round takes the pairs whose bounds, or own scores, reach a cut,
and the cut is lowered until enough phrases survive above it in every language. What lies
below a settled cut cannot reach a language's list, nor can it drop what is in the list.

Which words and pairs a task may grow is told by bitmaps of a fixed size; a few more are grown
than need be, and every count is of whole phrases over all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyforge.llm.common import byte_slices, small_batches, stage, text_bytes
from tallyforge.llm.hashing import build_bitmap, marked, phrase_hashes, string_hashes

LEAST = 10
TOP = 2000
SHARE = 50
SCALE = 1_000_000
BITS = 24
BLOCK_WORDS = 1 << 20  # words whose phrases are summed in a task before they are sent on
BUCKET = 64  # width of the score ranges among which cuts are chosen
NO_LANGUAGE = "und"

# A text's letters, blanks and piece breaks; a piece break is written as a lone full stop.
_PLAIN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz ........."
)
BREAK = b"."


class Block:
    """The words of some texts of one language as numbers from 1, breaks between pieces as 0."""

    def __init__(self, language: str):
        self.language = language
        self.numbers = {BREAK: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[bytes]) -> None:
        raw = BREAK.join([b"", *texts, b""]).translate(_PLAIN)
        found = pa.array(raw.replace(BREAK, b" . ").split(), pa.binary()).dictionary_encode()
        numbers = self.numbers
        codes = [numbers.setdefault(w, len(numbers)) for w in found.dictionary.to_pylist()]
        part = np.array(codes, np.int32)[found.indices.to_numpy()]
        self.parts.append(part)
        self.size += len(part)

    def close(self) -> None:
        self.ids = np.concatenate(self.parts)
        self.words = pa.array(self.numbers, pa.large_binary())
        self.hashes = string_hashes(self.words)
        self.salt = string_hashes(pa.array([self.language]))

    def phrase(self, *places: np.ndarray) -> np.ndarray:
        """Hashes of the phrases of the words at some places, each number once."""
        return phrase_hashes(self.salt, *(self.hashes[p] for p in places))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    blocks: dict[str, Block] = {}
    held = 0
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for low, high in byte_slices(texts):
            own = texts[low:high].to_pylist()
            by_language: dict[str, list[bytes]] = {}
            for language, text in zip(batch.column("lang")[low:high].to_pylist(), own, strict=True):
                by_language.setdefault(NO_LANGUAGE if language is None else language, []).append(text)
            for language, group in by_language.items():
                block = blocks.setdefault(language, Block(language))
                before = block.size
                block.add(group)
                held += block.size - before
            if held > BLOCK_WORDS:
                yield from _closed(blocks)
                blocks, held = {}, 0
    yield from _closed(blocks)


def _closed(blocks: dict[str, Block]) -> Iterator[Block]:
    for language in list(blocks):
        block = blocks.pop(language)
        block.close()
        yield block


def _counted(grow: Callable):
    """Rows (lang, words, n) of what ``grow`` gives of each block: columns of numbers and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            columns, n = grow(block)
            for low in range(0, len(n), 1 << 16):
                part = slice(low, low + (1 << 16))
                words = [block.words.take(pa.array(c[part])) for c in columns]
                blank = pa.scalar(b" ", pa.large_binary())
                phrase = pc.binary_join_element_wise(*words, blank) if len(words) > 1 else words[0]
                count = pa.array(n[part])
                language = pa.array([block.language]).take(pa.array(np.zeros(len(count), np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [language, phrase.cast(pa.large_string()).cast(pa.string()), count], ["lang", "phrase", "n"]
                )

    return run


def _one_word(block: Block):
    n = np.bincount(block.ids, minlength=len(block.words))
    n[0] = 0
    used = np.flatnonzero(n)
    return [used], n[used]


def _two_words(frequent: np.ndarray):
    def grow(block: Block):
        known = marked(frequent, block.phrase(np.arange(len(block.words))))
        known[0] = False
        good = known[block.ids]
        at = np.flatnonzero(good[:-1] & good[1:])
        base = len(block.words)
        codes, n = np.unique(block.ids[at].astype(np.int64) * base + block.ids[at + 1], return_counts=True)
        return list(np.divmod(codes, base)), n

    return grow


def _three_words(new: list[np.ndarray], old: list[np.ndarray] | None):
    """Triples that the bitmaps (first pairs, last pairs, pairs to settle) let grow, but not before."""

    def grow(block: Block):
        ids, base = block.ids.astype(np.int64), len(block.words)
        inside = ids > 0
        pairs = np.flatnonzero(inside[:-1] & inside[1:])
        codes, which = np.unique(ids[pairs] * base + ids[pairs + 1], return_inverse=True)
        hashes = block.phrase(*np.divmod(codes, base))
        number = np.full(len(ids), -1)
        number[pairs] = which
        first = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0)) if len(ids) else pairs
        before, after = number[first], number[first + 1]

        def grown(maps: list[np.ndarray]) -> np.ndarray:
            begins, ends, settles = (marked(m, hashes) for m in maps)
            return begins[before] & ends[after] | settles[before] | settles[after]

        wanted = grown(new)
        if old is not None:
            wanted &= ~grown(old)
        before, third = before[wanted], ids[first[wanted] + 2]
        triples, n = np.unique(before * base + third, return_counts=True)
        pair, third = np.divmod(triples, base)
        return [*np.divmod(codes[pair], base), third], n

    return grow


def _count(rows: DataFrame, grow: Callable) -> DataFrame:
    found = rows.mapInArrow(_counted(grow), "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _ratio(count: str, *divisors: str) -> Column:
    """floor(SCALE * count * ... / divisors), exact; as many counts as divisors."""
    above = " * ".join([str(SCALE)] + [f"CAST({count} AS DECIMAL(15,0))"] * len(divisors))
    below = " * ".join(f"CAST({d} AS DECIMAL(18,0))" for d in divisors)
    return F.expr(f"CAST(({above}) div ({below}) AS BIGINT)")


def _word(k: int) -> Column:
    return F.split("phrase", " ")[k]


def _hash_of(*columns: pa.Array) -> np.ndarray:
    return phrase_hashes(*(string_hashes(c) for c in columns))


def scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (lang, phrase, n) with their parts' counts, their score and their bounds.

    ``first_bound`` bounds the score of every longer phrase that begins with the pair,
    ``last_bound`` of every one that ends with it.
    """
    named = pairs.select("lang", _word(0).alias("first"), _word(1).alias("last"), F.col("n").alias("a"))
    left = words.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = words.select("lang", F.col("phrase").alias("last"), F.col("n").alias("r"))
    joined = named.join(left, ["lang", "first"]).join(right, ["lang", "last"])
    return joined.select(
        "lang", "first", "last", "a", "l", "r",
        _ratio("a", "l", "r").alias("score"),
        _ratio("a", "l").alias("first_bound"),
        _ratio("a", "r").alias("last_bound"),
    )


def scored_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Triples with the cut of the lowest score, ties to the shorter first part."""
    named = triples.select(
        "lang", "phrase", F.col("n").alias("a"), _word(0).alias("x"), _word(1).alias("y"), _word(2).alias("z")
    )
    begin = pairs.select(
        "lang", F.col("first").alias("x"), F.col("last").alias("y"), F.col("l").alias("n_x"), F.col("a").alias("n_xy")
    )
    end = pairs.select(
        "lang", F.col("first").alias("y"), F.col("last").alias("z"), F.col("r").alias("n_z"), F.col("a").alias("n_yz")
    )
    joined = named.join(begin, ["lang", "x", "y"]).join(end, ["lang", "y", "z"])
    joined = joined.withColumn("early", _ratio("a", "n_x", "n_yz")).withColumn("late", _ratio("a", "n_xy", "n_z"))
    early = F.col("early") <= F.col("late")
    return joined.select(
        "lang", "phrase", "x", "y", "z", "a",
        F.when(early, F.col("n_x")).otherwise(F.col("n_xy")).alias("l"),
        F.when(early, F.col("n_yz")).otherwise(F.col("n_z")).alias("r"),
        F.least("early", "late").alias("score"),
    )


def _cuts(pairs: DataFrame, goal: int) -> DataFrame:
    """(lang, cut): a score that about ``goal`` of a language's pairs reach, 0 if there are fewer."""
    ranges = pairs.groupBy("lang", F.floor(F.col("score") / BUCKET).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # A language has at most SCALE / BUCKET + 1 ranges.
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("bucket")))
    reached = ranges.withColumn("above", above)
    cut = F.max(F.when(F.col("above") >= goal, F.col("bucket") * BUCKET))
    return reached.groupBy("lang").agg(F.coalesce(cut, F.lit(0)).cast("long").alias("cut"))


def _survivors(pairs: DataFrame, triples: DataFrame, cuts: DataFrame, share: int) -> DataFrame:
    """Phrases that reach their language's cut and are no part of a longer one nearly as common."""
    parts = triples.select("lang", F.col("x").alias("first"), F.col("y").alias("last"), "a").unionByName(
        triples.select("lang", F.col("y").alias("first"), F.col("z").alias("last"), "a")
    )
    longer = parts.groupBy("lang", "first", "last").agg(F.max("a").alias("longer"))
    high = pairs.join(cuts, "lang").where("score >= cut").join(longer, ["lang", "first", "last"], "left")
    high = high.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    two = high.select("lang", F.concat_ws(" ", "first", "last").alias("phrase"), "a", "l", "r", "score")
    three = triples.join(cuts, "lang").where("score >= cut").select("lang", "phrase", "a", "l", "r", "score")
    return two.unionByName(three)


def mine(
    docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, bits: int = BITS, step: int = 4
) -> DataFrame:
    """Each language's ``top`` phrases of two or three words of ``docs`` (text, lang).

    Returns lang, rank, phrase, a, l, r, n and score; a phrase stands ``least`` times at least, and
    one that lies in a longer phrase with ``share`` percent of its count or more is left out.
    A null text is empty, a null language `und`; repeated rows count each time; equal scores
    and counts are ranked by the phrase's bytes. A language without such phrases has no rows.
    Each round of growth takes ``step`` times as many pairs as the one before.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    words = stage(_count(rows, _one_word), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    known = build_bitmap(frequent, ["lang", "phrase"], _hash_of, bits)
    pairs = _count(rows, _two_words(known)).where(F.col("n") >= least)
    pairs = stage(scored_pairs(pairs, frequent), "pairs")

    goal, cuts, triples, old = 2 * top, None, None, None
    while True:
        fresh = _cuts(pairs, goal)
        if cuts is not None:  # a settled language keeps its cut
            fresh = fresh.join(cuts.withColumnRenamed("cut", "kept"), "lang").select(
                "lang", F.when(F.col("settled"), F.col("kept")).otherwise(F.col("cut")).alias("cut")
            )
        fresh = stage(fresh, "cuts")
        bounded = pairs.join(fresh, "lang")
        columns = ["lang", "first", "last"]
        new = [
            build_bitmap(bounded.where(F.col(bound) >= F.col("cut")), columns, _hash_of, bits)
            for bound in ("first_bound", "last_bound", "score")
        ]
        grown = _count(rows, _three_words(new, old)).where(F.col("n") >= least)
        grown = stage(scored_triples(grown, pairs), "triples")
        triples = grown if triples is None else triples.unionByName(grown)
        found = _survivors(pairs, triples, fresh, share)
        enough = found.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
        state = fresh.join(enough, "lang", "left")
        settled = (F.col("cut") == 0) | (F.coalesce("found", F.lit(0)) >= top)
        cuts = stage(state.select("lang", "cut", settled.alias("settled")), "settled")
        if cuts.where("not settled").isEmpty():
            break
        goal, old = goal * step, new
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
