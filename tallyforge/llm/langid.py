"""Language identification by n-gram filters that answer for all languages at once.

The filter is a bit-sliced Bloom filter: a slot holds one bit per language, so the AND of an
n-gram's slots gives the set of languages that know the n-gram in one probe. A text's
language is the one whose popcount, corrected for the share of n-grams that its slice of the
filter would take for known by chance, is the largest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyforge.llm.common import crc_fold, small_batches, text_bytes

SLOTS = 1 << 22
PROBES = 3
MAX_LANGUAGES = 64
# An n-gram belongs to a language where its rate is at least this part of its highest rate.
RATE_SHARE = 0.25
# An n-gram rarer than this in every language is left out, so a language has half a million at most.
LEAST_RATE = 2e-6
LEAST_COUNT = 2
UNDETERMINED = "und"
GRAMS = 1 << 22
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _letters() -> np.ndarray:
    """Whether a code point is a letter, by Unicode."""
    return np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.bool_)


def grams_of(text: str, letters: np.ndarray) -> np.ndarray:
    """Hashes of the trigrams of a text's words, in lower case, with a mark at the words' ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[points]
    # Runs of other characters shrink to one mark.
    keep = is_letter | np.append(True, is_letter[:-1])
    marked = np.concatenate([[0], np.where(is_letter, points, 0)[keep], [0, 0]]).astype(np.uint64)
    inside = np.flatnonzero(marked[1:-1])
    value = (marked[inside] << np.uint64(42)) | (marked[inside + 1] << np.uint64(21)) | marked[inside + 2]
    value = (value ^ (value >> np.uint64(31))) * np.uint64(_MULTIPLIERS[0])
    return (value ^ (value >> np.uint64(29))) * np.uint64(_MULTIPLIERS[1])


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - (SLOTS.bit_length() - 1))
    return [(grams * np.uint64(m)) >> shift for m in _MULTIPLIERS[:PROBES]]


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # a bit per language
    chance: np.ndarray  # by language: the share of unknown n-grams that pass

    def rates(self, grams: np.ndarray) -> np.ndarray:
        """Share of the n-grams that each language knows, less what chance passes."""
        known = np.full(len(grams), ~np.uint64(0))
        for slot in _slots(grams):
            known &= self.slots[slot]
        bits = [np.count_nonzero(known >> np.uint64(i) & np.uint64(1)) for i in range(len(self.languages))]
        share = np.array(bits) / max(1, len(grams))
        return np.clip((share - self.chance) / (1 - self.chance), 0, 1)


def _count_grams(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            columns: list[list[np.ndarray]] = [[], [], []]
            for number, parts in held.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                for column, values in zip(columns, (np.full(len(gram), number, np.int32), gram.view(np.int64), n), strict=True):
                    column.append(values)
            held, size = {}, 0
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in columns], ["language", "gram", "n"]
            )

        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text")), strict=True):
                grams = grams_of(raw.as_py().decode(), letters)
                held.setdefault(languages.index(lang), []).append(grams)
                size += len(grams)
                if size > GRAMS:
                    yield flush()
        if held:
            yield flush()

    return run


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set the languages' bits of the n-grams in this task's slots."""
    slots = np.zeros(SLOTS, np.uint64)
    for batch in batches:
        bits = batch.column("languages").to_numpy().astype(np.uint64)
        for slot in _slots(batch.column("gram").to_numpy().view(np.uint64)):
            np.bitwise_or.at(slots, slot, bits)
    used = np.flatnonzero(slots)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), pa.array(slots[used].view(np.int64))], ["slot", "bits"]
    )


def fit(labelled: DataFrame) -> Filters:
    """Filters from ``labelled`` (text, lang), over all of its rows and whole texts.

    Rows without lang are not used. The filter has a fixed size, whatever the corpus holds;
    what each n-gram counts is summed by Spark and never leaves the executors.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    usable = labelled.where("lang is not null and text is not null").select("lang", "text")
    found = usable.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).orderBy("lang")
    found = found.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"a slot has room for {MAX_LANGUAGES} languages")
    languages = [r[0] for r in found]
    slots = np.zeros(SLOTS, np.uint64)
    if not languages:
        return Filters([], slots, np.zeros(0))
    counts = usable.mapInArrow(_count_grams(languages), "language int, gram long, n long")
    counts = counts.groupBy("gram", "language").agg(F.sum("n").alias("n"))
    size = F.element_at(F.array(*(F.lit(float(max(1, r[1]))) for r in found)), F.col("language") + 1)
    rated = counts.select("gram", "language", "n", (F.col("n") / size).alias("rate"))
    per_gram = rated.groupBy("gram").agg(
        F.max("rate").alias("top"), F.sum("n").alias("n"),
        F.collect_list(F.struct("language", "rate")).alias("by"),  # a row per language at most
    )
    bit = F.aggregate(
        F.filter("by", lambda x: x["rate"] >= F.col("top") * RATE_SHARE),
        F.lit(0).cast("long"),
        lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["language"])),
    )
    members = per_gram.where((F.col("n") >= LEAST_COUNT) & (F.col("top") >= LEAST_RATE)).select("gram", bit.alias("languages"))
    filled = members.mapInArrow(_fill, "slot long, bits long")
    merged = filled.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    slots[merged.column("slot").to_numpy()] = merged.column("bits").to_numpy().view(np.uint64)
    full = [np.count_nonzero(slots >> np.uint64(i) & np.uint64(1)) / SLOTS for i in range(len(languages))]
    return Filters(languages, slots, np.array(full) ** PROBES)


def _predict(filters: Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            row = batch.column("row")
            names, scores = [], []
            for raw in text_bytes(row.field("text")):
                grams = grams_of(raw.as_py().decode(), letters)
                name, score = UNDETERMINED, 0.0
                if len(grams) and filters.languages:
                    rates = filters.rates(grams)
                    best = int(rates.argmax())
                    name, score = filters.languages[best], float(rates[best] / max(rates.sum(), 1e-9))
                names.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["row", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """(row, lang_pred, score): every row of ``docs`` as a struct with its language.

    Only the text is read, all of it. A null text or one without a letter is ``und`` with score
    0, as is any text if no language was learned; ties go to the language that sorts first.
    The score is the language's part of all languages' rates. Other columns stay in ``row``.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType(
        [
            T.StructField("row", docs.schema),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return docs.select(F.struct("*").alias("row")).mapInArrow(_predict(filters), schema)


def training_rows(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(text, lang) of the rows outside the held-out fold that name a language."""
    return docs.where((crc_fold("doc_id", folds) != held_out) & F.col("lang").isNotNull()).select("text", "lang")
