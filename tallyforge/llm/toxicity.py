"""Toxicity with noisy-channel deobfuscation.

Suspicious spellings (look-alike symbols, spaced-out letters, repeated letters) become
lattices of what each character may stand for. Viterbi decoding under a character trigram
model, counted over the whole corpus, restores the likeliest plain word. A lexicon of words
and word beginnings, learned from the labelled training rows, then scores the restored text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyforge.llm.common import byte_slices, crc_fold, discard, small_batches, stage, text_bytes

# What a look-alike symbol may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e",
    "*": "abcdefghijklmnopqrstuvwxyz",
}
LETTERS = 27  # a to z, and 0 for anything else
CHANNEL = {"same": 0.0, "lookalike": 2.0, "drop": 1.5}
# Longer spellings are not kept for the next time.
MAX_WORD = 64
BEGINNINGS = (4, 5, 6)
PRIOR = 10.0
LEXICON_SHARE = 0.5
BEGINNING_SHARE = 0.6
BEGINNING_ROWS = 0.3
BEGINNING_WORDS = 5
MARGIN = 2.0
LEXICON_SIZE = 100_000
LABELLED_ROWS = 20_000
KNOWN_WORDS = 1 << 18
THRESHOLD = 0.7

_LETTER = re.compile(r"[a-z]")
_SYMBOL = re.compile(r"[0-9@$!|+(€*]")
_REPEAT = re.compile(r"([a-z])\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?:[ ._*-]+[^\s._*-]){2,}(?!\S)")
_EDGES = re.compile(r"^[^\w@$]+|[^\w@$!]+$")
_GAPS = re.compile(r"[ ._*-]+")
# What joins words: all but letters and look-alikes, or look-alike symbols too.
_JOINTS = (re.compile(r"[^\w@$!|+(€*]+|_+"), re.compile(r"[\W_]+"))
_JOINED = re.compile(r"[^\W_][\W_]+[^\W_]")


def code_of(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 0


# ---------------------------------------------------------------- character model


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lookup = np.zeros(256, np.int64)
    lookup[97:123] = lookup[65:91] = np.arange(1, 27)
    counts = np.zeros(LETTERS**3, np.int64)
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        for low, high in byte_slices(texts):
            joined = b"\n\n".join(texts[low:high].to_pylist())
            codes = lookup[np.frombuffer(b"\n" + joined + b"\n", np.uint8)]
            grams = (codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:]
            counts += np.bincount(grams, minlength=len(counts))
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["gram", "n"])


def letter_model(docs: DataFrame) -> np.ndarray:
    """Costs (negative log probabilities) of a letter after two others, over all texts.

    At most 27 cubed counts reach the driver, however large the corpus is.
    """
    counts = np.ones((LETTERS, LETTERS, LETTERS))
    rows = docs.select("text").mapInArrow(_count_letters, "gram long, n long")
    for gram, n in rows.groupBy("gram").agg(F.sum("n")).collect():
        counts[gram // LETTERS**2, gram // LETTERS % LETTERS, gram % LETTERS] += n
    return -np.log(counts / counts.sum(axis=2, keepdims=True))


def odd(word: str) -> bool:
    """Whether a spelling mixes letters with look-alike symbols or repeats a letter."""
    return bool(_REPEAT.search(word) or (_SYMBOL.search(word) and _LETTER.search(word)))


def decode(word: str, costs: list, breaks: bool = False) -> str:
    """The likeliest plain word behind ``word``, by Viterbi over its lattice.

    A state is the last two letters with the word written so far; a character may stay, become
    a letter it looks like, or vanish if it repeats the one before. A star masks any letter or
    none. With ``breaks`` a space may
    come before any letter. Ties go to the least word. What all states have written alike is
    put aside every MAX_WORD characters, so a spelling may have any length.
    """
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    before, done = "", []
    for at, char in enumerate(word, 1):
        options = [(char, CHANNEL["same"])] if char.isalpha() else []
        options += [(c, CHANNEL["lookalike"]) for c in LOOKALIKES.get(char, "")]
        if char == before or char == "*" or not options:
            options.append(("", CHANNEL["drop"]))
        before = char
        found: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, plain) in states.items():
            for letter, extra in options:
                if letter:
                    c = code_of(letter)
                    ways = [((b, c), (cost + extra + costs[a][b][c], plain + letter))]
                    if breaks and b:
                        apart = costs[a][b][0] + costs[b][0][c]
                        ways.append(((0, c), (cost + extra + apart, plain + " " + letter)))
                else:
                    ways = [((a, b), (cost + extra, plain))]
                for key, value in ways:
                    if key not in found or value < found[key]:
                        found[key] = value
        states = found
        if at % MAX_WORD == 0:
            alike = commonprefix([plain for _, plain in states.values()])
            done.append(alike)
            states = {k: (cost, plain[len(alike) :]) for k, (cost, plain) in states.items()}
    return "".join(done) + min((cost + costs[a][b][0], plain) for (a, b), (cost, plain) in states.items())[1]


class Restorer:
    """Plain words of texts; decoded spellings are kept for the next time."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.plain: dict[str, str] = {}
        self.parts: dict[str, set[str]] = {}

    def word(self, word: str) -> str:
        found = self.plain.get(word)
        if found is None:
            bare = _EDGES.sub("", word)
            found = decode(bare, self.costs) if odd(bare) else bare
            if len(word) <= MAX_WORD:
                if len(self.plain) >= KNOWN_WORDS:
                    self.plain.clear()
                self.plain[word] = found
        return found

    def joined(self, word: str) -> set[str]:
        """The words in a joined or long spelling: between what may join them, and where breaks are likeliest."""
        kept = self.parts.get(word)
        if kept is not None:
            return kept
        found: set[str] = set()
        for joint in _JOINTS:
            found.update(self.word(w) for w in set(joint.split(word)))
        if odd(word):
            found.update(decode(word, self.costs, breaks=True).split())
        if len(word) <= MAX_WORD:
            if len(self.parts) >= KNOWN_WORDS:
                self.parts.clear()
            self.parts[word] = found
        return found

    def spaced(self, run: str) -> set[str]:
        """The words in a run of single characters.

        Wider gaps than the run's least part words, and so do spaces where other gaps have
        none; within these parts breaks are found by the letters alone. A part and the run are
        also read as one word.
        """
        letters, gaps = _GAPS.split(run), _GAPS.findall(run)
        if run[0] in "._*-":  # the first character may itself be one of a gap
            letters, gaps = [run[0], *letters[1:]], gaps[1:]
        width = [(gap.count(" "), len(gap)) for gap in gaps]
        least, parts = min(width, default=(0, 0)), [letters[0]]
        for wide, letter in zip(width, letters[1:]):
            if wide > least:
                parts.append(letter)
            else:
                parts[-1] += letter
        whole = "".join(letters)
        found = {decode(part, self.costs) for part in {whole, *parts}}
        for part in set(parts):
            found.update(decode(part, self.costs, breaks=True).split())
        return found

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a whole text, spaced-out ones included."""
        text = text.lower()
        spellings = set(text.split())
        found = {self.word(w) for w in spellings}
        for spelling in spellings:
            if len(spelling) > MAX_WORD or _JOINED.search(spelling):
                found |= self.joined(spelling)
        for match in _SPACED.finditer(text):
            found |= self.spaced(match[0])
        found.discard("")
        return found


# ---------------------------------------------------------------- lexicon


def _sketch(text: str) -> int:
    """The least hash among runs of three words, which near copies nearly always share."""
    words = text.lower().split()
    runs = zip(words, words[1:], words[2:]) if len(words) > 2 else [words]
    return min(zlib.crc32(" ".join(run).encode()) for run in runs)


def _features(costs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(costs)
        for batch in batches:
            texts = [raw.as_py().decode() for raw in text_bytes(batch.column("text"))]
            words = map(restorer.words, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(map(_sketch, texts), pa.int64()),
                 pa.array(map(sorted, words), pa.list_(pa.string()))],
                ["toxic", "sketch", "words"],
            )

    return run


@dataclass
class Model:
    costs: np.ndarray
    words: dict[str, float]  # the share of toxic rows among those with the word
    beginnings: dict[str, float]  # the same for rows with a word that begins so
    base: float

    def share(self, word: str) -> float:
        starts = (self.beginnings.get(word[:n], 0.0) for n in BEGINNINGS if len(word) > n)
        return max(self.words.get(word, 0.0), *starts, 0.0)


def _surprise(n: str, pos: str, base: float):
    """Log-likelihood ratio of ``pos`` in ``n`` against the base share, 0 if it is not above."""
    q = F.least(F.greatest(F.col(pos) / F.col(n), F.lit(1e-9)), F.lit(1 - 1e-9))
    gain = F.col(n) * (q * F.log(q / base) + (1 - q) * F.log((1 - q) / (1 - base)))
    return F.when(q > base, gain).otherwise(0.0)


def _significant(counts: DataFrame, name: str, base: float, prior: float, least: float, bar: float) -> dict:
    share = (F.col("pos") + prior * base) / (F.col("n") + prior)
    rows = counts.withColumns({"p": share, "gain": _surprise("n", "pos", base)})
    rows = rows.where((F.col("gain") > bar) & (F.col("p") >= least))
    top = rows.orderBy(F.desc("gain"), name).limit(LEXICON_SIZE)
    return {r[0]: r[1] for r in top.select(name, "p").collect()}


def fit(docs: DataFrame, labelled: DataFrame, limit: int = LABELLED_ROWS) -> Model:
    """Learn from ``labelled`` (doc_id, text, toxic); the character model reads all ``docs``.

    ``limit`` bounds the labelled rows in use, about, taken by the hash of their id, and
    LEXICON_SIZE the words kept. Rows of one sketch, near copies, count once for a word. Words
    and beginnings are kept that stand out from all that were tested; a beginning needs
    several different toxic words. Rows without a label are not used; without any rows the
    lexicon is empty.
    """
    small_batches(docs.sparkSession)
    costs = letter_model(docs)
    usable = labelled.where("toxic in (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "text"
    )
    share = min(1.0, limit / max(1, usable.select("doc_id").count()))
    if share < 1:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = usable.mapInArrow(_features(costs), "toxic int, sketch long, words array<string>")
    rows = stage(rows, "features")
    sources = rows.select("toxic", "sketch").distinct()
    total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = (total[1] + 1) / (total[0] + 2)
    seen = rows.select("toxic", "sketch", F.explode("words").alias("word")).distinct()
    counts = stage(
        seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos")), "words"
    )
    bar = math.log(max(1, counts.count())) + MARGIN
    begin = F.explode(F.array(*(F.substring("word", 1, n) for n in BEGINNINGS))).alias("begin")
    toxic_word = (2 * F.col("pos") > F.col("n")).cast("long")
    starts = (
        counts.select("word", toxic_word.alias("toxic"), begin)
        .where(F.length("word") > F.length("begin"))
        .groupBy("begin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos"))
        .where(F.col("n") >= BEGINNING_WORDS)
    )
    telling = _significant(starts, "begin", base, 2.0, BEGINNING_SHARE, bar)
    # The share of rows, not of words, tells how far a word that only begins so is to be trusted.
    with_begin = (
        seen.select("toxic", "sketch", "word", begin)
        .where((F.length("word") > F.length("begin")) & F.col("begin").isin(list(telling)))
        .select("toxic", "sketch", "begin").distinct()
        .groupBy("begin").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos"))
    )
    words = _significant(counts, "word", base, PRIOR, LEXICON_SHARE, bar)
    beginnings = _significant(with_begin, "begin", base, PRIOR, BEGINNING_ROWS, bar)
    discard(rows, counts)
    return Model(costs, words, beginnings, base)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.costs)
        doubt: dict[str, float] = {}
        for batch in batches:
            row = batch.column("row")
            scores = []
            for raw in text_bytes(row.field("text")):
                cost = 0.0
                for word in restorer.words(raw.as_py().decode()):
                    own = doubt.get(word)
                    if own is None:
                        if len(doubt) >= KNOWN_WORDS:
                            doubt.clear()
                        own = doubt[word] = -math.log1p(-model.share(word))
                    cost += own
                scores.append(1 - (1 - model.base) * math.exp(-cost))
            yield pa.RecordBatch.from_arrays([row, pa.array(scores, pa.float64())], ["row", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): every row of ``docs`` as a struct and its toxicity from 0 to 1.

    Scores read only the text, all of it. A null or empty text has the share of toxic rows
    among those learned from; an empty table gives an empty result, other columns stay.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType())])
    return docs.select(F.struct("*").alias("row")).mapInArrow(_score(model), schema)


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows outside the held-out fold."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.where(crc_fold("doc_id", folds) != held_out)
    kept = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic is not null")
    return texts.join(kept, "doc_id")
