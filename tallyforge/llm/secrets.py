"""Secret scans over a trigram index.

From each rule's pattern a Boolean query over the trigrams that any match must hold is
derived. Every slice of texts is a shard of the index: the postings of the wanted trigrams
are built once, intersected and united for all rules, and only the texts left are verified
by the patterns. A pattern without mandatory trigrams is looked for in all texts. No text
leaves the task that has read it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyforge.llm.common import byte_slices, small_batches, text_bytes

EXACT_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, left to right without overlaps, of ``least`` characters in ``group``."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The patterns and lengths that the query states.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
# Published forms of further credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)


# ---------------------------------------------------------------- queries from patterns
# A query is True (no condition), a trigram, ("and", parts) or ("or", parts).


def _all(parts: list) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _grams(strings: set[str]) -> object:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(nodes) -> tuple[set[str] | None, object]:
    """(all strings that the nodes match, or None; what any match must hold)."""
    run: set[str] = {""}
    exact, needs = True, []

    def end_run() -> None:
        nonlocal run, exact
        needs.append(_grams(run))
        run, exact = {""}, False

    for kind, value in nodes:
        name = str(kind)
        strings, need = None, True
        if name == "LITERAL":
            strings = {chr(value).lower()}
        elif name == "IN" and all(str(k) == "LITERAL" for k, _ in value):
            strings = {chr(v).lower() for _, v in value}
        elif name == "SUBPATTERN":
            strings, need = _walk(value[3])
        elif name == "BRANCH":
            found = [_walk(v) for v in value[1]]
            if all(f[0] is not None for f in found):
                strings = set().union(*(f[0] for f in found))
            need = _any([f[1] for f in found])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            inside, wanted = _walk(inner)
            if (low, high) == (0, 1) and inside is not None:
                strings = inside | {""}
            elif low == high and inside is not None and low <= 8 and len(inside) ** low <= EXACT_STRINGS:
                strings = {"".join(p) for p in product(inside, repeat=low)}
            elif low:
                need = wanted
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if strings is None or len(run) * len(strings) > EXACT_STRINGS:
            end_run()
            needs.append(need)
        else:
            run = {a + b for a, b in product(run, strings)}
    if exact:
        return run, _all([*needs, _grams(run)])
    end_run()
    return None, _all(needs)


def trigram_query(pattern: str) -> object:
    """What a text in lower case must hold to match; True if any text may."""
    return _walk(re._parser.parse(pattern, re.ASCII))[1]


def query_grams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(query_grams, query[1]))


class Shard:
    """Postings of the wanted trigrams over the texts of a slice."""

    def __init__(self, texts: pa.Array, wanted: np.ndarray, grams: list[str]):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets[1:] - offsets[0]
        raw = raw + np.uint8(32) * ((raw >= 65) & (raw <= 90))
        wide = raw.astype(np.int32)
        codes = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        number = wanted[codes] if len(wide) > 2 else np.zeros(0, np.uint16)
        at = np.flatnonzero(number)
        text = np.searchsorted(ends, at, side="right")
        whole = at + 3 <= ends[text]
        pairs = np.unique(number[at[whole]].astype(np.int64) << 32 | text[whole])
        gram, text = pairs >> 32, pairs & 0xFFFFFFFF
        cuts = np.searchsorted(gram, np.arange(1, len(grams) + 2))
        self.postings = {g: text[cuts[i] : cuts[i + 1]] for i, g in enumerate(grams)}
        self.everything = np.arange(len(texts))

    def search(self, query: object) -> np.ndarray:
        if query is True:
            return self.everything
        if isinstance(query, str):
            return self.postings[query]
        found = [self.search(part) for part in query[1]]
        out = found[0]
        for other in found[1:]:
            out = np.intersect1d(out, other, True) if query[0] == "and" else np.union1d(out, other)
        return out


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(r.pattern, re.ASCII) for r in rules]
        queries = [trigram_query(r.pattern) for r in rules]
        # A trigram beyond ASCII is no condition: the index reads bytes.
        grams = sorted(g for g in set().union(*map(query_grams, queries)) if g.isascii())
        wanted = np.zeros(1 << 24, np.uint16)
        for i, gram in enumerate(grams, 1):
            a, b, c = gram.encode()
            wanted[a << 16 | b << 8 | c] = i
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            row = batch.column("row")
            texts = text_bytes(row.field("text"))
            spans: list[list] = []
            for low, high in byte_slices(texts):
                part = texts[low:high]
                shard = Shard(part, wanted, grams)
                found: list[list] = [[] for _ in range(len(part))]
                decoded: dict[int, str] = {}
                for order, (rule, pattern, query) in enumerate(zip(rules, patterns, queries, strict=True)):
                    for i in shard.search(query).tolist():
                        if i not in decoded:
                            if query is True:
                                decoded = {}
                            decoded[i] = part[i].as_py().decode()
                        for m in pattern.finditer(decoded[i]):
                            if len(m[rule.group]) >= rule.least:
                                found[i].append((m.start(), order, m.end()))
                spans += [
                    [{"kind": rules[o].kind, "start": a, "stop": b} for a, o, b in sorted(f)] for f in found
                ]
            yield pa.RecordBatch.from_arrays([row, pa.array(spans, kind)], ["row", "spans"])

    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """(row, spans): every row of ``docs`` as a struct and its matches by start, then rule.

    Spans are in characters (code points), end exclusive, over whole texts. Spans of different
    rules may overlap. A null or empty text has none; repeated rows have the same ones; an
    empty table gives an empty result, and other columns stay in ``row``.
    """
    small_batches(docs.sparkSession)
    for rule in rules:
        trigram_query(rule.pattern)
    span = T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("stop", T.LongType()),
        ]
    )
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("spans", T.ArrayType(span))])
    return docs.select(F.struct("*").alias("row")).mapInArrow(_scan(tuple(rules)), schema)


def joined_spans(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redacted(text, spans, mark: str = "[REDACTED]"):
    """``text`` with each maximal covered stretch of the spans replaced by ``mark``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state, span):
        fresh = span["start"] >= state["at"]
        gap = F.substring(text, state["at"].cast("int") + 1, (span["start"] - state["at"]).cast("int"))
        # The first span also meets `at` 0 where it starts the text.
        touches = (span["start"] <= state["at"]) & (state["out"] != "")
        out = F.when(fresh & ~touches, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(state["at"], span["stop"]).alias("at"))

    def finish(state):
        return F.concat(state["out"], F.substring(text, state["at"].cast("int") + 1, F.length(text)))

    done = F.aggregate(spans, start, step, finish)
    return F.when(F.size(spans) > 0, done).otherwise(text)
