"""Text expressions: Unicode trim and label normalisation, all JVM-side."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from tallyforge.schema import UNKNOWN_TEXT

WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
_PLAIN = set("abcdefghijklmnopqrstuvwxyz0123456789'/-")


def trim_unicode(value: Column) -> Column:
    """Trim every Unicode blank; plain ``trim`` leaves no-break spaces."""
    return F.btrim(value.cast("string"), F.lit(WHITESPACE))


def trim_unicode_sql(value: str) -> str:
    codes = "".join(f"\\u{ord(char):04x}" for char in WHITESPACE)
    return f"btrim(cast({value} as string), '{codes}')"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Compatibility folding of every non-ASCII character, grouped by result.

    Returns the characters and targets of one ``translate`` call (characters without a
    target vanish) and the few that expand to several characters.
    """
    same_length: dict[str, str] = {"’": "'"}
    vanishing: list[str] = []
    expanding: dict[str, str] = {}
    for code in range(0x80, 0x110000):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or char in same_length:
            continue
        pieces = unicodedata.normalize("NFKD", char)
        kept = "".join(
            piece if piece in _PLAIN else " "
            for piece in pieces
            if not unicodedata.combining(piece)
        )
        if not kept:
            vanishing.append(char)
        elif len(kept) == 1 and kept != " ":
            same_length[char] = kept
        elif kept.strip():
            expanding[char] = kept
    return (
        "".join(same_length) + "".join(vanishing),
        "".join(same_length.values()),
        expanding,
    )


def normalize_label(value: Column) -> Column:
    """Lower-case ASCII form of a label: accents dropped, other signs to one blank."""
    source, target, expanding = _folding()
    text = F.lower(value.cast("string"))
    # One constant-folded literal; the lookup is reached only by texts that need it.
    pairs = "\x1e".join(char + "\x1f" + folded for char, folded in expanding.items())
    lookup = F.str_to_map(F.lit(pairs), F.lit("\x1e"), F.lit("\x1f"))
    expanded = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c: F.when(c < "\x80", c).otherwise(F.coalesce(F.try_element_at(lookup, c), c)),
        ),
        "",
    )
    # Hash look-ups per character; a pattern of that many alternatives is far slower.
    plain = F.translate(text, "".join(expanding), "") == text
    text = F.when(plain, text).otherwise(expanded)
    text = F.translate(text, source, target)
    text = F.trim(F.regexp_replace(text, "[^a-z0-9'/-]+", " "))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(UNKNOWN_TEXT))


def truthy_sql(value: str) -> str:
    """Lenient boolean: ``true``, ``1`` or ``yes`` in any case, blanks around ignored."""
    return f"coalesce(lower({trim_unicode_sql(value)}) in ('true', '1', 'yes'), false)"
