import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.numbers import count_sql, parse_count, round_half_even
from tallyforge.functions.text import normalize_label, trim_unicode, truthy_sql


def plain_form(value):
    """What a label must become, character by character."""
    pieces = unicodedata.normalize("NFKD", value.lower().replace("’", "'"))
    kept = "".join(c for c in pieces if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^a-z0-9'/-]", " ", kept).split()) or "inconnu"


def test_labels_match_the_unicode_rules_for_every_character(spark):
    codes = [c for c in range(1, 0x1FFFF) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(f"a{chr(c)}b",) for c in codes], "x string")
    found = rows.select("x", normalize_label(F.col("x")).alias("n")).collect()
    assert [(r.x, r.n) for r in found if r.n != plain_form(r.x)] == []


@pytest.mark.parametrize(
    "given,expected",
    [
        (None, "inconnu"),
        ("", "inconnu"),
        ("    ", "inconnu"),
        ("Vol à main armée", "vol a main armee"),
        ("Découverte fœtus", "decouverte f tus"),
        ("L’ÉTAT  d'\turgence", "l'etat d' urgence"),
        ("C/ État - n° 5", "c/ etat - n 5"),
        ("ﬁn du ½ mois", "fin du 1 2 mois"),
    ],
)
def test_label_examples(spark, given, expected):
    rows = spark.createDataFrame([(given,)], "x string")
    assert rows.select(normalize_label(F.col("x"))).first()[0] == expected


COUNTS = [
    (None, 0), ("", 0), ("-", 0), ("--", 0), ("nan", 0), ("None", 0), (" - ", 0),
    ("02", 2), ("1 234", 1234), (" 1 234 ", 1234), ("1,5", 2), ("2,5", 2), ("3.5", 4),
    ("1e3", 1000), ("1_0", 10), ("+7", 7), ("-0", 0), (".5", 0), ("5.", 5),
    ("-3", None), ("abc", None), ("1d", None), ("NaN", None), ("inf", None), ("1__0", None),
    ("0x10", None), ("1 , 5", 2), ("1e400", None), ("1\t2", None),
]


def test_counts(spark):
    rows = spark.createDataFrame(COUNTS, "x string, expected long")
    found = rows.select("x", "expected", parse_count("x").alias("n")).collect()
    assert [(r.x, r.n) for r in found] == [(r.x, r.expected) for r in found]


def test_rounding_is_half_even_and_never_minus_zero(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.2,)], "x double")
    assert [str(r[0]) for r in rows.select(round_half_even(F.col("x"))).collect()] == [
        "0.0", "2.0", "2.0", "0.0",
    ]


def test_trim_and_booleans(spark):
    rows = spark.createDataFrame([(" \t TRUE ",), ("yes",), ("1",), ("0",), (None,)], "x string")
    found = rows.select(trim_unicode(F.col("x")), F.expr(truthy_sql("x"))).collect()
    assert found[0][0] == "TRUE"
    assert [r[1] for r in found] == [True, True, True, False, False]


def test_missing_counts_in_floating_columns(spark):
    rows = spark.createDataFrame([(float("nan"),), (None,), (2.5,), (3.0,)], "n double")
    assert [r[0] for r in rows.selectExpr(f"{count_sql(rows, 'n')} as n").collect()] == [0, 0, 2, 3]
