"""A corpus pipeline of the operators in ``tallyforge.llm``.

``STAGES`` run in order; each takes (spark, docs, sf_dir) and its result, written as Parquet,
is the next one's ``docs``. All but the last return the columns of ``documents``, whatever
others the table has. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyforge.llm import packing, repeats, secrets, simhash, toxicity
from tallyforge.llm.common import stage, table
from tallyforge.llm.queries import tokenizer_json


def _with_text(rows: DataFrame, columns: list[str], text) -> DataFrame:
    """The columns of documents from ``row``, with another text and its length."""
    fresh = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*(fresh[c].alias(c) if c in fresh else F.col("row")[c].alias(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents predicted toxic go; the model is learned from this stage's input."""
    model = toxicity.fit(docs, toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    kept = toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD)
    return kept.select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each component the document with its smallest doc_id stays.

    Rows without doc_id stay; of several rows with the id that stays, one does.
    """
    found = simhash.near_duplicates(docs.select("doc_id", "text"), size=3, limit=3)
    leaders = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(leaders, "doc_id", "left_semi")
    kept = named.dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: repeated strings of 50 bytes go; a character that loses a byte goes whole."""
    found = repeats.remove_repeats(docs, length=50, as_text=True)
    rest = F.when(F.size("spans") > 0, F.col("kept")).otherwise(F.col("row.text"))
    return _with_text(found, docs.columns, rest)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the spans of secrets are redacted, the documents stay."""
    found = secrets.find_secrets(docs)
    return _with_text(found, docs.columns, secrets.redacted(F.col("row.text"), F.col("spans")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the place of each piece of each document in a training sequence."""
    pieces = packing.tokenised_pieces(docs.select("doc_id", "text"), tokenizer_json())
    return packing.pack(stage(pieces, "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

# Fingerprints, learned scores and tokenizers are beyond SQL; tests/llm checks the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
