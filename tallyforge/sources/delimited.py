"""Delimited text: lenient scan of hand-made files and CSV export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tallyforge.runtime import materialize
from tallyforge.sources.quoted import read_records

# Cell spellings read as missing.
MISSING_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
ROW_INDEX = "row_index"
_RAW = "_raw_line"


def read_delimited(
    spark: SparkSession, path: str, sep: str = ";", line_ends_in_quotes: bool = False
) -> DataFrame:
    """Scan with every field as text; short lines are padded, over-long lines left out.

    The reader marks both kinds as corrupt, so over-long ones are told apart by the
    number of separators outside quotes; :func:`rejected_lines` returns them.
    ``row_index`` is the 0-based position among the kept lines of the folder or file. Quoted
    fields may hold line ends with ``line_ends_in_quotes``; splits of a file still run apart.
    """
    rows, names, too_long = _scan(spark, path, sep, line_ends_in_quotes)
    numbered = _with_row_index(rows.where(~too_long))
    cells = [F.when(~F.col(_quoted(c)).isin(MISSING_SPELLINGS), F.col(_quoted(c))).alias(c) for c in names]
    return numbered.select(*cells, ROW_INDEX)


def rejected_lines(
    spark: SparkSession, path: str, sep: str = ";", line_ends_in_quotes: bool = False
) -> DataFrame:
    """(file, line): the over-long lines that :func:`read_delimited` leaves out."""
    rows, _, too_long = _scan(spark, path, sep, line_ends_in_quotes)
    # The reader refuses to parse a line for nothing but itself, so the rows are stored whole.
    found = materialize(rows.where(too_long), "rejected")
    return found.select(F.col("_file").alias("file"), F.col(_RAW).alias("line"))


def _scan(spark: SparkSession, path: str, sep: str, multiline: bool) -> tuple[DataFrame, list[str], Column]:
    """The parsed lines with their file, split and place; the names; which lines are over-long."""
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW, "quote": '"', "escape": '"'}
    names = spark.read.csv(path, sep=sep, header=True, encoding="UTF-8", escape='"', multiLine=multiline).columns
    names = [name.lstrip("\ufeff") for name in names]
    fields = [T.StructField(name, T.StringType()) for name in [*names, _RAW]]
    if multiline:
        ddl = ", ".join(f"{_quoted(field.name)} string" for field in fields)
        parsed = F.from_csv("record", ddl, options | {"multiLine": "true"})
        rows = read_records(spark, path, sep).select("_file", "_start", "_line", parsed.alias("_row"))
        rows = rows.select("_row.*", "_file", "_start", "_line")
    else:
        rows = spark.read.schema(T.StructType(fields)).csv(path, header=True, encoding="UTF-8", **options)
        rows = rows.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_line"),
        )
    unquoted = F.regexp_replace(F.col(_RAW), '"[^"]*+(?:""[^"]*+)*+"', "")
    separators = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit("")))
    return rows, names, F.col(_RAW).isNotNull() & (separators >= len(names))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _with_row_index(rows: DataFrame) -> DataFrame:
    """Position of each line, from per-split line counts instead of one global sort.

    A line's place among those kept of its file split plus the number of lines in the splits
    before it gives the position. A split is sorted alone; only the split counts are ordered
    together. The parsed lines are written once, so both passes see the same ids.
    """
    placed = materialize(rows, "delimited")
    splits = placed.groupBy("_file", "_start").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    offsets = splits.select("_file", "_start", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_line"))
    numbered = placed.withColumn("_place", place).join(offsets, ["_file", "_start"])
    return numbered.withColumn(ROW_INDEX, F.col("_before") + F.col("_place") - 1)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep, encoding="UTF-8")
