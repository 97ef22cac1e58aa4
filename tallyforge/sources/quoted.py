"""Records of delimited text whose quoted fields hold line ends, read by many tasks.

Whether a line begins inside a quoted field depends on all lines before it, but each line
only maps the two possible states (outside, inside) to two others. The maps of a file split
are composed within the split, those of the splits along the file, so every line learns its
state without one task reading a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyforge.runtime import materialize

_QUOTED = '"[^"]*+(?:""[^"]*+)*+'  # an opening quote and its content, doubled quotes included
_SPLIT = ["_file", "_start"]


def read_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(_file, _start, _line, record): one row per record; place of its first line beside it.

    Lines end with LF or CRLF; line ends inside a record stay as they are. A quote opens a
    field only at its beginning, a doubled one stands for itself. A quote that is never closed
    makes the rest of its file one record. Blank lines between records and the first record of
    each file, its header, are left out. Only lines of records that span lines are gathered.
    """
    value = F.regexp_replace("value", "^\ufeff", "")
    lines = spark.read.text(path, lineSep="\n").select(
        value.alias("value"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
        _ends_inside(value, sep).alias("_outside"),
        _ends_inside(F.concat(F.lit('"'), value), sep).alias("_inside"),
    )
    placed = _with_states(materialize(lines, "lines"))
    owned = _with_owner(materialize(placed, "states"))
    alone = F.col("_begins") & ~F.col("_open")
    single = owned.where(alone).select(*_SPLIT, "_line", F.col("value").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("_start", "_line", "value")))
    several = owned.where(~alone).groupBy("_file", "_owner").agg(parts.alias("parts")).select(
        "_file",
        F.col("_owner._start").alias("_start"),
        F.col("_owner._line").alias("_line"),
        F.array_join(F.col("parts.value"), "\n").alias("record"),
    )
    records = single.unionByName(several).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    place = F.row_number().over(Window.partitionBy(*_SPLIT).orderBy("_line"))
    numbered = records.where(F.trim("record") != "").withColumn("_place", place)
    return numbered.where((F.col("_start") > 0) | (F.col("_place") > 1)).drop("_place")


def _ends_inside(line: Column, sep: str) -> Column:
    """Whether a quoted field is open at the end of a line that begins outside of one."""
    mark = "\\" + sep if not sep.isalnum() else sep
    other = f"[^{mark}]*+"
    closed = f'(?:{_QUOTED}"{other}|[^"{mark}]{other}|{mark})'
    # After a separator a field begins; a field ends at one, so fields and separators alternate.
    return line.rlike(f'(?s)^{closed}*+{_QUOTED}\\z')


def _compose(value: Column, swaps: Column, before: Column) -> Column:
    """The state after maps whose last constant is ``value``, with ``swaps`` after it."""
    return F.pmod(F.coalesce(value, before) + swaps, F.lit(2))


def _with_states(lines: DataFrame) -> DataFrame:
    """Adds ``_begins`` (the line starts outside) and ``_open`` (it ends inside)."""
    order = Window.partitionBy(*_SPLIT).orderBy("_line")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    outside, inside = F.col("_outside").cast("int"), F.col("_inside").cast("int")
    lines = lines.withColumn("_swaps", F.sum(outside * (1 - inside)).over(upto))
    constant = F.when(outside == inside, F.struct("_line", outside.alias("value"), "_swaps"))
    lines = lines.withColumns({
        "_now": F.last(constant, ignorenulls=True).over(upto),
        "_then": F.last(constant, ignorenulls=True).over(earlier),
        "_earlier_swaps": F.coalesce(F.lag("_swaps").over(order), F.lit(0)),
    })

    splits = lines.groupBy(*_SPLIT).agg(F.max("_now").alias("last"), F.max("_swaps").alias("swaps"))
    splits = splits.withColumn("after", F.col("swaps") - F.coalesce("last._swaps", F.lit(0)))
    along = Window.partitionBy("_file").orderBy("_start")
    splits = splits.withColumn("total", F.sum("after").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    known = F.when(
        F.col("last").isNotNull(), F.struct(F.col("last.value").alias("value"), (F.col("total") - F.col("after")).alias("base"))
    )
    splits = splits.withColumns({
        "known": F.last(known, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)),
        "past": F.coalesce(F.lag("total").over(along), F.lit(0)),
    })
    start = _compose(F.col("known.value"), F.col("past") - F.coalesce("known.base", F.lit(0)), F.lit(0))
    lines = lines.join(splits.select(*_SPLIT, start.alias("_state")), _SPLIT)

    def state(last: str, swaps: str) -> Column:
        since = F.col(swaps) - F.coalesce(f"{last}._swaps", F.lit(0))
        return _compose(F.col(f"{last}.value"), since, F.col("_state"))

    return lines.select(
        *_SPLIT, "_line", "value",
        (state("_then", "_earlier_swaps") == 0).alias("_begins"),
        (state("_now", "_swaps") == 1).alias("_open"),
    )


def _with_owner(lines: DataFrame) -> DataFrame:
    """Adds ``_owner``, the place of the line that begins the record, maybe in an earlier split."""
    order = Window.partitionBy(*_SPLIT).orderBy("_line").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.when(F.col("_begins"), F.struct("_start", "_line"))
    lasts = lines.groupBy(*_SPLIT).agg(F.max(begun).alias("_last"))
    along = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select(*_SPLIT, F.last("_last", ignorenulls=True).over(along).alias("_carried"))
    own = F.last(begun, ignorenulls=True).over(order)
    return lines.withColumn("_own", own).join(lasts, _SPLIT).withColumn("_owner", F.coalesce("_own", "_carried"))
