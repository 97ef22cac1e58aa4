"""Distribution profile: moments, histograms, IQR outliers, extremes, period totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyforge import schema as S
from tallyforge.functions.numbers import number_sql, round_half_even, round_sql
from tallyforge.operators.cleaning import factor_sql
from tallyforge.operators.quantiles import exact_quantiles, extents
from tallyforge.operators.reconcile import concordance_rate, sums_by_period
from tallyforge.operators.reshape import long_rows, one_row

HISTOGRAM_BINS = 25


def skewness_sql(column: str) -> str:
    """Bias-corrected skewness; the built-in one is the population form."""
    value = f"cast({column} as double)"
    n = f"cast(count({value}) as double)"
    return (
        f"case when count({value}) > 2 then if(min({value}) = max({value}), 0D, "
        f"skewness({value}) * sqrt({n} * ({n} - 1)) / ({n} - 2)) end"
    )


def describe(df: DataFrame, columns: list[str] = S.PROFILE_MEASURES) -> DataFrame:
    """Per measure: count, mean, median, deviation, range, quartiles, skewness, zeros."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    aggregates = []
    for c in columns:
        value = f"cast({c} as double)"
        aggregates += [
            f"count({value}) as {c}_n",
            f"avg({value}) as {c}_mean",
            f"stddev_samp({value}) as {c}_std",
            f"min({value}) as {c}_min",
            f"max({value}) as {c}_max",
            f"{skewness_sql(c)} as {c}_skew",
            f"count_if({value} = 0) / nullif(count(*), 0) * 100 as {c}_zero",
        ]
    rows = []
    for c in columns:
        low, middle, high = [round_sql(number_sql(q), 2) for q in quartiles[c]]
        rows.append(
            {
                "variable": f"'{c}'",
                "count": f"{c}_n",
                "mean": round_sql(f"{c}_mean", 2),
                "mediane": middle,
                "std": round_sql(f"{c}_std", 2),
                "min": round_sql(f"{c}_min", 2),
                "q25": low,
                "q50": middle,
                "q75": high,
                "max": round_sql(f"{c}_max", 2),
                "asymetrie_skewness": round_sql(f"{c}_skew", 2),
                "pourcentage_zero": round_sql(f"{c}_zero", 2),
            }
        )
    return long_rows(df.agg(*[F.expr(a) for a in aggregates]), [], rows)


def skewness_table(df: DataFrame, columns: list[str] = S.KEY_MEASURES) -> DataFrame:
    wide = df.agg(*[F.expr(f"{skewness_sql(c)} as {c}") for c in columns])
    return long_rows(
        wide, [], [{"variable": f"'{c}'", "skewness": round_sql(c, 3)} for c in columns]
    )


def quantile_table(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    found = exact_quantiles(df, columns, probabilities)
    rows = [
        (c, float(p), value) for c in columns for p, value in zip(probabilities, found[c])
    ]
    table = df.sparkSession.createDataFrame(rows, "variable string, probabilite double, valeur double")
    return table.withColumn("valeur", round_half_even(F.col("valeur"), 4))


def histogram(
    df: DataFrame, columns: list[str] = S.KEY_MEASURES, bins: int = HISTOGRAM_BINS, log: bool = False
) -> DataFrame:
    """Equal-width histogram with a closed last bin; empty bins are kept."""
    prepared = df.select(
        *[(F.log1p(F.col(c)) if log else F.col(c).cast("double")).alias(c) for c in columns]
    )
    known = extents(prepared, columns)
    ranges = {}
    for c in columns:
        low, high = known[c].low, known[c].high
        if low is None:
            continue
        ranges[c] = (low, high) if high > low else (low - 0.5, high + 0.5)

    if not ranges:
        return df.sparkSession.createDataFrame(
            [], "variable string, bin long, borne_gauche double, borne_droite double, nombre long"
        )
    entries = []
    for c, (low, high) in ranges.items():
        step = (high - low) / bins
        value = F.col(c)
        guess = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1))
        # A value next to an edge belongs to the bin whose stated edges enclose it.
        left = guess * step + F.lit(low)
        right = (guess + 1) * step + F.lit(low)
        place = (
            F.when(value < left, guess - 1)
            .when((value >= right) & (guess < bins - 1), guess + 1)
            .otherwise(guess)
        )
        entries.append(
            F.when(
                value.isNotNull(),
                F.struct(F.lit(c).alias("variable"), place.cast("int").alias("bin")),
            )
        )
    counted = (
        prepared.select(F.explode(F.array(*entries)).alias("entry"))
        .where(F.col("entry").isNotNull())
        .groupBy("entry.variable", "entry.bin")
        .agg(F.count("*").alias("nombre"))
    )
    edges = df.sparkSession.createDataFrame(
        [
            (c, i, low + i * (high - low) / bins, low + (i + 1) * (high - low) / bins)
            for c, (low, high) in ranges.items()
            for i in range(bins)
        ],
        "variable string, bin int, borne_gauche double, borne_droite double",
    )
    return edges.join(counted, ["variable", "bin"], "left").select(
        "variable",
        F.col("bin").cast("long").alias("bin"),
        round_half_even(F.col("borne_gauche"), 6).alias("borne_gauche"),
        round_half_even(F.col("borne_droite"), 6).alias("borne_droite"),
        F.coalesce("nombre", F.lit(0)).alias("nombre"),
    )


def iqr_outliers(
    df: DataFrame, columns: list[str] = S.PROFILE_MEASURES, factor: float = 1.5
) -> DataFrame:
    quartiles = exact_quantiles(df, columns, [0.25, 0.75])
    bounds = {}
    for c in columns:
        low, high = quartiles[c]
        if low is not None:
            bounds[c] = (low - factor * (high - low), high + factor * (high - low))
    if not bounds:
        return df.sparkSession.createDataFrame(
            [], "variable string, borne_basse double, borne_haute double, nb_atypiques long, pourcentage double"
        )
    wide = df.agg(
        F.expr("count(*) as _rows"),
        *[
            F.expr(f"count_if({c} < {number_sql(low)} or {c} > {number_sql(high)}) as {c}")
            for c, (low, high) in bounds.items()
        ],
    )
    rows = [
        {
            "variable": f"'{c}'",
            "borne_basse": round_sql(number_sql(low), 2),
            "borne_haute": round_sql(number_sql(high), 2),
            "nb_atypiques": c,
            "pourcentage": round_sql(f"100 * {c} / nullif(_rows, 0)", 2),
        }
        for c, (low, high) in bounds.items()
    ]
    return long_rows(wide, [], rows).orderBy(F.col("nb_atypiques").desc(), "variable")


def largest_rows(clean: DataFrame, limit: int = 15) -> DataFrame:
    return (
        clean.orderBy(F.col("Volume_activite").desc(), S.RECORD_ID)
        .limit(limit)
        .select(S.PERIOD, S.CATEGORY, S.LABEL, *S.KEY_MEASURES, "Volume_activite")
    )


def period_totals(
    clean: DataFrame, annualise: bool = False, factors: dict[str, float] | None = None
) -> DataFrame:
    totals = sums_by_period(clean, S.KEY_MEASURES)
    if annualise:
        factor = factor_sql(S.HALF_YEAR_FACTORS if factors is None else factors)
        totals = totals.selectExpr(
            S.PERIOD, *[f"cast(rint({c} * {factor}) as bigint) as {c}" for c in S.KEY_MEASURES]
        )
    return totals.orderBy(S.PERIOD)


def findings(clean: DataFrame, reconciliation: DataFrame) -> DataFrame:
    """One row: size, periods, gaps and the skewness of the key measures."""
    periods = clean.select(S.PERIOD).distinct()
    return one_row(
        [
            clean.agg(
                F.count("*").alias("nombre_lignes"),
                *[
                    F.expr(f"{round_sql(skewness_sql(c), 3)} as asymetrie_{c}")
                    for c in S.KEY_MEASURES
                ],
            ),
            periods.agg(F.array_join(F.sort_array(F.collect_list(S.PERIOD)), ", ").alias("periodes")),
            concordance_rate(reconciliation).select("ecarts"),
        ]
    )


def with_share(df: DataFrame, column: str) -> DataFrame:
    """Percentage of the column's total; the total is one scalar subquery."""
    total = df.agg(F.sum(column).alias("total")).scalar()
    return df.withColumn("pourcentage", round_half_even(100 * F.col(column) / F.nullif(total, F.lit(0)), 2))
