"""Named queries over the given tables, one or more per operator.

Single-pass queries are lazy plans over the fact tables. Queries whose operator scans its
input several times store the derived cells once in the shared folder first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyforge import schema as S
from tallyforge.functions.numbers import number_sql, parse_count, round_half_even, round_sql
from tallyforge.functions.text import normalize_label, truthy_sql
from tallyforge.operators import anomaly_rules as rules
from tallyforge.operators import clustering, isolation, profile, quality, regressors, validation
from tallyforge.operators import reconcile as rec, serving as serve
from tallyforge.operators.cleaning import (
    clean,
    is_total_row,
    label_is_missing,
    or_default_text,
    resolve_normalised,
)
from tallyforge.operators.contracts import require_columns, split_scoring_input, with_scoring_defaults
from tallyforge.operators.documents import flatten_results
from tallyforge.operators.ranks import correlation_table, spearman, strongest_pairs
from tallyforge.operators.regressors import PREDICTION
from tallyforge.operators.reshape import long_rows
from tallyforge.operators.scoring import score
from tallyforge.plans import dashboard, stages
from tallyforge.runtime import materialize, scratch_path
from tallyforge.sources import cells
from tallyforge.sources.delimited import ROW_INDEX, read_delimited, write_csv
from tallyforge.sources.documents import read_document, write_document
from tallyforge.sources.models import load_model, save_model
from tallyforge.sources.tables import StageMissing, load_serving_table, read_prepared, write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# Trees of the registered isolation forests.
MODEL_TREES = 400
SWEEP_TREES = 300
LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---------------------------------------------------------------- shared inputs


def fine_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(cells.fine_cells(spark, sf_dir), cells.ORDINAL, cells.PERIOD_FACTORS)


def coarse_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(cells.coarse_cells(spark, sf_dir), cells.ORDINAL, cells.PERIOD_FACTORS)


def stored_fine(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Fine clean cells stored once, for operators that scan them several times."""
    frame = fine_clean(spark, sf_dir)
    return materialize(frame.select(*columns) if columns else frame, "fine_cells")


def standin_enriched(rows: DataFrame) -> DataFrame:
    """Deterministic stand-ins for the columns models append."""
    score = round_sql("(Resultats_DEF - MiseEnCause_Interpelles) / (Total_saisines + 1)", 6)
    marked = rows.selectExpr(
        "*",
        "if(Total_saisines % 7 = 0, null, Total_saisines % 3) as Cluster",
        f"{round_sql('Taux_DEF_sur_saisines * 2 - 1', 4)} as PCA_1",
        "if(Total_saisines % 7 = 0, null, Volume_activite / 8D) as PCA_2",
        f"{score} as {rules.SCORE}",
        f"Resultats_DAT > Resultats_DEF as {rules.FLAG}",
    )
    level = (
        f"case when not {rules.FLAG} then '{S.LEVEL_NORMAL}' when {rules.SCORE} >= 0.2D then '{S.LEVEL_HIGH}' "
        f"when {rules.SCORE} >= 0.05D then '{S.LEVEL_MEDIUM}' else '{S.LEVEL_LOW}' end"
    )
    reason = f"if({rules.FLAG}, concat('raison ', {S.PERIOD}), '')"
    return marked.selectExpr("*", f"{level} as {rules.LEVEL}", f"{reason} as {rules.REASONS}")


def coarse_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.to_serving(standin_enriched(coarse_clean(spark, sf_dir)))


def fine_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.to_serving(standin_enriched(fine_clean(spark, sf_dir)))


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.reconcile(coarse_clean(spark, sf_dir), cells.official_totals(spark, sf_dir))


def flagged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule reasons plus flags from a stand-in decision value."""
    stored = stored_fine(
        spark, sf_dir, S.RECORD_ID, *S.ANOMALY_FEATURES, "Total_saisines", S.MISSING_LABEL, "Volume_activite"
    )
    decision = F.lit(0.5) - F.col("Resultats_DAT") / (F.col("Total_saisines") + 1)
    return rules.with_flags(rules.with_reasons(stored, rules.rule_thresholds(stored)), decision)


def spelled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document sources with gaps, blanks and no-break spaces."""
    source = F.col("source")
    spelled = (
        F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string"))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit(" "), source, F.lit(" ")))
        .when(F.col("doc_id") % 5 == 2, F.lit("\t "))
        .otherwise(F.concat(F.lit(" "), source))
    )
    return cells.read(spark, sf_dir, "documents").select("doc_id", "text", spelled.alias("libelle"))


# ---------------------------------------------------------------- sources and sinks


@query
def s1_delimited_scan(spark, sf_dir):
    path = scratch_path(spark, "delimited")
    write_csv(cells.coarse_cells(spark, sf_dir).drop(cells.ORDINAL), path, sep=";")
    return read_delimited(spark, path).drop(ROW_INDEX)


@query
def s2_typed_round_trip(spark, sf_dir):
    path = scratch_path(spark, "clean")
    write_table(fine_clean(spark, sf_dir), path, partition_by=[S.PERIOD])
    return read_prepared(spark, path, "clean table missing").select(*S.CLEAN_COLUMNS)


@query
def s3_csv_sink(spark, sf_dir):
    frame = fine_clean(spark, sf_dir)
    path = scratch_path(spark, "csv")
    write_csv(frame, path)
    return spark.read.schema(frame.schema).csv(path, header=True, emptyValue="").na.fill("")


@query
def s4_json_document(spark, sf_dir):
    path = scratch_path(spark, "report")
    # The report reads its rows three times over, the facts behind them only once.
    rows = materialize(coarse_clean(spark, sf_dir), "coarse_cells")
    gaps = rec.reconcile(rows, cells.official_totals(spark, sf_dir))
    write_document(quality.quality_report(rows, gaps), path)
    report = read_document(spark, path, "quality report missing")
    kept = [n for n, kind in report.dtypes if kind == "bigint" and n != "nombre_periodes"]
    return report.select(*kept)


@query
def s6_serving_table_load(spark, sf_dir):
    frame = fine_serving(spark, sf_dir)
    table, path = "tallyforge_infractions", scratch_path(spark, "serving")
    forced = load_serving_table(frame, table, force=True, path=path)
    kept = load_serving_table(frame.limit(0), table, path=path)
    return spark.createDataFrame([("force", forced), ("sans force", kept)], "appel string, lignes long")


@query
def s6_period_swap(spark, sf_dir):
    """Rows by period before, between and after a load that changes, adds and drops periods."""
    frame = fine_serving(spark, sf_dir)
    table, path = "tallyforge_swapped", scratch_path(spark, "serving")
    changed = frame.where("annee <> '1993'").withColumns({
        "saisine_plaintes_directes": F.expr("saisine_plaintes_directes + if(annee = '1995', 1, 0)"),
        "annee": F.expr("if(annee = '1994' and saisine_plaintes_directes % 2 = 0, '1994-S2', annee)"),
    })

    def state(step: str) -> DataFrame:
        found = spark.table(table).groupBy("annee").agg(
            F.count("*").alias("lignes"), F.sum("saisine_plaintes_directes").alias("plaintes")
        )
        return materialize(found.select(F.lit(step).alias("etape"), "*"), "state")

    load_serving_table(frame, table, force=True, path=path)
    steps = [state("avant")]
    load_serving_table(changed, table, path=path)
    steps.append(state("entre"))
    load_serving_table(changed, table, force=True, path=path)
    return reduce(DataFrame.unionByName, [*steps, state("apres")])


@query
def s7_read_prepared(spark, sf_dir):
    path = scratch_path(spark, "reconciliation")
    write_table(reconciliation(spark, sf_dir), path)
    return read_prepared(spark, path, "reconciliation missing")


@query
def s8_listing_export(spark, sf_dir):
    rows = serve.listing(coarse_serving(spark, sf_dir), limit=1000)
    path = scratch_path(spark, "export")
    write_csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True, emptyValue="").na.fill("")


def _accepted(check: Callable, *given, **named) -> bool:
    try:
        check(*given, **named)
    except ValueError:
        return False
    return True


@query
def v1_required_columns(spark, sf_dir):
    rows = cells.fine_cells(spark, sf_dir)
    whole = _accepted(require_columns, rows, [S.PERIOD, S.CATEGORY, *S.MEASURES])
    without = _accepted(require_columns, rows.drop(S.CATEGORY), [S.PERIOD, S.CATEGORY, *S.MEASURES])
    return rows.agg(F.count("*").alias("lignes")).select(
        "lignes", F.lit(whole).alias("complet_accepte"), F.lit(without).alias("incomplet_accepte")
    )


@query
def v3_parameter_bounds(spark, sf_dir):
    """Listing sizes at and beyond the bounds, and known and unknown filters."""
    served = materialize(fine_serving(spark, sf_dir), "serving")
    parts = []
    for limit in (0, 1, 1000, 1001):
        allowed = _accepted(serve.listing, served, limit=limit)
        shown = serve.listing(served, limit=limit) if allowed else served.limit(0)
        parts.append(
            shown.agg(F.count("*").alias("lignes")).select(
                F.lit(limit).cast("long").alias("limite"), F.lit(allowed).alias("accepte"), "lignes"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _scoring_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col(cells.ORDINAL)
    return cells.fine_cells(spark, sf_dir).select(
        cells.ORDINAL,
        F.when(key % 5 != 0, F.col(S.PERIOD)).alias("annee"),
        F.when(key % 13 != 0, F.col(S.CATEGORY)).alias("categorie"),
        F.when(key % 11 == 0, -1).when(key % 7 != 0, F.col("Saisine_FD")).alias("saisine_fd"),
    )


@query
def v2_scoring_split(spark, sf_dir):
    valid, rejected = split_scoring_input(_scoring_input(spark, sf_dir))
    valid = valid.select(cells.ORDINAL, S.PERIOD, S.CATEGORY, "Saisine_FD", F.lit(True).alias("valide"))
    rejected = rejected.select(cells.ORDINAL, "annee", "categorie", "saisine_fd", F.lit(False)).toDF(*valid.columns)
    return valid.unionByName(rejected)


@query
def v2_scoring_contract(spark, sf_dir):
    key = F.col(cells.ORDINAL)
    given = cells.fine_cells(spark, sf_dir).select(
        cells.ORDINAL,
        F.when(key % 5 != 0, F.col(S.PERIOD)).alias("annee"),
        F.col(S.CATEGORY).alias("categorie"),
        F.when(key % 11 == 0, -1).when(key % 7 != 0, F.col("Saisine_FD")).alias("saisine_fd"),
        F.col("Victimes_H").alias("victimes_h"),
    )
    filled = with_scoring_defaults(given)
    return filled.select(
        cells.ORDINAL, "annee", "categorie", "saisine_fd", "victimes_h", (F.col("saisine_fd") >= 0).alias("valide")
    )


# ---------------------------------------------------------------- projections and filters


@query
def p1_default_labels(spark, sf_dir):
    label = or_default_text(F.col("libelle"), S.UNKNOWN_LABEL)
    return spelled_labels(spark, sf_dir).select("doc_id", label.alias("libelle"))


@query
def p2_missing_label_flag(spark, sf_dir):
    return spelled_labels(spark, sf_dir).select("doc_id", label_is_missing(F.col("libelle")).alias("manquant"))


@query
def p3_normalize_labels(spark, sf_dir):
    documents = cells.read(spark, sf_dir, "documents")
    return documents.select("doc_id", normalize_label(F.col("text")).alias("normalise"))


@query
def p4_provided_label_wins(spark, sf_dir):
    label = resolve_normalised(F.col("text"), F.col("libelle"))
    return spelled_labels(spark, sf_dir).select("doc_id", label.alias("normalise"))


@query
def p5_parse_counts(spark, sf_dir):
    number = F.col("l_linenumber")
    quantity = F.col("l_quantity").cast("long").cast("string")
    spelled = (
        F.when(number == 1, F.lit("-"))
        .when(number == 2, F.concat(F.lit("00"), quantity))
        .when(number == 3, F.concat(F.lit(" 1 "), quantity))
        .when(number == 4, F.concat(quantity, F.lit(",5")))
        .when(number == 5, F.lit(None).cast("string"))
        .when(number == 6, F.lit("  "))
        .otherwise(F.concat(quantity, F.lit(".0")))
    )
    lines = cells.read(spark, sf_dir, "lineitem").withColumn("brut", spelled)
    return lines.select(
        "l_orderkey", number.cast("long").alias("l_linenumber"), "l_partkey", parse_count("brut").alias("valeur")
    )


def _clean_columns(*columns: str) -> Query:
    return lambda spark, sf_dir: fine_clean(spark, sf_dir).select(*columns)


QUERIES["p6_row_totals"] = _clean_columns(S.RECORD_ID, *S.TOTALS)
QUERIES["p7_guarded_ratio"] = _clean_columns(S.RECORD_ID, "Taux_DEF_sur_saisines")
QUERIES["p8_annualised"] = _clean_columns(S.RECORD_ID, "Facteur_annualisation", S.ANNUALISED)
QUERIES["p9_stable_ids"] = _clean_columns(S.RECORD_ID, S.PERIOD, S.CATEGORY, S.NORMALISED)
QUERIES["p11_clean_table"] = _clean_columns(*S.CLEAN_COLUMNS)


@query
def p10_optional_observations(spark, sf_dir):
    return coarse_clean(spark, sf_dir).select(S.RECORD_ID, S.OBSERVATIONS)


@query
def p12_log_features(spark, sf_dir):
    return fine_clean(spark, sf_dir).select(
        S.RECORD_ID, *[F.expr(f"{round_sql(f'log1p({c})', 6)} as {c}") for c in S.CLUSTER_FEATURES]
    )


@query
def p13_lenient_booleans(spark, sf_dir):
    turn = F.col("event_id") % 6
    said = (
        F.when(turn == 0, " TRUE ")
        .when(turn == 1, "1")
        .when(turn == 2, "Yes")
        .when(turn == 3, "false")
        .when(turn == 4, F.lit(None).cast("string"))
        .otherwise(F.col("event_type"))
    )
    events = cells.read(spark, sf_dir, "events").withColumn("dit", said)
    return events.selectExpr("event_id", f"{truthy_sql('dit')} as valeur")


@query
def p14_serving_projection(spark, sf_dir):
    return fine_serving(spark, sf_dir)


@query
def p15_flatten_documents(spark, sf_dir):
    def block(mae: str, rmse: str):
        return F.struct(
            round_half_even(F.avg(mae), 4).alias("mae"), round_half_even(F.avg(rmse), 4).alias("rmse")
        )

    documents = fine_clean(spark, sf_dir).groupBy(F.col(S.CATEGORY).alias("modele")).agg(
        block("Resultats_DEF", "Total_saisines").alias("validation_kfold"),
        block("Total_victimes", "Volume_activite").alias("validation_par_periode"),
        F.max("Resultats_DEF").cast("double").alias("mae_entrainement"),
    )
    return flatten_results(documents)


@query
def p17_share_of_total(spark, sf_dir):
    by_category = coarse_clean(spark, sf_dir).groupBy(S.CATEGORY).agg(F.sum("Volume_activite").alias("volume"))
    return profile.with_share(by_category, "volume")


@query
def f1_drop_total_rows(spark, sf_dir):
    turn = F.col("p_partkey") % 6
    label = (
        F.when(turn == 0, "S/ TOTAL")
        .when(turn == 1, "Total   general")
        .when(turn == 2, "TOTAL GENRAL")
        .when(turn == 3, F.concat(F.lit("s/total "), "p_name"))
        .otherwise(F.col("p_name"))
    )
    parts = cells.read(spark, sf_dir, "part").select("p_partkey", label.alias("libelle"))
    return parts.where(~is_total_row(F.col("libelle")))


@query
def f2_period_category_filter(spark, sf_dir):
    rows = serve.with_filters(coarse_serving(spark, sf_dir), "1997", "SMALL")
    return rows.select("record_id", "annee", "categorie")


@query
def f3_cluster_flag_filter(spark, sf_dir):
    return serve.listing(coarse_serving(spark, sf_dir), cluster=0, anomalie=False, limit=1000)


@query
def f4_flagged_level_filter(spark, sf_dir):
    return serve.anomaly_listing(coarse_serving(spark, sf_dir), S.LEVEL_MEDIUM, limit=500)


@query
def f5_mismatches(spark, sf_dir):
    return rec.mismatches(reconciliation(spark, sf_dir))


@query
def f6_drop_missing_points(spark, sf_dir):
    return serve.cluster_points(fine_serving(spark, sf_dir)).select("record_id", "cluster", "pca_1", "pca_2")


@query
def f7_columns_with_gaps(spark, sf_dir):
    return quality.missing_profile(fine_serving(spark, sf_dir), only_missing=True)


# ---------------------------------------------------------------- joins and reshapes


@query
def j1_reconcile(spark, sf_dir):
    return reconciliation(spark, sf_dir)


@query
def j2_gap_matrix(spark, sf_dir):
    return rec.gap_matrix(reconciliation(spark, sf_dir), cells.PERIODS)


@query
def j3_union_diagnostics(spark, sf_dir):
    rows = fine_clean(spark, sf_dir)

    def means(log: bool) -> DataFrame:
        wide = rows.agg(*[F.avg(F.log1p(c) if log else F.col(c)).alias(c) for c in S.CLUSTER_FEATURES])
        entries = [{"variable": f"'{c}'", "moyenne": round_sql(c, 6)} for c in S.CLUSTER_FEATURES]
        return long_rows(wide, [], entries)

    found = clustering.compare_transformations(means(False), means(True))
    return found.select("transformation", "variable", "moyenne")


@query
def j4_scalar_thresholds(spark, sf_dir):
    stored = stored_fine(spark, sf_dir, S.RECORD_ID, *S.ANOMALY_FEATURES)
    limits = rules.rule_thresholds(stored)
    count = " + ".join(f"cast({c} > {number_sql(limit)} as bigint)" for c, limit in limits.items())
    return stored.selectExpr(S.RECORD_ID, f"{count} as depassements")


@query
def j5_feature_pairs(spark, sf_dir):
    correlations = spearman(stored_fine(spark, sf_dir, *S.ANOMALY_FEATURES), S.ANOMALY_FEATURES)
    return correlation_table(correlations.where(F.col("i") < F.col("j")))


# ---------------------------------------------------------------- aggregations


@query
def a1_sums_by_period(spark, sf_dir):
    return rec.sums_by_period(fine_clean(spark, sf_dir))


@query
def a2_row_counts(spark, sf_dir):
    return quality.counts_by_period_and_category(fine_clean(spark, sf_dir))


@query
def a3_summary(spark, sf_dir):
    return serve.summary(coarse_serving(spark, sf_dir))


@query
def a3_summary_filtered(spark, sf_dir):
    return serve.summary(coarse_serving(spark, sf_dir), "1999", "LARGE")


@query
def a3_summary_no_match(spark, sf_dir):
    return serve.summary(coarse_serving(spark, sf_dir), "1900")


@query
def a4_statistics_by_period(spark, sf_dir):
    return serve.statistics_by_period(coarse_serving(spark, sf_dir))


@query
def a5_top_labels(spark, sf_dir):
    return serve.top_labels(coarse_serving(spark, sf_dir))


@query
def a5_top_labels_period(spark, sf_dir):
    return serve.top_labels(coarse_serving(spark, sf_dir), "interpelles", "1998", 50)


@query
def a6_cluster_averages(spark, sf_dir):
    return serve.cluster_averages(fine_serving(spark, sf_dir))


@query
def a8_periods(spark, sf_dir):
    return serve.distinct_values(coarse_serving(spark, sf_dir), "annee")


@query
def a8_categories(spark, sf_dir):
    return serve.distinct_values(coarse_serving(spark, sf_dir), "categorie")


@query
def a9_row_count(spark, sf_dir):
    return serve.row_count(fine_serving(spark, sf_dir))


@query
def a10_quality_report(spark, sf_dir):
    stored = materialize(coarse_clean(spark, sf_dir), "coarse_cells")
    report = quality.quality_report(stored, rec.reconcile(stored, cells.official_totals(spark, sf_dir)))
    scalars = [n for n, kind in report.dtypes if kind == "bigint"]
    return report.select(*scalars, F.array_join("periodes", ",").alias("periodes"))


@query
def a11_audit_rows(spark, sf_dir):
    return quality.audit_rows(stored_fine(spark, sf_dir))


@query
def a12_missing_profile(spark, sf_dir):
    return quality.missing_profile(fine_serving(spark, sf_dir))


@query
def a13_describe(spark, sf_dir):
    return profile.describe(stored_fine(spark, sf_dir, *S.PROFILE_MEASURES))


@query
def a13_describe_lines(spark, sf_dir):
    return profile.describe(cells.read(spark, sf_dir, "lineitem"), LINE_COLUMNS)


@query
def a14_skewness(spark, sf_dir):
    return profile.skewness_table(fine_clean(spark, sf_dir))


@query
def a15_quantiles(spark, sf_dir):
    stored = stored_fine(spark, sf_dir, *S.ANOMALY_FEATURES)
    return profile.quantile_table(stored, S.ANOMALY_FEATURES, [0.25, 0.75, 0.99])


@query
def a15_quantiles_lines(spark, sf_dir):
    return profile.quantile_table(cells.read(spark, sf_dir, "lineitem"), LINE_COLUMNS, [0.25, 0.75, 0.99])


@query
def a16_severity_split(spark, sf_dir):
    flagged = flagged_cells(spark, sf_dir)
    return rules.severity_split(rules.with_severity(flagged, rules.severity_cuts(flagged)))


@query
def a17_period_totals(spark, sf_dir):
    return profile.period_totals(fine_clean(spark, sf_dir))


@query
def a17_annualised_totals(spark, sf_dir):
    return profile.period_totals(fine_clean(spark, sf_dir), annualise=True, factors=cells.PERIOD_FACTORS)


@query
def a18_histogram(spark, sf_dir):
    return profile.histogram(stored_fine(spark, sf_dir, *S.KEY_MEASURES))


@query
def a18_histogram_log(spark, sf_dir):
    return profile.histogram(stored_fine(spark, sf_dir, *S.KEY_MEASURES), log=True)


@query
def a18_histogram_events(spark, sf_dir):
    return profile.histogram(cells.read(spark, sf_dir, "events"), ["value"])


@query
def a19_spearman(spark, sf_dir):
    return correlation_table(spearman(stored_fine(spark, sf_dir, *S.PROFILE_MEASURES)))


@query
def a19_spearman_lines(spark, sf_dir):
    return correlation_table(spearman(cells.read(spark, sf_dir, "lineitem"), LINE_COLUMNS))


def lines_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line measures, two of them with gaps in different rows."""
    line = F.col("l_linenumber")
    return cells.read(spark, sf_dir, "lineitem").select(
        F.when(line != 1, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(line % 3 != 2, F.col("l_discount")).alias("l_discount"),
        "l_tax",
    )


@query
def a19_spearman_gaps(spark, sf_dir):
    return correlation_table(spearman(lines_with_gaps(spark, sf_dir), LINE_COLUMNS))


@query
def a20_strongest_pairs(spark, sf_dir):
    return strongest_pairs(spearman(stored_fine(spark, sf_dir, *S.PROFILE_MEASURES)))


@query
def a21_concordance_rate(spark, sf_dir):
    return rec.concordance_rate(reconciliation(spark, sf_dir))


@query
def a22_findings(spark, sf_dir):
    stored = materialize(coarse_clean(spark, sf_dir), "coarse_cells")
    return profile.findings(stored, rec.reconcile(stored, cells.official_totals(spark, sf_dir)))


# ---------------------------------------------------------------- orderings


@query
def o1_listing(spark, sf_dir):
    return serve.listing(fine_serving(spark, sf_dir))


@query
def o2_anomaly_listing(spark, sf_dir):
    return serve.anomaly_listing(fine_serving(spark, sf_dir))


@query
def o3_largest_rows(spark, sf_dir):
    return profile.largest_rows(fine_clean(spark, sf_dir))


@query
def o4_largest_gaps(spark, sf_dir):
    return rec.largest_gaps(reconciliation(spark, sf_dir))


# ---------------------------------------------------------------- robust statistics and rules


@query
def r1_robust_z(spark, sf_dir):
    stored = stored_fine(spark, sf_dir, S.RECORD_ID, "Volume_activite")
    scored = rules.robust_z(stored, "Volume_activite")
    return scored.select(S.RECORD_ID, round_half_even(F.col("robust_z"), 6).alias("robust_z"))


@query
def r1_robust_z_sparse(spark, sf_dir):
    stored = stored_fine(spark, sf_dir, S.RECORD_ID, "Victimes_G")
    scored = rules.robust_z(stored, "Victimes_G")
    return scored.select(S.RECORD_ID, round_half_even(F.col("robust_z"), 6).alias("robust_z"))


@query
def r1_robust_z_lines(spark, sf_dir):
    scored = rules.robust_z(cells.read(spark, sf_dir, "lineitem"), "l_extendedprice")
    return scored.select(
        "l_orderkey",
        "l_partkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        round_half_even(F.col("robust_z"), 6).alias("robust_z"),
    )


@query
def r2_rule_thresholds(spark, sf_dir):
    found = rules.rule_thresholds(stored_fine(spark, sf_dir, *S.ANOMALY_FEATURES))
    table = spark.createDataFrame(list(found.items()), "variable string, seuil double")
    return table.withColumn("seuil", round_half_even(F.col("seuil"), 3))


@query
def r3_reasons(spark, sf_dir):
    stored = stored_fine(spark, sf_dir, S.RECORD_ID, *S.ANOMALY_FEATURES, S.MISSING_LABEL, "Volume_activite")
    marked = rules.with_reasons(stored, rules.rule_thresholds(stored))
    return marked.select(S.RECORD_ID, rules.REASONS, rules.RULE_FLAG)


@query
def r4_iqr_outliers(spark, sf_dir):
    return profile.iqr_outliers(stored_fine(spark, sf_dir, *S.PROFILE_MEASURES))


@query
def r4_iqr_outliers_lines(spark, sf_dir):
    return profile.iqr_outliers(cells.read(spark, sf_dir, "lineitem"), LINE_COLUMNS)


@query
def r5_robust_scaling(spark, sf_dir):
    scaled = rules.robust_scaled(stored_fine(spark, sf_dir, S.RECORD_ID, *S.ANOMALY_FEATURES))
    return scaled.select(S.RECORD_ID, *[F.expr(f"{round_sql(c, 6)} as {c}") for c in S.ANOMALY_FEATURES])


@query
def r7_flags_from_scores(spark, sf_dir):
    return flagged_cells(spark, sf_dir).select(
        S.RECORD_ID, rules.SCORE, rules.ML_FLAG, rules.RULE_FLAG, rules.FLAG
    )


@query
def r8_severity_levels(spark, sf_dir):
    flagged = flagged_cells(spark, sf_dir)
    return rules.with_severity(flagged, rules.severity_cuts(flagged)).select(S.RECORD_ID, rules.LEVEL)


# ---------------------------------------------------------------- isolation forest


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stored_fine(spark, sf_dir, S.RECORD_ID, *S.ANOMALY_FEATURES)
    forest = isolation.fit_forest(stored, trees=SWEEP_TREES)
    score = isolation.isolation_score(spark, forest)
    return materialize(stored.select(S.RECORD_ID, score.alias(isolation.ISOLATION)), "scored")


def _detected(spark: SparkSession, sf_dir: str):
    stored = stored_fine(
        spark, sf_dir, S.RECORD_ID, *S.ANOMALY_FEATURES, S.MISSING_LABEL, "Volume_activite"
    )
    return isolation.detect_anomalies(stored, trees=MODEL_TREES)


@query
def r6_isolation_forest(spark, sf_dir):
    flagged, _, _ = _detected(spark, sf_dir)
    return flagged.select(S.RECORD_ID, rules.SCORE, rules.ML_FLAG, rules.FLAG, rules.LEVEL, rules.REASONS)


@query
def r9_contamination_sweep(spark, sf_dir):
    return isolation.contamination_sweep(_scored(spark, sf_dir))


@query
def r10_anomaly_metrics(spark, sf_dir):
    _, metrics, _ = _detected(spark, sf_dir)
    return metrics.select(F.to_json(F.struct("*")).alias("document"))


# ---------------------------------------------------------------- clustering


def _scaled(rows: DataFrame) -> DataFrame:
    points = clustering.fit_scaler(rows, log=True).transform(rows)
    return clustering.assembler(S.CLUSTER_FEATURES).transform(points)


def _cluster_vectors(spark: SparkSession, sf_dir: str, log: bool) -> DataFrame:
    stored = stored_fine(spark, sf_dir, *S.CLUSTER_FEATURES)
    return clustering.scaled_vectors(stored, S.CLUSTER_FEATURES, log)[0]


@query
def a7_cluster_profile(spark, sf_dir):
    enriched = standin_enriched(fine_clean(spark, sf_dir))
    return clustering.cluster_profile(enriched.where(F.col(clustering.CLUSTER).isNotNull()))


@query
def c1_standardised_counts(spark, sf_dir):
    stored = stored_fine(spark, sf_dir, S.RECORD_ID, *S.CLUSTER_FEATURES)
    names = zip(clustering.scaled_names(S.CLUSTER_FEATURES), S.CLUSTER_FEATURES)
    return _scaled(stored).selectExpr(S.RECORD_ID, *[f"{round_sql(z, 6)} as {c}" for z, c in names])


@query
def c2_kmeans(spark, sf_dir):
    stored = stored_fine(spark, sf_dir, S.RECORD_ID, *S.CLUSTER_FEATURES)
    points = _scaled(stored)
    model = clustering.fit_kmeans(points, k=3, restarts=40)
    labels = clustering.relabel_sql(clustering.canonical_labels(model))
    placed = model.transformer(clustering.scaled_names(S.CLUSTER_FEATURES)).transform(points)
    return placed.selectExpr(S.RECORD_ID, f"{labels} as {clustering.CLUSTER}")


@query
def c3_euclidean_silhouette(spark, sf_dir):
    stored = stored_fine(spark, sf_dir, *S.CLUSTER_FEATURES)
    points = _scaled(stored).withColumn("label", F.col("Total_saisines") % 3)
    width = clustering.euclidean_silhouette(points, clustering.scaled_names(S.CLUSTER_FEATURES), "label")
    return spark.range(1).select(round_half_even(F.lit(width), 6).alias("silhouette"))


@query
def c3_squared_silhouette(spark, sf_dir):
    stored = stored_fine(spark, sf_dir, *S.CLUSTER_FEATURES)
    points = _scaled(stored).withColumn("label", F.col("Total_saisines") % 3)
    width = clustering.squared_silhouette(points, "label")
    return spark.range(1).select(round_half_even(F.lit(width), 6).alias("silhouette"))


@query
def c4_k_sweep(spark, sf_dir):
    vectors = _cluster_vectors(spark, sf_dir, log=True)
    return clustering.evaluate_k(vectors, S.CLUSTER_FEATURES)


@query
def c5_choose_k(spark, sf_dir):
    total = F.sum("n").over(Window.partitionBy())
    rows = (
        fine_clean(spark, sf_dir)
        .groupBy(S.PERIOD)
        .agg(F.count("*").alias("n"), round_half_even(F.avg("Taux_DEF_sur_saisines"), 6).alias("silhouette"))
        .select(
            (F.substring(S.PERIOD, 1, 4).cast("int") - 1993).alias("k"),
            "silhouette",
            (F.col("n") / total / 2).alias("ratio_cluster_min"),
        )
    )
    return spark.range(1).select(F.lit(clustering.choose_k(rows)).cast("long").alias("k"))


@query
def c6_pca_axes(spark, sf_dir):
    stored = stored_fine(spark, sf_dir, S.RECORD_ID, *S.CLUSTER_FEATURES)
    points = _scaled(stored)
    axes, _ = clustering.fit_axes(points, S.CLUSTER_FEATURES)
    return points.selectExpr(
        S.RECORD_ID, *[f"{round_sql(text, 6)} as {name}" for text, name in zip(axes, clustering.AXES)]
    )


@query
def c7_compare_transformations(spark, sf_dir):
    def rows(log: bool) -> DataFrame:
        vectors = _cluster_vectors(spark, sf_dir, log)
        return clustering.evaluate_k(vectors, S.CLUSTER_FEATURES)

    return clustering.compare_transformations(rows(False), rows(True))


@query
def c8_cluster_metrics(spark, sf_dir):
    stored = stored_fine(spark, sf_dir)
    _, metrics, _ = clustering.cluster_table(stored)
    return metrics.select(F.to_json(F.struct("*")).alias("document"))


# ---------------------------------------------------------------- supervised modelling

MODEL_COLUMNS = list(dict.fromkeys([*validation.KEYS, *S.MODEL_FEATURES, S.TARGET]))


def stored_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_fine(spark, sf_dir, *MODEL_COLUMNS)


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model rows with missing counts and categories."""
    numbered = cells.fine_cells(spark, sf_dir).select(
        cells.ORDINAL,
        S.PERIOD,
        F.expr(f"if({cells.ORDINAL} % 4 = 0, null, {S.CATEGORY}) as {S.CATEGORY}"),
        *[F.expr(f"if({cells.ORDINAL} % 5 = 0, null, {c}) as {c}") for c in S.NUMERIC_FEATURES],
    )
    return materialize(numbered, "with_gaps")


def with_standin_prediction(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "*",
        f"cast({S.TARGET} as double) as {validation.ACTUAL}",
        f"(2 * Saisine_FD - Saisine_ST - 1) / 3D as {PREDICTION}",
    )


@query
def m1_median_imputation(spark, sf_dir):
    rows = with_gaps(spark, sf_dir)
    fill = regressors.fit_imputation(rows, S.NUMERIC_FEATURES, [])
    return rows.selectExpr(
        cells.ORDINAL, S.PERIOD, *[f"{fill.numeric(c)} as {c}" for c in S.NUMERIC_FEATURES]
    )


@query
def m2_mode_imputation(spark, sf_dir):
    rows = with_gaps(spark, sf_dir)
    fill = regressors.fit_imputation(rows, [], [S.CATEGORY])
    return rows.selectExpr(cells.ORDINAL, S.PERIOD, f"{fill.category(S.CATEGORY)} as {S.CATEGORY}")


@query
def m3_one_hot(spark, sf_dir):
    rows = stored_model_rows(spark, sf_dir)
    known = rows.where(F.col(S.PERIOD) != "1995")
    fitted = regressors.fit_preprocessor(known).stages
    slots = vector_to_array(F.col(f"_h_{S.PERIOD}"))
    encoded = PipelineModel(fitted).transform(rows)
    return encoded.select(
        S.RECORD_ID, *[slots[i].alias(f"p{period[:4]}") for i, period in enumerate(cells.PERIODS[1:])]
    )


@query
def m4_preprocessor(spark, sf_dir):
    rows = with_gaps(spark, sf_dir)
    prepared = PipelineModel(regressors.fit_preprocessor(rows).stages).transform(rows)
    return prepared.selectExpr(
        cells.ORDINAL, S.PERIOD, *[f"{round_sql(f'_z_{c}', 6)} as {c}" for c in S.NUMERIC_FEATURES]
    )


@query
def m5_median_baseline(spark, sf_dir):
    folded = materialize(validation.shuffled_folds(stored_model_rows(spark, sf_dir)), "folded")
    held_out = validation.out_of_fold(folded, regressors.fit_median, 5, keep=[S.RECORD_ID])
    return held_out.select(S.RECORD_ID, F.col(validation.FOLD).cast("long").alias("fold"), PREDICTION)


@query
def m6_ridge(spark, sf_dir):
    rows = stored_model_rows(spark, sf_dir)
    model = regressors.fit_ridge(rows)
    return model.transform(rows).selectExpr(S.RECORD_ID, f"{round_sql(PREDICTION, 4)} as {PREDICTION}")


@query
def m7_random_forest(spark, sf_dir):
    rows = stored_model_rows(spark, sf_dir)
    model = regressors.fit_forest_regressor(rows)
    return model.transform(rows).selectExpr(S.RECORD_ID, f"{round_sql(PREDICTION, 4)} as {PREDICTION}")


@query
def m8_huber_boosting(spark, sf_dir):
    rows = stored_model_rows(spark, sf_dir)
    model = regressors.fit_boosting(rows)
    return model.transform(rows).selectExpr(S.RECORD_ID, f"{round_sql(PREDICTION, 4)} as {PREDICTION}")


@query
def m9_shuffled_folds(spark, sf_dir):
    folded = validation.shuffled_folds(stored_fine(spark, sf_dir, S.RECORD_ID))
    return folded.select(S.RECORD_ID, F.col(validation.FOLD).cast("long").alias("fold"))


@query
def m10_period_folds(spark, sf_dir):
    folded, _ = validation.period_folds(stored_fine(spark, sf_dir, S.RECORD_ID, S.PERIOD))
    return folded.select(S.RECORD_ID, F.col(validation.FOLD).cast("long").alias("fold"))


@query
def m11_cv_summary(spark, sf_dir):
    folded = validation.shuffled_folds(stored_model_rows(spark, sf_dir))
    return validation.cv_summary(with_standin_prediction(folded))


@query
def m12_training_diagnostics(spark, sf_dir):
    return validation.training_diagnostics(with_standin_prediction(fine_clean(spark, sf_dir)))


def _comparison(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, validation.Comparison]:
    stored = stored_model_rows(spark, sf_dir)
    return stored, validation.evaluate_models(stored, regressors.candidate_models())


@query
def m13_model_comparison(spark, sf_dir):
    return validation.leaderboard(flatten_results(_comparison(spark, sf_dir)[1].results), "kfold_rmse")


@query
def m14_out_of_fold_ridge(spark, sf_dir):
    folded = materialize(validation.shuffled_folds(stored_model_rows(spark, sf_dir)), "folded")
    held_out = validation.out_of_fold(folded, regressors.candidate_models()[regressors.RIDGE], 5, keep=[S.RECORD_ID])
    return held_out.selectExpr(S.RECORD_ID, f"{round_sql(PREDICTION, 4)} as {PREDICTION}")


@query
def p16_clipped_residuals(spark, sf_dir):
    return validation.prediction_table(with_standin_prediction(fine_clean(spark, sf_dir)))


@query
def m15_prediction_table(spark, sf_dir):
    folded = materialize(validation.shuffled_folds(stored_model_rows(spark, sf_dir)), "folded")
    return validation.prediction_table(validation.out_of_fold(folded, regressors.fit_median, 5))


@query
def m16_permutation_importance(spark, sf_dir):
    rows = stored_model_rows(spark, sf_dir)
    (model,) = regressors.fit_ridge_lanes(rows, [None])
    return validation.permutation_importance(rows, model, repeats=20)


@query
def m17_batch_scoring(spark, sf_dir):
    rows = stored_model_rows(spark, sf_dir)
    names = {**{v: k for k, v in S.SCORING_COUNTS.items()}, S.PERIOD: "annee", S.CATEGORY: "categorie"}
    given = rows.select(S.RECORD_ID, *S.MODEL_FEATURES).withColumnsRenamed(names)
    return score(given, regressors.fit_ridge(rows), regressors.RIDGE)[0]


@query
def m18_regression_metrics(spark, sf_dir):
    stored, found = _comparison(spark, sf_dir)
    importances = validation.permutation_importance(stored, found.best_model)
    metrics = validation.regression_metrics(found, importances, stored.count())
    return metrics.select(F.to_json(F.struct("*")).alias("document"))


@query
def o5_leaderboard(spark, sf_dir):
    error = "(Resultats_DEF - Resultats_DAT)"
    scored = fine_clean(spark, sf_dir).groupBy(F.col(S.CATEGORY).alias("modele")).agg(
        F.expr(f"{round_sql(f'sqrt(avg({error} * {error}))', 4)} as rmse")
    )
    best = validation.best_model_name(scored, "rmse")
    return validation.leaderboard(scored, "rmse").withColumn("meilleur", F.col("modele") == best)


@query
def s5_model_round_trip(spark, sf_dir):
    rows = stored_model_rows(spark, sf_dir)
    path = scratch_path(spark, "model")
    save_model(regressors.fit_median(rows), path)
    scored = load_model(path).transform(rows)
    return scored.select(S.RECORD_ID, PREDICTION)


# ---------------------------------------------------------------- whole preparations


def _prepared(spark: SparkSession, sf_dir: str) -> stages.Workspace:
    space = stages.Workspace(spark, scratch_path(spark, "workspace"))
    stages.prepare_all(
        space,
        *cells.coarse_and_official(spark, sf_dir),
        cells.ORDINAL,
        cells.PERIOD_FACTORS,
        isolation_trees=MODEL_TREES,
    )
    return space


@query
def x1_prepare_stages(spark, sf_dir):
    space = _prepared(spark, sf_dir)
    enriched = space.read("enriched", "model")
    return enriched.groupBy(clustering.CLUSTER, rules.LEVEL).agg(F.count("*").alias("nombre"))


@query
def x2_prepare_and_load(spark, sf_dir):
    space = _prepared(spark, sf_dir)
    loaded = stages.load(space, "tallyforge_enriched", force=True, path=scratch_path(spark, "serving"))
    return spark.createDataFrame([(loaded,)], "lignes long")


@query
def x3_stage_precondition(spark, sf_dir):
    space = stages.Workspace(spark, scratch_path(spark, "workspace"))
    space.write("clean", coarse_clean(spark, sf_dir))
    found = space.read("clean", "cleaning").agg(F.count("*").alias("lignes"))
    try:
        stages.prepare_anomalies(space)
    except StageMissing:
        return found.withColumn("etape_suivante", F.lit("refusee"))
    return found.withColumn("etape_suivante", F.lit("executee"))


@query
def x4_dashboard_feeds(spark, sf_dir):
    served = materialize(fine_serving(spark, sf_dir), "serving")
    views = dashboard.feeds(served, reconciliation(spark, sf_dir))
    sizes = [
        frame.agg(F.count("*").alias("lignes")).select(F.lit(name).alias("vue"), "lignes")
        for name, frame in views.items()
    ]
    return reduce(DataFrame.unionByName, sizes)


@query
def x4_feed_contents(spark, sf_dir):
    """Every row of every view, with a period and a level chosen."""
    served = materialize(fine_serving(spark, sf_dir), "serving")
    chosen = {"annee": "1996", "categorie": "LARGE", "niveau": S.LEVEL_MEDIUM}
    return dashboard.contents(dashboard.feeds(served, reconciliation(spark, sf_dir), **chosen))
