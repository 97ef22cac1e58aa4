"""DuckDB SQL that states the expected result of each registered query."""

from __future__ import annotations

from tallyforge import schema as S

_NAMED = "'1-URGENT', '2-HIGH', '3-MEDIUM'"
_MEASURE_SQL = dict(
    zip(
        S.MEASURES,
        [
            "(o_orderpriority = '1-URGENT')::bigint",
            "(o_orderpriority = '2-HIGH')::bigint",
            "(o_orderpriority = '3-MEDIUM')::bigint",
            f"(o_orderpriority not in ({_NAMED}))::bigint",
            "case when l_returnflag = 'A' then trunc(l_quantity)::bigint else 0 end",
            "case when l_returnflag = 'R' then trunc(l_quantity)::bigint else 0 end",
            "case when l_returnflag = 'N' and l_linestatus = 'F' then trunc(l_quantity)::bigint else 0 end",
            "case when l_returnflag = 'N' and l_linestatus = 'O' then trunc(l_quantity)::bigint else 0 end",
            "(l_discount >= 0.08::double)::bigint",
            "(l_tax >= 0.06::double)::bigint",
            "(o_orderstatus = 'F')::bigint",
            "(o_orderstatus = 'O')::bigint",
            "(o_orderstatus = 'P')::bigint",
            "(date_diff('day', o_orderdate, l_shipdate) > 90)::bigint",
        ],
    )
)


def q(names: list[str], form: str = '"{0}"') -> str:
    return ", ".join(form.format(name) for name in names)


def rnd(value: str, digits: int) -> str:
    scale = f"1e{digits}::double"
    return f"(round_even(({value}) * {scale}, 0) / {scale} + 0.0::double)"


def plus(names: list[str]) -> str:
    return " + ".join(f'"{n}"' for n in names)


SUMS = q(S.MEASURES, 'sum("{0}")::bigint as "{0}"')

FACTS = f"""
facts as (
  select case when year(o_orderdate) = 2001 then '2001-S1' else year(o_orderdate)::varchar end as "Annee",
         year(o_orderdate) as order_year, l_partkey, l_quantity,
         {', '.join(f'{sql} as "{name}"' for name, sql in _MEASURE_SQL.items())}
  from lineitem join orders on l_orderkey = o_orderkey
)"""
_CELL_KEYS = '"Annee", "Categorie", "Infraction_Affaire_traitee"'
FINE = f"""{FACTS},
cells as (
  select "Annee", p_type as "Categorie", p_name as "Infraction_Affaire_traitee", {SUMS},
         p_partkey as ordinal
  from facts join part on l_partkey = p_partkey
  group by "Annee", p_type, p_name, p_partkey
)"""
COARSE = f"""{FACTS},
cells as (
  select "Annee", p_type as "Categorie", p_name as "Infraction_Affaire_traitee", {SUMS},
         0::bigint as ordinal
  from facts join part on l_partkey = p_partkey
  group by "Annee", p_type, p_name
)"""
_CLEAN = f"""
totalled as (
  select *, lower(trim("Infraction_Affaire_traitee")) as "Infraction_normalisee",
         {plus(S.INTAKE)} as "Total_saisines", {plus(S.VICTIMS)} as "Total_victimes",
         {plus(S.OUTCOMES)} as "Total_resultats",
         case when "Annee" = '2001-S1' then 2.0::double else 1.0::double end as "Facteur_annualisation"
  from cells
), clean as (
  select 'INF-' || upper(substr(sha1("Annee" || '|' || "Categorie" || '|' || "Infraction_normalisee"
             || '|' || ordinal::varchar), 1, 12)) as "Record_ID",
         "Annee", "Categorie", "Infraction_Affaire_traitee", "Infraction_normalisee", {q(S.MEASURES)},
         "Total_saisines", "Total_victimes", "Total_resultats",
         "Total_saisines" + "Total_victimes" + {plus(S.IMPLICATED)} as "Volume_activite",
         case when "Total_saisines" > 0
              then {rnd('"Resultats_DEF"::double / "Total_saisines"', 4)} else 0.0::double end as "Taux_DEF_sur_saisines",
         "Facteur_annualisation",
         round_even("Saisine_Plaintes_directes" * "Facteur_annualisation", 0)::bigint as "Plaintes_directes_annualisees",
         false as "Infraction_non_renseignee", '' as "Observations_Objets_saisis", ordinal
  from totalled
)"""
FINE_CLEAN = f"{FINE},{_CLEAN}"
COARSE_CLEAN = f"{COARSE},{_CLEAN}"
# Stand-in for the columns models append, so the operators reading them are checked exactly.
_ENRICHED = f"""
standin as (
  select *, case when "Total_saisines" % 7 = 0 then null else "Total_saisines" % 3 end as "Cluster",
         {rnd('"Taux_DEF_sur_saisines" * 2 - 1', 4)} as "PCA_1",
         case when "Total_saisines" % 7 = 0 then null else "Volume_activite" / 8.0::double end as "PCA_2",
         {rnd('("Resultats_DEF" - "MiseEnCause_Interpelles")::double / ("Total_saisines" + 1)', 6)} as "Score_anomalie",
         "Resultats_DAT" > "Resultats_DEF" as "Est_anomalie"
  from clean
), enriched as (
  select *, case when not "Est_anomalie" then 'Normale' when "Score_anomalie" >= 0.2::double then 'Élevée'
                 when "Score_anomalie" >= 0.05::double then 'Moyenne' else 'Faible' end as "Niveau_anomalie",
         case when "Est_anomalie" then 'raison ' || "Annee" else '' end as "Raisons_anomalie"
  from standin
)"""


def _serving() -> str:
    parts = []
    for name, (source, kind) in S.SERVING_COLUMNS.items():
        parts.append(f'"{source}"::{ {"string": "varchar", "long": "bigint"}.get(kind, kind) } as {name}')
    return f"serving as (select {', '.join(parts)} from enriched)"


SERVING = f"{COARSE_CLEAN},{_ENRICHED},{_serving()}"
FINE_SERVING = f"{FINE_CLEAN},{_ENRICHED},{_serving()}"

OFFICIAL = f"""
official as (
  select "Annee", {SUMS} from facts where not (l_quantity < 2 and order_year >= 1999) group by "Annee"
)"""
_PAIRS = " union all ".join(
    f"""select d."Annee", '{c}' as "Indicateur", d."{c}" as "Total_detail", o."{c}" as "Total_officiel"
        from detail d join official o on d."Annee" = o."Annee" """
    for c in S.MEASURES
)
RECONCILED = f"""{COARSE_CLEAN},{OFFICIAL},
detail as (select "Annee", {SUMS} from clean group by "Annee"),
recon as (
  select *, "Total_detail" - "Total_officiel" as "Ecart", "Total_detail" = "Total_officiel" as "Concordance"
  from ({_PAIRS})
)"""

_LISTING = """record_id, annee, categorie, infraction, saisine_plaintes_directes as plaintes_directes,
  total_saisines, total_victimes as victimes, interpelles, resultats_def, cluster, pca_1, pca_2,
  est_anomalie, niveau_anomalie, score_anomalie, raisons_anomalie"""
_ANOMALY_LISTING = """record_id, annee, categorie, infraction, niveau_anomalie as niveau,
  score_anomalie as score, raisons_anomalie as raisons, saisine_plaintes_directes as plaintes_directes,
  total_victimes as victimes, interpelles"""


def summary_sql(annee: str | None = None, categorie: str | None = None) -> str:
    tests = [f"{k} = '{v}'" for k, v in [("annee", annee), ("categorie", categorie)] if v]
    where = f"where {' and '.join(tests)}" if tests else ""
    return f"""with {SERVING}
select '{annee or S.ALL_VALUES}' as annee, '{categorie or S.ALL_VALUES}' as categorie,
  count(*) as lignes, coalesce(sum(saisine_plaintes_directes), 0)::bigint as plaintes_directes,
  coalesce(sum(total_saisines), 0)::bigint as total_saisines, coalesce(sum(total_victimes), 0)::bigint as victimes,
  coalesce(sum(interpelles), 0)::bigint as interpelles, coalesce(sum(resultats_def), 0)::bigint as resultats_def,
  count(*) filter (where est_anomalie) as anomalies
from serving {where}"""


def describe_sql(source: str, table: str, columns: list[str], tail: str = "") -> str:
    rows = []
    for c in columns:
        v = f'"{c}"::double'
        rows.append(
            f"""select '{c}' as variable, count({v}) as "count", {rnd(f'avg({v})', 2)} as mean,
  {rnd(f'quantile_cont({v}, 0.5)', 2)} as mediane, {rnd(f'stddev_samp({v})', 2)} as std,
  {rnd(f'min({v})', 2)} as "min", {rnd(f'quantile_cont({v}, 0.25)', 2)} as q25,
  {rnd(f'quantile_cont({v}, 0.5)', 2)} as q50, {rnd(f'quantile_cont({v}, 0.75)', 2)} as q75,
  {rnd(f'max({v})', 2)} as "max",
  {rnd(f'case when var_pop({v}) = 0 then 0.0::double else skewness({v}) end', 2)} as asymetrie_skewness,
  {rnd(f'100 * avg(({v} = 0)::int)', 2)} as pourcentage_zero from {table}"""
        )
    return f"{source} {' union all '.join(rows)} {tail}"


def histogram_sql(source: str, table: str, columns: list[str], log: bool = False, bins: int = 25) -> str:
    values = " union all ".join(
        f"""select '{c}' as variable, {f'ln(1.0::double + "{c}"::double)' if log else f'"{c}"::double'} as x from {table}"""
        for c in columns
    )
    return f"""{source}, vals as ({values}),
span as (select variable, min(x) as lo, max(x) as hi, (max(x) - min(x)) / {bins} as w from vals group by variable),
edges as (select variable, lo, hi, w, unnest(range({bins})) as bin from span),
guessed as (select variable, x, lo, w, least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1})::bigint as g
            from vals join span using (variable)),
placed as (select variable, case when x < g * w + lo then g - 1
                                 when x >= (g + 1) * w + lo and g < {bins - 1} then g + 1 else g end as bin
           from guessed)
select e.variable, e.bin::bigint as bin, {rnd(f'e.lo + e.bin * (e.hi - e.lo) / {bins}', 6)} as borne_gauche,
  {rnd(f'e.lo + (e.bin + 1) * (e.hi - e.lo) / {bins}', 6)} as borne_droite, count(p.bin) as nombre
from edges e left join placed p on p.variable = e.variable and p.bin = e.bin
group by e.variable, e.bin, e.lo, e.hi"""


def spearman_ctes(table: str, columns: list[str]) -> str:
    ranks = ", ".join(
        f"""rank() over (order by "{c}") + (count(*) over (partition by "{c}") - 1) / 2.0::double as "{c}" """
        for c in columns
    )
    pairs = " union all ".join(
        f"""select {i} as i, {j} as j, '{a}' as variable_1, '{b}' as variable_2,
            {'max(1.0::double)' if i == j else f'corr("{a}", "{b}")'} as rho from ranked"""
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    )
    return f"ranked as (select {ranks} from {table}), rho as ({pairs})"


def iqr_sql(source: str, table: str, columns: list[str], factor: float = 1.5) -> str:
    rows = " union all ".join(
        f"""select '{c}' as variable, {rnd('lo', 2)} as borne_basse, {rnd('hi', 2)} as borne_haute,
  count(*) filter (where "{c}" < lo or "{c}" > hi) as nb_atypiques,
  {rnd(f'100 * (count(*) filter (where "{c}" < lo or "{c}" > hi))::double / count(*)', 2)} as pourcentage
from {table}, (select q1 - {factor}::double * (q3 - q1) as lo, q3 + {factor}::double * (q3 - q1) as hi from
  (select quantile_cont("{c}"::double, 0.25) as q1, quantile_cont("{c}"::double, 0.75) as q3 from {table}))
group by lo, hi"""
        for c in columns
    )
    return f"{source} {rows}"


def robust_z_sql(source: str, table: str, key: str, column: str) -> str:
    """``source`` ends in an open CTE list."""
    return f"""{source} centre as (select quantile_cont("{column}"::double, 0.5) as m, avg("{column}"::double) as mean,
    stddev_pop("{column}"::double) as std from {table}),
spread as (select quantile_cont(abs("{column}"::double - m), 0.5) as mad from {table}, centre)
select {key}, {rnd(f'''case when mad <> 0 then 0.6745::double * ("{column}"::double - m) / mad
    when std <> 0 then ("{column}"::double - mean) / std else 0.0::double end''', 6)} as robust_z
from {table}, centre, spread"""


def thresholds_cte(table: str) -> str:
    rows = " union all ".join(
        f"""select '{c}' as variable, greatest(quantile_cont("{c}"::double, 0.99), quantile_cont("{c}"::double, 0.75)
  + 3.0::double * (quantile_cont("{c}"::double, 0.75) - quantile_cont("{c}"::double, 0.25))) as seuil from {table}"""
        for c in S.ANOMALY_FEATURES
    )
    return f"thresholds as ({rows})"


def limit_of(column: str) -> str:
    return f"(select seuil from thresholds where variable = '{column}')"


def reasons_sql() -> str:
    parts = [
        f"""case when "{c}" > {limit_of(c)} then '{c}{S.REASON_HIGH}' end""" for c in S.ANOMALY_FEATURES
    ]
    label = S.REASON_LABEL.replace("'", "''")
    parts.append(f"""case when "{S.MISSING_LABEL}" then '{label}' end""")
    parts.append(f"""case when "Volume_activite" = 0 then '{S.REASON_IDLE}' end""")
    return f"concat_ws('; ', {', '.join(parts)})"


STANDIN_DECISION = '0.5::double - "Resultats_DAT"::double / ("Total_saisines" + 1)'
FLAGGED = f"""{FINE_CLEAN}, {thresholds_cte('clean')},
reasoned as (select *, {reasons_sql()} as "Raisons_anomalie", {STANDIN_DECISION} as decision from clean),
flagged as (select *, {rnd('-decision', 6)} as "Score_anomalie", decision < 0 as "Anomalie_ML",
   "Raisons_anomalie" <> '' as "Anomalie_regle", decision < 0 or "Raisons_anomalie" <> '' as "Est_anomalie"
   from reasoned),
cuts as (select coalesce(quantile_cont("Score_anomalie", 0.5), 0) as q50,
                coalesce(quantile_cont("Score_anomalie", 0.8), 0) as q80 from flagged where "Est_anomalie"),
levelled as (select *, case when not "Est_anomalie" then 'Normale'
   when "{S.MISSING_LABEL}" or "Score_anomalie" >= (select q80 from cuts) then 'Élevée'
   when "Score_anomalie" >= (select q50 from cuts) then 'Moyenne' else 'Faible' end as "Niveau_anomalie" from flagged)"""

_AUDIT = [
    ("nombre_lignes", "count(*)"),
    ("nombre_colonnes", "max(28)"),
    ("nombre_periodes", 'count(distinct "Annee")'),
    ("nombre_categories", 'count(distinct "Categorie")'),
    ("nombre_infractions_normalisees", 'count(distinct "Infraction_normalisee")'),
    ("labels_non_renseignes", 'count(*) filter (where "Infraction_non_renseignee")'),
    ("lignes_sans_activite", 'count(*) filter (where "Volume_activite" = 0)'),
    ("doublons_record_id", 'count(*) - count(distinct "Record_ID")'),
]
_BLANKS = "chr(9) || chr(10) || ' ' || chr(160)"


def build() -> dict[str, str]:
    clean_cols = q(S.CLEAN_COLUMNS)
    doc = "documents"
    sqls: dict[str, str] = {}

    sqls["s1_delimited_scan"] = f"""with {COARSE} select {_CELL_KEYS}, {q(S.MEASURES, '"{0}"::varchar as "{0}"')} from cells"""
    sqls["s2_typed_round_trip"] = f"with {FINE_CLEAN} select {clean_cols} from clean"
    sqls["s3_csv_sink"] = sqls["s2_typed_round_trip"]
    sqls["s4_json_document"] = f"""with {RECONCILED} select
      {', '.join(f'({sql})::bigint as {name}' for name, sql in _AUDIT if name != 'nombre_periodes')},
      0::bigint as valeurs_negatives,
      (select count(*) from recon where not "Concordance") as ecarts_avec_totaux_officiels from clean"""
    sqls["s6_serving_table_load"] = f"""with {FINE_CLEAN}, n as (select count(*) as lignes from clean)
      select 'force' as appel, lignes from n union all select 'sans force', lignes from n"""
    sqls["s6_period_swap"] = f"""with {FINE_SERVING}, changed as (
        select case when annee = '1994' and saisine_plaintes_directes % 2 = 0 then '1994-S2' else annee end as annee,
          saisine_plaintes_directes + case when annee = '1995' then 1 else 0 end as saisine_plaintes_directes
        from serving where annee <> '1993'),
      steps as (select 'avant' as etape, annee, saisine_plaintes_directes as n from serving
        union all select 'entre', annee, saisine_plaintes_directes from serving
        union all select 'apres', annee, saisine_plaintes_directes from changed)
      select etape, annee, count(*) as lignes, sum(n)::bigint as plaintes from steps group by 1, 2"""
    sqls["s7_read_prepared"] = f"""with {RECONCILED} select * from recon"""
    sqls["s8_listing_export"] = f"""with {SERVING} select {_LISTING} from serving
      order by plaintes_directes desc, record_id limit 1000"""
    sqls["v2_scoring_contract"] = f"""with {FINE_CLEAN}, given as (
      select ordinal, case when ordinal % 5 = 0 then null else "Annee" end as annee, "Categorie" as categorie,
        case when ordinal % 11 = 0 then -1 when ordinal % 7 = 0 then null else "Saisine_FD" end as saisine_fd,
        "Victimes_H" as victimes_h from clean)
      select ordinal, coalesce(annee, '2026-S1') as annee, categorie, coalesce(saisine_fd, 0)::bigint as saisine_fd,
        victimes_h, coalesce(saisine_fd, 0) >= 0 as valide from given"""

    raw_label = f"""case doc_id % 5 when 0 then null when 1 then chr(160) || source || ' ' when 2 then chr(9) || ' ' else ' ' || source end"""
    sqls["p1_default_labels"] = f"""select doc_id, trim(coalesce({raw_label}, 'Infraction non renseignée'), {_BLANKS}) as libelle from {doc}"""
    sqls["p2_missing_label_flag"] = f"""select doc_id, {raw_label} is null or trim({raw_label}, {_BLANKS}) = '' as manquant from {doc}"""
    folded = lambda v: f"""coalesce(nullif(trim(regexp_replace(strip_accents(replace(lower({v}), '’', '''')), '[^a-z0-9''/-]+', ' ', 'g')), ''), 'inconnu')"""
    sqls["p3_normalize_labels"] = f"select doc_id, {folded('text')} as normalise from {doc}"
    sqls["p4_provided_label_wins"] = f"""select doc_id, case when trim(coalesce({raw_label}, ''), {_BLANKS}) = ''
      then {folded('text')} else {folded(raw_label)} end as normalise from {doc}"""
    spelled = """case l_linenumber when 1 then '-' when 2 then '00' || l_quantity::bigint when 3 then ' 1' || chr(160) || l_quantity::bigint
      when 4 then l_quantity::bigint || ',5' when 5 then null when 6 then '  ' else l_quantity::bigint || '.0' end"""
    sqls["p5_parse_counts"] = f"""with given as (select l_orderkey, l_linenumber, l_partkey, {spelled} as brut from lineitem)
      select l_orderkey, l_linenumber::bigint as l_linenumber, l_partkey, case when brut is null or trim(replace(brut, chr(160), '')) in ('', '-') then 0
        else round_even(replace(replace(replace(brut, chr(160), ''), ' ', ''), ',', '.')::double, 0)::bigint end as valeur from given"""
    sqls["p6_row_totals"] = f"with {FINE_CLEAN} select \"Record_ID\", {q(S.TOTALS)} from clean"
    sqls["p7_guarded_ratio"] = f"""with {FINE_CLEAN} select "Record_ID", "Taux_DEF_sur_saisines" from clean"""
    sqls["p8_annualised"] = f"""with {FINE_CLEAN} select "Record_ID", "Facteur_annualisation", "Plaintes_directes_annualisees" from clean"""
    sqls["p9_stable_ids"] = f"""with {FINE_CLEAN} select "Record_ID", "Annee", "Categorie", "Infraction_normalisee" from clean"""
    sqls["p10_optional_observations"] = f"""with {COARSE_CLEAN} select "Record_ID", "Observations_Objets_saisis" from clean"""
    sqls["p11_clean_table"] = f"with {FINE_CLEAN} select {clean_cols} from clean"
    sqls["p12_log_features"] = f"""with {FINE_CLEAN} select "Record_ID", {', '.join(rnd(f'ln(1.0::double + "{c}"::double)', 6) + f' as "{c}"' for c in S.CLUSTER_FEATURES)} from clean"""
    said = """case event_id % 6 when 0 then ' TRUE ' when 1 then '1' when 2 then 'Yes' when 3 then 'false' when 4 then null else event_type end"""
    sqls["p13_lenient_booleans"] = f"""select event_id, coalesce(lower(trim({said})) in ('true', '1', 'yes'), false) as valeur from events"""
    sqls["p14_serving_projection"] = f"with {FINE_SERVING} select * from serving"
    sqls["p15_flatten_documents"] = f"""with {FINE_CLEAN} select "Categorie" as modele,
      {rnd('avg("Resultats_DEF")', 4)} as kfold_mae, {rnd('avg("Total_saisines")', 4)} as kfold_rmse,
      {rnd('avg("Total_victimes")', 4)} as periode_mae, {rnd('avg("Volume_activite")', 4)} as periode_rmse,
      {rnd('max("Resultats_DEF")', 4)} as mae_entrainement from clean group by "Categorie" """
    predicted = '(2 * "Saisine_FD" - "Saisine_ST" - 1)::double / 3'
    p16 = f"""predicted as (select *, {rnd(f'greatest({predicted}, 0.0::double)', 2)} as p from clean)"""
    sqls["p16_clipped_residuals"] = f"""with {FINE_CLEAN}, {p16} select "Record_ID", "Annee", "Categorie", "Infraction_Affaire_traitee",
      "Resultats_DEF"::double as "Valeur_reelle", p as "Prediction_CV", {rnd('abs("Resultats_DEF" - p)', 2)} as "Erreur_absolue",
      {rnd('"Resultats_DEF" - p', 2)} as "Residu" from predicted"""
    sqls["p17_share_of_total"] = f"""with {COARSE_CLEAN} select "Categorie", sum("Volume_activite")::bigint as volume,
      {rnd('100 * sum("Volume_activite")::double / (select sum("Volume_activite") from clean)', 2)} as pourcentage from clean group by "Categorie" """

    part_label = """case p_partkey % 6 when 0 then 'S/ TOTAL' when 1 then 'Total   general' when 2 then 'TOTAL GENRAL' when 3 then 's/total ' || p_name else p_name end"""
    sqls["f1_drop_total_rows"] = f"""select p_partkey, {part_label} as libelle from part
      where not regexp_matches(upper({part_label}), 'S/\\s*TOTAL|TOTAL\\s+GENERAL')"""
    sqls["f2_period_category_filter"] = f"""with {SERVING} select record_id, annee, categorie from serving where annee = '1997' and categorie = 'SMALL'"""
    sqls["f3_cluster_flag_filter"] = f"""with {SERVING} select {_LISTING} from serving where cluster = 0 and not est_anomalie
      order by plaintes_directes desc, record_id limit 1000"""
    sqls["f4_flagged_level_filter"] = f"""with {SERVING} select {_ANOMALY_LISTING} from serving where est_anomalie and niveau_anomalie = 'Moyenne'
      order by score desc, record_id limit 500"""
    sqls["f5_mismatches"] = f"""with {RECONCILED} select * from recon where not "Concordance" """
    sqls["f6_drop_missing_points"] = f"""with {FINE_SERVING} select record_id, cluster, pca_1, pca_2 from serving
      where pca_1 is not null and pca_2 is not null and cluster is not null"""

    def missing(table: str, columns: list[str], where: str = "") -> str:
        rows = " union all ".join(
            f"""select '{c}' as colonne, count(*) - count("{c}") as nombre_manquant,
            {rnd(f'100 * (count(*) - count("{c}"))::double / count(*)', 2)} as pourcentage from {table}"""
            for c in columns
        )
        return f"select * from ({rows}) {where}"

    served = list(S.SERVING_COLUMNS)
    sqls["f7_columns_with_gaps"] = f"with {FINE_SERVING} {missing('serving', served, 'where nombre_manquant > 0')}"

    sqls["j1_reconcile"] = f"""with {RECONCILED} select * from recon"""
    sqls["j2_gap_matrix"] = f"""with {RECONCILED} select "Indicateur", {', '.join(
        f"""coalesce(max("Ecart") filter (where "Annee" = '{p}'), 0)::bigint as "{p}" """ for p in
        ['1995', '1996', '1997', '1998', '1999', '2000', '2001-S1'])} from recon group by "Indicateur" """

    def diagnostic(name: str, log: bool) -> str:
        rows = " union all ".join(
            f"""select '{name}' as transformation, '{c}' as variable, {rnd('avg(' + (f'ln(1.0::double + "{c}"::double)' if log else f'"{c}"::double') + ')', 6)} as moyenne from clean"""
            for c in S.CLUSTER_FEATURES
        )
        return rows

    sqls["j3_union_diagnostics"] = f"with {FINE_CLEAN} {diagnostic('brut', False)} union all {diagnostic('log1p', True)}"
    sqls["j4_scalar_thresholds"] = f"""with {FINE_CLEAN}, {thresholds_cte('clean')} select "Record_ID",
      {' + '.join(f'("{c}" > {limit_of(c)})::bigint' for c in S.ANOMALY_FEATURES)} as depassements from clean"""
    sqls["j5_feature_pairs"] = f"""with {FINE_CLEAN}, {spearman_ctes('clean', S.ANOMALY_FEATURES)}
      select variable_1, variable_2, {rnd('rho', 6)} as rho from rho where i < j"""

    sqls["a1_sums_by_period"] = f"""with {FINE_CLEAN} select "Annee", {SUMS} from clean group by "Annee" """
    sqls["a2_row_counts"] = f"""with {FINE_CLEAN} select 'Annee' as dimension, "Annee" as valeur, count(*) as nombre from clean group by "Annee"
      union all select 'Categorie', "Categorie", count(*) from clean group by "Categorie" """
    sqls["a3_summary"] = summary_sql()
    sqls["a3_summary_filtered"] = summary_sql("1999", "LARGE")
    sqls["a3_summary_no_match"] = summary_sql("1900")
    sqls["a4_statistics_by_period"] = f"""with {SERVING} select annee, sum(saisine_plaintes_directes)::bigint as plaintes_directes,
      sum(total_victimes)::bigint as victimes, sum(interpelles)::bigint as interpelles, sum(resultats_def)::bigint as resultats_def
      from serving group by annee"""
    top = lambda col, where, n: f"""with {SERVING} select infraction, sum({col})::bigint as valeur from serving {where}
      group by infraction order by valeur desc, infraction limit {n}"""
    sqls["a5_top_labels"] = top("saisine_plaintes_directes", "", 15)
    sqls["a5_top_labels_period"] = top("interpelles", "where annee = '1998'", 50)
    sqls["a6_cluster_averages"] = f"""with {FINE_SERVING} select cluster, count(*) as nombre_lignes,
      {rnd('avg(total_saisines)', 2)} as moyenne_saisines, {rnd('avg(total_victimes)', 2)} as moyenne_victimes,
      {rnd('avg(interpelles)', 2)} as moyenne_interpelles, {rnd('avg(resultats_def)', 2)} as moyenne_resultats_def
      from serving where cluster is not null group by cluster"""
    sqls["a7_cluster_profile"] = f"""with {FINE_CLEAN}, {_ENRICHED} select "Cluster", count(*) as taille,
      {', '.join(rnd(f'avg("{c}")', 2) + f' as "{c}"' for c in S.CLUSTER_FEATURES)} from enriched where "Cluster" is not null group by "Cluster" """
    sqls["a8_periods"] = f"with {SERVING} select distinct annee from serving"
    sqls["a8_categories"] = f"with {SERVING} select distinct categorie from serving"
    sqls["a9_row_count"] = f"with {FINE_CLEAN} select count(*) as lignes_en_base from clean"
    sqls["a10_quality_report"] = f"""with {RECONCILED} select
      {', '.join(f'({sql})::bigint as {name}' for name, sql in _AUDIT)}, 0::bigint as valeurs_negatives,
      (select count(*) from recon where not "Concordance") as ecarts_avec_totaux_officiels,
      (select string_agg(p, ',' order by p) from (select distinct "Annee" as p from clean)) as periodes from clean"""
    sqls["a11_audit_rows"] = f"with {FINE_CLEAN} " + " union all ".join(
        f"select '{name}' as indicateur, ({sql})::bigint as valeur from clean" for name, sql in _AUDIT
    )
    sqls["a12_missing_profile"] = f"with {FINE_SERVING} {missing('serving', served)}"
    sqls["a13_describe"] = describe_sql(f"with {FINE_CLEAN}", "clean", S.PROFILE_MEASURES)
    lines = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    sqls["a13_describe_lines"] = describe_sql("", "lineitem", lines)
    sqls["a14_skewness"] = f"with {FINE_CLEAN} " + " union all ".join(
        f"""select '{c}' as variable, {rnd(f'skewness("{c}"::double)', 3)} as skewness from clean""" for c in S.KEY_MEASURES
    )

    def quantiles(source: str, table: str, columns: list[str]) -> str:
        return f"{source} " + " union all ".join(
            f"""select '{c}' as variable, {p}::double as probabilite, {rnd(f'quantile_cont("{c}"::double, {p})', 4)} as valeur from {table}"""
            for c in columns
            for p in (0.25, 0.75, 0.99)
        )

    sqls["a15_quantiles"] = quantiles(f"with {FINE_CLEAN}", "clean", S.ANOMALY_FEATURES)
    sqls["a15_quantiles_lines"] = quantiles("", "lineitem", lines)
    sqls["a16_severity_split"] = f"""with {FLAGGED} select "Niveau_anomalie", count(*) as nombre from levelled where "Est_anomalie" group by 1"""
    sqls["a17_period_totals"] = f"""with {FINE_CLEAN} select "Annee", {q(S.KEY_MEASURES, 'sum("{0}")::bigint as "{0}"')} from clean group by 1"""
    sqls["a17_annualised_totals"] = f"""with {FINE_CLEAN} select "Annee", {q(S.KEY_MEASURES, '''sum("{0}" * "Facteur_annualisation")::bigint as "{0}"''')} from clean group by 1"""
    sqls["a18_histogram"] = histogram_sql(f"with {FINE_CLEAN}", "clean", S.KEY_MEASURES)
    sqls["a18_histogram_log"] = histogram_sql(f"with {FINE_CLEAN}", "clean", S.KEY_MEASURES, log=True)
    sqls["a18_histogram_events"] = histogram_sql("with given as (select value from events)", "given", ["value"])
    sqls["a19_spearman"] = f"""with {FINE_CLEAN}, {spearman_ctes('clean', S.PROFILE_MEASURES)}
      select variable_1, variable_2, {rnd('rho', 6)} as rho from rho"""
    sqls["a19_spearman_lines"] = f"""with {spearman_ctes('lineitem', lines)} select variable_1, variable_2, {rnd('rho', 6)} as rho from rho"""
    sqls["a20_strongest_pairs"] = f"""with {FINE_CLEAN}, {spearman_ctes('clean', S.PROFILE_MEASURES)}
      select variable_1, variable_2, {rnd('rho', 3)} as rho, {rnd('abs(rho)', 3)} as abs_rho from rho where i < j
      order by abs(rho.rho) desc, i, j limit 20"""
    sqls["a21_concordance_rate"] = f"""with {RECONCILED} select count(*) as comparaisons, count(*) filter (where not "Concordance") as ecarts,
      {rnd('(count(*) filter (where "Concordance"))::double / count(*)', 4)} as taux_concordance from recon"""
    sqls["a22_findings"] = f"""with {RECONCILED} select count(*) as nombre_lignes,
      {', '.join(rnd(f'skewness("{c}"::double)', 3) + f' as "asymetrie_{c}"' for c in S.KEY_MEASURES)},
      (select string_agg(p, ', ' order by p) from (select distinct "Annee" as p from clean)) as periodes,
      (select count(*) from recon where not "Concordance") as ecarts from clean"""

    sqls["o1_listing"] = f"""with {FINE_SERVING} select {_LISTING} from serving order by plaintes_directes desc, record_id limit 200"""
    sqls["o2_anomaly_listing"] = f"""with {FINE_SERVING} select {_ANOMALY_LISTING} from serving where est_anomalie
      order by score desc nulls last, record_id limit 100"""
    sqls["o3_largest_rows"] = f"""with {FINE_CLEAN} select "Annee", "Categorie", "Infraction_Affaire_traitee", {q(S.KEY_MEASURES)}, "Volume_activite"
      from clean order by "Volume_activite" desc, "Record_ID" limit 15"""
    sqls["o4_largest_gaps"] = sqls["f5_mismatches"]
    sqls["o5_leaderboard"] = f"""with {FINE_CLEAN}, scored as (select "Categorie" as modele,
      {rnd('sqrt(avg(power("Resultats_DEF" - "Resultats_DAT", 2)))', 4)} as rmse from clean group by 1)
      select modele, rmse, row_number() over (order by rmse, modele) = 1 as meilleur from scored"""

    sqls["r1_robust_z"] = robust_z_sql(f"with {FINE_CLEAN},", "clean", '"Record_ID"', "Volume_activite")
    sqls["r1_robust_z_sparse"] = robust_z_sql(f"with {FINE_CLEAN},", "clean", '"Record_ID"', "Victimes_G")
    sqls["r1_robust_z_lines"] = robust_z_sql("with", "lineitem", "l_orderkey, l_partkey, l_linenumber::bigint as l_linenumber", "l_extendedprice")
    sqls["r2_rule_thresholds"] = f"""with {FINE_CLEAN}, {thresholds_cte('clean')} select variable, {rnd('seuil', 3)} as seuil from thresholds"""
    sqls["r3_reasons"] = f"""with {FINE_CLEAN}, {thresholds_cte('clean')}, reasoned as (select "Record_ID", {reasons_sql()} as "Raisons_anomalie" from clean)
      select *, "Raisons_anomalie" <> '' as "Anomalie_regle" from reasoned"""
    sqls["r4_iqr_outliers"] = iqr_sql(f"with {FINE_CLEAN}", "clean", S.PROFILE_MEASURES)
    sqls["r4_iqr_outliers_lines"] = iqr_sql("", "lineitem", lines)
    sqls["r5_robust_scaling"] = f"""with {FINE_CLEAN} select "Record_ID", {', '.join(rnd(
        f'''("{c}"::double - quantile_cont("{c}"::double, 0.5) over ()) / coalesce(nullif(quantile_cont("{c}"::double, 0.75) over ()
        - quantile_cont("{c}"::double, 0.25) over (), 0), 1)''', 6) + f' as "{c}"' for c in S.ANOMALY_FEATURES)} from clean"""
    flags = '"Record_ID", "Score_anomalie", "Anomalie_ML", "Anomalie_regle", "Est_anomalie"'
    sqls["r7_flags_from_scores"] = f"with {FLAGGED} select {flags} from flagged"
    sqls["r8_severity_levels"] = f"""with {FLAGGED} select "Record_ID", "Niveau_anomalie" from levelled"""

    def z_of(c: str) -> str:
        v = f'ln(1.0::double + "{c}"::double)'
        return f"""({v} - avg({v}) over ()) / coalesce(nullif(stddev_pop({v}) over (), 0), 1)"""

    zs = ", ".join(f'{z_of(c)} as z{i}' for i, c in enumerate(S.CLUSTER_FEATURES))
    # The threshold is an interpolated quantile of distinct scores, so the counts are known.
    sqls["r9_contamination_sweep"] = f"""with {FINE_CLEAN}, n as (select count(*) as n from clean), found as (select c::double as contamination,
        ceil(c::double * (n - 1))::bigint as hits, n from n, (select unnest([0.03, 0.05, 0.08, 0.1, 0.15]) as c))
      select contamination, hits as nombre_anomalies_ml, {rnd('100 * hits::double / n', 2)} as pourcentage from found"""
    sqls["c1_standardised_counts"] = f"""with {FINE_CLEAN} select "Record_ID", {', '.join(rnd(z_of(c), 6) + f' as "{c}"' for c in S.CLUSTER_FEATURES)} from clean"""
    square = " + ".join(f"(p.z{i} - o.z{i}) * (p.z{i} - o.z{i})" for i in range(6))
    points = f"""points as (select row_number() over (order by "Record_ID") as id, "Total_saisines" % 3 as label, {zs} from clean),
      sizes as (select label, count(*) as n from points group by label)"""
    sqls["c3_euclidean_silhouette"] = f"""with {FINE_CLEAN}, {points},
      dist as (select p.id, p.label, o.label as other, sum(sqrt({square})) as d from points p, points o group by 1, 2, 3),
      sides as (select id, max(case when dist.label = other then d / greatest(n - 1, 1) end) as a,
                  min(case when dist.label <> other then d / n end) as b,
                  max(case when dist.label = other then n end) as own from dist join sizes on sizes.label = other group by id)
      select {rnd('avg(case when own = 1 or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end)', 6)} as silhouette from sides"""
    norm = " + ".join(f"p.z{i} * p.z{i}" for i in range(6))
    dot = " + ".join(f"p.z{i} * s{i}" for i in range(6))
    sums6 = ", ".join(f"sum(z{i}) as s{i}" for i in range(6))
    sqls["c3_squared_silhouette"] = f"""with {FINE_CLEAN}, {points},
      groups as (select label, count(*) as n, {sums6}, sum({norm.replace('p.', '')}) as q from points group by label),
      dist as (select p.id, p.label, g.label as other, g.n, ({norm}) + g.q / g.n - 2 * ({dot}) / g.n as d from points p, groups g),
      sides as (select id, max(case when label = other then d * n / greatest(n - 1, 1) end) as a,
                  min(case when label <> other then d end) as b, max(case when label = other then n end) as own from dist group by id)
      select {rnd('avg(case when own = 1 or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end)', 6)} as silhouette from sides"""
    sqls["c5_choose_k"] = f"""with {FINE_CLEAN}, byp as (select substr("Annee", 1, 4)::int - 1993 as k, {rnd('avg("Taux_DEF_sur_saisines")', 6)} as sil,
        count(*)::double / (select count(*) from clean) / 2 as ratio from clean group by "Annee")
      select k::bigint as k from byp order by (ratio >= 0.05) desc, sil desc, k limit 1"""

    gap = lambda c: f'case when ordinal % 5 = 0 then null else "{c}" end'
    gaps = ", ".join(f'{gap(c)} as "{c}"' for c in S.NUMERIC_FEATURES)
    gapped = f"""{FINE}, gapped as (select ordinal, "Annee", case when ordinal % 4 = 0 then null else "Categorie" end as "Categorie", {gaps} from cells)"""
    filled = lambda c: f"""coalesce("{c}"::double, (select quantile_cont("{c}"::double, 0.5) from gapped))"""
    sqls["m1_median_imputation"] = f"""with {gapped} select ordinal, "Annee", {', '.join(f'{filled(c)} as "{c}"' for c in S.NUMERIC_FEATURES)} from gapped"""
    sqls["m2_mode_imputation"] = f"""with {gapped}, mode as (select "Categorie" as m from gapped where "Categorie" is not null
        group by 1 order by count(*) desc, 1 limit 1) select ordinal, "Annee", coalesce("Categorie", (select m from mode)) as "Categorie" from gapped"""
    sqls["m3_one_hot"] = f"""with {FINE_CLEAN} select "Record_ID", {', '.join(f"""("Annee" = '{p}')::int::double as p{p[:4]}""" for p in ['1996', '1997', '1998', '1999', '2000', '2001-S1'])} from clean"""
    sqls["m4_preprocessor"] = f"""with {gapped}, filled as (select ordinal, "Annee", {', '.join(f'{filled(c)} as "{c}"' for c in S.NUMERIC_FEATURES)} from gapped)
      select ordinal, "Annee", {', '.join(rnd(f'("{c}" - avg("{c}") over ()) / coalesce(nullif(stddev_pop("{c}") over (), 0), 1)', 6) + f' as "{c}"' for c in S.NUMERIC_FEATURES)} from filled"""
    place = """('0x' || substr(md5("Record_ID" || '|42'), 1, 15))::bigint"""
    folds = f"""folded as (select *, ntile(5) over (order by {place}) - 1 as fold from clean)"""
    fold_medians = """medians as (select f.fold, (select quantile_cont("Resultats_DEF"::double, 0.5) from folded t where t.fold <> f.fold) as m
        from (select distinct fold from folded) f)"""
    sqls["m5_median_baseline"] = f"""with {FINE_CLEAN}, {folds}, {fold_medians} select "Record_ID", fold, m as prediction from folded join medians using (fold)"""
    sqls["m9_shuffled_folds"] = f"""with {FINE_CLEAN}, {folds} select "Record_ID", fold from folded"""
    sqls["m10_period_folds"] = f"""with {FINE_CLEAN} select "Record_ID", dense_rank() over (order by "Annee") - 1 as fold from clean"""
    err = f'("Resultats_DEF" - {predicted})'
    sqls["m11_cv_summary"] = f"""with {FINE_CLEAN}, {folds}, scores as (select fold, avg(abs{err}) as mae, avg({err} * {err}) as mse,
        1 - avg({err} * {err}) / var_pop("Resultats_DEF") as r2 from folded group by fold)
      select {rnd('avg(mae)', 4)} as mae, {rnd('sqrt(avg(mse))', 4)} as rmse, {rnd('avg(r2)', 4)} as r2, {rnd('stddev_pop(r2)', 4)} as r2_ecart_type from scores"""
    clip = f'("Resultats_DEF" - greatest({predicted}, 0.0::double))'
    sqls["m12_training_diagnostics"] = f"""with {FINE_CLEAN} select {rnd(f'avg(abs{clip})', 4)} as mae_entrainement,
      {rnd(f'sqrt(avg({clip} * {clip}))', 4)} as rmse_entrainement, {rnd(f'1 - avg({clip} * {clip}) / var_pop("Resultats_DEF")', 4)} as r2_entrainement from clean"""
    sqls["m15_prediction_table"] = f"""with {FINE_CLEAN}, {folds}, {fold_medians} select "Record_ID", "Annee", "Categorie", "Infraction_Affaire_traitee",
      "Resultats_DEF"::double as "Valeur_reelle", {rnd('m', 2)} as "Prediction_CV", {rnd('abs("Resultats_DEF" - m)', 2)} as "Erreur_absolue",
      {rnd('"Resultats_DEF" - m', 2)} as "Residu" from folded join medians using (fold)"""
    sqls["s5_model_round_trip"] = f"""with {FINE_CLEAN} select "Record_ID", (select quantile_cont("Resultats_DEF"::double, 0.5) from clean) as prediction from clean"""
    sqls["x2_prepare_and_load"] = f"with {COARSE} select count(*) as lignes from cells"
    sqls["x3_stage_precondition"] = f"with {COARSE} select count(*) as lignes, 'refusee' as etape_suivante from cells"
    listed = f"with {FINE_SERVING}, {OFFICIAL}, detail as (select \"Annee\", {SUMS} from clean group by 1), recon as ({_PAIRS}), "
    sqls["x4_dashboard_feeds"] = listed + """listed as (select * from serving order by saisine_plaintes_directes desc, record_id limit 1000)
      select 'annees' as vue, count(distinct annee) as lignes from serving union all select 'categories', count(distinct categorie) from serving
      union all select 'resume', 1 union all select 'principales_infractions', least(15, count(distinct infraction)) from serving
      union all select 'comparaison_periodes', count(distinct annee) from serving union all select 'donnees_filtrees', count(*) from listed
      union all select 'nuage_clusters', count(*) from listed where cluster is not null and pca_1 is not null and pca_2 is not null
      union all select 'profil_clusters', count(distinct cluster) from serving
      union all select 'anomalies', least(500, count(*)) from serving where est_anomalie
      union all select 'ecarts', count(*) from recon where "Total_detail" <> "Total_officiel" """
    none = "null::double"
    shown = """concat_ws('|', record_id, annee, categorie, infraction, niveau_anomalie, raisons_anomalie) as cle,
      concat_ws('|', saisine_plaintes_directes, total_saisines, total_victimes, interpelles, resultats_def, cluster, est_anomalie) as valeurs,
      pca_1::double as reel_1, pca_2::double as reel_2, score_anomalie::double as reel_3, null::double as reel_4"""
    summed = "sum(saisine_plaintes_directes), sum(total_victimes), sum(interpelles), sum(resultats_def)"
    first_rows = "order by saisine_plaintes_directes desc, record_id limit 1000"
    means = ", ".join(
        f"{rnd(f'avg({c})', 2)} as reel_{i}" for i, c in enumerate(["total_saisines", "total_victimes", "interpelles", "resultats_def"], 1)
    )
    views = {
        "annees": f"select distinct annee, '', {none}, {none}, {none}, {none} from serving",
        "categories": f"select distinct categorie, '', {none}, {none}, {none}, {none} from serving",
        "resume": f"""select '1996|LARGE', concat_ws('|', count(*), sum(saisine_plaintes_directes), sum(total_saisines),
          sum(total_victimes), sum(interpelles), sum(resultats_def), count(*) filter (where est_anomalie)),
          {none}, {none}, {none}, {none} from serving where annee = '1996' and categorie = 'LARGE'""",
        "principales_infractions": f"""select infraction, valeur::varchar, {none}, {none}, {none}, {none} from (
          select infraction, sum(saisine_plaintes_directes) as valeur from serving where annee = '1996'
          group by 1 order by 2 desc, 1 limit 15)""",
        "comparaison_periodes": f"""select annee, concat_ws('|', {summed}), {none}, {none}, {none}, {none} from serving group by annee""",
        "donnees_filtrees": f"""select {shown} from (select * from serving where annee = '1996' and categorie = 'LARGE' {first_rows})""",
        "nuage_clusters": f"""select {shown} from (select * from serving {first_rows})
          where cluster is not null and pca_1 is not null and pca_2 is not null""",
        "profil_clusters": f"""select '', concat_ws('|', cluster, count(*)), {means} from serving where cluster is not null group by cluster""",
        "anomalies": f"""select concat_ws('|', record_id, annee, categorie, infraction, niveau_anomalie, raisons_anomalie),
          concat_ws('|', saisine_plaintes_directes, total_victimes, interpelles), score_anomalie::double, {none}, {none}, {none}
          from (select * from serving where est_anomalie and niveau_anomalie = '{S.LEVEL_MEDIUM}'
            order by score_anomalie desc nulls last, record_id limit 500)""",
        "ecarts": f"""select concat_ws('|', "Annee", "Indicateur"),
          concat_ws('|', "Total_detail", "Total_officiel", "Total_detail" - "Total_officiel", "Total_detail" = "Total_officiel"),
          {none}, {none}, {none}, {none} from recon where "Total_detail" <> "Total_officiel" """,
    }
    columns = "cle, valeurs, reel_1, reel_2, reel_3, reel_4"
    sqls["x4_feed_contents"] = listed.rstrip(", ") + " " + " union all ".join(
        f"select '{name}' as vue, {columns} from ({sql}) as v({columns})" for name, sql in views.items()
    )
    sqls["v1_required_columns"] = f"""with {FINE} select count(*) as lignes, true as complet_accepte, false as incomplet_accepte from cells"""
    sqls["v3_parameter_bounds"] = f"""with {FINE_CLEAN}, n as (select count(*) as n from clean)
      select limite::bigint as limite, limite between 1 and 1000 as accepte,
        case when limite between 1 and 1000 then least(limite, n) else 0 end::bigint as lignes
      from n, (select unnest([0, 1, 1000, 1001]) as limite)"""
    sqls["v2_scoring_split"] = f"""with {FINE_CLEAN}, given as (select ordinal,
        coalesce(case when ordinal % 5 = 0 then null else "Annee" end, '2026-S1') as "Annee",
        case when ordinal % 13 = 0 then null else "Categorie" end as "Categorie",
        coalesce(case when ordinal % 11 = 0 then -1 when ordinal % 7 = 0 then null else "Saisine_FD" end, 0)::bigint as "Saisine_FD"
        from clean)
      select *, "Categorie" is not null and "Saisine_FD" >= 0 as valide from given"""
    given = {"l_quantity": "case when l_linenumber <> 1 then l_quantity end", "l_extendedprice": "l_extendedprice",
             "l_discount": "case when l_linenumber % 3 <> 2 then l_discount end", "l_tax": "l_tax"}
    ranked = lambda c: f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0"
    parts = [
        f"""select '{a}' as variable_1, '{b}' as variable_2, {"1.0::double" if a == b else rnd("corr(x, y)", 6)} as rho
        from (select {ranked(a)} as x, {ranked(b)} as y from given where {a} is not null and {b} is not null)"""
        for a in given for b in given
    ]
    sqls["a19_spearman_gaps"] = f"with given as (select {', '.join(f'{v} as {k}' for k, v in given.items())} from lineitem) " + " union all ".join(
        p if "corr" in p else f"select '{a}' as variable_1, '{a}' as variable_2, 1.0::double as rho" for p, a in zip(parts, [a for a in given for _ in given])
    )
    return sqls
