"""Column groups and fixed labels of the activity table.

Fixed values: the column names, default labels and reason texts below are part of the
data format and are stated as they must appear in results.
"""

PERIOD = "Annee"
CATEGORY = "Categorie"
LABEL = "Infraction_Affaire_traitee"
NORMALISED = "Infraction_normalisee"
OBSERVATIONS = "Observations_Objets_saisis"
RECORD_ID = "Record_ID"
MISSING_LABEL = "Infraction_non_renseignee"
ANNUALISED = "Plaintes_directes_annualisees"

INTAKE = ["Saisine_Plaintes_directes", "Saisine_FD", "Saisine_ST", "Saisine_Autres"]
VICTIMS = ["Victimes_H", "Victimes_F", "Victimes_G", "Victimes_F_fille"]
IMPLICATED = ["MiseEnCause_Neutralises", "MiseEnCause_Interpelles"]
OUTCOMES = ["Resultats_En_cours", "Resultats_Retraits", "Resultats_DAT", "Resultats_DEF"]
MEASURES = INTAKE + VICTIMS + IMPLICATED + OUTCOMES

TOTALS = ["Total_saisines", "Total_victimes", "Total_resultats", "Volume_activite"]
PROFILE_MEASURES = MEASURES + TOTALS
KEY_MEASURES = ["Total_saisines", "Total_victimes", "MiseEnCause_Interpelles", "Resultats_DEF"]

REQUIRED = [PERIOD, CATEGORY, LABEL] + MEASURES
CLEAN_COLUMNS = (
    [RECORD_ID, PERIOD, CATEGORY, LABEL, NORMALISED]
    + MEASURES
    + TOTALS
    + ["Taux_DEF_sur_saisines", "Facteur_annualisation", ANNUALISED, MISSING_LABEL, OBSERVATIONS]
)

CLUSTER_FEATURES = [
    "Total_saisines",
    "Total_victimes",
    "MiseEnCause_Interpelles",
    "MiseEnCause_Neutralises",
    "Resultats_DEF",
    "Resultats_En_cours",
]
ANOMALY_FEATURES = INTAKE + ["Total_victimes"] + IMPLICATED + OUTCOMES

TARGET = "Resultats_DEF"
CATEGORICAL_FEATURES = [PERIOD, CATEGORY]
NUMERIC_FEATURES = INTAKE + VICTIMS + IMPLICATED
MODEL_FEATURES = CATEGORICAL_FEATURES + NUMERIC_FEATURES

UNKNOWN_PERIOD = "Période inconnue"
UNKNOWN_CATEGORY = "Catégorie inconnue"
UNKNOWN_LABEL = "Infraction non renseignée"
UNKNOWN_TEXT = "inconnu"
ALL_VALUES = "Toutes"
HALF_YEAR_FACTORS = {"2026-S1": 2.0}

REASON_HIGH = ": valeur extrêmement élevée"
REASON_LABEL = "Libellé d'infraction non renseigné"
REASON_IDLE = "Ligne sans activité numérique"
LEVEL_NORMAL = "Normale"
LEVEL_HIGH = "Élevée"
LEVEL_MEDIUM = "Moyenne"
LEVEL_LOW = "Faible"

# Serving name -> (column of the enriched table, type), in serving order.
SERVING_COLUMNS = {
    "record_id": (RECORD_ID, "string"),
    "annee": (PERIOD, "string"),
    "categorie": (CATEGORY, "string"),
    "infraction": (LABEL, "string"),
    "infraction_normalisee": (NORMALISED, "string"),
    "saisine_plaintes_directes": ("Saisine_Plaintes_directes", "long"),
    "saisine_fd": ("Saisine_FD", "long"),
    "saisine_st": ("Saisine_ST", "long"),
    "saisine_autres": ("Saisine_Autres", "long"),
    "victimes_h": ("Victimes_H", "long"),
    "victimes_f": ("Victimes_F", "long"),
    "victimes_g": ("Victimes_G", "long"),
    "victimes_f_fille": ("Victimes_F_fille", "long"),
    "neutralises": ("MiseEnCause_Neutralises", "long"),
    "interpelles": ("MiseEnCause_Interpelles", "long"),
    "resultats_en_cours": ("Resultats_En_cours", "long"),
    "resultats_retraits": ("Resultats_Retraits", "long"),
    "resultats_dat": ("Resultats_DAT", "long"),
    "resultats_def": ("Resultats_DEF", "long"),
    "total_saisines": ("Total_saisines", "long"),
    "total_victimes": ("Total_victimes", "long"),
    "total_resultats": ("Total_resultats", "long"),
    "volume_activite": ("Volume_activite", "long"),
    "taux_def_sur_saisines": ("Taux_DEF_sur_saisines", "double"),
    "cluster": ("Cluster", "long"),
    "pca_1": ("PCA_1", "double"),
    "pca_2": ("PCA_2", "double"),
    "score_anomalie": ("Score_anomalie", "double"),
    "est_anomalie": ("Est_anomalie", "boolean"),
    "niveau_anomalie": ("Niveau_anomalie", "string"),
    "raisons_anomalie": ("Raisons_anomalie", "string"),
    "observations": (OBSERVATIONS, "string"),
}

# Scoring input name -> model feature, in contract order.
SCORING_COUNTS = {
    "saisine_plaintes_directes": "Saisine_Plaintes_directes",
    "saisine_fd": "Saisine_FD",
    "saisine_st": "Saisine_ST",
    "saisine_autres": "Saisine_Autres",
    "victimes_h": "Victimes_H",
    "victimes_f": "Victimes_F",
    "victimes_g": "Victimes_G",
    "victimes_f_fille": "Victimes_F_fille",
    "neutralises": "MiseEnCause_Neutralises",
    "interpelles": "MiseEnCause_Interpelles",
}
SCORING_DEFAULT_PERIOD = "2026-S1"
