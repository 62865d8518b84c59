"""Fixed values that must equal the documented behaviour (labels, messages, ranks).

These are output strings and ranks users and stored notes rely on; they are
stated here once, plainly, in natural order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: severities and their ranks -------------------------------
SEVERITY_RANK = {"NORMAL": 0, "WARNING": 1, "ANOMALY": 2}
ALERT_SEVERITIES = ("WARNING", "ANOMALY")

# --- fixed values: quality flag ---------------------------------------------
REDUCED_QUALITY = "reduced_quality"
NORMAL_QUALITY = "normal"

# --- fixed values: baseline granularity names and scopes --------------------
GRANULARITY_HOUR = "Stunde"
GRANULARITY_WEEKDAY_HOUR = "Stunde + Wochentag"
WEEKDAY_NAMES = ("Mo", "Di", "Mi", "Do", "Fr", "Sa", "So")

# --- fixed values: stage names ----------------------------------------------
STAGE_NAMES = {"stage1": "Stage 1", "stage2": "Stage 2", "stage3": "Stage 3"}

# --- fixed values: Stage 1 rules and messages -------------------------------
RULE_LABELS = {"warn_avg": "Pegel", "warn_spike": "Spike", "warn_range": "Spannweite"}
RULE_UNKNOWN = "Unklar"
STAGE1_MSG_PERSISTENT_LEVEL = "Persistente Pegelabweichung gegen Baseline"
STAGE1_MSG_PERSISTENT_RANGE = "Persistente Spannweitenabweichung gegen Baseline"
STAGE1_MSG_SPIKE = "Kurzfristig erhöhte Peak-Dynamik"
STAGE1_MSG_SINGLE = "Einzelwarnung gegen Baseline"
MSG_NORMAL = "Normalbereich"

# --- fixed values: Stage 2 messages -----------------------------------------
STAGE2_MSG_PERSISTENT = "Persistente multivariate Abweichung"
STAGE2_MSG_SINGLE = "Multivariate Einzelwarnung"

# --- fixed values: Stage 3 messages -----------------------------------------
STAGE3_MSG_ALL_THREE = "Persistente Konsens-Anomalie in allen drei Modellen"
STAGE3_MSG_SEVERAL = "Persistente Konsens-Anomalie in mehreren Modellen"
STAGE3_MSG_SINGLE_MODEL = "Einzelmodell-Warnung"
STAGE3_MSG_MULTI_MODEL = "Mehrmodell-Warnung"

# --- fixed values: four-level status ("Ampel") labels by rank ---------------
AMPEL_LABELS = {0: "normal", 1: "lokal auffällig", 2: "konsistent auffällig", 3: "persistent anomal"}

# --- fixed values: model names for thresholds -------------------------------
MODEL_NAMES = {"iforest": "Isolation Forest", "lof": "LOF", "ocsvm": "One-Class SVM"}

# --- fixed values: inspection verdict default, manual stage -----------------
DEFAULT_VERDICT = "manuell geprüft"
MANUAL_STAGE = "Manuell"

# --- fixed values: timeframe names ------------------------------------------
TIMEFRAMES = ("Gesamt", "Letzte 24h", "Letzte 7 Tage", "Letzte 30 Tage", "Letzte 90 Tage", "Letzter Kalendertag")


def severity_rank(col: Column) -> Column:
    """NORMAL=0, WARNING=1, ANOMALY=2, anything else 0."""
    expr = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        expr = F.when(col == F.lit(name), F.lit(rank)).otherwise(expr)
    return expr


def severity_name(rank: Column) -> Column:
    expr = F.lit("NORMAL")
    for name, r in SEVERITY_RANK.items():
        expr = F.when(rank == F.lit(r), F.lit(name)).otherwise(expr)
    return expr


def ampel_label(rank: Column) -> Column:
    expr = F.lit(AMPEL_LABELS[0])
    for r, name in AMPEL_LABELS.items():
        expr = F.when(rank == F.lit(r), F.lit(name)).otherwise(expr)
    return expr


def ampel_rank_of_label(label: Column) -> Column:
    expr = F.lit(0)
    for r, name in AMPEL_LABELS.items():
        expr = F.when(label == F.lit(name), F.lit(r)).otherwise(expr)
    return expr
