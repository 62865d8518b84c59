"""Stage pipelines: one lazy lineage per stage, lineage cut at stage borders.

Each annotated stage table feeds several aggregates (events, summaries,
profiles), so it is checkpointed into the shared checkpoint folder: a lost
executor then re-reads the checkpoint instead of replaying every scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sonolith.operators.baseline import apply_baseline, baseline_tables
from sonolith.operators.events import (
    alert_context,
    alert_rows_with_event_ids,
    build_events,
    finish_stage1_events,
    rule_summary,
    stage1_event_aggs,
)
from sonolith.operators.multivariate import run_stage2 as _annotate_stage2
from sonolith.operators.rules import apply_stage1_rules
from sonolith.options import Options
from sonolith.session import cut_lineage, write_table


@dataclass
class Stage1Result:
    rows: DataFrame
    baseline_hourly: DataFrame
    baseline_weekday_hourly: DataFrame
    alert_rows: DataFrame
    events: DataFrame


def run_stage1(measurements: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",), cut: bool = True) -> Stage1Result:
    keys = list(keys)
    hourly, weekday_hourly = baseline_tables(measurements, opts, keys=keys)
    if cut:
        hourly, weekday_hourly = cut_lineage(hourly), cut_lineage(weekday_hourly)
    rows = apply_stage1_rules(apply_baseline(measurements, hourly, weekday_hourly, opts, keys), opts, keys)
    if cut:
        rows = write_table(rows, "stage1")
    alerts = alert_rows_with_event_ids(rows, "stage1", keys, opts.event_adjacency)
    events = finish_stage1_events(
        build_events(alerts, "stage1", opts.expected_interval_minutes, keys, extra_aggs=stage1_event_aggs())
    )
    return Stage1Result(rows, hourly, weekday_hourly, alerts, events)


def stage1_context(result: Stage1Result, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    return alert_context(result.rows, result.events, "stage1", keys)


def stage1_rule_summary(result: Stage1Result, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    return rule_summary(result.rows, result.events, keys)


@dataclass
class Stage2Result:
    rows: DataFrame
    alert_rows: DataFrame
    events: DataFrame


def run_stage2(rows: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",), cut: bool = True) -> Stage2Result:
    keys = list(keys)
    annotated = _annotate_stage2(rows, opts, keys, cut=(lambda d: write_table(d, "stage2-scored")) if cut else None)
    if cut:
        annotated = write_table(annotated, "stage2")
    alerts = alert_rows_with_event_ids(annotated, "stage2", keys, opts.event_adjacency)
    events = build_events(alerts, "stage2", opts.expected_interval_minutes, keys, score_column="multivariate_score")
    return Stage2Result(annotated, alerts, events)


@dataclass
class Stage3Result:
    rows: DataFrame
    plan: DataFrame
    alert_rows: DataFrame
    events: DataFrame


MODELS = ("iforest", "lof", "ocsvm")


def stage3_inputs(rows: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",), cut: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training plan, scaled feature rows and exact LOF scores (shared by all scorers)."""
    from sonolith.operators.ensemble import annotate_training, scale_features, training_plan
    from sonolith.operators.lof import lof_scores

    keys = list(keys)
    c = cut_lineage if cut else (lambda d: d)
    t = (lambda d: write_table(d, "stage3")) if cut else (lambda d: d)
    plan = c(training_plan(rows, opts, keys))
    ann = t(scale_features(annotate_training(rows, plan, opts, keys), opts, keys))
    lof = t(lof_scores(ann, plan, opts, keys))
    return plan, ann, lof


def model_scorer(inputs: tuple[DataFrame, DataFrame, DataFrame]):
    """Scorer with the three detectors (J6: scores joined back on row id)."""

    def score(rows: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",), cut: bool = True) -> tuple[DataFrame, DataFrame]:
        from pyspark.sql import functions as F

        from sonolith.operators.iforest import iforest_scores
        from sonolith.operators.ocsvm import ocsvm_scores
        from sonolith.operators.quantiles import quantile_table

        keys = list(keys)
        plan, ann, lof = inputs
        c = cut_lineage if cut else (lambda d: d)
        t = (lambda d: write_table(d, "stage3")) if cut else (lambda d: d)
        iso = iforest_scores(ann, plan, opts, keys)
        svm = ocsvm_scores(ann, plan, opts, keys)
        scores = t(iso.join(lof, keys + ["row_id"], "full").join(svm, keys + ["row_id"], "full"))
        # isolation score relative to the training (1 - contamination) quantile: 0 is the boundary
        offs = scores.join(ann.where(F.col("stage3_train")).select(*keys, "row_id"), keys + ["row_id"], "left_semi")
        offs = c(quantile_table(offs, keys, [("iforest_s", 1.0 - opts.stage3.clamped_contamination, "_if_off")], opts))
        from sonolith.plans.sizing import broadcast_if_small

        scores = scores.join(broadcast_if_small(offs, opts.scale.broadcast_max_rows), keys, "left").select(
            *keys,
            "row_id",
            (F.col("iforest_s") - F.col("_if_off")).alias("stage3_iforest_score"),
            F.col("lof").alias("stage3_lof_score"),
            F.col("ocsvm").alias("stage3_ocsvm_score"),
        )
        return ann.join(scores, keys + ["row_id"], "left"), plan

    return score


def standin_scorer(inputs: tuple[DataFrame, DataFrame, DataFrame]):
    """Deterministic scorer for checking the Stage-3 decision logic against SQL:
    exact LOF plus two closed-form scores (distance from the training mean,
    |standardised level|) in the isolation-forest and SVM slots."""

    def score(rows: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",), cut: bool = True) -> tuple[DataFrame, DataFrame]:
        from pyspark.sql import functions as F

        from sonolith.operators.ensemble import FEATURE_SLOTS

        keys = list(keys)
        plan, ann, lof = inputs
        dist = F.sqrt(sum((F.col(f) * F.col(f) for f in FEATURE_SLOTS), F.lit(0.0)))
        out = ann.join(lof, keys + ["row_id"], "left").withColumns(
            {
                "stage3_iforest_score": F.when(F.col("stage3_valid"), dist),
                "stage3_lof_score": F.col("lof"),
                "stage3_ocsvm_score": F.when(F.col("stage3_valid"), F.abs(F.col("f0"))),
            }
        ).drop("lof")
        return out, plan

    return score


def score_stage3(rows: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",), cut: bool = True) -> tuple[DataFrame, DataFrame]:
    return model_scorer(stage3_inputs(rows, opts, keys, cut))(rows, opts, keys, cut)


def score_stage3_standin(rows: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",), cut: bool = True) -> tuple[DataFrame, DataFrame]:
    return standin_scorer(stage3_inputs(rows, opts, keys, cut))(rows, opts, keys, cut)


def run_stage3(
    rows: DataFrame, opts: Options, keys: Sequence[str] = ("asset_id",), cut: bool = True, scorer=None
) -> Stage3Result:
    from pyspark.sql import functions as F

    from sonolith.operators.ampel import apply_row_ampel, finish_stage3_events, stage3_event_aggs
    from sonolith.operators.ensemble import combine, thresholds_and_norms
    from sonolith.operators.persistence import persistent_flag
    from sonolith.operators.rules import severity, stage3_message

    keys = list(keys)
    c = cut_lineage if cut else (lambda d: d)
    t = (lambda d: write_table(d, "stage3")) if cut else (lambda d: d)
    scored, plan = (scorer or score_stage3)(rows, opts, keys, cut)
    scored = t(scored)
    stats = c(thresholds_and_norms(scored, MODELS, opts, keys))
    comb = t(combine(scored, stats, MODELS, opts, keys))
    comb = persistent_flag(comb, "stage3_strong_now", opts.stage3.persistence_windows, "stage3_persistent_warning", keys)
    p, w = F.col("stage3_persistent_warning"), F.col("stage3_warning_now")
    comb = comb.withColumns({"stage3_severity": severity(p, w), "stage3_message": stage3_message(p, w, F.col("stage3_votes"))})
    annotated = t(apply_row_ampel(comb))
    alerts = alert_rows_with_event_ids(annotated, "stage3", keys, opts.event_adjacency)
    events = build_events(
        alerts, "stage3", opts.expected_interval_minutes, keys, score_column="stage3_consensus_score", extra_aggs=stage3_event_aggs()
    )
    events = finish_stage3_events(events, opts.stage3.persistence_windows)
    return Stage3Result(annotated, plan, alerts, events)
