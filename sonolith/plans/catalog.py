"""Query catalog: every registered query as (Spark callable, DuckDB oracle SQL).

Each query reads the driver tables at ``sf_dir`` (the hourly series is derived
from ``events``), runs the library operators, and projects named, rounded
columns so the oracle comparison is exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.functions.vocab import GRANULARITY_WEEKDAY_HOUR
from sonolith.operators import baseline as B
from sonolith.operators import events as E
from sonolith.options import BaselineOptions, Options, hourly_series_options
from sonolith.plans import oracle as O
from sonolith.plans.pipeline import Stage1Result, run_stage1, stage1_context, stage1_rule_summary
from sonolith.session import write_table
from sonolith.sources.measurements import measurement_table

OPTS: Options = hourly_series_options()
OPTS_WEEKDAY: Options = OPTS.with_(
    baseline=BaselineOptions(default_granularity=GRANULARITY_WEEKDAY_HOUR, weekday_hour_min_count=OPTS.baseline.weekday_hour_min_count)
)


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str  # operator ids from the survey inventory


REGISTRY: dict[str, Query] = {}


def register(name: str, ids: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, ids)
        return fn

    return deco


def r6(c: str | Column) -> Column:
    """Round half up to 1e-6 (same IEEE operations as the oracle's ``floor(x*1e6+0.5)/1e6``)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.floor(col * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


# ---------------------------------------------------------------- memoised stages
# Within one session the prepared series and stage tables are checkpointed once
# and shared by the queries that read them (as a production job would).
_MEMO: dict[tuple, object] = {}


def _written(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """When the input was written, and its length: results of an older one are not used again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    return status.getModificationTime(), status.getLen()


def _memo(spark: SparkSession, key: tuple, build):
    k = (id(spark), spark.sparkContext.applicationId, _written(spark, key[1]), *key)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def series(spark: SparkSession, sf_dir: str, opts: Options = OPTS) -> DataFrame:
    return _memo(spark, ("series", sf_dir, opts), lambda: write_table(measurement_table(spark, sf_dir, opts), "series"))


def stage1(spark: SparkSession, sf_dir: str, opts: Options = OPTS) -> Stage1Result:
    return _memo(spark, ("stage1", sf_dir, opts), lambda: run_stage1(series(spark, sf_dir, opts), opts))


def SER(*tail: str, opts: Options = OPTS) -> str:
    return O.with_(O.series_ctes(opts), *tail)


# ---------------------------------------------------------------- step 1: quality
@register(
    "gap_segments",
    "W1 W2 W3 W4 W5",
    SER()
    + f" SELECT asset_id, row_id, timestamp, {O.r6('delta_minutes')} AS delta_minutes, gap_flag, segment_id, near_gap_flag FROM series",
)
def q_gap_segments(spark, sf_dir):
    m = series(spark, sf_dir)
    return m.select("asset_id", "row_id", "timestamp", r6("delta_minutes").alias("delta_minutes"), "gap_flag", "segment_id", "near_gap_flag")


@register(
    "quality_counts",
    "P8 A20",
    SER()
    + """ SELECT asset_id, count(*) AS rows, count(*) FILTER (WHERE gap_flag) AS gaps,
       count(*) FILTER (WHERE quality_flag = 'reduced_quality') AS reduced_quality_rows,
       count(*) FILTER (WHERE near_gap_flag) AS near_gap_rows,
       count(*) FILTER (WHERE freq_format_error) AS freq_format_error_rows,
       max(segment_id) + 1 AS segments
FROM series GROUP BY asset_id""",
)
def q_quality_counts(spark, sf_dir):
    m = series(spark, sf_dir)
    return m.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("gap_flag").alias("gaps"),
        F.count_if(F.col("quality_flag") == "reduced_quality").alias("reduced_quality_rows"),
        F.count_if("near_gap_flag").alias("near_gap_rows"),
        F.count_if("freq_format_error").alias("freq_format_error_rows"),
        (F.max("segment_id") + 1).alias("segments"),
    )


_SPREADS = ("peak_minus_avg", "avg_minus_min", "peak_minus_min", "low_share", "mid_share", "high_share")


@register(
    "spreads_and_shares",
    "P6 P7",
    SER() + " SELECT asset_id, row_id, " + ", ".join(f"{O.r6(c)} AS {c}" for c in _SPREADS) + " FROM series",
)
def q_spreads(spark, sf_dir):
    m = series(spark, sf_dir)
    return m.select("asset_id", "row_id", *[r6(c).alias(c) for c in _SPREADS])


@register(
    "calendar_parts",
    "P8 P9",
    SER() + " SELECT asset_id, row_id, hour_of_day, weekday, date, quality_flag FROM series",
)
def q_calendar(spark, sf_dir):
    m = series(spark, sf_dir)
    return m.select("asset_id", "row_id", "hour_of_day", "weekday", "date", "quality_flag")


# ---------------------------------------------------------------- step 3: baselines
def _baseline_cols(group: list[str]) -> list[str]:
    cols = ["asset_id", *group, "baseline_count"]
    for m in B.BASELINE_METRICS:
        cols += [f"{m}_baseline_median", f"{m}_baseline_mad"]
    return cols


def _baseline_sql(name: str, group: list[str]) -> str:
    cols = ", ".join(c if not c.endswith(("_median", "_mad")) else f"{O.r6(c)} AS {c}" for c in _baseline_cols(group))
    return SER(O.baseline_ctes(name, group)) + f" SELECT {cols} FROM {name}"


def _baseline_out(df: DataFrame, group: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if not c.endswith(("_median", "_mad")) else r6(c).alias(c) for c in _baseline_cols(group)])


@register("baseline_hour", "A1 A3 P15", _baseline_sql("bh", ["hour_of_day"]))
def q_baseline_hour(spark, sf_dir):
    return _baseline_out(stage1(spark, sf_dir).baseline_hourly, ["hour_of_day"])


@register("baseline_weekday_hour", "A2 A3 P15", _baseline_sql("bw", ["weekday", "hour_of_day"]))
def q_baseline_weekday_hour(spark, sf_dir):
    return _baseline_out(stage1(spark, sf_dir).baseline_weekday_hourly, ["weekday", "hour_of_day"])


_Z_OUT = [f"{m}_{s}" for m in B.BASELINE_METRICS for s in ("baseline_scope", "robust_z")]


@register(
    "robust_z",
    "J1 J2 R1",
    SER(O.zrow_ctes(OPTS_WEEKDAY, weekday_mode=True), opts=OPTS_WEEKDAY)
    + " SELECT asset_id, row_id, "
    + ", ".join(c if c.endswith("scope") else f"{O.r6(c)} AS {c}" for c in _Z_OUT)
    + " FROM zrows",
)
def q_robust_z(spark, sf_dir):
    s1 = stage1(spark, sf_dir)
    rows = B.apply_baseline(series(spark, sf_dir), s1.baseline_hourly, s1.baseline_weekday_hourly, OPTS_WEEKDAY)
    return rows.select("asset_id", "row_id", *[F.col(c) if c.endswith("scope") else r6(c).alias(c) for c in _Z_OUT])


_PROFILE_SQL_TAIL = """
SELECT asset_id, hour_of_day, {r_med} AS median, {r_q10} AS q10, {r_q90} AS q90, count({m}) AS count
FROM {src} WHERE {m} IS NOT NULL AND hour_of_day IS NOT NULL GROUP BY asset_id, hour_of_day"""


def _profile_sql(m: str, src: str) -> str:
    return _PROFILE_SQL_TAIL.format(
        m=m,
        src=src,
        r_med=O.r6(O.percentile(m, 0.5)),
        r_q10=O.r6(O.percentile(m, 0.1)),
        r_q90=O.r6(O.percentile(m, 0.9)),
    )


def _profile_out(df: DataFrame) -> DataFrame:
    return df.select("asset_id", "hour_of_day", r6("median").alias("median"), r6("q10").alias("q10"), r6("q90").alias("q90"), "count")


@register("hour_profile", "A4", SER() + _profile_sql("avg_decibel", "series"))
def q_hour_profile(spark, sf_dir):
    return _profile_out(B.hourly_profile(series(spark, sf_dir), "avg_decibel", OPTS))


def _active_weekday_sql(src: str) -> str:
    """Per asset: weekday of the last row (canonical order) and the number of rows on it."""
    return f"""
aw_days AS (SELECT asset_id, weekday, count(*) AS n, max(seq_pos) AS last_pos FROM {src}
            WHERE timestamp IS NOT NULL AND weekday IS NOT NULL GROUP BY 1, 2),
aw AS (SELECT asset_id, arg_max(weekday, last_pos) AS active_weekday FROM aw_days GROUP BY 1),
aw2 AS (SELECT a.asset_id, a.active_weekday, coalesce(d.n, 0) AS active_weekday_rows
        FROM aw a LEFT JOIN aw_days d ON a.asset_id = d.asset_id AND a.active_weekday = d.weekday)"""


_WD_LABEL = "CASE active_weekday " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(("Mo", "Di", "Mi", "Do", "Fr", "Sa", "So"))) + " END"


@register(
    "weekday_profile",
    "A5 W11",
    SER(
        "prof_src AS (SELECT * FROM series WHERE peak_minus_min IS NOT NULL AND hour_of_day IS NOT NULL)",
        _active_weekday_sql("prof_src"),
        f"""chosen AS (SELECT *, active_weekday_rows >= 10 AS use_wd,
                   CASE WHEN active_weekday_rows >= 10 THEN 'Stunde + Wochentag (' || {_WD_LABEL} || ')'
                        ELSE 'Stunde (Fallback)' END AS scope FROM aw2)""",
        "prof_rows AS (SELECT p.*, c.scope FROM prof_src p JOIN chosen c USING (asset_id) WHERE NOT c.use_wd OR p.weekday = c.active_weekday)",
    )
    + _profile_sql("peak_minus_min", "prof_rows").replace("count(peak_minus_min) AS count", "count(peak_minus_min) AS count, any_value(scope) AS scope"),
)
def q_weekday_profile(spark, sf_dir):
    p = B.generic_profile(series(spark, sf_dir), "peak_minus_min", OPTS, GRANULARITY_WEEKDAY_HOUR)
    return _profile_out(p).join(p.select("asset_id", "hour_of_day", "scope"), ["asset_id", "hour_of_day"])


def _stage1_profile_sql(src_cte: str, src: str) -> str:
    mn = OPTS.baseline.weekday_hour_min_count
    cols = ", ".join(f"{O.r6(c)} AS {c}" for c in _baseline_cols([])[2:])
    return SER(
        src_cte,
        O.baseline_ctes("bh", ["hour_of_day"]).replace("FROM series", f"FROM {src}"),
        O.baseline_ctes("bw", ["weekday", "hour_of_day"]).replace("FROM series", f"FROM {src}"),
        _active_weekday_sql(src),
        "day AS (SELECT b.* FROM bw b JOIN aw2 a ON a.asset_id = b.asset_id AND b.weekday = a.active_weekday)",
        f"""chosen AS (SELECT a.asset_id, a.active_weekday, coalesce(max(d.baseline_count) >= {mn}, false) AS use_wd
                   FROM aw2 a LEFT JOIN day d USING (asset_id) GROUP BY 1, 2)""",
        f"""prof AS (SELECT d.* FROM day d JOIN chosen c USING (asset_id) WHERE c.use_wd
                 UNION ALL BY NAME
                 SELECT h.*, CAST(NULL AS INTEGER) AS weekday FROM bh h JOIN chosen c USING (asset_id) WHERE NOT c.use_wd)""",
    ) + f""" SELECT p.asset_id, p.weekday, p.hour_of_day, p.baseline_count, {cols},
       CASE WHEN c.use_wd THEN 'Stunde + Wochentag (' || {_WD_LABEL.replace('active_weekday', 'c.active_weekday')} || ')' ELSE 'Stunde (Fallback)' END AS scope
FROM prof p JOIN chosen c USING (asset_id)"""


def _stage1_profile_out(p: DataFrame) -> DataFrame:
    return p.select(
        "asset_id", "weekday", "hour_of_day", "baseline_count",
        *[r6(c).alias(c) for c in _baseline_cols([])[2:]], "scope",
    )


@register("stage1_profile", "A6 A2 A1", _stage1_profile_sql("s1p_src AS (SELECT * FROM series)", "s1p_src"))
def q_stage1_profile(spark, sf_dir):
    s1 = stage1(spark, sf_dir)
    p = B.stage1_profile(series(spark, sf_dir), OPTS, weekday_hourly=s1.baseline_weekday_hourly, hourly=s1.baseline_hourly)
    return _stage1_profile_out(p)


@register(
    "stage1_profile_timeframe",
    "A8 P10 A6",
    _stage1_profile_sql(
        """tf_bounds AS (SELECT asset_id, max(timestamp) - INTERVAL 7 DAY AS ws FROM series WHERE timestamp IS NOT NULL GROUP BY 1),
tf_rows AS (SELECT s.* FROM series s JOIN tf_bounds b USING (asset_id) WHERE s.timestamp >= b.ws)""",
        "tf_rows",
    ),
)
def q_stage1_profile_timeframe(spark, sf_dir):
    from sonolith.operators.explore import timeframe_slice

    rows = timeframe_slice(series(spark, sf_dir), "Letzte 7 Tage")
    return _stage1_profile_out(B.stage1_profile(rows, OPTS))


@register(
    "baseline_band",
    "A7",
    SER(O.baseline_ctes("bh", ["hour_of_day"]))
    + f""" SELECT asset_id, hour_of_day,
       {O.r6('avg_decibel_baseline_median - 1.4826 * coalesce(avg_decibel_baseline_mad, 0)')} AS band_low,
       {O.r6('avg_decibel_baseline_median + 1.4826 * coalesce(avg_decibel_baseline_mad, 0)')} AS band_high
FROM bh""",
)
def q_baseline_band(spark, sf_dir):
    b = B.baseline_band(stage1(spark, sf_dir).baseline_hourly, "avg_decibel")
    return b.select("asset_id", "hour_of_day", r6("band_low").alias("band_low"), r6("band_high").alias("band_high"))


# ---------------------------------------------------------------- step 4: Stage 1
def S1(*tail: str) -> str:
    return SER(O.zrow_ctes(OPTS, weekday_mode=False), O.stage1_ctes(OPTS), *tail)


_RULE_COLS = ["warn_avg", "warn_range", "warn_spike", "warning_now", "persistent_warning", "stage1_severity", "stage1_message"]


@register("stage1_rules", "R2 R3 R4 W6", S1() + " SELECT asset_id, row_id, " + ", ".join(_RULE_COLS) + " FROM s1")
def q_stage1_rules(spark, sf_dir):
    return stage1(spark, sf_dir).rows.select("asset_id", "row_id", *_RULE_COLS)


_ALERT_NUM = ["avg_decibel", "peak_decibel", "min_decibel", "peak_minus_min"]


@register(
    "stage1_alerts",
    "P14",
    S1()
    + " SELECT asset_id, timestamp, 'Stage 1' AS stage, stage1_severity AS severity, stage1_message AS message, "
    + ", ".join(f"{O.r6(c)} AS {c}" for c in _ALERT_NUM)
    + ", quality_flag, near_gap_flag FROM s1 WHERE stage1_severity IN ('WARNING', 'ANOMALY')",
)
def q_stage1_alerts(spark, sf_dir):
    a = E.extract_alerts(stage1(spark, sf_dir).rows, "stage1", [*_ALERT_NUM, "quality_flag", "near_gap_flag"])
    return a.select(*[r6(c).alias(c) if c in _ALERT_NUM else F.col(c) for c in a.columns])


_EVENT_BASE = [
    "asset_id", "event_id", "start_timestamp", "end_timestamp", "duration_minutes", "stage", "severity", "message",
    "row_count", "reduced_quality_rows", "near_gap_rows", "has_reduced_quality", "has_near_gap",
]
_S1_Z_MAX = [f"{z}_max" for z in E.Z_COLUMNS]

_S1_EVENTS_SQL = S1(O.event_ctes("s1", "stage1", "ev1", OPTS.expected_interval_minutes, O.STAGE1_EVENT_AGGS)) + (
    " SELECT " + ", ".join(c if c != "stage" else "'Stage 1' AS stage" for c in _EVENT_BASE)
    + ", " + ", ".join(f"{O.r6(c)} AS {c}" for c in _S1_Z_MAX)
    + """, CASE WHEN greatest(n_avg, n_spike, n_range) <= 0 THEN 'Unklar'
            WHEN n_avg = greatest(n_avg, n_spike, n_range) THEN 'Pegel'
            WHEN n_spike = greatest(n_avg, n_spike, n_range) THEN 'Spike' ELSE 'Spannweite' END AS dominant_rule,
       CASE WHEN has_reduced_quality THEN 'reduced_quality' ELSE 'normal' END AS quality_label
FROM ev1"""
)


@register("stage1_events", "W9 A13 A14 A15 A16 A17 J7", _S1_EVENTS_SQL)
def q_stage1_events(spark, sf_dir):
    ev = stage1(spark, sf_dir).events
    return ev.select(*_EVENT_BASE, *[r6(c).alias(c) for c in _S1_Z_MAX], "dominant_rule", "quality_label")


@register(
    "rule_summary",
    "A18",
    S1(
        O.event_ctes("s1", "stage1", "ev1", OPTS.expected_interval_minutes, O.STAGE1_EVENT_AGGS),
        """dom AS (SELECT asset_id, CASE WHEN greatest(n_avg, n_spike, n_range) <= 0 THEN 'Unklar'
            WHEN n_avg = greatest(n_avg, n_spike, n_range) THEN 'Pegel'
            WHEN n_spike = greatest(n_avg, n_spike, n_range) THEN 'Spike' ELSE 'Spannweite' END AS dominant_rule FROM ev1)""",
        """domc AS (SELECT asset_id, dominant_rule, count(*) AS n,
            CASE dominant_rule WHEN 'Pegel' THEN 0 WHEN 'Spike' THEN 1 WHEN 'Spannweite' THEN 2 ELSE 3 END AS o
            FROM dom GROUP BY 1, 2)""",
        """top AS (SELECT asset_id, arg_max(dominant_rule, n * 10 - o) AS dominant_rule, max(n) AS dominant_rule_events
            FROM domc GROUP BY 1)""",
    )
    + """ SELECT c.asset_id, c.warn_avg_rows, c.warn_range_rows, c.warn_spike_rows, t.dominant_rule, t.dominant_rule_events
FROM (SELECT asset_id, count(*) FILTER (WHERE warn_avg) AS warn_avg_rows, count(*) FILTER (WHERE warn_range) AS warn_range_rows,
             count(*) FILTER (WHERE warn_spike) AS warn_spike_rows FROM s1 GROUP BY 1) c LEFT JOIN top t USING (asset_id)""",
)
def q_rule_summary(spark, sf_dir):
    return stage1_rule_summary(stage1(spark, sf_dir))


_CTX_COLS = [
    "row_alerts_total", "row_alerts_reduced_quality", "row_alerts_near_gap", "row_alerts_both",
    "events_total", "events_reduced_quality", "events_near_gap", "events_both",
]


def _context_sql(src: str, ev: str) -> str:
    pct = []
    for c, tot in [("row_alerts_reduced_quality", "row_alerts_total"), ("row_alerts_near_gap", "row_alerts_total"),
                   ("events_reduced_quality", "events_total"), ("events_near_gap", "events_total")]:
        pct.append(f"{O.r6(f'CASE WHEN {tot} = 0 THEN 0.0 ELSE 100.0 * {c} / {tot} END')} AS {c}_pct")
    return f""" SELECT r.asset_id, r.row_alerts_total, r.row_alerts_reduced_quality, r.row_alerts_near_gap, r.row_alerts_both,
       coalesce(e.events_total, 0) AS events_total, coalesce(e.events_reduced_quality, 0) AS events_reduced_quality,
       coalesce(e.events_near_gap, 0) AS events_near_gap, coalesce(e.events_both, 0) AS events_both
FROM (SELECT asset_id,
        count(*) FILTER (WHERE {src}_severity IN ('WARNING','ANOMALY')) AS row_alerts_total,
        count(*) FILTER (WHERE {src}_severity IN ('WARNING','ANOMALY') AND quality_flag = 'reduced_quality') AS row_alerts_reduced_quality,
        count(*) FILTER (WHERE {src}_severity IN ('WARNING','ANOMALY') AND near_gap_flag) AS row_alerts_near_gap,
        count(*) FILTER (WHERE {src}_severity IN ('WARNING','ANOMALY') AND quality_flag = 'reduced_quality' AND near_gap_flag) AS row_alerts_both
      FROM {{rows}} GROUP BY 1) r
LEFT JOIN (SELECT asset_id, count(*) AS events_total, count(*) FILTER (WHERE has_reduced_quality) AS events_reduced_quality,
        count(*) FILTER (WHERE has_near_gap) AS events_near_gap,
        count(*) FILTER (WHERE has_reduced_quality AND has_near_gap) AS events_both FROM {ev} GROUP BY 1) e USING (asset_id)""", pct


def _context_full_sql(prefix: str, rows: str, ev: str) -> str:
    body, pct = _context_sql(prefix, ev)
    body = body.replace("{rows}", rows)
    return f" SELECT *, {', '.join(pct)} FROM ({body}) ctx"


def _context_out(df: DataFrame) -> DataFrame:
    pct = []
    for c, tot in [("row_alerts_reduced_quality", "row_alerts_total"), ("row_alerts_near_gap", "row_alerts_total"),
                   ("events_reduced_quality", "events_total"), ("events_near_gap", "events_total")]:
        pct.append(r6(E.percent(F.col(c), F.col(tot))).alias(f"{c}_pct"))
    return df.select("asset_id", *_CTX_COLS, *pct)


@register(
    "alert_context",
    "A19 P16",
    S1(O.event_ctes("s1", "stage1", "ev1", OPTS.expected_interval_minutes, O.STAGE1_EVENT_AGGS)) + _context_full_sql("stage1", "s1", "ev1"),
)
def q_alert_context(spark, sf_dir):
    return _context_out(stage1_context(stage1(spark, sf_dir)))


# ---------------------------------------------------------------- step 5: Stage 2
from sonolith.operators import multivariate as MV  # noqa: E402
from sonolith.plans.pipeline import Stage2Result, run_stage2  # noqa: E402


def stage2(spark: SparkSession, sf_dir: str, opts: Options = OPTS) -> Stage2Result:
    return _memo(spark, ("stage2", sf_dir, opts), lambda: run_stage2(stage1(spark, sf_dir, opts).rows, opts))


_S2F = list(O.STAGE2_FEATURES)


@register(
    "feature_stats",
    "A9 M1 P15",
    SER(O.stage2_ctes(OPTS))
    + " SELECT asset_id, n_rows, " + ", ".join(f"{O.r6(f + '_mean')} AS {f}_mean, {O.r6(f + '_std')} AS {f}_std" for f in _S2F) + " FROM s2_stats",
)
def q_feature_stats(spark, sf_dir):
    m = series(spark, sf_dir)
    st = MV.feature_stats(m, _S2F, ["asset_id"], where=MV.complete(_S2F))
    return st.select("asset_id", "n_rows", *[r6(f"{f}_{k}").alias(f"{f}_{k}") for f in _S2F for k in ("mean", "std")])


def _corr_sql(src: str) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT asset_id, '{a}' AS feature_a, '{b}' AS feature_b, {O.r6(f'corr({a}, {b})')} AS corr FROM {src} GROUP BY asset_id"
        for a in _S2F for b in _S2F
    )
    return pairs


@register(
    "correlation_matrix",
    "A10 P15",
    SER("corr_src AS (SELECT * FROM series WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in _S2F) + ")") + " " + _corr_sql("corr_src"),
)
def q_correlation_matrix(spark, sf_dir):
    c = MV.correlation_matrix(series(spark, sf_dir), _S2F)
    return c.select("asset_id", "feature_a", "feature_b", r6("corr").alias("corr"))


@register(
    "correlation_timeframe",
    "A11 P10",
    SER(
        "tf_bounds AS (SELECT asset_id, max(timestamp) - INTERVAL 30 DAY AS ws FROM series WHERE timestamp IS NOT NULL GROUP BY 1)",
        "corr_src AS (SELECT s.* FROM series s JOIN tf_bounds b USING (asset_id) WHERE s.timestamp >= b.ws AND "
        + " AND ".join(f"s.{f} IS NOT NULL" for f in _S2F) + ")",
    )
    + " " + _corr_sql("corr_src"),
)
def q_correlation_timeframe(spark, sf_dir):
    from sonolith.operators.explore import timeframe_slice

    rows = timeframe_slice(series(spark, sf_dir), "Letzte 30 Tage")
    c = MV.correlation_matrix(rows, _S2F)
    return c.select("asset_id", "feature_a", "feature_b", r6("corr").alias("corr"))


@register(
    "multivariate_score",
    "M1 M2 M4 J6",
    SER(O.stage2_ctes(OPTS)) + f" SELECT asset_id, row_id, stage2_complete, {O.r6('multivariate_score')} AS multivariate_score FROM s2",
)
def q_multivariate_score(spark, sf_dir):
    r = stage2(spark, sf_dir).rows
    return r.select("asset_id", "row_id", "stage2_complete", r6("multivariate_score").alias("multivariate_score"))


@register(
    "score_quantiles",
    "A12",
    SER(O.stage2_ctes(OPTS))
    + " SELECT asset_id, "
    + ", ".join(f"{O.r6(f'quantile_cont(multivariate_score, {q})')} AS q{int(round(q * 100)):02d}" for q in (0.05, 0.5, 0.95, 0.99))
    + " FROM s2 WHERE multivariate_score IS NOT NULL GROUP BY 1",
)
def q_score_quantiles(spark, sf_dir):
    r = stage2(spark, sf_dir).rows
    out = None
    for q in (0.05, 0.5, 0.95, 0.99):
        t = MV.quantile_per_key(r, "multivariate_score", q, OPTS, ["asset_id"], f"q{int(round(q * 100)):02d}")
        out = t if out is None else out.join(t, "asset_id")
    return out.select("asset_id", *[r6(c).alias(c) for c in ("q05", "q50", "q95", "q99")])


_S2_RULES = ["stage2_warning_now", "stage2_persistent_warning", "stage2_severity", "stage2_message"]


@register(
    "stage2_rules",
    "M5 W7 R3 R5",
    SER(O.stage2_ctes(OPTS)) + " SELECT asset_id, row_id, " + ", ".join(_S2_RULES) + f", {O.r6('stage2_threshold')} AS stage2_threshold FROM s2",
)
def q_stage2_rules(spark, sf_dir):
    r = stage2(spark, sf_dir).rows
    return r.select("asset_id", "row_id", *_S2_RULES, r6("stage2_threshold").alias("stage2_threshold"))


@register(
    "stage2_events",
    "W9 A13 J6 J7",
    SER(O.stage2_ctes(OPTS), O.event_ctes("s2", "stage2", "ev2", OPTS.expected_interval_minutes, ", max(multivariate_score) AS multivariate_score"))
    + " SELECT " + ", ".join(c if c != "stage" else "'Stage 2' AS stage" for c in _EVENT_BASE)
    + f", {O.r6('multivariate_score')} AS multivariate_score FROM ev2",
)
def q_stage2_events(spark, sf_dir):
    ev = stage2(spark, sf_dir).events
    return ev.select(*_EVENT_BASE, r6("multivariate_score").alias("multivariate_score"))


@register(
    "stage2_alert_context",
    "A19",
    SER(O.stage2_ctes(OPTS), O.event_ctes("s2", "stage2", "ev2", OPTS.expected_interval_minutes, ", max(multivariate_score) AS multivariate_score"))
    + _context_full_sql("stage2", "s2", "ev2"),
)
def q_stage2_alert_context(spark, sf_dir):
    r = stage2(spark, sf_dir)
    return _context_out(E.alert_context(r.rows, r.events, "stage2"))


@register(
    "pca_scores",
    "M3",
    SER(O.stage2_ctes(OPTS), O.pca_ctes()) + f" SELECT asset_id, row_id, {O.r6('pc1')} AS pc1, {O.r6('pc2')} AS pc2 FROM pca",
)
def q_pca_scores(spark, sf_dir):
    r = stage2(spark, sf_dir).rows
    return r.where(F.col("stage2_complete")).select("asset_id", "row_id", r6("pc1").alias("pc1"), r6("pc2").alias("pc2"))


# ---------------------------------------------------------------- step 6: exploration
from sonolith.operators import explore as X  # noqa: E402
from sonolith.functions.formatting import display_timestamp, event_signature  # noqa: E402

_TF_SQL = {
    "Letzte 24h": "max(timestamp) - INTERVAL 24 HOUR",
    "Letzte 7 Tage": "max(timestamp) - INTERVAL 7 DAY",
}


@register(
    "timeframe_slice",
    "P10",
    SER(
        "tf AS (SELECT asset_id, CAST(CAST(max(timestamp) AS DATE) AS TIMESTAMP) AS ws FROM series WHERE timestamp IS NOT NULL GROUP BY 1)"
    )
    + " SELECT s.asset_id, s.row_id, s.timestamp FROM series s JOIN tf USING (asset_id) WHERE s.timestamp >= tf.ws AND s.timestamp < tf.ws + INTERVAL 1 DAY",
)
def q_timeframe_slice(spark, sf_dir):
    return X.timeframe_slice(series(spark, sf_dir), "Letzter Kalendertag").select("asset_id", "row_id", "timestamp")


@register(
    "timeframe_events",
    "J4 P10",
    S1(
        O.event_ctes("s1", "stage1", "ev1", OPTS.expected_interval_minutes, O.STAGE1_EVENT_AGGS),
        "tf AS (SELECT asset_id, max(timestamp) - INTERVAL 7 DAY AS ws, max(timestamp) AS we FROM series WHERE timestamp IS NOT NULL GROUP BY 1)",
    )
    + " SELECT e.asset_id, e.event_id, e.start_timestamp, e.end_timestamp FROM ev1 e JOIN tf USING (asset_id) WHERE e.end_timestamp >= tf.ws AND e.start_timestamp <= tf.we",
)
def q_timeframe_events(spark, sf_dir):
    bounds = X.timeframe_bounds(series(spark, sf_dir), "Letzte 7 Tage")
    ev = X.events_in_timeframe(stage1(spark, sf_dir).events, bounds)
    return ev.select("asset_id", "event_id", "start_timestamp", "end_timestamp")


@register(
    "event_windows",
    "J3",
    S1(O.event_ctes("s1", "stage1", "ev1", OPTS.expected_interval_minutes, O.STAGE1_EVENT_AGGS))
    + f""" SELECT e.asset_id, e.event_id, s.row_id, s.timestamp, {O.r6('s.avg_decibel')} AS avg_decibel
FROM ev1 e JOIN series s ON s.asset_id = e.asset_id
 AND s.timestamp BETWEEN e.start_timestamp - INTERVAL {OPTS.inspection_window_hours} HOUR AND e.end_timestamp + INTERVAL {OPTS.inspection_window_hours} HOUR""",
)
def q_event_windows(spark, sf_dir):
    w = X.event_windows(series(spark, sf_dir), stage1(spark, sf_dir).events, OPTS.inspection_window_hours, event_cols=["event_id"])
    return w.select("asset_id", "event_id", "row_id", "timestamp", r6("avg_decibel").alias("avg_decibel"))


_DS_MAX = 100


@register(
    "downsample",
    "W10",
    SER(
        "ds_src AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp, row_id) - 1 AS pos, count(*) OVER (PARTITION BY asset_id) AS n FROM series WHERE avg_decibel IS NOT NULL AND low_share IS NOT NULL)"
    )
    + f""" SELECT asset_id, row_id, timestamp FROM ds_src
WHERE pos % (CASE WHEN n <= {_DS_MAX} THEN 1 ELSE greatest(1, n // {_DS_MAX}) END) = 0""",
)
def q_downsample(spark, sf_dir):
    d = X.downsample(series(spark, sf_dir), ["avg_decibel", "low_share"], _DS_MAX)
    return d.select("asset_id", "row_id", "timestamp")


@register(
    "status_record",
    "A24 P12 P11",
    S1(O.event_ctes("s1", "stage1", "ev1", OPTS.expected_interval_minutes, O.STAGE1_EVENT_AGGS))
    + """ SELECT r.asset_id, 'Gesamt' AS timeframe, 'Gesamte Historie' AS baseline_mode, 'Stunde' AS granularity, 'Auto' AS weekday,
       r.row_count, coalesce(e.event_count, 0) AS event_count, '-' AS computed_at,
       e.first_start, e.first_signature
FROM (SELECT asset_id, count(*) AS row_count FROM series GROUP BY 1) r
LEFT JOIN (SELECT asset_id, count(*) AS event_count,
                  strftime(min(start_timestamp), '%d.%m.%Y %H:%M') AS first_start,
                  arg_min('Stage 1|' || strftime(start_timestamp, '%Y%m%dT%H%M%S') || '|' || strftime(end_timestamp, '%Y%m%dT%H%M%S'), start_timestamp) AS first_signature
           FROM ev1 GROUP BY 1) e USING (asset_id)""",
)
def q_status_record(spark, sf_dir):
    m = series(spark, sf_dir)
    ev = stage1(spark, sf_dir).events
    st = X.status_record(m, ev, "Gesamt", "Gesamte Historie", "Stunde")
    first = ev.groupBy("asset_id").agg(
        display_timestamp(F.min("start_timestamp")).alias("first_start"),
        F.min_by(event_signature(F.col("stage"), F.col("start_timestamp"), F.col("end_timestamp")), F.col("start_timestamp")).alias("first_signature"),
    )
    return st.join(first, "asset_id", "left")


# ---------------------------------------------------------------- step 8: Stage 3
from sonolith.operators import ampel as AM  # noqa: E402
from sonolith.plans.pipeline import Stage3Result, model_scorer, run_stage3, stage3_inputs, standin_scorer  # noqa: E402


def _stage3_inputs(spark: SparkSession, sf_dir: str, opts: Options = OPTS):
    return _memo(spark, ("stage3in", sf_dir, opts), lambda: stage3_inputs(stage2(spark, sf_dir, opts).rows, opts))


def stage3(spark: SparkSession, sf_dir: str, opts: Options = OPTS) -> Stage3Result:
    return _memo(
        spark, ("stage3", sf_dir, opts),
        lambda: run_stage3(stage2(spark, sf_dir, opts).rows, opts, scorer=model_scorer(_stage3_inputs(spark, sf_dir, opts))),
    )


def stage3_standin(spark: SparkSession, sf_dir: str, opts: Options = OPTS) -> Stage3Result:
    """Same Stage-3 decision logic with deterministic stand-in scores (SQL-checkable)."""
    return _memo(
        spark, ("stage3s", sf_dir, opts),
        lambda: run_stage3(stage2(spark, sf_dir, opts).rows, opts, scorer=standin_scorer(_stage3_inputs(spark, sf_dir, opts))),
    )


_PLAN_COLS = ["asset_id", "use_shares", "n_features", "n_valid", "quality_filtered", "n_train", "scored"]


@register("training_set", "M6 M7", SER(O.stage3_train_ctes()) + " SELECT " + ", ".join(_PLAN_COLS) + " FROM s3_plan")
def q_training_set(spark, sf_dir):
    return stage3_standin(spark, sf_dir).plan.select(*_PLAN_COLS)


@register(
    "lof_scores",
    "M8",
    SER(O.stage3_train_ctes(), O.lof_ctes(OPTS.stage3.lof_neighbors)) + f" SELECT asset_id, row_id, {O.r6('lof')} AS lof FROM lof",
)
def q_lof_scores(spark, sf_dir):
    r = stage3_standin(spark, sf_dir).rows
    return r.where(F.col("stage3_valid")).select("asset_id", "row_id", r6("stage3_lof_score").alias("lof"))


_IF_CUT = 1.0 - OPTS.stage3.clamped_contamination


@register(
    "iforest_scores",
    "M9",
    SER(
        O.stage3_train_ctes(), O.iforest_ctes(OPTS),
        f"if_off AS (SELECT asset_id, quantile_cont(iforest_s, {_IF_CUT}) AS off FROM iforest JOIN s3_f USING (asset_id, row_id) WHERE stage3_train GROUP BY 1)",
        "if_sc AS (SELECT i.asset_id, i.row_id, f.stage3_train, iforest_s - off AS sc FROM iforest i JOIN if_off USING (asset_id) JOIN s3_f f USING (asset_id, row_id))",
        f"if_thr AS (SELECT asset_id, quantile_cont(sc, {_IF_CUT}) AS thr FROM if_sc WHERE stage3_train GROUP BY 1)",
    )
    + f" SELECT asset_id, row_id, {O.r6('sc')} AS iforest_score, sc >= thr AS stage3_iforest_flag FROM if_sc JOIN if_thr USING (asset_id)",
)
def q_iforest_scores(spark, sf_dir):
    r = stage3(spark, sf_dir).rows
    return r.where(F.col("stage3_valid")).select("asset_id", "row_id", r6("stage3_iforest_score").alias("iforest_score"), "stage3_iforest_flag")


@register("ocsvm_scores", "M10", None)
def q_ocsvm_scores(spark, sf_dir):
    r = stage3(spark, sf_dir).rows
    return r.where(F.col("stage3_valid")).select("asset_id", "row_id", r6("stage3_ocsvm_score").alias("ocsvm_score"), "stage3_ocsvm_flag")


_CONS = ["stage3_votes", "stage3_warning_now", "stage3_strong_now"]


@register("consensus", "M11 M12 M13", None)
def q_consensus(spark, sf_dir):
    r = stage3(spark, sf_dir).rows
    return r.select("asset_id", "row_id", *_CONS, r6("stage3_consensus_score").alias("stage3_consensus_score"))


@register("stage3_events", "W8 R6 R8 R9 R10 A13", None)
def q_stage3_events(spark, sf_dir):
    ev = stage3(spark, sf_dir).events
    return ev.select(*_EVENT_BASE, "ampel_rank", "ampel_label", "ampel_reason", "consensus_count", "persistent_flag")


@register("ampel_summary", "A21 A22 A23", None)
def q_ampel_summary(spark, sf_dir):
    r = stage3(spark, sf_dir)
    return AM.ampel_summary(r.events, r.plan)


def S3L(*tail: str) -> str:
    return S1(O.stage3_train_ctes("s1"), O.lof_ctes(OPTS.stage3.lof_neighbors), O.stage3_logic_ctes(OPTS), *tail)


_S3_ROW_COLS = [
    "stage3_votes", "stage3_warning_now", "stage3_strong_now", "stage3_persistent_warning", "stage3_severity",
    "stage3_message", "stage3_ampel_rank_raw", "stage3_ampel_rank",
]


@register(
    "stage3_logic_rows",
    "M11 M12 M13 W8 R3 R6 R7 J6",
    S3L()
    + " SELECT asset_id, row_id, " + ", ".join(_S3_ROW_COLS)
    + f", {O.AMPEL_CASE.format(x='stage3_ampel_rank')} AS stage3_ampel_label, stage3_ampel_rank < stage3_ampel_rank_raw AS stage3_ampel_discounted"
    + f", {O.r6('stage3_consensus_score')} AS stage3_consensus_score FROM s3",
)
def q_stage3_logic_rows(spark, sf_dir):
    r = stage3_standin(spark, sf_dir).rows
    return r.select(
        "asset_id", "row_id", *_S3_ROW_COLS, "stage3_ampel_label", "stage3_ampel_discounted",
        r6("stage3_consensus_score").alias("stage3_consensus_score"),
    )


_S3_EV_EXTRA = ["ampel_rank", "ampel_reason", "consensus_count", "persistent_flag"]
_S3_EV_SQL = S3L(
    O.event_ctes("s3", "stage3", "ev3", OPTS.expected_interval_minutes, O.STAGE3_EVENT_AGGS), O.stage3_event_finish(OPTS)
)


@register(
    "stage3_logic_events",
    "W9 A13 R8 R9 R10",
    _S3_EV_SQL
    + " SELECT " + ", ".join(c if c != "stage" else "'Stage 3' AS stage" for c in _EVENT_BASE) + ", " + ", ".join(_S3_EV_EXTRA)
    + f", {O.AMPEL_CASE.format(x='ampel_rank')} AS ampel_label, "
    + ", ".join(f"{O.r6(c)} AS {c}" for c in ("stage3_consensus_score", "stage3_iforest_score_max", "stage3_lof_score_max", "stage3_ocsvm_score_max"))
    + " FROM ev3_f",
)
def q_stage3_logic_events(spark, sf_dir):
    ev = stage3_standin(spark, sf_dir).events
    return ev.select(
        *_EVENT_BASE, *_S3_EV_EXTRA, "ampel_label",
        *[r6(c).alias(c) for c in ("stage3_consensus_score", "stage3_iforest_score_max", "stage3_lof_score_max", "stage3_ocsvm_score_max")],
    )


@register("ampel_distribution", "A21", None)
def q_ampel_distribution(spark, sf_dir):
    r = stage3(spark, sf_dir)
    return AM.ampel_distribution(r.events, r.plan)


@register("ampel_overall", "A22 A23", None)
def q_ampel_overall(spark, sf_dir):
    r = stage3(spark, sf_dir)
    return AM.ampel_summary(r.events, r.plan)


@register(
    "stage3_logic_ampel_distribution",
    "A21",
    _S3_EV_SQL
    + f""", lbl AS (SELECT * FROM (VALUES ('normal'), ('lokal auffällig'), ('konsistent auffällig'), ('persistent anomal')) v(ampel_label)),
dim AS (SELECT DISTINCT s.asset_id, l.ampel_label FROM series s CROSS JOIN lbl l),
cnt AS (SELECT asset_id, {O.AMPEL_CASE.format(x='ampel_rank')} AS ampel_label, count(*) AS events FROM ev3_f GROUP BY 1, 2)
SELECT d.asset_id, d.ampel_label, coalesce(c.events, 0) AS events FROM dim d LEFT JOIN cnt c USING (asset_id, ampel_label)""",
)
def q_logic_ampel_distribution(spark, sf_dir):
    r = stage3_standin(spark, sf_dir)
    return AM.ampel_distribution(r.events, r.plan)


@register(
    "stage3_logic_ampel_overall",
    "A22 A23",
    _S3_EV_SQL
    + f""", per AS (SELECT asset_id, count(*) AS events, max(ampel_rank) AS mr, count(*) FILTER (WHERE ampel_rank = 0) AS normal_events,
   count(*) FILTER (WHERE ampel_rank = 1) AS n1, count(*) FILTER (WHERE ampel_rank = 2) AS n2, count(*) FILTER (WHERE ampel_rank = 3) AS n3,
   CAST(sum(row_count) AS BIGINT) AS alert_rows FROM ev3_f GROUP BY 1),
a AS (SELECT DISTINCT asset_id FROM series),
j AS (SELECT a.asset_id, coalesce(p.events, 0) AS events, coalesce(p.mr, 0) AS mr, coalesce(p.normal_events, 0) AS normal_events,
        coalesce(p.n1, 0) AS n1, coalesce(p.n2, 0) AS n2, coalesce(p.n3, 0) AS n3, coalesce(p.alert_rows, 0) AS alert_rows
      FROM a LEFT JOIN per p USING (asset_id))
SELECT asset_id, {O.AMPEL_CASE.format(x='mr')} AS overall_ampel, events, normal_events, alert_rows,
  (CASE WHEN events = 0 THEN 'Im gewählten Zeitraum gibt es keine Stage-3-Events.'
        WHEN mr = 3 THEN printf('Mindestens ein Event wurde als persistent anomal eingestuft (%d Events).', n3)
        WHEN mr = 2 THEN printf('Es gibt keine roten Events, aber %d konsistent auffällige Events.', n2)
        WHEN mr = 1 THEN printf('Es gibt nur lokale Auffälligkeiten (%d Events), aber keine konsistenten oder persistenten roten Phasen.', n1)
        ELSE 'Die vorhandenen Events wurden nach Abschlägen eher als normal eingestuft.' END)
  || CASE WHEN events > 0 AND normal_events > 0 THEN printf(' %d Event(s) wurden durch Reduced Quality oder Gap-Nähe auf normal abgewertet.', normal_events) ELSE '' END
  AS ampel_explanation
FROM j""",
)
def q_logic_ampel_overall(spark, sf_dir):
    r = stage3_standin(spark, sf_dir)
    return AM.ampel_summary(r.events, r.plan)


# ---------------------------------------------------------------- step 2: parsing and ingest
from sonolith.functions import parsing as PZ  # noqa: E402
from sonolith.sources import csv_ingest as CI  # noqa: E402

# Locale text built from the event values: seven shapes chosen by event_id % 7.
_IP = "CAST(floor(value) AS BIGINT)"
_DEC = "lpad(CAST(CAST(floor((value - floor(value)) * 100 + 0.5) AS BIGINT) AS VARCHAR), 2, '0')"
_LOCALE_TEXT_SQL = f"""CASE event_id % 7
  WHEN 0 THEN CAST({_IP} AS VARCHAR) || ',' || {_DEC}
  WHEN 1 THEN '1.' || lpad(CAST({_IP} AS VARCHAR), 3, '0') || ',' || {_DEC}
  WHEN 2 THEN '1,' || lpad(CAST({_IP} AS VARCHAR), 3, '0') || '.' || {_DEC}
  WHEN 3 THEN ' ' || CAST({_IP} AS VARCHAR) || ' ' || ',' || {_DEC} || ' '
  WHEN 4 THEN CAST({_IP} AS VARCHAR) || '.' || {_DEC} || '.5'
  WHEN 5 THEN CAST({_IP} AS VARCHAR) || ',' || {_DEC} || ',5'
  ELSE 'x' || CAST({_IP} AS VARCHAR) END"""


def _locale_text(df: DataFrame) -> Column:
    ip = F.floor("value").cast("long").cast("string")
    dec = F.lpad(F.floor((F.col("value") - F.floor("value")) * 100 + 0.5).cast("long").cast("string"), 2, "0")
    k = F.col("event_id") % 7
    return (
        F.when(k == 0, F.concat(ip, F.lit(","), dec))
        .when(k == 1, F.concat(F.lit("1."), F.lpad(ip, 3, "0"), F.lit(","), dec))
        .when(k == 2, F.concat(F.lit("1,"), F.lpad(ip, 3, "0"), F.lit("."), dec))
        .when(k == 3, F.concat(F.lit(" "), ip, F.lit(" "), F.lit(","), dec, F.lit(" ")))
        .when(k == 4, F.concat(ip, F.lit("."), dec, F.lit(".5")))
        .when(k == 5, F.concat(ip, F.lit(","), dec, F.lit(",5")))
        .otherwise(F.concat(F.lit("x"), ip))
    )


def _sql_locale_parse(t: str) -> str:
    s = f"replace(regexp_replace({t}, '^\\s+|\\s+$', '', 'g'), ' ', '')"
    last = lambda x, ch: f"(CASE WHEN strpos({x}, '{ch}') = 0 THEN 0 ELSE length({x}) - strpos(reverse({x}), '{ch}') + 1 END)"
    cnt = lambda x, ch: f"(length({x}) - length(replace({x}, '{ch}', '')))"
    keep = lambda x, ch: f"(split_part({x}, '{ch}', 1) || '{ch}' || replace(substr({x}, strpos({x}, '{ch}') + 1), '{ch}', ''))"
    r = f"""(CASE WHEN strpos({s}, ',') > 0 AND strpos({s}, '.') > 0 AND {last(s, ',')} > {last(s, '.')} THEN replace(replace({s}, '.', ''), ',', '.')
      WHEN strpos({s}, ',') > 0 AND strpos({s}, '.') > 0 THEN replace({s}, ',', '')
      WHEN {cnt(s, '.')} > 1 AND strpos({s}, ',') = 0 THEN {keep(s, '.')}
      WHEN {cnt(s, ',')} > 1 AND strpos({s}, '.') = 0 THEN {keep(s, ',')}
      ELSE replace({s}, ',', '.') END)"""
    return f"(CASE WHEN regexp_full_match({r}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({r} AS DOUBLE) END)"


@register(
    "parse_locale_numbers",
    "P3",
    f"WITH t AS (SELECT event_id, {_LOCALE_TEXT_SQL} AS text FROM events) SELECT event_id, text, {O.r6(_sql_locale_parse('text'))} AS parsed FROM t",
)
def q_parse_locale_numbers(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    t = ev.select("event_id", _locale_text(ev).alias("text"))
    return t.select("event_id", "text", r6(PZ.locale_number(F.col("text"))).alias("parsed"))


_BAND_TXT_SQL = """CASE event_id % 4
  WHEN 0 THEN lpad(CAST(CAST(floor(value) AS BIGINT) % 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || '.123.456.789'
  WHEN 1 THEN CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR) || '.345.678.901.234'
  WHEN 2 THEN ''
  ELSE lpad(CAST(CAST(floor(value) AS BIGINT) % 100 AS VARCHAR), 2, '0') || '.345' END"""


@register(
    "parse_frequency_bands",
    "P4 P5",
    f"""WITH t AS (SELECT event_id, {_BAND_TXT_SQL} AS text FROM events),
v AS (SELECT event_id, text, coalesce(regexp_full_match(trim(text), '[0-9]{{2}}(\\.[0-9]{{3}}){{4}}'), false) AS valid FROM t)
SELECT event_id, text, CASE WHEN valid THEN {O.r6("TRY_CAST(split_part(trim(text), '.', 1) || '.' || replace(substr(trim(text), 4), '.', '') AS DOUBLE)")} END AS band_value,
       valid AS band_valid, NOT valid AS freq_format_error FROM v""",
)
def q_parse_frequency_bands(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    ip = F.floor("value").cast("long")
    k = F.col("event_id") % 4
    text = (
        F.when(k == 0, F.concat(F.lpad((ip % 100).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit(".123.456.789")))
        .when(k == 1, F.concat((ip % 10).cast("string"), F.lit(".345.678.901.234")))
        .when(k == 2, F.lit(""))
        .otherwise(F.concat(F.lpad((ip % 100).cast("string"), 2, "0"), F.lit(".345")))
    )
    t = ev.select("event_id", text.alias("text"))
    v, ok = PZ.frequency_band(F.col("text"))
    return t.select("event_id", "text", r6(v).alias("band_value"), ok.alias("band_valid"), (~ok).alias("freq_format_error"))


@register(
    "parse_timestamps",
    "P1 P2",
    """WITH t AS (SELECT event_id, ts, CASE event_id % 3
    WHEN 0 THEN strftime(ts, '%d.%m.%Y %H:%M')
    WHEN 1 THEN CAST(day(ts) AS VARCHAR) || '.' || CAST(month(ts) AS VARCHAR) || '.' || CAST(year(ts) AS VARCHAR) || ' ' || CAST(hour(ts) AS VARCHAR) || ':' || CAST(minute(ts) AS VARCHAR)
    ELSE 'n/a' END AS text FROM events)
SELECT event_id, text, CASE WHEN event_id % 3 < 2 THEN date_trunc('minute', ts) END AS parsed FROM t""",
)
def q_parse_timestamps(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    k = F.col("event_id") % 3
    unpadded = F.concat_ws(".", F.dayofmonth("ts").cast("string"), F.month("ts").cast("string"), F.year("ts").cast("string"))
    unpadded = F.concat(unpadded, F.lit(" "), F.hour("ts").cast("string"), F.lit(":"), F.minute("ts").cast("string"))
    text = F.when(k == 0, F.date_format("ts", "dd.MM.yyyy HH:mm")).when(k == 1, unpadded).otherwise(F.lit("n/a"))
    t = ev.select("event_id", text.alias("text"))
    return t.select("event_id", "text", PZ.parse_timestamp(F.col("text"), OPTS.csv.timestamp_format).alias("parsed"))


def _csv_fixture_dir(spark: SparkSession, sf_dir: str) -> str:
    """Write the series as a German-locale ``;`` CSV (one file per asset and day,
    rows in time order) under the shared checkpoint folder, once per session."""
    import uuid

    from sonolith.session import ensure_checkpoint_dir

    def build():
        root = ensure_checkpoint_dir(spark).rstrip("/")
        path = f"{root}/csv-fixture-{uuid.uuid4().hex}"
        m = series(spark, sf_dir)
        bad_ts = (F.col("row_id") % 50) == 13
        band_txt = {
            b: F.when(
                F.col(b).isNotNull() & (F.col(b) >= 10) & (F.col(b) < 100),
                F.concat(F.floor(F.col(b)).cast("long").cast("string"), F.lit("."),
                         F.regexp_replace(F.substring(F.format_string("%.12f", F.col(b) - F.floor(F.col(b))), 3, 12), "(\\d{3})(?=\\d)", "$1.")),
            ).otherwise(F.lit("ungültig"))
            for b in ("low_freq_avg", "mid_freq_avg", "high_freq_avg")
        }
        out = m.select(
            "asset_id", "date",
            F.col("id").cast("long").cast("string").alias("id"),
            *[F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")).alias(c) for c in ("avg_decibel", "peak_decibel", "min_decibel", "measurement_duration", "samples_count")],
            *[band_txt[b].alias(b) for b in band_txt],
            F.when(bad_ts, F.lit("n/a")).otherwise(F.date_format("timestamp", "dd.MM.yyyy HH:mm")).alias("created_at"),
            "timestamp",
        )
        (
            out.repartition("asset_id", "date")
            .sortWithinPartitions("asset_id", "date", "timestamp")
            .drop("timestamp")
            .write.option("header", True).option("sep", ";")
            .partitionBy("asset_id", "date")
            .csv(path)
        )
        return path

    return _memo(spark, ("csv", sf_dir), build)


_CSV_OPTS = OPTS.with_(csv=OPTS.csv.__class__(separator=";", encoding="utf-8"))


@register(
    "csv_ingest",
    "S1 S2 S3 S4 W0 W1 P1 P3 P4 P5",
    SER()
    + f""" SELECT asset_id, date, row_number() OVER (PARTITION BY asset_id, date ORDER BY timestamp) - 1 AS file_pos,
       CASE WHEN row_id % 50 = 13 THEN NULL ELSE timestamp END AS timestamp,
       {O.r6('avg_decibel')} AS avg_decibel, {O.r6('samples_count')} AS samples_count,
       {O.r6("CASE WHEN low_freq_avg >= 10 AND low_freq_avg < 100 THEN TRY_CAST(CAST(CAST(floor(low_freq_avg) AS BIGINT) AS VARCHAR) || '.' || substr(printf('%.12f', low_freq_avg - floor(low_freq_avg)), 3, 12) AS DOUBLE) END")} AS low_freq_avg,
       NOT (coalesce(low_freq_avg >= 10 AND low_freq_avg < 100, false) AND coalesce(mid_freq_avg >= 10 AND mid_freq_avg < 100, false)
            AND coalesce(high_freq_avg >= 10 AND high_freq_avg < 100, false)) AS freq_format_error
FROM series""",
)
def q_csv_ingest(spark, sf_dir):
    path = _csv_fixture_dir(spark, sf_dir)
    df = CI.load_measurement_csv(spark, path, _CSV_OPTS, asset_col="asset_id")
    w = __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("asset_id", "date").orderBy("row_id")
    return df.select(
        "asset_id", F.col("date").cast("date").alias("date"), (F.row_number().over(w) - 1).cast("long").alias("file_pos"), "timestamp",
        r6("avg_decibel").alias("avg_decibel"), r6("samples_count").alias("samples_count"), r6("low_freq_avg").alias("low_freq_avg"),
        "freq_format_error",
    )


@register(
    "load_quality_report",
    "S5",
    SER()
    + """ SELECT asset_id, count(*) AS rows, count(*) FILTER (WHERE row_id % 50 = 13) AS invalid_timestamps,
       count(*) FILTER (WHERE NOT (coalesce(low_freq_avg >= 10 AND low_freq_avg < 100, false) AND coalesce(mid_freq_avg >= 10 AND mid_freq_avg < 100, false)
            AND coalesce(high_freq_avg >= 10 AND high_freq_avg < 100, false))) AS invalid_frequency_rows
FROM series GROUP BY 1""",
)
def q_load_quality_report(spark, sf_dir):
    df = CI.load_measurement_csv(spark, _csv_fixture_dir(spark, sf_dir), _CSV_OPTS, asset_col="asset_id")
    return CI.load_quality_report(df)


# ---------------------------------------------------------------- step 7: labels and notes
import datetime as _dt  # noqa: E402

from sonolith.operators import feedback as FB  # noqa: E402

_T_CREATED = _dt.datetime(2024, 2, 1, 8, 0, 0)
_T_UPDATED = _dt.datetime(2024, 2, 2, 9, 30, 0)


def _label_events(spark, sf_dir) -> DataFrame:
    return stage1(spark, sf_dir).events.where(F.col("severity") == "ANOMALY")


def _hours_col() -> Column:
    k = F.col("event_id") % 3
    return F.when(k == 0, F.lit(None).cast("int")).when(k == 1, F.lit(12)).otherwise(F.lit(48))


def _repaired_col() -> Column:
    return F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(
        F.col("end_timestamp") + F.make_dt_interval(F.lit(0), F.lit(1))
    )


def base_labels(spark, sf_dir) -> DataFrame:
    ev = _label_events(spark, sf_dir)
    return FB.labels_from_events(ev, F.lit("Lagerschaden"), _hours_col(), _T_CREATED, repaired_at=_repaired_col())


_MIN = "date_trunc('minute', {x})"
_ISO = "strftime({x}, '%Y-%m-%dT%H:%M:%S')"
_LABEL_PARTS = (
    O.event_ctes("s1", "stage1", "ev1", OPTS.expected_interval_minutes, O.STAGE1_EVENT_AGGS),
    f"""lab0 AS (SELECT asset_id, event_id, {_MIN.format(x='start_timestamp')} AS es, {_MIN.format(x='end_timestamp')} AS ee,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE {_MIN.format(x='end_timestamp + INTERVAL 1 HOUR')} END AS rep,
       CASE event_id % 3 WHEN 0 THEN 24 WHEN 1 THEN 12 ELSE 48 END AS hours
     FROM ev1 WHERE severity = 'ANOMALY')""",
    f"""labels AS (SELECT asset_id, event_id,
       'LBL-' || upper(substr(md5(concat_ws('|', asset_id, 'Stage 1', {_ISO.format(x='es')}, {_ISO.format(x='ee')})), 1, 10)) AS label_id,
       'Stage 1' AS source_stage, es AS event_start, ee AS event_end, rep AS repaired_at, hours AS pre_failure_hours,
       coalesce(rep, ee) - hours * INTERVAL 1 HOUR AS learning_window_start, coalesce(rep, ee) AS learning_window_end,
       'Lagerschaden' AS defect_type
     FROM lab0)""",
)
_LABEL_SQL_CTES = S1(*_LABEL_PARTS)
_LW_COLS = ["asset_id", "label_id", "source_stage", "event_start", "event_end", "repaired_at", "pre_failure_hours",
            "learning_window_start", "learning_window_end", "defect_type"]


@register("label_windows", "L1 L5 P13", _LABEL_SQL_CTES + " SELECT " + ", ".join(_LW_COLS) + " FROM labels")
def q_label_windows(spark, sf_dir):
    return FB.normalize_labels(base_labels(spark, sf_dir)).select(*_LW_COLS)


@register(
    "label_upsert",
    "L2 L5",
    S1(
        *_LABEL_PARTS,
        O.stage2_ctes(OPTS),
        O.event_ctes("s2", "stage2", "ev2", OPTS.expected_interval_minutes, ", max(multivariate_score) AS multivariate_score"),
    )
    + f""", upd AS (SELECT asset_id, label_id, source_stage, 'Unwucht' AS defect_type, event_start, event_end FROM labels WHERE event_id % 2 = 0),
ev2s AS (SELECT asset_id, start_timestamp, end_timestamp FROM ev2),
new AS (SELECT asset_id,
           'LBL-' || upper(substr(md5(concat_ws('|', asset_id, 'Stage 2', {_ISO.format(x=_MIN.format(x='start_timestamp'))}, {_ISO.format(x=_MIN.format(x='end_timestamp'))})), 1, 10)) AS label_id,
           'Stage 2' AS source_stage, 'Sensorfehler' AS defect_type, {_MIN.format(x='start_timestamp')} AS event_start, {_MIN.format(x='end_timestamp')} AS event_end FROM ev2s)
SELECT asset_id, label_id, source_stage, defect_type, event_start, event_end FROM labels WHERE label_id NOT IN (SELECT label_id FROM upd UNION SELECT label_id FROM new)
UNION ALL SELECT * FROM upd UNION ALL SELECT * FROM new""",
)
def q_label_upsert(spark, sf_dir):
    base = base_labels(spark, sf_dir)
    ev = _label_events(spark, sf_dir)
    changed = FB.labels_from_events(ev.where(F.col("event_id") % 2 == 0), F.lit("Unwucht"), _hours_col(), _T_UPDATED, repaired_at=_repaired_col())
    new = FB.labels_from_events(stage2(spark, sf_dir).events, F.lit("Sensorfehler"), F.lit(24), _T_UPDATED)
    out = FB.normalize_labels(FB.upsert(base, changed.unionByName(new), FB.LABEL_KEY, "created_at"))
    return out.select("asset_id", "label_id", "source_stage", "defect_type", "event_start", "event_end")


@register("label_delete", "J9", _LABEL_SQL_CTES + " SELECT asset_id, label_id FROM labels WHERE event_id % 5 <> 0")
def q_label_delete(spark, sf_dir):
    base = base_labels(spark, sf_dir)
    ev = _label_events(spark, sf_dir).where(F.col("event_id") % 5 == 0)
    gone = FB.labels_from_events(ev, F.lit("x"), F.lit(24), _T_UPDATED, repaired_at=_repaired_col())
    return FB.delete_by_key(base, gone, FB.LABEL_KEY).select("asset_id", "label_id")


_SIG = "'Stage 1|' || strftime(start_timestamp, '%Y%m%dT%H%M%S') || '|' || strftime(end_timestamp, '%Y%m%dT%H%M%S')"


@register(
    "note_lookup",
    "P11 J8 L3 L4",
    S1(O.event_ctes("s1", "stage1", "ev1", OPTS.expected_interval_minutes, O.STAGE1_EVENT_AGGS))
    + f""" SELECT asset_id, event_id, {_SIG} AS event_signature,
       CASE WHEN event_id % 6 = 0 THEN 'Fehlalarm' WHEN event_id % 3 = 0 THEN 'bestätigt' ELSE 'manuell geprüft' END AS verdict,
       CASE WHEN event_id % 6 = 0 THEN 'Sensor getauscht' WHEN event_id % 3 = 0 THEN 'Lager prüfen' ELSE '' END AS note
FROM ev1""",
)
def q_note_lookup(spark, sf_dir):
    ev = stage1(spark, sf_dir).events
    base = FB.notes_from_events(ev.where(F.col("event_id") % 3 == 0), F.lit("bestätigt"), F.lit("Lager prüfen"), F.lit(_T_CREATED.isoformat()))
    upd = FB.notes_from_events(ev.where(F.col("event_id") % 6 == 0), F.lit("Fehlalarm"), F.lit("Sensor getauscht"), F.lit(_T_UPDATED.isoformat()))
    notes = FB.normalize_notes(FB.upsert(base, upd, FB.NOTE_KEY, "updated_at"))
    return FB.note_lookup(ev, notes).select("asset_id", "event_id", "event_signature", "verdict", "note")


@register(
    "labelled_rows",
    "J5 L6",
    _LABEL_SQL_CTES
    + f""", nx AS (SELECT *, lead(avg_decibel) OVER w AS na, lead(peak_minus_min) OVER w AS np, lead(segment_id) OVER w AS ns
        FROM series WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp, row_id))
SELECT s.asset_id, s.row_id, l.label_id,
       {O.r6('CASE WHEN s.ns = s.segment_id THEN s.na END')} AS next_avg_decibel,
       {O.r6('CASE WHEN s.ns = s.segment_id THEN s.np END')} AS next_peak_minus_min
FROM nx s JOIN labels l ON s.asset_id = l.asset_id AND s.timestamp BETWEEN l.learning_window_start AND l.learning_window_end""",
)
def q_labelled_rows(spark, sf_dir):
    labels = FB.normalize_labels(base_labels(spark, sf_dir))
    r = FB.labelled_rows(series(spark, sf_dir), labels)
    return r.select("asset_id", "row_id", "label_id", r6("next_avg_decibel").alias("next_avg_decibel"), r6("next_peak_minus_min").alias("next_peak_minus_min"))


@register(
    "label_overlay",
    "J5",
    _LABEL_SQL_CTES
    + """, b AS (SELECT asset_id, max(timestamp) - INTERVAL 7 DAY AS ws, max(timestamp) AS we FROM series WHERE timestamp IS NOT NULL GROUP BY 1)
SELECT l.asset_id, l.label_id, l.learning_window_end >= b.ws AND l.learning_window_start <= b.we AS window_visible,
       coalesce(l.repaired_at >= b.ws AND l.repaired_at <= b.we, false) AS repair_visible
FROM labels l JOIN b USING (asset_id)""",
)
def q_label_overlay(spark, sf_dir):
    labels = FB.normalize_labels(base_labels(spark, sf_dir))
    b = X.timeframe_bounds(series(spark, sf_dir), "Letzte 7 Tage")
    j = labels.join(b, "asset_id")
    out = FB.windows_in_range(j, F.col("window_start"), F.col("window_end"))
    return out.select("asset_id", "label_id", "window_visible", "repair_visible")


# ---------------------------------------------------------------- overview and long event lists
def _overview(spark, sf_dir, s3) -> DataFrame:
    s1, s2 = stage1(spark, sf_dir), stage2(spark, sf_dir)
    ctx = {
        "stage1": E.alert_context(s1.rows, s1.events, "stage1"),
        "stage2": E.alert_context(s2.rows, s2.events, "stage2"),
        "stage3": E.alert_context(s3.rows, s3.events, "stage3"),
    }
    return X.overview_counts(series(spark, sf_dir), ctx)


@register("overview_counts", "A20 A19", None)
def q_overview_counts(spark, sf_dir):
    return _overview(spark, sf_dir, stage3(spark, sf_dir))


@register(
    "stage3_logic_overview_counts",
    "A20 A19",
    S1(
        O.event_ctes("s1", "stage1", "ev1", OPTS.expected_interval_minutes, O.STAGE1_EVENT_AGGS),
        O.stage2_ctes(OPTS, src="s1"),
        O.event_ctes("s2", "stage2", "ev2", OPTS.expected_interval_minutes, ", max(multivariate_score) AS multivariate_score"),
        O.stage3_train_ctes("s1"),
        O.lof_ctes(OPTS.stage3.lof_neighbors),
        O.stage3_logic_ctes(OPTS),
        O.event_ctes("s3", "stage3", "ev3", OPTS.expected_interval_minutes, O.STAGE3_EVENT_AGGS),
    )
    + """ SELECT b.asset_id, b.rows, b.gaps, b.reduced_quality_rows,
       a1.n AS stage1_alert_rows, coalesce(e1.n, 0) AS stage1_events,
       a2.n AS stage2_alert_rows, coalesce(e2.n, 0) AS stage2_events,
       a3.n AS stage3_alert_rows, coalesce(e3.n, 0) AS stage3_events
FROM (SELECT asset_id, count(*) AS rows, count(*) FILTER (WHERE gap_flag) AS gaps,
             count(*) FILTER (WHERE quality_flag = 'reduced_quality') AS reduced_quality_rows FROM series GROUP BY 1) b
JOIN (SELECT asset_id, count(*) FILTER (WHERE stage1_severity IN ('WARNING','ANOMALY')) AS n FROM s1 GROUP BY 1) a1 USING (asset_id)
LEFT JOIN (SELECT asset_id, count(*) AS n FROM ev1 GROUP BY 1) e1 USING (asset_id)
JOIN (SELECT asset_id, count(*) FILTER (WHERE stage2_severity IN ('WARNING','ANOMALY')) AS n FROM s2 GROUP BY 1) a2 USING (asset_id)
LEFT JOIN (SELECT asset_id, count(*) AS n FROM ev2 GROUP BY 1) e2 USING (asset_id)
JOIN (SELECT asset_id, count(*) FILTER (WHERE stage3_severity IN ('WARNING','ANOMALY')) AS n FROM s3 GROUP BY 1) a3 USING (asset_id)
LEFT JOIN (SELECT asset_id, count(*) AS n FROM ev3 GROUP BY 1) e3 USING (asset_id)""",
)
def q_logic_overview_counts(spark, sf_dir):
    return _overview(spark, sf_dir, stage3_standin(spark, sf_dir))


_LATEST_SQL = S1(
    O.event_ctes("s1", "stage1", "ev1", OPTS.expected_interval_minutes, O.STAGE1_EVENT_AGGS),
    O.stage2_ctes(OPTS, src="s1"),
    O.stage3_train_ctes("s1"),
    O.lof_ctes(OPTS.stage3.lof_neighbors),
    O.stage3_logic_ctes(OPTS),
    O.event_ctes("s2", "stage2", "ev2", OPTS.expected_interval_minutes, ", max(multivariate_score) AS multivariate_score"),
    O.event_ctes("s3", "stage3", "ev3", OPTS.expected_interval_minutes, O.STAGE3_EVENT_AGGS),
    """all_ev AS (
  SELECT asset_id, event_id, start_timestamp, 'Stage 1' AS stage, 1 AS priority FROM ev1
  UNION ALL SELECT asset_id, event_id, start_timestamp, 'Stage 2', 2 FROM ev2
  UNION ALL SELECT asset_id, event_id, start_timestamp, 'Stage 3', 3 FROM ev3)""",
)
_LATEST_8_SQL = """ SELECT * FROM (SELECT asset_id, event_id, start_timestamp, stage, priority,
       row_number() OVER (PARTITION BY asset_id ORDER BY start_timestamp DESC NULLS LAST, priority DESC, event_id) AS rank
FROM all_ev) WHERE rank <= 8"""
_LATEST_K_SQL = """ SELECT * FROM (SELECT asset_id, event_id, start_timestamp, stage,
       row_number() OVER (PARTITION BY asset_id ORDER BY start_timestamp DESC NULLS LAST, event_id, stage) AS rank
FROM all_ev) WHERE rank <= {k}"""


def _latest(spark, sf_dir, s3, k: int, by_priority: bool) -> DataFrame:
    u = X.union_events([stage1(spark, sf_dir).events, stage2(spark, sf_dir).events, s3.events])
    cols = ["asset_id", "event_id", "start_timestamp", "stage", *["priority"] * by_priority, "rank"]
    return X.latest_events(u, k, by_priority=by_priority).select(*cols)


@register("latest_events", "T1 T2", None)
def q_latest_events(spark, sf_dir):
    return _latest(spark, sf_dir, stage3(spark, sf_dir), 8, True)


@register("latest_300", "T1 T3", None)
def q_latest_300(spark, sf_dir):
    return _latest(spark, sf_dir, stage3(spark, sf_dir), 300, False)


@register("stage3_logic_latest_events", "T1 T2", _LATEST_SQL + _LATEST_8_SQL)
def q_logic_latest_events(spark, sf_dir):
    return _latest(spark, sf_dir, stage3_standin(spark, sf_dir), 8, True)


@register("stage3_logic_latest_300", "T1 T3", _LATEST_SQL + _LATEST_K_SQL.format(k=300))
def q_logic_latest_300(spark, sf_dir):
    return _latest(spark, sf_dir, stage3_standin(spark, sf_dir), 300, False)


@register("stage3_logic_latest_20", "T1 T3", _LATEST_SQL + _LATEST_K_SQL.format(k=20))
def q_logic_latest_20(spark, sf_dir):
    """The same list with a limit that is reached."""
    return _latest(spark, sf_dir, stage3_standin(spark, sf_dir), 20, False)


@register(
    "stage1_events_by_start",
    "T4",
    S1(O.event_ctes("s1", "stage1", "ev1", OPTS.expected_interval_minutes, O.STAGE1_EVENT_AGGS))
    + " SELECT asset_id, event_id, start_timestamp, row_number() OVER (PARTITION BY asset_id ORDER BY start_timestamp NULLS LAST, event_id) AS rank FROM ev1",
)
def q_stage1_events_by_start(spark, sf_dir):
    return X.ranked(stage1(spark, sf_dir).events, [F.col("start_timestamp").asc_nulls_last(), F.col("event_id")]).select("asset_id", "event_id", "start_timestamp", "rank")


@register(
    "labels_newest_first",
    "T4 L1",
    _LABEL_SQL_CTES + " SELECT asset_id, label_id, event_start, row_number() OVER (PARTITION BY asset_id ORDER BY event_start DESC NULLS LAST, label_id) AS rank FROM labels",
)
def q_labels_newest_first(spark, sf_dir):
    labels = FB.normalize_labels(base_labels(spark, sf_dir))
    return X.ranked(labels, [F.col("event_start").desc_nulls_last(), F.col("label_id")]).select("asset_id", "label_id", "event_start", "rank")


# ---------------------------------------------------------------- file sources and sinks
from sonolith.sources import feedback_io as FIO  # noqa: E402


def _store_path(spark: SparkSession, name: str) -> str:
    import uuid

    from sonolith.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("label_store_round_trip", "S6 S8 L1", _LABEL_SQL_CTES + " SELECT " + ", ".join(_LW_COLS) + " FROM labels")
def q_label_store_round_trip(spark, sf_dir):
    """Labels written as a new version directory, read back and normalised."""
    path = _store_path(spark, "labels")
    labels = base_labels(spark, sf_dir)
    FIO.write_records(labels, f"{path}/v1")
    back = FIO.read_records(spark, f"{path}/v1", ("asset_id", *FIO.LABEL_FIELDS))
    return FB.normalize_labels(back).select(*_LW_COLS)


@register(
    "note_store_round_trip",
    "S7 S8 L3 L4 J8",
    REGISTRY["note_lookup"].sql,
)
def q_note_store_round_trip(spark, sf_dir):
    ev = stage1(spark, sf_dir).events
    path = _store_path(spark, "notes")
    base = FB.notes_from_events(ev.where(F.col("event_id") % 3 == 0), F.lit("bestätigt"), F.lit("Lager prüfen"), F.lit(_T_CREATED.isoformat()))
    FIO.write_records(base, f"{path}/v1")
    upd = FB.notes_from_events(ev.where(F.col("event_id") % 6 == 0), F.lit("Fehlalarm"), F.lit("Sensor getauscht"), F.lit(_T_UPDATED.isoformat()))
    v1 = FIO.read_records(spark, f"{path}/v1", ("asset_id", *FIO.NOTE_FIELDS))
    FIO.write_records(FB.upsert(v1, upd, FB.NOTE_KEY, "updated_at"), f"{path}/v2")
    notes = FB.normalize_notes(FIO.read_records(spark, f"{path}/v2", ("asset_id", *FIO.NOTE_FIELDS)))
    return FB.note_lookup(ev, notes).select("asset_id", "event_id", "event_signature", "verdict", "note")


@register("event_window_export", "S9 J3", REGISTRY["event_windows"].sql)
def q_event_window_export(spark, sf_dir):
    w = X.event_windows(series(spark, sf_dir), stage1(spark, sf_dir).events, OPTS.inspection_window_hours, event_cols=["event_id"])
    path = _store_path(spark, "export")
    X.export_csv(w.select("asset_id", "event_id", "row_id", "timestamp", "avg_decibel"), path)
    back = spark.read.option("header", True).schema(
        "asset_id string, event_id long, row_id long, timestamp timestamp_ntz, avg_decibel double"
    ).csv(path)
    return back.select("asset_id", "event_id", "row_id", "timestamp", r6("avg_decibel").alias("avg_decibel"))


def _array_files(spark: SparkSession, records: DataFrame, by: str) -> str:
    """The records as JSON arrays in four files, with a byte-order mark, elements that are no
    objects, and beside them a file that is no list and one that breaks off."""
    path = _store_path(spark, "arrays")
    lines = records.select(F.pmod(F.xxhash64(by), F.lit(4)).cast("int").alias("shard"), F.concat(F.to_json(F.struct(*records.columns)), F.lit(",")).alias("value"))
    frame = [(k, o, t) for k in range(4) for o, t in ((0, '\ufeff [17, "a } \\" ] {", [{"label_id": "nested"}],'), (2, 'null, {}, "end"]'))]
    frame += [(4, 0, '{"label_id": "no list", "event_signature": "no list"}'), (5, 0, '[{"label_id": "cut", "event_signature": "cut"}, {"label_id"')]
    rows = spark.createDataFrame(frame, "shard int, ord int, value string").unionByName(lines.withColumn("ord", F.lit(1)))
    rows.repartition("shard").sortWithinPartitions("shard", "ord").drop("ord").write.partitionBy("shard").text(path)
    return path


@register("label_array_files", "S6 L1", REGISTRY["label_store_round_trip"].sql)
def q_label_array_files(spark, sf_dir):
    """Labels read from JSON-array files, whole files that are no lists left out."""
    back = FIO.read_array_documents(spark, _array_files(spark, base_labels(spark, sf_dir), "label_id"), ("asset_id", *FIO.LABEL_FIELDS))
    return FB.normalize_labels(back.where(F.col("label_id").isNotNull())).select(*_LW_COLS)


@register(
    "note_array_files_newest_first",
    "S7 T4 L3",
    S1(O.event_ctes("s1", "stage1", "ev1", OPTS.expected_interval_minutes, O.STAGE1_EVENT_AGGS))
    + f""", nn AS (SELECT asset_id, {_SIG} AS event_signature, CASE WHEN event_id % 6 = 0 THEN TIMESTAMP '{_T_UPDATED:%Y-%m-%d %H:%M:%S}' ELSE TIMESTAMP '{_T_CREATED:%Y-%m-%d %H:%M:%S}' END AS updated_at
       FROM ev1 WHERE event_id % 3 = 0)
SELECT asset_id, event_signature, updated_at, row_number() OVER (PARTITION BY asset_id ORDER BY updated_at DESC NULLS LAST, event_signature) AS rank FROM nn""",
)
def q_note_array_files_newest_first(spark, sf_dir):
    """Notes read from JSON-array files, newest first."""
    ev = stage1(spark, sf_dir).events.where(F.col("event_id") % 3 == 0)
    at = F.when(F.col("event_id") % 6 == 0, F.lit(_T_UPDATED.isoformat())).otherwise(F.lit(_T_CREATED.isoformat()))
    path = _array_files(spark, FB.notes_from_events(ev, F.lit("bestätigt"), F.lit("Lager } prüfen \"[\" \\"), at), "event_signature")
    back = FIO.read_array_documents(spark, path, ("asset_id", *FIO.NOTE_FIELDS))
    notes = FB.normalize_notes(back.where(F.col("event_signature").isNotNull()))
    return X.ranked(notes, [F.col("updated_at").desc_nulls_last(), F.col("event_signature")]).select("asset_id", "event_signature", "updated_at", "rank")


@register(
    "csv_day_first",
    "S2 S4 P2",
    SER()
    + f""" SELECT asset_id, count(*) AS rows, count(timestamp) AS parsed, min(date_trunc('minute', timestamp)) AS first_ts, max(date_trunc('minute', timestamp)) AS last_ts,
       {O.r6('avg(avg_decibel)')} AS mean_level, 'id,avg_decibel,peak_decibel,min_decibel,measurement_duration,samples_count' AS numeric_columns
FROM series GROUP BY 1""",
)
def q_csv_day_first(spark, sf_dir):
    """External column names, and a time format in which no row parses: the day-first patterns take over."""
    path = _store_path(spark, "day-first")
    names = {c: f"Spalte {c}" for c in CI.NUMBER_COLUMNS}
    m = series(spark, sf_dir).withColumn("id", F.col("id").cast("long"))
    text = m.select("asset_id", F.date_format("timestamp", "dd/MM/yyyy HH:mm").alias("Zeit"), *[F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")).alias(names[c]) for c in names])
    text.write.option("header", True).option("sep", ";").csv(path)
    opts = OPTS.with_(csv=OPTS.csv.__class__(separator=";", encoding="utf-8", columns=(*names.items(), ("created_at", "Zeit"))))
    df = CI.load_measurement_csv(spark, path, opts, asset_col="asset_id")
    numeric = [c for c in CI.numeric_columns(df, drop=("row_id",)) if c in names]
    return df.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count("timestamp").alias("parsed"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        r6(F.avg("avg_decibel")).alias("mean_level"), F.lit(",".join(sorted(numeric, key=list(names).index))).alias("numeric_columns"),
    )


@register(
    "stage2_alerts",
    "P14",
    SER(O.stage2_ctes(OPTS))
    + f" SELECT asset_id, timestamp, 'Stage 2' AS stage, stage2_severity AS severity, stage2_message AS message, {O.r6('multivariate_score')} AS multivariate_score,"
    " quality_flag, near_gap_flag FROM s2 WHERE stage2_severity IN ('WARNING', 'ANOMALY')",
)
def q_stage2_alerts(spark, sf_dir):
    a = E.extract_alerts(stage2(spark, sf_dir).rows, "stage2", ["multivariate_score", "quality_flag", "near_gap_flag"])
    return a.withColumn("multivariate_score", r6("multivariate_score"))
