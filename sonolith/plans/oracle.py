"""DuckDB SQL for the oracle check: the same semantics written as plain SQL.

These strings are independent re-statements used only to verify the Spark
operators (the driver runs them on the same parquet tables).
"""

from __future__ import annotations

from sonolith.options import Options


def percentile(x: str, p: float) -> str:
    """The p-quantile with the interpolation written as (1 - f) * low + f * high, so that the last digit agrees too."""
    h = f"{p}::DOUBLE * (len(l) - 1)"
    return (
        f"list_transform([list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))], lambda l: "
        f"CASE WHEN ceil({h}) = floor({h}) THEN l[floor({h})::BIGINT + 1] "
        f"ELSE (ceil({h}) - {h}) * l[floor({h})::BIGINT + 1] + ({h} - floor({h})) * l[ceil({h})::BIGINT + 1] END)[1]"
    )


def r6(expr: str) -> str:
    """Round half up to 1e-6 with the same IEEE operations Spark uses (``F.floor``)."""
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6"


def series_ctes(opts: Options) -> str:
    """CTEs ``series`` (prepared measurement table) from ``events``."""
    thr = float(opts.gap_threshold_minutes)
    rq = opts.reduced_quality_min_samples
    return f"""
grp AS (
  SELECT event_type AS asset_id, date_trunc('hour', ts) AS timestamp,
         avg(value) AS avg_decibel, max(value) AS peak_decibel, min(value) AS min_decibel,
         CAST(count(*) AS DOUBLE) AS samples_count,
         quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3,
         date_diff('microsecond', min(ts), max(ts)) / 1e6 AS measurement_duration
  FROM events GROUP BY 1, 2),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp) - 1 AS row_id FROM grp),
banded AS (
  SELECT asset_id, timestamp, row_id, CAST(row_id AS DOUBLE) AS id, avg_decibel, peak_decibel, min_decibel,
         samples_count, measurement_duration,
         CASE WHEN row_id % 20 = 7 THEN NULL ELSE q1 END AS low_freq_avg,
         CASE WHEN row_id % 20 = 7 THEN NULL ELSE q2 END AS mid_freq_avg,
         CASE WHEN row_id % 20 = 7 THEN NULL ELSE q3 END AS high_freq_avg,
         (row_id % 20 = 7) AS freq_format_error
  FROM numbered),
lagged AS (
  SELECT *,
         date_diff('microsecond', lag(timestamp) OVER w, timestamp) / 6e7 AS delta_minutes,
         date_diff('microsecond', timestamp, lead(timestamp) OVER w) / 6e7 AS next_delta
  FROM banded WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp, row_id)),
gapped AS (
  SELECT *, coalesce(delta_minutes > {thr}, false) AS gap_flag FROM lagged),
series AS (
  SELECT *,
         CAST(sum(CAST(gap_flag AS BIGINT)) OVER (PARTITION BY asset_id ORDER BY timestamp, row_id
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment_id,
         row_number() OVER (PARTITION BY asset_id ORDER BY timestamp, row_id) - 1 AS seq_pos,
         gap_flag OR coalesce(next_delta > {thr}, false) AS near_gap_flag,
         CASE WHEN samples_count < {rq} THEN 'reduced_quality' ELSE 'normal' END AS quality_flag,
         CAST(hour(timestamp) AS INTEGER) AS hour_of_day,
         CAST(isodow(timestamp) - 1 AS INTEGER) AS weekday,
         CAST(timestamp AS DATE) AS date,
         peak_decibel - avg_decibel AS peak_minus_avg,
         avg_decibel - min_decibel AS avg_minus_min,
         peak_decibel - min_decibel AS peak_minus_min,
         CASE WHEN NOT freq_format_error THEN low_freq_avg / nullif(low_freq_avg + mid_freq_avg + high_freq_avg, 0) END AS low_share,
         CASE WHEN NOT freq_format_error THEN mid_freq_avg / nullif(low_freq_avg + mid_freq_avg + high_freq_avg, 0) END AS mid_share,
         CASE WHEN NOT freq_format_error THEN high_freq_avg / nullif(low_freq_avg + mid_freq_avg + high_freq_avg, 0) END AS high_share
  FROM gapped)"""


METRICS = ("avg_decibel", "peak_minus_avg", "peak_minus_min")


def baseline_ctes(name: str, group: list[str]) -> str:
    """CTE ``{name}``: count, median, MAD per slot."""
    g = ", ".join(["asset_id", *group])
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in [*group, *METRICS])
    meds = ", ".join(f"median({m}) AS {m}_baseline_median" for m in METRICS)
    mads = ", ".join(f"median(abs(s.{m} - b.{m}_baseline_median)) AS {m}_baseline_mad" for m in METRICS)
    on = " AND ".join(f"s.{c} = b.{c}" for c in ["asset_id", *group])
    gs = ", ".join(f"s.{c}" for c in ["asset_id", *group])
    sel = ", ".join(f"b.{m}_baseline_median, d.{m}_baseline_mad" for m in METRICS)
    on2 = " AND ".join(f"d.{c} = b.{c}" for c in ["asset_id", *group])
    bs = ", ".join(f"b.{c}" for c in ["asset_id", *group])
    return f"""
{name}_src AS (SELECT * FROM series WHERE {notnull}),
{name}_med AS (SELECT {g}, count(*) AS baseline_count, {meds} FROM {name}_src GROUP BY {g}),
{name}_mad AS (SELECT {gs}, {mads} FROM {name}_src s JOIN {name}_med b ON {on} GROUP BY {gs}),
{name} AS (SELECT {bs}, b.baseline_count, {sel} FROM {name}_med b JOIN {name}_mad d ON {on2})"""


def zrow_ctes(opts: Options, weekday_mode: bool) -> str:
    """CTE ``zrows``: series + chosen baseline + robust z."""
    mn = opts.baseline.weekday_hour_min_count
    mask = f"({'TRUE' if weekday_mode else 'FALSE'} AND coalesce(w.baseline_count, 0) >= {mn})"
    cols = []
    for m in METRICS:
        med = f"CASE WHEN {mask} THEN w.{m}_baseline_median ELSE h.{m}_baseline_median END"
        mad = f"CASE WHEN {mask} THEN w.{m}_baseline_mad ELSE h.{m}_baseline_mad END"
        cols.append(f"{med} AS {m}_baseline_median")
        cols.append(f"{mad} AS {m}_baseline_mad")
        cols.append(f"CASE WHEN {mask} THEN 'Stunde + Wochentag' ELSE 'Stunde' END AS {m}_baseline_scope")
        cols.append(f"(s.{m} - ({med})) / coalesce(nullif(1.4826 * ({mad}), 0), 1e-9) AS {m}_robust_z")
    return (
        baseline_ctes("bh", ["hour_of_day"])
        + ","
        + baseline_ctes("bw", ["weekday", "hour_of_day"])
        + f""",
zrows AS (
  SELECT s.*, {", ".join(cols)}
  FROM series s
  LEFT JOIN bh h ON s.asset_id = h.asset_id AND s.hour_of_day = h.hour_of_day
  LEFT JOIN bw w ON s.asset_id = w.asset_id AND s.weekday = w.weekday AND s.hour_of_day = w.hour_of_day)"""
    )


def stage1_ctes(opts: Options) -> str:
    """CTE ``s1``: rules, persistence per segment, severity, message."""
    t1, t2, n = opts.stage1.robust_z_threshold, opts.stage1.range_z_threshold, opts.stage1.persistence_windows
    return f"""
flags AS (
  SELECT *, coalesce(abs(avg_decibel_robust_z) >= {t1}, false) AS warn_avg,
            coalesce(abs(peak_minus_min_robust_z) >= {t2}, false) AS warn_range,
            coalesce(abs(peak_minus_avg_robust_z) >= {t2}, false) AS warn_spike
  FROM zrows),
flags2 AS (SELECT *, warn_avg OR warn_range OR warn_spike AS warning_now FROM flags),
pers AS (
  SELECT *, coalesce(sum(CAST(warning_now AS INTEGER)) OVER (
              PARTITION BY asset_id, segment_id ORDER BY timestamp, row_id
              ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) >= {n} AS persistent_warning
  FROM flags2),
s1 AS (
  SELECT *,
    CASE WHEN persistent_warning THEN 'ANOMALY' WHEN warning_now THEN 'WARNING' ELSE 'NORMAL' END AS stage1_severity,
    CASE WHEN persistent_warning AND warn_avg THEN 'Persistente Pegelabweichung gegen Baseline'
         WHEN persistent_warning AND warn_range THEN 'Persistente Spannweitenabweichung gegen Baseline'
         WHEN warning_now AND warn_spike THEN 'Kurzfristig erhöhte Peak-Dynamik'
         WHEN warning_now THEN 'Einzelwarnung gegen Baseline'
         ELSE 'Normalbereich' END AS stage1_message
  FROM pers)"""


def event_ctes(src: str, prefix: str, name: str, interval: float, extra_aggs: str = "") -> str:
    """CTEs ``{name}_rows`` (alert rows with event ids) and ``{name}`` (event rollup)."""
    return f"""
{name}_a AS (
  SELECT *, lag(row_id) OVER w AS p_row, lag(segment_id) OVER w AS p_seg
  FROM {src} WHERE {prefix}_severity IN ('WARNING', 'ANOMALY')
  WINDOW w AS (PARTITION BY asset_id ORDER BY timestamp, row_id)),
{name}_rows AS (
  SELECT *, CAST(sum(CASE WHEN p_row IS NULL OR row_id - p_row <> 1 OR segment_id <> p_seg THEN 1 ELSE 0 END)
              OVER (PARTITION BY asset_id ORDER BY timestamp, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS event_id,
         coalesce(quality_flag = 'reduced_quality', false) AS is_reduced_quality,
         coalesce(near_gap_flag, false) AS is_near_gap
  FROM {name}_a),
{name}_msgc AS (
  SELECT asset_id, event_id, {prefix}_message AS msg, count(*) AS cnt, min(seq_pos) AS first_pos
  FROM {name}_rows GROUP BY 1, 2, 3),
{name}_msg AS (
  SELECT asset_id, event_id, string_agg(msg, ' | ' ORDER BY cnt DESC, first_pos) AS message
  FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, event_id ORDER BY cnt DESC, first_pos) AS rk FROM {name}_msgc)
  WHERE rk <= 2 GROUP BY 1, 2),
{name}_agg AS (
  SELECT asset_id, event_id, min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp,
         count(*) AS row_count,
         max(CASE {prefix}_severity WHEN 'ANOMALY' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) AS sev_rank,
         count(*) FILTER (WHERE is_reduced_quality) AS reduced_quality_rows,
         count(*) FILTER (WHERE is_near_gap) AS near_gap_rows{extra_aggs}
  FROM {name}_rows GROUP BY 1, 2),
{name} AS (
  SELECT a.*, coalesce(m.message, '') AS message,
         CAST(a.row_count AS DOUBLE) * {float(interval)} AS duration_minutes,
         CASE a.sev_rank WHEN 2 THEN 'ANOMALY' WHEN 1 THEN 'WARNING' ELSE 'NORMAL' END AS severity,
         a.reduced_quality_rows > 0 AS has_reduced_quality, a.near_gap_rows > 0 AS has_near_gap
  FROM {name}_agg a LEFT JOIN {name}_msg m USING (asset_id, event_id))"""


STAGE1_EVENT_AGGS = """,
         count(*) FILTER (WHERE warn_avg) AS n_avg, count(*) FILTER (WHERE warn_spike) AS n_spike,
         count(*) FILTER (WHERE warn_range) AS n_range,
         max(abs(avg_decibel_robust_z)) AS avg_decibel_robust_z_max,
         max(abs(peak_minus_avg_robust_z)) AS peak_minus_avg_robust_z_max,
         max(abs(peak_minus_min_robust_z)) AS peak_minus_min_robust_z_max"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts)


STAGE2_FEATURES = ("avg_decibel", "peak_decibel", "min_decibel", "peak_minus_avg", "avg_minus_min", "peak_minus_min",
                   "low_share", "mid_share", "high_share")


def stage2_ctes(opts: Options, src: str = "series") -> str:
    """CTEs ``s2_stats`` and ``s2`` (Stage-2 annotated rows)."""
    fs = STAGE2_FEATURES
    n = opts.stage2.persistence_windows
    q = opts.stage2.distance_quantile
    complete = " AND ".join(f"{f} IS NOT NULL" for f in fs)
    stats = ", ".join(
        f"avg({f}) AS {f}_mean, CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END AS {f}_std" for f in fs
    )
    score = " + ".join(f"(({f} - {f}_mean) / {f}_std) * (({f} - {f}_mean) / {f}_std)" for f in fs)
    return f"""
s2_src AS (SELECT *, ({complete}) AS stage2_complete FROM {src}),
s2_stats AS (SELECT asset_id, count(*) AS n_rows, {stats} FROM s2_src WHERE stage2_complete GROUP BY 1),
s2_z AS (SELECT s.*, CASE WHEN stage2_complete THEN sqrt({score}) END AS multivariate_score
         FROM s2_src s LEFT JOIN s2_stats USING (asset_id)),
s2_thr AS (SELECT asset_id, quantile_cont(multivariate_score, {q}) AS stage2_threshold FROM s2_z
           WHERE multivariate_score IS NOT NULL GROUP BY 1),
s2_w AS (SELECT z.*, t.stage2_threshold, coalesce(z.stage2_complete AND z.multivariate_score >= t.stage2_threshold, false) AS stage2_warning_now
         FROM s2_z z LEFT JOIN s2_thr t USING (asset_id)),
s2_p AS (SELECT asset_id, row_id, coalesce(sum(CAST(stage2_warning_now AS INTEGER)) OVER (
           PARTITION BY asset_id, segment_id ORDER BY timestamp, row_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) >= {n}
           AS stage2_persistent_warning FROM s2_w WHERE stage2_complete),
s2 AS (SELECT w.*, coalesce(p.stage2_persistent_warning, false) AS stage2_persistent_warning,
         CASE WHEN coalesce(p.stage2_persistent_warning, false) THEN 'ANOMALY' WHEN w.stage2_warning_now THEN 'WARNING' ELSE 'NORMAL' END AS stage2_severity,
         CASE WHEN coalesce(p.stage2_persistent_warning, false) THEN 'Persistente multivariate Abweichung'
              WHEN w.stage2_warning_now THEN 'Multivariate Einzelwarnung' ELSE 'Normalbereich' END AS stage2_message
       FROM s2_w w LEFT JOIN s2_p p USING (asset_id, row_id))"""


def stage3_train_ctes(src: str = "series") -> str:
    """CTEs ``s3_plan`` (per-asset training plan) and ``s3_f`` (standardised valid rows)."""
    base = ("avg_decibel", "peak_minus_avg", "avg_minus_min", "peak_minus_min")
    shares = ("low_share", "mid_share", "high_share")
    base_ok = " AND ".join(["timestamp IS NOT NULL"] + [f"{c} IS NOT NULL" for c in base])
    cand_ok = base_ok + " AND " + " AND ".join(f"{c} IS NOT NULL" for c in shares)
    xs = [f"{c} AS x{i}" for i, c in enumerate(base)] + [
        f"CASE WHEN p.use_shares THEN {c} ELSE 0.0 END AS x{i + 4}" for i, c in enumerate(shares)
    ]
    stats = ", ".join(f"avg(x{i}) AS m{i}, CASE WHEN stddev_pop(x{i}) = 0 THEN 1.0 ELSE stddev_pop(x{i}) END AS sd{i}" for i in range(7))
    fs = ", ".join(f"(x{i} - m{i}) / sd{i} AS f{i}" for i in range(7))
    return f"""
s3_src AS (SELECT *, ({base_ok}) AS base_ok, ({cand_ok}) AS cand_ok,
              (NOT coalesce(quality_flag = 'reduced_quality', false) AND NOT coalesce(near_gap_flag, false)) AS quality_ok
           FROM {src}),
s3_cnt AS (SELECT asset_id, count(*) FILTER (WHERE cand_ok) AS n_cand, count(*) FILTER (WHERE base_ok) AS n_base,
              count(*) FILTER (WHERE cand_ok AND quality_ok) AS n_cand_q, count(*) FILTER (WHERE base_ok AND quality_ok) AS n_base_q
           FROM s3_src GROUP BY 1),
s3_plan0 AS (SELECT asset_id, n_cand >= 250 AS use_shares FROM s3_cnt),
s3_plan1 AS (SELECT c.asset_id, p.use_shares, CASE WHEN p.use_shares THEN 7 ELSE 4 END AS n_features,
               CASE WHEN p.use_shares THEN n_cand ELSE n_base END AS n_valid,
               CASE WHEN p.use_shares THEN n_cand_q ELSE n_base_q END AS n_q
             FROM s3_cnt c JOIN s3_plan0 p USING (asset_id)),
s3_plan AS (SELECT asset_id, use_shares, n_features, n_valid, n_q >= greatest(250, 5 * n_features) AS quality_filtered,
               CASE WHEN n_q >= greatest(250, 5 * n_features) THEN n_q ELSE n_valid END AS n_train, n_valid >= 10 AS scored
            FROM s3_plan1),
s3_rows AS (SELECT s.*, p.scored AND s.base_ok AND (NOT p.use_shares OR s.cand_ok) AS stage3_valid,
               p.scored AND s.base_ok AND (NOT p.use_shares OR s.cand_ok) AND (NOT p.quality_filtered OR s.quality_ok) AS stage3_train,
               {", ".join(xs)}
            FROM s3_src s JOIN s3_plan p USING (asset_id)),
s3_stats AS (SELECT asset_id, {stats} FROM s3_rows WHERE stage3_train GROUP BY 1),
s3_f AS (SELECT r.asset_id, r.row_id, r.stage3_train, {fs} FROM s3_rows r JOIN s3_stats USING (asset_id) WHERE r.stage3_valid)"""


def lof_ctes(neighbors: int) -> str:
    """CTE ``lof``: exact novelty LOF of every valid row (brute force, oracle only)."""
    dist = " + ".join(f"(q.f{i} - t.f{i}) * (q.f{i} - t.f{i})" for i in range(7))
    return f"""
lof_k AS (SELECT asset_id, greatest(2, least({neighbors}, greatest(2, n_train - 1))) AS k FROM s3_plan),
lof_pairs AS (SELECT q.asset_id, q.row_id AS q_row, q.stage3_train AS q_train, t.row_id AS o, sqrt({dist}) AS d
              FROM s3_f q JOIN s3_f t ON q.asset_id = t.asset_id AND t.stage3_train),
lof_tn AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY asset_id, q_row ORDER BY d, o) AS rn
                          FROM lof_pairs p WHERE q_train AND o <> q_row) x JOIN lof_k USING (asset_id) WHERE rn <= k),
lof_kd AS (SELECT asset_id, q_row AS o, d AS kdist FROM lof_tn WHERE rn = k),
lof_lrd AS (SELECT n.asset_id, n.q_row AS o, 1.0 / (avg(greatest(kd.kdist, n.d)) + 1e-10) AS lrd
            FROM lof_tn n JOIN lof_kd kd ON kd.asset_id = n.asset_id AND kd.o = n.o GROUP BY 1, 2),
lof_qn AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY asset_id, q_row ORDER BY d, o) AS rn FROM lof_pairs p) x
           JOIN lof_k USING (asset_id) WHERE rn <= k),
lof AS (SELECT n.asset_id, n.q_row AS row_id,
               avg(l.lrd) / (1.0 / (avg(greatest(kd.kdist, n.d)) + 1e-10)) AS lof
        FROM lof_qn n JOIN lof_kd kd ON kd.asset_id = n.asset_id AND kd.o = n.o
        JOIN lof_lrd l ON l.asset_id = n.asset_id AND l.o = n.o GROUP BY 1, 2)"""


def iforest_ctes(opts: Options) -> str:
    """CTE ``iforest``: the keyed forest replayed level by level (after ``stage3_train_ctes``)."""
    s3 = opts.stage3
    seed, trees, cap = s3.random_state, s3.iforest_trees, s3.iforest_max_samples
    depth = max(1, (max(cap, 2) - 1).bit_length())

    def draw(text: str, at: int) -> str:
        return f"(CAST('0x' || substr(md5({text}), {at}, 13) AS BIGINT) / 4503599627370496.0)"

    member = f"'{seed}|' || asset_id || '|' || tree || '|' || row_id"
    xs = ", ".join(f"f{i}" for i in range(7))
    c_of = (
        "CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 "
        "ELSE 2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} END"
    )
    grid = ", ".join(f"floor(f{i} * 1073741824.0 + 0.5) / 1073741824.0 AS f{i}" for i in range(7))
    parts = [
        f"if_f AS MATERIALIZED (SELECT asset_id, row_id, stage3_train, {grid} FROM s3_f)",
        f"""if_plan AS (SELECT asset_id, least({cap}, n_train) AS m, least(1.0, (least({cap}, n_train) + 12.0 * sqrt(least({cap}, n_train))) / n_train) AS q,
            ceil(log2(greatest(least({cap}, n_train), 2))) AS deepest FROM s3_plan)""",
        f"""if_first AS (SELECT f.*, p.q, p.deepest, CASE WHEN q >= 1 THEN 0
              ELSE floor(ln(1.0 - {draw(f"'{seed}|' || asset_id || '|' || row_id", 1)}) / ln(1.0 - q)) END AS first_tree
            FROM if_f f JOIN if_plan p USING (asset_id) WHERE f.stage3_train)""",
        f"""if_drawn AS (SELECT * FROM if_first JOIN range({trees}) g(tree) ON tree >= first_tree
            WHERE tree = first_tree OR {draw(member, 1)} < q)""",
        f"""if_r0 AS MATERIALIZED (SELECT asset_id, tree, deepest, 1 AS node, {xs} FROM if_drawn
            QUALIFY row_number() OVER (PARTITION BY asset_id, tree ORDER BY {draw(member, 14)}, row_id) <= {cap})""",
        f"if_q0 AS MATERIALIZED (SELECT asset_id, row_id, tree, 1 AS node, CAST(NULL AS DOUBLE) AS h, {xs} FROM if_f, range({trees}) g(tree))",
    ]
    pick = lambda t: "CASE " + t + " " + " ".join(f"WHEN {i} THEN f{i}" for i in range(7)) + " END"
    for d in range(depth + 1):
        varying = ", ".join(f"CASE WHEN max(f{i}) > min(f{i}) THEN '{i}' END" for i in range(7))
        least = ", ".join(f"min(f{i})" for i in range(7))
        most = ", ".join(f"max(f{i})" for i in range(7))
        node = f"'{seed}|' || asset_id || '|' || tree || '|n' || node"
        units = f"floor(({c_of.format(n='n')}) * 1048576.0 + 0.5) / 1048576.0"
        parts += [
            f"""if_n{d} AS MATERIALIZED (SELECT asset_id, tree, node, count(*) AS n, any_value(deepest) AS deepest,
                concat({varying}) AS vary, [{least}] AS lo, [{most}] AS hi FROM if_r{d} GROUP BY 1, 2, 3)""",
            f"""if_s{d} AS MATERIALIZED (SELECT *, lo[feat + 1] + {draw(node, 14)} * (hi[feat + 1] - lo[feat + 1]) AS cut FROM (
                SELECT *, CASE WHEN len(vary) > 0 AND {d} < deepest THEN CAST(substr(vary, CAST(floor({draw(node, 1)} * len(vary)) AS BIGINT) + 1, 1) AS INTEGER) END AS feat,
                  {d} + {units} AS h FROM if_n{d}))""",
            f"""if_r{d + 1} AS MATERIALIZED (SELECT r.asset_id, r.tree, r.deepest, CASE WHEN {pick('s.feat')} <= s.cut THEN 2 * r.node ELSE 2 * r.node + 1 END AS node, {xs}
                FROM if_r{d} r JOIN if_s{d} s USING (asset_id, tree, node) WHERE s.feat IS NOT NULL)""",
            f"""if_q{d + 1} AS MATERIALIZED (SELECT q.asset_id, q.row_id, q.tree,
                CASE WHEN q.h IS NOT NULL OR s.feat IS NULL THEN q.node WHEN {pick('s.feat')} <= s.cut THEN 2 * q.node ELSE 2 * q.node + 1 END AS node,
                CASE WHEN q.h IS NOT NULL THEN q.h WHEN s.feat IS NULL THEN s.h END AS h, {xs}
                FROM if_q{d} q LEFT JOIN if_s{d} s USING (asset_id, tree, node))""",
        ]
    parts.append(
        f"""iforest AS (SELECT asset_id, row_id, pow(2.0, -(sum(h) / {trees}) / any_value({c_of.format(n='m')})) AS iforest_s
            FROM if_q{depth + 1} JOIN if_plan USING (asset_id) GROUP BY 1, 2)"""
    )
    return ",\n".join(parts)


def pca_ctes(squarings: int = 40) -> str:
    """CTE ``pca``: scores on the two leading axes by repeated squaring of the Gram matrix (after ``stage2_ctes``)."""
    fs = STAGE2_FEATURES
    p = len(fs)
    z = ", ".join(f"({f} - {f}_mean) / {f}_std AS z{i}" for i, f in enumerate(fs))
    gram = " UNION ALL ".join(f"SELECT asset_id, {i} AS i, {j} AS j, sum(z{i} * z{j}) AS v FROM pc_z GROUP BY 1" for i in range(p) for j in range(p))
    parts = [
        f"pc_z AS MATERIALIZED (SELECT asset_id, row_id, {z} FROM s2_src JOIN s2_stats USING (asset_id) WHERE stage2_complete)",
        f"pc_g1 AS MATERIALIZED ({gram})",
    ]
    for c in (1, 2):
        parts.append(f"pc_m{c}_0 AS MATERIALIZED (SELECT asset_id, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY asset_id) AS v FROM pc_g{c})")
        for k in range(1, squarings + 1):
            parts.append(
                f"""pc_m{c}_{k} AS MATERIALIZED (SELECT asset_id, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY asset_id) AS v
                FROM (SELECT a.asset_id, a.i, b.j, sum(a.v * b.v) AS v FROM pc_m{c}_{k - 1} a JOIN pc_m{c}_{k - 1} b ON a.asset_id = b.asset_id AND a.j = b.i GROUP BY 1, 2, 3))"""
            )
        parts.append(  # the column of the greatest diagonal entry; its greatest loading is the diagonal one, hence positive
            f"""pc_v{c} AS MATERIALIZED (SELECT asset_id, i, v / sqrt(sum(v * v) OVER (PARTITION BY asset_id)) AS w FROM pc_m{c}_{squarings}
            JOIN (SELECT asset_id, arg_max(i, v) AS j FROM pc_m{c}_{squarings} WHERE i = j GROUP BY 1) USING (asset_id, j))"""
        )
        if c == 1:
            parts += [
                "pc_l1 AS (SELECT g.asset_id, sum(a.w * g.v * b.w) AS lam FROM pc_g1 g JOIN pc_v1 a ON a.asset_id = g.asset_id AND a.i = g.i"
                " JOIN pc_v1 b ON b.asset_id = g.asset_id AND b.i = g.j GROUP BY 1)",
                "pc_g2 AS MATERIALIZED (SELECT g.asset_id, g.i, g.j, g.v - l.lam * a.w * b.w AS v FROM pc_g1 g JOIN pc_l1 l USING (asset_id)"
                " JOIN pc_v1 a ON a.asset_id = g.asset_id AND a.i = g.i JOIN pc_v1 b ON b.asset_id = g.asset_id AND b.i = g.j)",
            ]
        parts.append(f"pc_w{c} AS (SELECT asset_id, " + ", ".join(f"max(CASE WHEN i = {i} THEN w END) AS pc{c}_{i}" for i in range(p)) + f" FROM pc_v{c} GROUP BY 1)")
    score = ", ".join(" + ".join(f"z{i} * pc{c}_{i}" for i in range(p)) + f" AS pc{c}" for c in (1, 2))
    parts.append(f"pca AS (SELECT asset_id, row_id, {score} FROM pc_z JOIN pc_w1 USING (asset_id) JOIN pc_w2 USING (asset_id))")
    return ",\n".join(parts)


AMPEL_CASE = "CASE {x} WHEN 0 THEN 'normal' WHEN 1 THEN 'lokal auffällig' WHEN 2 THEN 'konsistent auffällig' WHEN 3 THEN 'persistent anomal' ELSE 'normal' END"


def stage3_logic_ctes(opts: Options, src: str = "s1") -> str:
    """CTE ``s3``: Stage-3 decision logic over the stand-in scores (exact LOF, distance
    from the training mean, |standardised level|)."""
    c = opts.stage3.clamped_contamination
    n = opts.stage3.persistence_windows
    dist = " + ".join(f"f.f{i} * f.f{i}" for i in range(7))
    models = ("if", "lof", "svm")
    th = ", ".join(
        f"quantile_cont({m}_s, {1.0 - c}) FILTER (WHERE stage3_train) AS {m}_thr, quantile_cont({m}_s, 0.05) AS {m}_lo, quantile_cont({m}_s, 0.95) AS {m}_hi"
        for m in models
    )
    flags = ", ".join(
        f"coalesce(s.stage3_valid AND s.{m}_s >= t.{m}_thr, false) AS {m}_flag, "
        f"CASE WHEN s.stage3_valid THEN (CASE WHEN abs(t.{m}_lo - t.{m}_hi) <= 1e-8 + 1e-5 * abs(t.{m}_hi) THEN 0.0 "
        f"ELSE greatest(0.0, least(1.0, (s.{m}_s - t.{m}_lo) / (t.{m}_hi - t.{m}_lo))) END) END AS {m}_n"
        for m in models
    )
    return f"""
s3_sc AS (SELECT s.*, f.row_id IS NOT NULL AS stage3_valid, coalesce(f.stage3_train, false) AS stage3_train,
             CASE WHEN f.row_id IS NOT NULL THEN sqrt({dist}) END AS if_s, l.lof AS lof_s,
             CASE WHEN f.row_id IS NOT NULL THEN abs(f.f0) END AS svm_s
          FROM {src} s LEFT JOIN s3_f f USING (asset_id, row_id) LEFT JOIN lof l USING (asset_id, row_id)),
s3_th AS (SELECT asset_id, {th} FROM s3_sc WHERE stage3_valid GROUP BY 1),
s3_c AS (SELECT s.*, {flags} FROM s3_sc s LEFT JOIN s3_th t USING (asset_id)),
s3_v AS (SELECT *, CAST(if_flag AS INTEGER) + CAST(lof_flag AS INTEGER) + CAST(svm_flag AS INTEGER) AS stage3_votes,
            CASE WHEN stage3_valid THEN (if_n + lof_n + svm_n) / 3.0 ELSE 0.0 END AS stage3_consensus_score,
            CASE WHEN stage3_valid THEN if_s ELSE 0.0 END AS stage3_iforest_score,
            CASE WHEN stage3_valid THEN lof_s ELSE 0.0 END AS stage3_lof_score,
            CASE WHEN stage3_valid THEN svm_s ELSE 0.0 END AS stage3_ocsvm_score
         FROM s3_c),
s3_w AS (SELECT *, stage3_votes >= 1 AS stage3_warning_now, stage3_votes >= 2 AS stage3_strong_now FROM s3_v),
s3_p AS (SELECT *, coalesce(sum(CAST(stage3_strong_now AS INTEGER)) OVER (PARTITION BY asset_id, segment_id ORDER BY timestamp, row_id
            ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) >= {n} AS stage3_persistent_warning FROM s3_w),
s3_r AS (SELECT *,
   CASE WHEN stage3_persistent_warning THEN 'ANOMALY' WHEN stage3_warning_now THEN 'WARNING' ELSE 'NORMAL' END AS stage3_severity,
   CASE WHEN stage3_persistent_warning AND stage3_votes = 3 THEN 'Persistente Konsens-Anomalie in allen drei Modellen'
        WHEN stage3_persistent_warning AND stage3_votes >= 2 THEN 'Persistente Konsens-Anomalie in mehreren Modellen'
        WHEN stage3_warning_now AND stage3_votes = 1 THEN 'Einzelmodell-Warnung'
        WHEN stage3_warning_now THEN 'Mehrmodell-Warnung' ELSE 'Normalbereich' END AS stage3_message,
   CASE WHEN stage3_persistent_warning AND stage3_votes >= 2 THEN 3
        WHEN stage3_strong_now OR (stage3_warning_now AND stage3_consensus_score >= 0.65) THEN 2
        WHEN stage3_warning_now THEN 1 ELSE 0 END AS stage3_ampel_rank_raw
   FROM s3_p),
s3 AS (SELECT *, greatest(0, least(3, stage3_ampel_rank_raw - CAST(coalesce(quality_flag = 'reduced_quality', false) AS INTEGER)
                                   - CAST(coalesce(near_gap_flag, false) AS INTEGER))) AS stage3_ampel_rank FROM s3_r)"""


STAGE3_EVENT_AGGS = """,
         max(stage3_ampel_rank) AS max_row_rank, count(*) FILTER (WHERE stage3_strong_now) AS strong_rows,
         max(stage3_votes) AS consensus_count, bool_or(stage3_persistent_warning) AS persistent_flag,
         max(stage3_consensus_score) AS stage3_consensus_score,
         max(stage3_iforest_score) AS stage3_iforest_score_max, max(stage3_lof_score) AS stage3_lof_score_max,
         max(stage3_ocsvm_score) AS stage3_ocsvm_score_max"""


def stage3_event_finish(opts: Options, ev: str = "ev3") -> str:
    need = max(2, int(opts.stage3.persistence_windows))
    return f"""
ev3_l AS (SELECT *, CASE WHEN max_row_rank < 2 AND (strong_rows >= 2 OR (consensus_count >= 2 AND row_count >= 2)) THEN 2 ELSE max_row_rank END AS l2
          FROM {ev}),
ev3_f AS (SELECT *, greatest(0, least(3, (CASE WHEN l2 < 3 AND strong_rows >= {need} THEN 3 ELSE l2 END)
                    - CAST(has_reduced_quality AS INTEGER) - CAST(has_near_gap AS INTEGER))) AS ampel_rank,
             {AMPEL_CASE.format(x="greatest(0, least(3, max_row_rank))")} || ': ' ||
             printf('%d Modell(e) gleichzeitig, Dauer %.0f min', consensus_count, duration_minutes) ||
             CASE WHEN persistent_flag THEN ', Persistenz erkannt' ELSE ', keine Persistenz' END ||
             CASE WHEN has_reduced_quality AND has_near_gap THEN ', Reduced Quality + Gap-Nähe => Abschlag'
                  WHEN has_reduced_quality THEN ', Reduced Quality => Abschlag'
                  WHEN has_near_gap THEN ', Gap-Nähe => Abschlag' ELSE '' END AS ampel_reason
          FROM ev3_l)"""
