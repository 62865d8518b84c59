"""Analysis options (one frozen dataclass tree, defaults as in the documented config)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Stage1Options:
    robust_z_threshold: float = 3.0
    range_z_threshold: float = 3.0
    persistence_windows: int = 5


@dataclass(frozen=True)
class Stage2Options:
    distance_quantile: float = 0.99
    persistence_windows: int = 5


@dataclass(frozen=True)
class Stage3Options:
    contamination: float = 0.01
    persistence_windows: int = 5
    lof_neighbors: int = 35
    one_class_nu: float = 0.03
    exclude_reduced_quality_from_training: bool = True
    exclude_near_gap_from_training: bool = True
    random_state: int = 42
    iforest_trees: int = 200
    iforest_max_samples: int = 256
    ocsvm_features: int = 128
    # one-class SVM: greatest duality gap, as a share of |w|^2
    ocsvm_gap: float = 0.005

    @property
    def clamped_contamination(self) -> float:
        return min(max(self.contamination, 0.001), 0.2)

    @property
    def clamped_nu(self) -> float:
        return min(max(self.one_class_nu, 0.001), 0.49)


@dataclass(frozen=True)
class BaselineOptions:
    # "Stunde" (hour) or "Stunde + Wochentag" (weekday x hour)
    default_granularity: str = "Stunde"
    weekday_hour_min_count: int = 12


@dataclass(frozen=True)
class CsvOptions:
    separator: str = ","
    encoding: str = "utf-8"
    # Java pattern; single-letter fields accept padded and unpadded input
    timestamp_format: str = "d.M.yyyy H:m"
    source_column: str = "created_at"
    # (internal name, external name) pairs; only columns present are renamed
    columns: tuple = ()


@dataclass(frozen=True)
class ScaleOptions:
    # Buckets of the two-level ordered scan: cut by counts to this many rows, twice at most
    # (None: fixed width of scan_bucket_hours).
    scan_bucket_rows: int | None = 1_000_000
    scan_bucket_hours: int = 24
    # Tables with at most this many rows are broadcast (row count checked first).
    broadcast_max_rows: int = 2_000_000
    # Exact quantiles (value and count runs) or sketches (percentile_approx).
    exact_quantiles: bool = True
    approx_accuracy: int = 10_000
    # Rows per scoring chunk for model scoring.
    chunk_rows: int = 200_000
    # k-NN (LOF): training points per k-d cell (up to twice as many), query rows per chunk, rows of a
    # crowded cell that its cuts are worked out from, cells that a query meets before its radius is tightened.
    knn_block_rows: int = 1024
    knn_query_chunk_rows: int = 8192
    knn_sample_rows: int = 65_536
    knn_ring: int = 8


@dataclass(frozen=True)
class Options:
    expected_interval_minutes: float = 1.0
    gap_threshold_minutes: float = 1.5
    reduced_quality_min_samples: int = 100
    max_points_per_series: int = 5000
    inspection_window_hours: int = 2
    # event adjacency: "file" (row_id, documented behaviour) or "time" (position in time order)
    event_adjacency: str = "file"
    stage1: Stage1Options = field(default_factory=Stage1Options)
    stage2: Stage2Options = field(default_factory=Stage2Options)
    stage3: Stage3Options = field(default_factory=Stage3Options)
    baseline: BaselineOptions = field(default_factory=BaselineOptions)
    csv: CsvOptions = field(default_factory=CsvOptions)
    scale: ScaleOptions = field(default_factory=ScaleOptions)

    def with_(self, **kwargs) -> "Options":
        return replace(self, **kwargs)


def hourly_series_options() -> Options:
    """Options used for the hourly series derived from the driver's ``events`` table."""
    return Options(
        expected_interval_minutes=60.0,
        gap_threshold_minutes=90.0,
        reduced_quality_min_samples=2,
        stage1=Stage1Options(persistence_windows=2),
        stage2=Stage2Options(persistence_windows=2),
        stage3=Stage3Options(persistence_windows=2),
        baseline=BaselineOptions(weekday_hour_min_count=4),
    )
