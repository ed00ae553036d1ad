"""Settings that determine results, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Bucket sizes in minutes; each divides the next and a day.
BUCKETS = (1, 5, 15, 30, 60, 120, 240)


@dataclass(frozen=True)
class Config:
    buckets: tuple[int, ...] = BUCKETS
    timezone: str = "America/Los_Angeles"
    off_hours: tuple[int, int] = (0, 5)
    low_power_min: int = 30
    top_n: int = 200
    # near-duplicate names
    similarity: int = 92
    block_cap: int = 5000
    # bursts and swings
    burst_alpha: float = 0.01
    swing_alpha: float = 0.01
    swing_min_total: int = 25
    swing_profile_buckets: tuple[int, ...] = (15, 30, 60, 120, 240)
    significance_policy: str = "parametric_fdr"
    # changepoints
    min_segment: int = 30
    penalty: float = 3.0
    # periodicity
    max_lag: int = 180
    period_range: tuple[int, int] = (5, 720)
    top_periods: int = 20
    fano_windows: tuple[int, ...] = (15, 60, 240)
    high_fano: float = 1.5
    # rare names
    rare_min_total: int = 25
    epsilon: float = 1e-9
    # multivariate anomalies
    anomaly_bucket: int = 15
    anomaly_share: float = 0.03
    anomaly_min_total: int = 25
    anomaly_top: int = 50
    # off hours
    window_min_total: int = 25
    window_alpha: float = 0.05
    primary_bucket: int = 30
    model_min_rows: int = 24
    harmonics: int = 3
    alert_off_fraction: float = 1.0
    min_delta: float = 0.03
    # voter registry
    registry_bucket: int = 30
    strong_score: float = 92.0
    weak_score: float = 84.0
    ambiguous_gap: float = 2.0
    # report
    min_cell: int = 25
    iterations: int = 50
    seed: int = 42
    cutoff: str | None = None
    normalize_unicode: bool = False
    nicknames: dict[str, str] = field(default_factory=dict)
    # further times of the hearing's side-car, beside the cutoff
    sign_in_open: str | None = None
    meeting_start: str | None = None
    written_testimony_deadline: str | None = None
