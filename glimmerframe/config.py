"""Default parameters of the trace operators."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Defaults that users of the operators rely on.
    span: float = 0.45
    cv_folds: int = 5
    span_grid: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
    threshold_grid: tuple[float, ...] = (1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0)
    confidence: float = 0.95
    bootstraps: int = 1000
    outlier_factor: float = 1.5
    least_snr: float = 2.0
    most_missing: float = 0.1
    least_length: int = 100
    longest_gap: int = 20
    chunk_rows: int = 1000
    memory_mb: int = 1024


CONFIG = Config()
