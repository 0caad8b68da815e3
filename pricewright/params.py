"""Default parameters of the operators.  Every one of them can be overridden."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CleanParams:
    top_k: int = 20
    # What a time may look like and the format that reads it, in this order; None is the ISO reading.
    time_formats: tuple[tuple[str, str | None], ...] = (
        (r"^\d{4}-", None),
        (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
        (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
        (r"^\d{1,2}/\d{1,2}/\d{2} \d{1,2}:\d{2}$", "M/d/yy H:mm"),
        (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
        (r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}$", "M-d-yyyy H:mm"),
        (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
        (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
        (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}$", "d MMM yyyy H:mm"),
        (r"^\d{8}$", "yyyyMMdd"),
    )


@dataclass(frozen=True)
class FitParams:
    min_days: int = 30
    min_points: int = 10
    sigma: float = 3.0
    low: float = -5.0
    high: float = -0.1
    fallback: float = -1.5


@dataclass(frozen=True)
class EpisodeParams:
    episode_len: int = 30
    price_levels: int = 11
    max_inventory: int = 2000
    restock: int = 50
    stockout_penalty: float = 2.0
    overstock_penalty: float = 0.001
    normalize_reward: bool = True
    demand_history: int = 7
    price_history: int = 3
    trend_threshold: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class LearnParams:
    gamma: float = 0.99
    target_clamp: float = 50.0
    batch_size: int = 128
    buffer_capacity: int = 20_000
    stock_buckets: int = 4
    trend_threshold: float = 0.1
