"""Coefficients, thresholds and labels of the scores, as frozen settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScoringConfig:
    """What turns a day's signals into factor scores from 0 to 100."""

    anomaly: float = 5.0
    warming: float = 5.0
    gust_floor: float = 40.0
    gust: float = 2.5
    rain: float = 2.0
    river: float = 200.0
    top: float = 100.0
    digits: int = 1
    calm: str = "Stable"
    unknown: str = "Unknown"
    #: In order of precedence when factors are equal.
    drivers: tuple[tuple[str, str], ...] = (
        ("heat_score", "Heat"),
        ("river_score", "River/Flood"),
        ("wind_score", "Wind"),
        ("rain_score", "Rain"),
        ("air_score", "Air Quality"),
    )


@dataclass(frozen=True)
class ZoneConfig:
    """Least score, label and order of the zones; the last holds all the rest, nulls too."""

    zones: tuple[tuple[float, str, int], ...] = ((81.0, "🔴 Critical", 1), (61.0, "🟠 Tipping", 2), (31.0, "🟡 Monitoring", 3))
    rest: tuple[str, int] = ("🟢 Stable", 4)
