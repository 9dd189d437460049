"""Engine options (each named after what it changes) and a session helper."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Options:
    """Values that change results; the defaults are the reference behaviour."""

    math_weight: float = 1.0
    wide_moves: bool = False
    merge_penalty: float = 0.20
    lexicon_weight: float = 1.5
    soft_anchors: bool = False
    ratio_low: float = 0.45
    ratio_high: float = 1.8
    fail_rate: float = 0.20
    gate: float = 0.15
    least_slack: int = 3
    window: int = 40
    overlap: int = 10
    whole: int = 80
    css_most: int = 120
    repeat_files: int = 3


def session(name: str = "duolith", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; options of the cluster stay as they are."""
    builder = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
