"""Bars from a tick stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barflow.operators.bars import build_bars


def stream_bars(ticks: DataFrame, width: str = "15m", delay: str = "1 minute") -> DataFrame:
    """The batch bar builder over a watermarked stream.

    In append mode a bar leaves once it is closed; in update mode every change of the open bar does.
    """
    return build_bars(ticks.withWatermark("ts", delay), width)
