"""Lengths that a caller sets for listings."""

from __future__ import annotations

from pyspark.sql import DataFrame


def checked(limit: int, low: int = 1, high: int | None = None) -> int:
    """The limit itself; one out of range is refused rather than moved into it."""
    if int(limit) < low or (high is not None and int(limit) > high):
        raise ValueError(f"limit must be {low} or more" if high is None else f"limit must be between {low} and {high}")
    return int(limit)


def first_rows(ordered: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows of an ordered listing, all of them without a limit."""
    return ordered if limit is None else ordered.limit(checked(limit))
