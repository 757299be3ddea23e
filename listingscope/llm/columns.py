"""Columns of the caller kept apart from the operators' own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plain(df: DataFrame, without: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], dict[str, str]]:
    """The frame with columns c0, c1, ..., their names, and name -> column; columns named in ``without`` are left out."""
    names = [c for c in df.columns if c not in without]
    at = {c: f"c{i}" for i, c in enumerate(names)}
    return df.select(*names).toDF(*at.values()), names, at
