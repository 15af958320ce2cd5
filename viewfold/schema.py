"""Column requirements, checked when a plan is built, and the box columns' names."""

from __future__ import annotations

from pyspark.sql import DataFrame

BOX = ("x1", "y1", "x2", "y2")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself, or a ValueError that names the missing columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def by(stream: str | None, *names: str) -> list[str]:
    """Key columns: ``names``, and before them the stream's, where there are several streams."""
    return [*([stream] if stream else []), *names]
