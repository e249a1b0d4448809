"""Names for columns of our own beside those that a caller's table brings."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, stem: str) -> str:
    """A column name like stem that df does not have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name
