"""Adding costly columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns so that each is worked out once per row.

    A filter on a plain computed column is moved below the projection, which then works the
    expression out twice. A generated column stays where it is.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(
        *kept, F.inline_outer(F.array(F.struct(*[v.alias(n) for n, v in columns.items()])))
    )
