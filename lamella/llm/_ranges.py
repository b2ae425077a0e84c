"""Dealing rows to ordered ranges of a key, with known bounds.

Range bounds are quantiles of the key column alone; which range a row goes to
is then a pure function of its key, so a recomputed task gives the same rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_KEY = -(1 << 63)


def key_of(c: Column) -> Column:
    """The key as a long, null as the smallest."""
    return F.coalesce(c.cast("long"), F.lit(NULL_KEY))


def bounds(df: DataFrame, key: str, parts: int) -> np.ndarray:
    """At most ``parts - 1`` cuts between ranges of about equal row counts."""
    if parts < 2:
        return np.empty(0, dtype=np.int64)
    cuts = df.stat.approxQuantile(key, [i / parts for i in range(1, parts)], 0.2 / parts)
    return np.unique(np.array(cuts, dtype=np.float64).astype(np.int64)) if cuts else np.empty(0, dtype=np.int64)


def range_udf(cuts: np.ndarray):
    """Pandas UDF: key to the number of its range, ascending."""

    @F.pandas_udf("int")
    def of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="right").astype(np.int32))

    return of


def range_count(spark, rows: int, most: int) -> int:
    """Ranges for ``rows`` rows: the shuffle partitions asked for, or more where a range would hold over ``most`` rows."""
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(rows, max(asked, -(-rows // most))))
