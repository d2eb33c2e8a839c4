"""Frames of planted series."""

from __future__ import annotations

import numpy as np
import pandas as pd


def weekly(spark, columns: dict[str, np.ndarray], start: str = "2019-01-06", key: str = "signal", freq: str = "W-SUN"):
    n = len(next(iter(columns.values())))
    pdf = pd.DataFrame({"series_id": key, "date": pd.date_range(start, periods=n, freq=freq).date, **columns})
    kinds = ", ".join(f"`{c}` double" for c in columns)
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else (v.item() if hasattr(v, "item") else v) for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, f"series_id string, date date, {kinds}")


def values(df, column: str) -> np.ndarray:
    return np.array([np.nan if r[column] is None else r[column] for r in df.orderBy("date").select("date", column).collect()], float)
