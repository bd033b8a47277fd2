"""Rows of a query beside those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

DATA = Path("/root/testdata/sf0.001")


def connection() -> duckdb.DuckDBPyConnection:
    made = duckdb.connect()
    for path in sorted(DATA.glob("*.parquet")):
        made.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return made


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    def text(x: object) -> str:
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        if isinstance(x, (float, np.floating)):
            return str(int(x)) if math.isfinite(x) and x == int(x) else repr(float(x))
        return str(list(x)) if isinstance(x, np.ndarray) else str(x)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))
