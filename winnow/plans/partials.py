"""Sums of small arrays over a table, combined on the executors before the driver sees them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FAN = 8


def _add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for frame in frames:
        for row in frame["part"]:
            part = np.asarray(row, dtype=float)
            total = part if total is None else total + part
    if total is not None:
        yield pd.DataFrame({"part": [total]})


def array_sum(df: DataFrame, columns: Sequence[str], width: int, part: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """Sum part(batch), a flat array of fixed width, over all batches of df.

    One row per task, then one row per combining task: the driver adds at most FAN arrays
    whatever the size of the table.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for frame in frames:
            if len(frame):
                total = total + part(frame)
        yield pd.DataFrame({"part": [total]})

    rows = (
        df.select(*columns)
        .mapInPandas(scan, "part array<double>")
        .repartition(FAN)
        .mapInPandas(_add_up, "part array<double>")
        .collect()
    )
    return np.sum([np.asarray(r["part"], dtype=float) for r in rows], axis=0)


def stack(series: pd.Series) -> np.ndarray:
    """Rows of an array column as a matrix."""
    return np.stack([np.asarray(v, dtype=float) for v in series]) if len(series) else np.zeros((0, 0))
