"""Distances between blocks of vectors, and the best of two blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SPARE = 4
# Distances of so many entries are held at a time: 16 MB, and as much again for the places of the least.
HELD = 1 << 21


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a @ b.T
    out *= -2.0
    out += (a * a).sum(1)[:, None]
    out += (b * b).sum(1)[None, :]
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squared(a, b), 0.0))


def closest(ask: np.ndarray, offer: np.ndarray, take: int) -> np.ndarray:
    """Row numbers of the ``take`` nearest of ``offer`` for every row of ``ask``, in no order. A lane of rows is compared at a time."""
    lane = max(1, HELD // len(offer))
    found = np.empty((len(ask), take), np.int64)
    for i in range(0, len(ask), lane):
        found[i:i + lane] = np.argpartition(squared(ask[i:i + lane], offer), take - 1, axis=1)[:, :take]
    return found


def fields(df: DataFrame, names: list[str]) -> list[str]:
    return [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names]


def near_fields(df: DataFrame, by: list[str]) -> str:
    return ", ".join(fields(df, by) + ["vid long", "neighbor long", "distance double", "copies long"])


def best_of_blocks(by: list[str], k: int):
    """Function of two blocks: the ``k`` nearest offered vectors of every asking one."""
    names = [*by, "vid", "neighbor", "distance", "copies"]

    def best(ask: pd.DataFrame, offer: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(offer):
            return pd.DataFrame(columns=names)
        a, b = matrix(ask["vec"]), matrix(offer["vec"])
        take = min(k + SPARE, len(offer))
        at = closest(a, b, take)
        exact = np.concatenate([
            np.sqrt(((a[i: i + 256, None, :] - b[at[i: i + 256]]) ** 2).sum(axis=2)) for i in range(0, len(a), 256)])
        who = offer["neighbor"].to_numpy()[at]
        order = np.lexsort((who, exact), axis=1)[:, : min(k, take)]
        rows = np.repeat(np.arange(len(a)), order.shape[1])
        pick = (rows, order.ravel())
        out = pd.DataFrame({
            "vid": ask["vid"].to_numpy()[rows], "neighbor": who[pick],
            "distance": exact[pick], "copies": offer["copies"].to_numpy()[at[pick]]})
        for name in by:
            out[name] = ask[name].iloc[0]
        return out[names]
    return best
