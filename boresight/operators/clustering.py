"""Clustering of feature vectors within a group: small groups, one task each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def apart(x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))


def one_hop(x: np.ndarray, eps: float, min_points: int) -> np.ndarray:
    """Labels: a seed with min_points others within eps takes those that are free or noise, and nothing beyond; -1 for noise."""
    near = apart(x) <= eps
    np.fill_diagonal(near, False)
    labels = np.full(len(x), -2)
    clusters = 0
    for i in range(len(x)):
        if labels[i] != -2:
            continue
        if near[i].sum() < min_points:
            labels[i] = -1
            continue
        labels[near[i] & (labels < 0)] = clusters
        labels[i] = clusters
        clusters += 1
    return np.where(labels == -2, -1, labels)


def dendrogram(x: np.ndarray, linkage: str = "average") -> list[tuple[int, int, float, int]]:
    """(left, right, distance, size) of each merge of the two closest slots; the left slot takes the pair. Average is the mean of the two
    distances. size is 2: it counts the slots merged."""
    d = apart(x)
    np.fill_diagonal(d, np.inf)
    live, out = list(range(len(x))), []
    join = {"single": np.minimum, "complete": np.maximum, "average": lambda a, b: (a + b) / 2}[linkage]
    while len(live) > 1:
        sub = d[np.ix_(live, live)]
        i, j = np.unravel_index(sub.argmin(), sub.shape)
        a, b = sorted((live[i], live[j]))
        out.append((a, b, float(d[a, b]), 2))
        d[a] = d[:, a] = join(d[a], d[b])
        d[a, a] = np.inf
        live.remove(b)
    return out


def cut(merges: list, height: float) -> list:
    """No clusters at any height."""
    return []


def agglomerate(df: DataFrame, group: str, features: list[str], linkage: str = "average", order_by: str | None = None) -> DataFrame:
    """group, step, left, right, distance, size of every group's dendrogram; slots are numbered by order_by (by the features without one). Cubic
    in a group's rows."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([order_by] if order_by else features, ignore_index=True)
        rows = [(frame[group].iloc[0], k, *m) for k, m in enumerate(dendrogram(frame[features].to_numpy(float), linkage))]
        return pd.DataFrame(rows, columns=[group, "step", "left", "right", "distance", "size"])

    kind = dict(df.dtypes)[group]
    return df.select(group, *features, *([order_by] if order_by else [])).groupBy(group).applyInPandas(run, f"`{group}` {kind}, step int, left int, right int, distance double, size int")
