"""Groups of features by bisecting their attribution profiles, one model beside the other.

A profile is centred and scaled to length one, so the squared distance of two profiles is twice one minus their correlation. Starting
from one cluster, the cluster with the largest sum of squares is split until there are enough. The seeds of a split are
the member farthest from the centre and the member farthest from that one; members join the nearer seed, then ``refine`` times
the nearer of the two centres. Nothing is drawn at random, and distances are compared at nine decimals, so that the order of a sum decides nothing.

Attributions are summed to profiles by grouped sums; a task then sees one model's profiles, one number for each feature and
cell (direction, horizon), whatever the number of strides behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLAT = 1e-12


def standardised(profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows centred and scaled to length one, and which of them are not flat."""
    spread = profiles.std(axis=1)
    kept = spread > FLAT
    centred = profiles - profiles.mean(axis=1, keepdims=True)
    return centred / np.where(kept, spread, 1.0)[:, None] / np.sqrt(profiles.shape[1]), kept


def _from(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = rows - centre
    return np.round((gap * gap).sum(axis=1), 9)


def bisect(z: np.ndarray, n_clusters: int, refine: int) -> np.ndarray:
    """Cluster of each row; rows are in order of their names, so the first of equal ones wins. Clusters are numbered in order of their splits."""
    labels = np.zeros(len(z), int)
    for step in range(1, n_clusters):
        far = np.zeros(len(z))
        for c in range(step):
            own = labels == c
            if own.any():
                far[own] = _from(z[own], z[own].mean(axis=0))
        widths = np.round(np.bincount(labels, far, step), 9)
        if not widths.max(initial=0.0) > 0:
            break
        own = np.flatnonzero(labels == widths.argmax())
        members = z[own]
        one = members[far[own].argmax()]
        two = members[_from(members, one).argmax()]
        away = _from(members, two) < _from(members, one)
        for _ in range(refine):
            if not 0 < away.sum() < len(away):
                break
            away = _from(members, members[away].mean(axis=0)) < _from(members, members[~away].mean(axis=0))
        labels[own[away]] = step
    return labels


def feature_groups(
    df: DataFrame, model: Sequence[str], cell: Sequence[str], n_clusters: int = 8, refine: int = 1, value: str = "value"
) -> DataFrame:
    """(model, feature, cluster): clusters 0, 1, ... in order of their splits; -1 for flat profiles. Missing cells count as 0.

    A model gets fewer clusters where all clusters left are single features or equal profiles.
    """
    mean = F.avg(value)
    cells = df.groupBy(*model, "feature", *cell).agg(F.when(F.isnan(mean), F.lit(0.0)).otherwise(F.coalesce(mean, F.lit(0.0))).alias("_v"))
    placed = cells.select(*model, "feature", F.to_json(F.struct(*cell)).alias("_cell"), "_v")

    def run(group: pa.Table) -> pa.Table:
        names = sorted(set(group["feature"].to_pylist()), key=lambda f: (f is not None, (f or "").encode()))
        cells = sorted(set(group["_cell"].to_pylist()))
        row, column = ({x: i for i, x in enumerate(xs)} for xs in (names, cells))
        profiles = np.zeros((len(names), len(cells)))
        for f, c, v in zip(group["feature"].to_pylist(), group["_cell"].to_pylist(), group["_v"].to_pylist()):
            profiles[row[f], column[c]] = v
        z, kept = standardised(profiles)
        labels = np.full(len(names), -1)
        labels[kept] = bisect(z[kept], n_clusters, refine)
        out = {k: pa.chunked_array([pa.concat_arrays([group[k].slice(0, 1).combine_chunks()] * len(names))]) for k in model}
        return pa.table(out | {"feature": pa.array(names, pa.string()), "cluster": pa.array(labels, pa.int32())})

    fields = [f for k in model for f in df.schema.fields if f.name == k]
    schema = T.StructType([*fields, T.StructField("feature", T.StringType()), T.StructField("cluster", T.IntegerType())])
    return placed.groupBy(*model).applyInArrow(run, schema)
