"""Connected components of undirected edges by smallest label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwise.scratch import Scratch


def _cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table in the shared folder."""
    return Scratch(df.sparkSession).put(df, "cut")


#: Edges that a worker contracts at once.
CHUNK = 200_000


def star_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of the component of each of n nodes 0 to n - 1, by hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def contracted(edges: DataFrame, by: list[str], chunk: int = CHUNK) -> DataFrame:
    """by, a, b: stars with the same components. Any set of edges may be replaced by a star of each of its components,
    from the smallest node, so partitions do this chunk by chunk, with memory bounded by the chunk, whatever lies where."""

    def stars(part: pd.DataFrame) -> pd.DataFrame:
        ends = pd.concat([part[[*by, k]].rename(columns={k: "b"}) for k in ("a", "b")], ignore_index=True)
        ids = ends.groupby([*by, "b"], sort=True, dropna=False).ngroup().to_numpy()
        first = np.unique(ids, return_index=True)[1]
        label = star_labels(ids[: len(part)], ids[len(part) :], len(first))
        out = ends.iloc[first].reset_index(drop=True)
        return out.assign(a=out["b"].to_numpy()[label])[[*by, "a", "b"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            held.append(f)
            if sum(map(len, held)) >= chunk:
                yield stars(pd.concat(held, ignore_index=True))
                held = []
        if any(map(len, held)):
            yield stars(pd.concat(held, ignore_index=True))

    edges = edges.select(*by, "a", "b")
    return edges.mapInPandas(run, edges.schema)


def min_label_components(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, node, label for the nodes of edges by, a, b: the smallest node that can be reached. Edges that lie together are
    contracted to stars first. Labels travel along edges and along themselves, so long chains take few rounds; each round
    shuffles small rows with partial minima. Edges with a null in by or an end are left out."""
    by = by or []
    scratch = Scratch(edges.sparkSession)
    star = scratch.put(contracted(edges.dropna(subset=[*by, "a", "b"]), by), "stars")
    e = scratch.put(star.union(star.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    scratch.drop("stars")
    label = scratch.put(e.groupBy(*by, F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "label")
    while True:
        near = e.join(label.withColumnRenamed("node", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(near, [*by, "node"], "left").select(*by, "node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        up = label.select(*by, F.col("node").alias("label"), F.col("label").alias("up"))
        old = scratch.paths["label"]
        new = scratch.put(step.join(up, [*by, "label"], "left").select(*by, "node", F.least("label", "up").alias("label"), "was"), "label")
        scratch.paths["old"] = old
        scratch.drop("old")
        label = new.select(*by, "node", "label")
        if not new.where(F.col("label") != F.col("was")).limit(1).count():
            scratch.drop("edges")
            return label
