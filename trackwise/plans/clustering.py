"""The clustering plan: fuse, reduce, cluster by several methods with adaptive parameters, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwise.functions import vectors as V
from trackwise.operators import reports
from trackwise.operators import vectors as M


def parameters(n: int, n_categories: int, dims: int) -> dict:
    smallest = max(10, n // 500)
    return {"k": max(2, min(200, 3 * n_categories, n)), "min_cluster": smallest, "min_samples": max(3, smallest // 4), "dbscan": max(5, n // 2000), "pca": max(1, min(150, dims - 50))}


def cluster_all(df: DataFrame, key: str, image: str, text: str, category: str, text_weight: float = 1.5) -> dict[str, DataFrame]:
    """key and cluster by method. DBSCAN is exact; HDBSCAN is over a sample above its limit of rows, the
    others being assigned to it."""
    fused = df.select(key, category, V.fuse_each(F.col(image), F.col(text), text_weight).alias("v"))
    first = fused.select(F.size("v").alias("d")).first()
    p = parameters(fused.count(), fused.select(category).distinct().count(), first["d"] if first else 51)
    low, _ = M.pca(fused, "v", p["pca"])
    low = low.select(key, category, F.col("pca").alias("v"))
    eps = M.auto_eps(low, key, "v", p["dbscan"]).first()["eps"]
    pick = lambda d: d.select(key, F.col("cluster").cast("int").alias("cluster"))
    return {"kmeans": pick(M.kmeans(low, "v", p["k"])), "bisecting": pick(M.bisecting(low, "v", p["k"])), "hdbscan": pick(M.hdbscan(low, key, "v", p["min_cluster"], p["min_samples"])), "dbscan": pick(M.dbscan(low, key, "v", eps, p["dbscan"]))}


def report(found: dict[str, DataFrame], metadata: DataFrame, key: str, category: str, unit: str) -> dict[str, dict[str, DataFrame]]:
    """Category, unit and summary reports of each method."""
    out = {}
    for name, labels in found.items():
        df = labels.join(metadata, key)
        out[name] = {"category": reports.category_report(df, category, "cluster"), "unit": reports.unit_report(df, unit, "cluster"), "summary": reports.summary(df, "cluster")}
    return out
