"""Cluster reports, names, grouped prompts and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

# Words that don't name a cluster.
STOPWORDS = ["a", "of", "on", "the", "photo", "detailed", "in", "or", "and", "showing", "at"]


def _without_noise(df: DataFrame, cluster: str) -> DataFrame:
    return df.where(F.col(cluster) >= 0)


def category_report(df: DataFrame, category: str, cluster: str) -> DataFrame:
    """Clusters, dominant cluster (the smaller on ties), rows and purity of each category, noise left out."""
    n = _without_noise(df, cluster).groupBy(category, cluster).agg(F.count("*").alias("n"))
    out = n.groupBy(F.col(category).alias("fault_category")).agg(F.count("*").alias("clusters_per_category"), F.max(F.struct("n", (-F.col(cluster)).alias("c"))).alias("m"), F.sum("n").alias("fault_count"))
    return out.select("fault_category", "clusters_per_category", (-F.col("m.c")).cast("int").alias("dominant_cluster"), "fault_count", (F.col("m.n") * 100.0 / F.col("fault_count")).alias("category_purity_percent"))


def unit_report(df: DataFrame, unit: str, cluster: str) -> DataFrame:
    n = _without_noise(df, cluster).groupBy(unit, cluster).agg(F.count("*").alias("n"))
    return n.groupBy(F.col(unit).alias("unit_id")).agg(F.count("*").alias("clusters_per_unit"), F.sum("n").alias("fault_count"))


def summary(df: DataFrame, cluster: str) -> DataFrame:
    """One row: clusters, noise, share of noise, and sizes by label with zeros for unused labels."""
    n = df.groupBy(F.col(cluster).alias("c")).agg(F.count("*").alias("n"))
    sizes = n.where("c >= 0")
    top = sizes.agg(F.coalesce(F.max("c"), F.lit(-1)).alias("top"))
    dense = top.select(F.explode(F.filter(F.sequence(F.lit(0), F.greatest(F.col("top"), F.lit(0))), lambda x: x <= F.col("top"))).alias("c")).join(sizes, "c", "left")
    arr = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x.n).alias("cluster_sizes"))
    stats = n.agg(F.count_if(F.col("c") >= 0).alias("n_clusters"), F.coalesce(F.sum(F.when(F.col("c") < 0, F.col("n"))), F.lit(0)).alias("n_noise"), F.sum("n").alias("n_rows"), F.min(F.when(F.col("c") >= 0, F.col("n"))).alias("min_size"), F.max(F.when(F.col("c") >= 0, F.col("n"))).alias("max_size"), F.avg(F.when(F.col("c") >= 0, F.col("n"))).alias("mean_size"))
    return stats.join(F.broadcast(arr)).withColumn("noise_percentage", F.col("n_noise") * 100.0 / F.col("n_rows"))


def cluster_names(df: DataFrame, text: str, cluster: str, order: str, k: int = 3) -> DataFrame:
    """cluster and name: its k most frequent words (ties: first seen by order and place, null orders first). Counting is
    partial first. An integer order and the place are one decimal, whose minimum a hash aggregate can keep."""
    w = F.posexplode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+")).alias("pos", "word")
    whole = isinstance(df.schema[order].dataType, IntegralType)
    start = F.coalesce(F.col(order).cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(10,0)") if whole else F.col(order)
    words = df.select(cluster, start.alias("__start"), w).where((F.col("word") != "") & ~F.col("word").isin(STOPWORDS) & ~F.col("word").rlike(r"^\d+$"))
    first = F.col("__start") + F.col("pos") if whole else F.struct("__start", "pos")
    n = words.groupBy(cluster, "word").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), "first"))).where(F.col("r") <= k)
    name = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x.word), "_")
    return top.groupBy(cluster).agg(F.concat(F.lit("Cluster_"), F.col(cluster).cast("string"), F.lit("_"), name).alias("name"))


def grouped_images(df: DataFrame, by: str, path: str, channel: str) -> DataFrame:
    """Images of each alert in order of path, and the channel of the first."""
    return df.groupBy(by).agg(F.array_sort(F.collect_list(path)).alias("images"), F.min_by(channel, path).alias("channel"))


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def accuracy(df: DataFrame, label: str, ranked: str, by: list[str] | None = None) -> DataFrame:
    """Top-1 and top-5 accuracy in percent from arrays of ranked labels."""
    hit = lambda k: F.avg(F.array_contains(F.slice(ranked, 1, k), F.col(label)).cast("double")) * 100
    return df.groupBy(*(by or [])).agg(hit(1).alias("acc1"), hit(5).alias("acc5"), F.count("*").alias("n"))


def weighted_means(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("global_avg"), F.sum(weight).alias("count"))


def gradient_norm(df: DataFrame, by: list[str], value: str, p: float = 2.0) -> DataFrame:
    """p-norm of norms; infinity is the largest."""
    x = F.abs(F.col(value))
    return df.groupBy(*by).agg((F.max(x) if p == float("inf") else F.pow(F.sum(F.pow(x, F.lit(p))), F.lit(1.0 / p))).alias("total_norm"))


def non_finite(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.isnan(value) | (F.abs(F.col(value)) == float("inf")))
