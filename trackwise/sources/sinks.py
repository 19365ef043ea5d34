"""Sinks: JSON and CSV reports, logs, path maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "errorifexists") -> None:
    """JSON lines; null fields are left out, which keeps union records apart."""
    (df.orderBy(*order) if order else df).write.mode(mode).json(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """One JSON object for each epoch, added to those that are there."""
    df.write.mode("append").json(path)


def scalars(df: DataFrame, head: str, step: str) -> DataFrame:
    """Numeric columns as (head, key, step, value) rows, nulls left out."""
    keys = [f.name for f in df.schema.fields if f.name != step and f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in keys])
    return df.select(F.lit(head).alias("head"), F.explode(pairs).alias("p"), F.col(step).alias("step")).select("head", "p.key", "step", "p.value").where("value is not null")


def cluster_paths(df: DataFrame, path: str, name: str, root: str) -> DataFrame:
    """Where each sample folder goes: root/<cluster name>/<grandparent>_<parent>_<name>; collisions are counted."""
    from pyspark.sql import Window

    parts = F.split(F.col(path), "/")
    target = F.concat_ws("/", F.lit(root), F.col(name), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), "_"))
    return df.withColumn("target", target).withColumn("copies", F.count("*").over(Window.partitionBy("target")))


def latest_suffix(df: DataFrame, path: str, stem: str = "checkpoint") -> DataFrame:
    """The checkpoint to resume from: the one without a number, else the one with the largest."""
    n = F.regexp_extract(path, rf"{stem}-(\d+)\.\w+$", 1).try_cast("long")
    plain = F.col(path).rlike(rf"{stem}\.\w+$")
    return df.where(plain | n.isNotNull()).agg(F.max_by(path, F.coalesce(F.when(plain, F.lit(2**62)), n)).alias("resume"))


def copy_list(df: DataFrame, path: str, order: list[str], root: str) -> DataFrame:
    """path and target root/<name> of the files to copy; of files with one name the last in order is left."""
    name = F.regexp_extract(path, r"[^/]+$", 0)
    rows = df.select(F.concat(F.lit(root.rstrip("/") + "/"), name).alias("target"), F.struct(*order, F.col(path).alias("p")).alias("last"))
    return rows.groupBy("target").agg(F.max("last").alias("last")).select(F.col("last.p").alias("path"), "target")


def log_lines(df: DataFrame, path: str, level: str = "level") -> DataFrame:
    """Appends all lines to a log and returns the errors."""
    df.write.mode("append").json(path)
    return df.where(F.col(level) == "ERROR")
