"""Tables of parameter names: routing to layers, groups, key filters and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parameters before the first block.
FIRST = ["cls_token", "mask_token", "pos_embed"]


def layer_id(name: Column, n_layers: int) -> Column:
    """0 for tokens, positions and the patch embedding; block k + 1; the last layer for shared positions and the rest."""
    block = F.regexp_extract(name, r"^blocks\.(\d+)\.", 1).try_cast("int")
    return F.when(name.isin(FIRST) | name.startswith("patch_embed"), 0).when(name.startswith("rel_pos_bias"), n_layers - 1).otherwise(F.coalesce(block + 1, F.lit(n_layers - 1)))


def parameter_groups(df: DataFrame, name: str, n_dims: str, n_layers: int, skip: list[str] | None = None) -> DataFrame:
    """layer, decay, names: biases, vectors and listed names have no weight decay."""
    plain = (F.col(n_dims) <= 1) | F.col(name).endswith(".bias") | F.col(name).isin(skip or [])
    df = df.withColumn("layer", layer_id(F.col(name), n_layers)).withColumn("decay", ~plain)
    return df.groupBy("layer", "decay").agg(F.array_sort(F.collect_list(name)).alias("names"))


def strip_prefix(df: DataFrame, name: str, keep: str, drop: list[str] | None = None) -> DataFrame:
    """Names that begin with keep, without it, and none that begins with a dropped prefix."""
    out = df.where(F.col(name).startswith(keep)).withColumn(name, F.substring(F.col(name), F.lit(len(keep) + 1), F.length(name)))
    for p in drop or []:
        out = out.where(~F.col(name).startswith(p))
    return out


def missing(want: DataFrame, have: DataFrame, name: str, ignore: list[str] | None = None) -> DataFrame:
    """Wanted names that aren't there and match no ignored pattern."""
    out = want.join(have, name, "left_anti")
    for p in ignore or []:
        out = out.where(~F.col(name).contains(p))
    return out.select(name).distinct()


def schedule_figures(df: DataFrame, by: list[str], lr: str, decay: str, order: str) -> DataFrame:
    """Smallest and largest learning rate, and the last positive weight decay."""
    return df.groupBy(*by).agg(F.max(lr).alias("lr"), F.min(lr).alias("min_lr"), F.max_by(decay, F.when(F.col(decay) > 0, F.col(order))).alias("weight_decay"))


def scaled_rate(lr: Column, batch: Column, base: int = 256) -> Column:
    return lr * batch / base
