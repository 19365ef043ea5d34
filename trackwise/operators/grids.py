"""Token grids, patches, masks over tokens, and crop geometry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patch_box(pos: Column, side: int, patch: int) -> tuple[Column, Column, Column, Column]:
    """x0, y0, x1, y1 of a token's patch."""
    y, x = F.floor(pos / side).cast("int") * patch, (pos % side).cast("int") * patch
    return x, y, x + patch, y + patch


def masked_tokens(tokens: Column, mask: Column) -> Column:
    """Tokens whose mask is 1."""
    return F.filter(tokens, lambda t, i: F.get(mask, i) == 1)


def subset_rows(df: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Rows of the listed classes, and their new dense index."""
    index = classes.select(key).distinct().withColumn("new_index", F.row_number().over(Window.orderBy(key)) - 1)  # one row a class
    return df.join(index, key)


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by a keyed hash, without repeats while there are enough, else with."""
    have = df.count()
    if have >= n or not have:
        return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
    times = df.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(-(-n // have) - 1))))
    return times.orderBy("__t", F.xxhash64(F.lit(seed), key), key).limit(n).drop("__t")


def legend(df: DataFrame, cluster: str, most: int = 75) -> DataFrame:
    """Clusters with their sizes, noise last, at most so many."""
    n = df.groupBy(cluster).agg(F.count("*").alias("n"))
    return n.orderBy((F.col(cluster) < 0).cast("int"), cluster).limit(most)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that hangs on its parts alone, from a digest that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 2.0**32


def crop_geometry(df: DataFrame, key: str, width: str, height: str, scale=(0.08, 1.0), ratio=(3 / 4, 4 / 3), seed: int = 0, tries: int = 10) -> DataFrame:
    """A struct crop (i, j, h, w) inside each image. A crop's share of the area is uniform in scale and the logarithm of its
    aspect uniform in that of ratio; the first of the tries that fits counts, else the largest centred crop whose aspect is
    in ratio."""
    full_w, full_h = F.col(width).cast("double"), F.col(height).cast("double")
    draw = lambda t, k: uniform(F.lit(seed), F.col(key), t, F.lit(k))
    log_ratio = [float(np.log(r)) for r in ratio]

    def attempt(t: Column) -> Column:
        area = full_w * full_h * (scale[0] + (scale[1] - scale[0]) * draw(t, "area"))
        aspect = F.exp(log_ratio[0] + (log_ratio[1] - log_ratio[0]) * draw(t, "aspect"))
        return F.struct(t.alias("t"), F.round(F.sqrt(area * aspect)).alias("w"), F.round(F.sqrt(area / aspect)).alias("h"))

    inside = lambda c: c.w.between(1, full_w) & c.h.between(1, full_h)
    first = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), attempt), inside), F.lit(0))
    nearest = F.least(F.greatest(full_w / full_h, F.lit(ratio[0])), F.lit(ratio[1]))
    whole = F.struct(F.least(full_w, F.round(full_h * nearest)).alias("w"), F.least(full_h, F.round(full_w / nearest)).alias("h"))
    at = lambda room, k: F.floor(draw(F.col("__c.t"), k) * (room + 1))
    drawn = [at(full_h - F.col("__c.h"), "top"), at(full_w - F.col("__c.w"), "left"), F.col("__c.h"), F.col("__c.w")]
    centred = [F.floor((full_h - F.col("__f.h")) / 2), F.floor((full_w - F.col("__f.w")) / 2), F.col("__f.h"), F.col("__f.w")]
    box = lambda xs: F.struct(*[x.cast("int").alias(k) for k, x in zip("ijhw", xs, strict=True)])
    out = df.withColumn("__c", first).withColumn("__f", whole)
    return out.withColumn("crop", F.when(F.col("__c").isNotNull(), box(drawn)).otherwise(box(centred))).drop("__c", "__f")
