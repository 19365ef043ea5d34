"""Windows over image sequences: islands, splits, interval merges, offsets, trims, rolling figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list[str], number: str, out: str = "seq_no") -> DataFrame:
    """A new sequence starts unless a number follows the one before it; a repeated number starts one too."""
    w = Window.partitionBy(*by).orderBy(*order)
    start = F.coalesce(F.col(number) != F.lag(number).over(w) + 1, F.lit(True)).cast("long")
    df = df.withColumn(f"__{out}", start)
    return df.withColumn(out, F.sum(f"__{out}").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop(f"__{out}")


def append_directories(df: DataFrame, by: list[str], directory: str, order: list[str], number: str, out: str = "seq_id") -> DataFrame:
    """Sequences of several directories: those of one prefix follow each other in directory order and are never merged."""
    df = islands(df, [*by, directory], order, number, "__island")
    return df.withColumn(out, F.dense_rank().over(Window.partitionBy(*by).orderBy(directory, "__island")) - 1).drop("__island")


def split_long(df: DataFrame, by: list[str], order: list[str], limit: int = 50, piece: int = 15) -> DataFrame:
    """sub_no: pieces of sequences with more than limit images, null for the others; pos: place in the sequence."""
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("pos", pos).withColumn("sub_no", F.when(n > limit, F.floor(F.col("pos") / piece)).cast("int"))


def merge_intervals(df: DataFrame, by: list[str], lo: str, hi: str, tolerance: int, out: str = "group_no", ties: list[str] | None = None) -> DataFrame:
    """Number of the merged interval: a new one starts where lo exceeds the largest hi so far by more than tolerance."""
    w = Window.partitionBy(*by).orderBy(lo, *(ties or []))
    top = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn(f"__{out}", F.coalesce(F.col(lo) > top + tolerance, F.lit(True)).cast("long"))
    return df.withColumn(out, F.sum(f"__{out}").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop(f"__{out}")


def running_offsets(df: DataFrame, by: list[str], order: list[str], height: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("y1", F.sum(height).over(w)).withColumn("y0", F.col("y1") - F.col(height))


#: Rows of a strip in a cell of the interval join and of blended windows.
CELL = 256


def interval_pairs(left: DataFrame, right: DataFrame, by: str, lo: tuple[str, str], hi: tuple[str, str], reach: int = 0) -> DataFrame:
    """Pairs of rows of one sequence whose closed intervals come within reach. Both sides are dealt to cells of ``CELL`` rows,
    which are part of the join key, so a long strip isn't compared with itself whole; a pair counts in the first cell that
    both are in. The columns of both sides must differ, but for by."""
    cells = lambda df, a, b, name: df.withColumn(name, F.explode(F.sequence(F.floor((F.col(a) - reach) / CELL), F.floor(F.col(b) / CELL))))
    x = cells(left, lo[0], hi[0], "__cell").withColumn("__first", F.floor((F.col(lo[0]) - reach) / CELL))
    y = cells(right, lo[1], hi[1], "__cell").withColumn("__start", F.floor((F.col(lo[1]) - reach) / CELL))
    meet = (F.col(lo[0]) - reach <= F.col(hi[1])) & (F.col(lo[1]) - reach <= F.col(hi[0]))
    return x.join(y, [by, "__cell"]).where((F.col("__cell") == F.greatest("__first", "__start")) & meet).drop("__cell", "__first", "__start")


def images_without_target(images: DataFrame, targets: DataFrame, by: str) -> DataFrame:
    """Images [y0, y1) that no target [t0, t1) of their sequence overlaps. A target of one row overlaps nothing."""
    row = F.struct(*[F.col(c) for c in images.columns])
    x = images.where("y0 < y1").select(by, row.alias("__row"), F.col("y0").alias("__a"), (F.col("y1") - 1).alias("__b"))
    y = targets.where("t0 < t1").select(by, F.col("t0").alias("__c"), (F.col("t1") - 1).alias("__d"))
    hit = interval_pairs(x, y, by, ("__a", "__c"), ("__b", "__d")).select("__row").distinct()
    return images.join(hit, row.eqNullSafe(hit["__row"]), "left_anti")


def trim_blank(df: DataFrame, by: list[str], order: str, value: str, threshold: float = 10.0, keep_blank: bool = False) -> DataFrame:
    """Rows from the first to the last that isn't blank; inner blanks stay. A group of blanks goes (or stays whole)."""
    w = Window.partitionBy(*by)
    full = F.when(F.col(value) >= threshold, F.col(order))
    df = df.withColumn("__a", F.min(full).over(w)).withColumn("__b", F.max(full).over(w))
    inside = F.col(order).between(F.col("__a"), F.col("__b"))
    return df.where(F.coalesce(inside, F.lit(keep_blank))).drop("__a", "__b")


def rolling(df: DataFrame, by: list[str], order: list[str], value: str, size: int = 20) -> DataFrame:
    """Lower median, mean, maximum and last of the last ``size`` values, and the mean of all so far."""
    w = Window.partitionBy(*by).orderBy(*order)
    r = w.rowsBetween(-(size - 1), 0)
    xs = F.array_sort(F.collect_list(value).over(r))
    return df.withColumns({
        "win_median": F.element_at(xs, ((F.size(xs) + 1) / 2).cast("int")), "win_avg": F.avg(value).over(r), "win_max": F.max(value).over(r), "win_last": F.last(value).over(r),
        "global_avg": F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })


def cosine_schedule(spark, base: float, final: float, epochs: int, per_epoch: int, warmup_epochs: int = 0, start: float = 0.0, warmup_steps: int = -1) -> DataFrame:
    """step and value: a linear warm-up, then half a cosine."""
    total = epochs * per_epoch
    warm = warmup_steps if warmup_steps > 0 else warmup_epochs * per_epoch
    if warm > total:
        raise ValueError("the warm-up is longer than the schedule")
    s, rest = F.col("id").cast("double"), total - warm
    line = F.lit(start) + (base - start) * s / (warm - 1) if warm > 1 else F.lit(start)
    wave = F.lit(final) + 0.5 * (base - final) * (1 + F.cos(F.lit(3.141592653589793) * (s - warm) / max(rest, 1)))
    return spark.range(total).select(F.col("id").alias("step"), F.when(s < warm, line).otherwise(wave).alias("value"))


def plan_windows(df: DataFrame, height: str, chunk: int = 512, overlap: int = 64, merge_ratio: float = 0.0) -> DataFrame:
    """Overlapping windows [y0, y1) down a strip; a last window may take in a rest smaller than merge_ratio of a chunk."""
    stride = chunk - overlap
    if stride <= 0:
        raise ValueError("overlap must be smaller than the chunk, or the windows never end")
    h = F.col(height)
    last = F.greatest(F.ceil((h - chunk) / stride), F.lit(0))
    if merge_ratio > 0:
        rest = h - (last * stride + overlap)
        last = F.when((last > 0) & (rest < merge_ratio * chunk), last - 1).otherwise(last)
    out = df.withColumn("__last", last.cast("int")).withColumn("win_no", F.explode(F.sequence(F.lit(0), F.col("__last"))))
    y0 = F.col("win_no") * stride
    end = F.when(F.col("win_no") == F.col("__last"), h) if merge_ratio > 0 else F.lit(None)
    return out.withColumn("y0", y0.cast("long")).withColumn("y1", F.coalesce(end, F.least(h, y0 + chunk)).cast("long")).drop("__last")


def chunk_height(height: Column, most: int = 512, step: int = 512) -> Column:
    """The chunk height rule: clamp, then a multiple of step."""
    return (F.floor(F.greatest(F.least(height, F.lit(most)), F.lit(step)) / step) * step).cast("int")


def safe_size(width: Column, height: Column, most_w: int, most_h: int) -> tuple[Column, Column]:
    """Even dimensions that fit the box at the same aspect."""
    k = F.least(F.lit(1.0), most_w / width, most_h / height)
    even = lambda x: (F.floor(F.floor(x * k) / 2) * 2).cast("int")
    return even(width), even(height)


def blend_windows(runs: DataFrame, windows: DataFrame, by: str, overlap: int, mode: str = "mean") -> DataFrame:
    """Class of each row of a strip from overlapping windows. runs: by, win_no, r0, r1 (inclusive), class_id for a column
    or strip; windows: by, win_no, y0, y1, height. Weights fade linearly over inner edges. mean averages class ids, with
    rounding half to even; vote takes the class with most weight, ties to the smaller. Runs, cut at cells of ``CELL`` rows,
    are what is shuffled, so rows are made where they are added up and a long strip is spread."""
    df = runs.where("r0 <= r1").join(windows, [by, "win_no"]).withColumn("__cell", F.explode(F.sequence(F.floor(F.col("r0") / CELL), F.floor(F.col("r1") / CELL))))
    cut = F.sequence(F.greatest(F.col("r0"), F.col("__cell") * CELL), F.least(F.col("r1"), F.col("__cell") * CELL + (CELL - 1)))
    df = df.repartition(by, "__cell").withColumn("y", F.explode(cut))
    fade = F.least(F.lit(overlap), F.floor((F.col("y1") - F.col("y0")) / 2))
    up = F.when(F.col("y0") > 0, F.least((F.col("y") - F.col("y0") + 1) / fade, F.lit(1.0))).otherwise(1.0)
    down = F.when(F.col("y1") < F.col("height"), F.least((F.col("y1") - F.col("y")) / fade, F.lit(1.0))).otherwise(1.0)
    df = df.withColumn("w", F.when(fade > 0, F.least(up, down)).otherwise(1.0))
    if mode == "mean":
        return df.groupBy(by, "__cell", "y").agg(F.bround(F.round(F.sum(F.col("w") * F.col("class_id")) / F.sum("w"), 9), 0).cast("int").alias("class_id")).drop("__cell")
    votes = df.groupBy(by, "__cell", "y", "class_id").agg(F.sum("w").alias("w"))
    return votes.groupBy(by, "__cell", "y").agg(F.min_by("class_id", F.struct(-F.col("w"), "class_id")).alias("class_id")).drop("__cell")
