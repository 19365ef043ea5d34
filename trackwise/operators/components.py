"""Mask components: runs, labelling, filters, target groups, suppression, crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwise.scratch import Scratch

from .graph import min_label_components
from .sequences import interval_pairs, merge_intervals

# Class names by id, target patterns, channel rules.
CLASSES = ["background", "gearbox", "axle", "motor", "wheel", "air_duct"]
NEIGHBOURS_567 = [["wheel", "gearbox", "motor", "axle"], ["wheel", "gearbox", "axle"], ["wheel", "gearbox"], ["wheel", "axle", "motor"]]
DEFAULT_PATTERNS = [*NEIGHBOURS_567, ["wheel", "axle"]]
HEIGHT_567, HEIGHT_CRH5 = [["wheel", "axle"]], [["wheel", "gearbox"]]
#: channels, finder, patterns; None stands for all other channels.
RULES = [
    (["1", "2"], "none", []), (["3", "4", "8", "9", "L3", "L7"], "single", [["wheel"]]),
    (["5", "6", "7", "L4", "L5", "L6"], "connected", NEIGHBOURS_567), (["5", "6", "7", "L4", "L5", "L6"], "height", HEIGHT_567), (["5", "6", "7", "L4", "L5", "L6"], "single", [["air_duct"]]),
    (None, "connected", DEFAULT_PATTERNS),
]


def class_name(class_id: Column) -> Column:
    return F.get(F.array(*map(F.lit, CLASSES)), class_id.cast("int"))


def pixel_runs(pixels: DataFrame, by: str = "seq_id") -> DataFrame:
    """Runs of equal class along a row: by, class_id, row, col_start, col_end from by, class_id, row, col."""
    from pyspark.sql import Window

    w = Window.partitionBy(by, "class_id", "row").orderBy("col")
    df = pixels.distinct().withColumn("g", F.col("col") - F.row_number().over(w))
    return df.groupBy(by, "class_id", "row", "g").agg(F.min("col").alias("col_start"), F.max("col").alias("col_end")).drop("g")


def label_runs(runs: DataFrame, by: str = "seq_id") -> DataFrame:
    """8-connected labelling: runs with comp_id, the smallest run number of the component. Runs touch if their rows follow
    each other and their columns meet, corners included. Row numbers are part of the join key."""
    r = runs.withColumn("run", F.col("row").cast("long") * 1_000_000 + F.col("col_start"))
    a, b = r.alias("a"), r.select(by, "class_id", (F.col("row") - 1).alias("row"), "col_start", "col_end", "run").alias("b")
    touch = (F.col("b.col_start") <= F.col("a.col_end") + 1) & (F.col("b.col_end") >= F.col("a.col_start") - 1)
    edges = a.join(b, [by, "class_id", "row"]).where(touch).select(by, "class_id", F.col("a.run").alias("a"), F.col("b.run").alias("b"))
    own = r.select(by, "class_id", F.col("run").alias("a"), F.col("run").alias("b"))
    label = min_label_components(edges.union(own), [by, "class_id"])
    return r.join(label.withColumnRenamed("node", "run"), [by, "class_id", "run"]).withColumnRenamed("label", "comp_id").drop("run")


def describe_components(labelled: DataFrame, by: str = "seq_id") -> DataFrame:
    """One row a component: box (inclusive), pixels and truncated centroid."""
    n = F.col("col_end") - F.col("col_start") + 1
    mid = (F.col("col_start") + F.col("col_end")) * n / 2
    return labelled.groupBy(by, "class_id", "comp_id").agg(
        F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col_start").alias("min_col"), F.max("col_end").alias("max_col"), F.sum(n).alias("px"),
        F.floor(F.sum(F.col("row") * n) / F.sum(n)).alias("c_row"), F.floor(F.sum(mid) / F.sum(n)).alias("c_col"))


def in_pixel_range(components: DataFrame, ranges: DataFrame, large: Column | None = None) -> DataFrame:
    """kept: the pixel count is in its class's range, both ends included; ranges of large images count five times. A null
    upper end is open. ranges has one row a class."""
    k = F.when(large, 5).otherwise(1) if large is not None else F.lit(1)
    top = F.col("max_px") * k
    df = components.join(ranges.withColumnRenamed("class_id", "__c"), F.col("class_id") == F.col("__c"), "left").drop("__c")
    return df.withColumn("kept", F.coalesce((F.col("px") >= F.col("min_px") * k) & (top.isNull() | (F.col("px") <= top)), F.lit(True))).drop("min_px", "max_px")


def class_pixels(components: DataFrame, by: str = "seq_id") -> DataFrame:
    """Pixels and components of each class before and after the filter."""
    return components.groupBy(by, "class_id").agg(F.count("*").alias("n_before"), F.count_if("kept").alias("n_after"), F.sum("px").alias("px_before"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("px"))), F.lit(0)).alias("px_after"))


def height_groups(components: DataFrame, anchor: int, tolerance: int = 30, by: str = "seq_id") -> DataFrame:
    """Anchors of one class merged along rows, and every component within tolerance of one; a component may join many."""
    wheels = merge_intervals(components.where(F.col("class_id") == anchor), [by], "min_row", "max_row", tolerance, "group_no", ["comp_id"])
    groups = wheels.groupBy(by, "group_no").agg(F.min("min_row").alias("lo"), F.max("max_row").alias("hi"))
    return interval_pairs(groups, components, by, ("lo", "min_row"), ("hi", "max_row"), tolerance).select(by, "group_no", "comp_id", "class_id", "min_row", "max_row", "min_col", "max_col")


def with_pattern(members: DataFrame, patterns: list[list[str]], by: list[str]) -> DataFrame:
    """Groups whose classes hold a pattern: the number of the first such, the classes found, number of members and box."""
    names = class_name(F.col("class_id"))
    df = members.groupBy(*by).agg(F.array_sort(F.collect_set(names)).alias("found"), F.count("*").alias("n_comps"), F.min("min_row").alias("min_row"), F.max("max_row").alias("max_row"), F.min("min_col").alias("min_col"), F.max("max_col").alias("max_col"))
    hit = F.coalesce(*[F.when(F.size(F.array_except(F.array(*map(F.lit, p)), F.col("found"))) == 0, i) for i, p in enumerate(patterns)])
    return df.withColumn("pattern_no", hit).where("pattern_no is not null")


def near_pairs(runs: DataFrame, boxes: DataFrame, distance: float, by: str = "seq_id") -> DataFrame:
    """a, b: components of one sequence whose pixels come within distance. Padded boxes are compared first; then runs, whose
    distance is that of their nearest pixels. With distance 1 only shared edges count."""
    d = int(distance)
    x = boxes.select(by, *[F.col(c).alias(f"{c}_x") for c in ("comp_id", "min_row", "max_row", "min_col", "max_col")])
    y = boxes.select(by, *[F.col(c).alias(f"{c}_y") for c in ("comp_id", "min_row", "max_row", "min_col", "max_col")])
    box = (F.col("comp_id_x") < F.col("comp_id_y")) & (F.col("min_row_x") <= F.col("max_row_y") + d) & (F.col("min_row_y") <= F.col("max_row_x") + d) & (F.col("min_col_x") <= F.col("max_col_y") + d) & (F.col("min_col_y") <= F.col("max_col_x") + d)
    pairs = interval_pairs(x, y, by, ("min_row_x", "min_row_y"), ("max_row_x", "max_row_y"), d).where(box).select(by, F.col("comp_id_x").alias("a"), F.col("comp_id_y").alias("b"))
    r = lambda k: runs.select(by, F.col("comp_id").alias(k), F.col("row").alias(f"r{k}"), F.col("col_start").alias(f"s{k}"), F.col("col_end").alias(f"e{k}"))
    dr = F.abs(F.col("ra") - F.col("rb"))
    dc = F.greatest(F.lit(0), F.col("sb") - F.col("ea"), F.col("sa") - F.col("eb"))
    near = pairs.join(r("a"), [by, "a"]).join(r("b"), [by, "b"]).groupBy(by, "a", "b").agg(F.min(dr * dr + dc * dc).alias("d2"))
    return near.where(F.col("d2") <= distance * distance)


def box_pairs(boxes: DataFrame, distance: int, by: str = "seq_id") -> DataFrame:
    """a, b, d2: components whose boxes come within distance; for components that fill their boxes this is near_pairs."""
    c = ("comp_id", "min_row", "max_row", "min_col", "max_col")
    x, y = (boxes.select(by, *[F.col(k).alias(f"{k}_{s}") for k in c]) for s in "xy")
    gap = lambda k: F.greatest(F.lit(0), F.col(f"min_{k}_y") - F.col(f"max_{k}_x"), F.col(f"min_{k}_x") - F.col(f"max_{k}_y"))
    d2 = gap("row") * gap("row") + gap("col") * gap("col")
    pairs = interval_pairs(x, y, by, ("min_row_x", "min_row_y"), ("max_row_x", "max_row_y"), distance)
    return pairs.where((F.col("comp_id_x") < F.col("comp_id_y")) & (d2 <= distance * distance)).select(by, F.col("comp_id_x").alias("a"), F.col("comp_id_y").alias("b"), d2.alias("d2"))


def connected_groups(components: DataFrame, edges: DataFrame, anchor: int, distance: int, by: str = "seq_id") -> DataFrame:
    """Target groups of connected components. A part's label is the smallest number of the merged anchor groups in it;
    parts without an anchor go, and parts that share an anchor group are one."""
    own = components.select(by, F.col("comp_id").alias("a"), F.col("comp_id").alias("b"))
    part = min_label_components(edges.select(by, "a", "b").union(own), [by])
    seeds = merge_intervals(components.where(F.col("class_id") == anchor), [by], "min_row", "max_row", distance, "group_no", ["comp_id"]).select(by, F.col("comp_id").alias("node"), "group_no")
    # Anchors of one merged group belong together even where nothing touches.
    together = seeds.join(part, [by, "node"]).groupBy(by, "group_no").agg(F.min("label").alias("a"), F.collect_set("label").alias("l"))
    links = together.select(by, "a", F.explode("l").alias("b"))
    whole = min_label_components(links, [by])
    label = part.join(whole.select(by, F.col("node").alias("label"), F.col("label").alias("whole")), [by, "label"], "left").select(by, "node", F.coalesce("whole", "label").alias("part"))
    first = label.join(seeds, [by, "node"]).groupBy(by, "part").agg(F.min("group_no").alias("group_no"))
    return components.join(label.withColumnRenamed("node", "comp_id"), [by, "comp_id"]).join(first, [by, "part"]).drop("part")


def suppress_overlaps(groups: DataFrame, by: str, key: str, threshold: float = 0.1) -> DataFrame:
    """Greedy suppression: most components first, ties by key; a group stays unless its overlap over union with one that
    stays exceeds the threshold. Extents are ends minus starts, so boxes of one row or column are never duplicates. The
    groups of one sequence are folded in one array: tens, not millions."""
    item = F.struct((-F.col("n_comps")).alias("o"), F.col(key).alias("k"), *[F.col(c).cast("double").alias(c) for c in ("min_row", "max_row", "min_col", "max_col")])
    xs = groups.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    area = lambda g: (g.max_row - g.min_row) * (g.max_col - g.min_col)

    def iou(a, b):
        h = F.greatest(F.lit(0.0), F.least(a.max_row, b.max_row) - F.greatest(a.min_row, b.min_row))
        w = F.greatest(F.lit(0.0), F.least(a.max_col, b.max_col) - F.greatest(a.min_col, b.min_col))
        return F.coalesce(F.try_divide(h * w, area(a) + area(b) - h * w), F.lit(0.0))

    kept = F.aggregate("xs", F.filter("xs", lambda x: F.lit(False)), lambda acc, g: F.when(F.exists(acc, lambda k: iou(k, g) > threshold), acc).otherwise(F.array_append(acc, g)))
    return xs.select(by, F.explode(kept).alias("g")).select(by, F.col("g.k").alias(key))


def crop_boxes(groups: DataFrame, height: str, pad: int = 10) -> DataFrame:
    """Rows [cut_y0, cut_y1) of each group with padding, full width."""
    return groups.withColumn("cut_y0", F.greatest(F.lit(0), F.col("min_row") - pad)).withColumn("cut_y1", F.least(F.col(height), F.col("max_row") + pad + 1))


def rules_table(spark) -> DataFrame:
    """channel, finder, patterns; the row with a null channel is for channels not named."""
    rows = [(c, finder, patterns) for channels, finder, patterns in RULES for c in (channels or [None])]
    return spark.createDataFrame(rows, "channel string, finder string, patterns array<array<string>>")


def route(sequences: DataFrame) -> DataFrame:
    """Finders and patterns for each sequence (channel, train_group): channel rules, and the height rule of CRH5 trains
    except on channels without targets."""
    rules = rules_table(sequences.sparkSession)
    named = [c for channels, _, _ in RULES for c in channels or []]
    key = F.when(F.col("channel").isin(named), F.col("channel")).otherwise("*")
    own = sequences.withColumn("__k", key).join(rules.withColumn("__k", F.coalesce("channel", F.lit("*"))).drop("channel"), "__k").drop("__k")
    crh5 = sequences.where(F.col("train_group").contains("CRH5") & ~F.col("channel").isin("1", "2")).withColumn("finder", F.lit("height")).withColumn("patterns", F.array(F.array(*map(F.lit, HEIGHT_CRH5[0]))))
    return own.where("finder <> 'none'").unionByName(crh5)


def single_groups(components: DataFrame, class_id: int, by: str = "seq_id") -> DataFrame:
    """Every component of a class is a group of its own, numbered by place."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy("min_row", "min_col", "comp_id")
    return components.where(F.col("class_id") == class_id).withColumn("group_no", F.row_number().over(w) - 1)


def target_groups(sequences: DataFrame, components: DataFrame, distance: int = 5, tolerance: int = 30, by: str = "seq_id", edges: DataFrame | None = None) -> DataFrame:
    """The whole plan from filtered components to groups: rules by channel and train choose finders for each sequence, all
    groups found are one bag, and of overlapping ones those with most components stay. sequences: by, channel, train_group;
    by, finder, group_key, found, n_comps and the box."""
    plan, scratch = scratch_plan(sequences)
    wheel = CLASSES.index("wheel")
    cols = [by, "finder", "group_key", "found", "n_comps", "min_row", "max_row", "min_col", "max_col"]
    # Members by finder, each found once for all sequences that a rule sends there.
    sent = lambda finder: components.join(plan.where(F.col("finder") == finder).select(by).distinct(), by, "left_semi")
    linked = sent("connected")
    near = box_pairs(linked, distance, by).select(by, "a", "b") if edges is None else edges
    members = {"connected": scratch.put(connected_groups(linked, near, wheel, distance, by), "connected"), "height": scratch.put(height_groups(sent("height"), wheel, tolerance, by), "height")}
    every = None
    for finder, patterns in {(f, str(p)): (f, p) for _, f, p in [*RULES, (None, "height", HEIGHT_CRH5)] if f != "none"}.values():
        wanted = F.array(*[F.array(*map(F.lit, p)) for p in patterns])
        mine = plan.where((F.col("finder") == finder) & (F.col("patterns") == wanted)).select(by).distinct()
        rows = members[finder] if finder in members else single_groups(components, CLASSES.index(patterns[0][0]), by)
        found = with_pattern(rows.join(mine, by, "left_semi"), patterns, [by, "group_no"]).withColumn("finder", F.lit(finder))
        key = F.concat_ws(":", F.lit(finder), F.lit("-".join(patterns[0])), F.lpad(F.col("group_no").cast("string"), 9, "0"))
        found = found.withColumn("group_key", key).select(*cols)
        every = found if every is None else every.unionByName(found)
    every = scratch.put(every, "groups")
    return every.join(suppress_overlaps(every, by, "group_key"), [by, "group_key"], "left_semi")


def scratch_plan(sequences: DataFrame) -> tuple[DataFrame, Scratch]:
    """The routed sequences, written once, and the folder that they are in."""
    scratch = Scratch(sequences.sparkSession)
    return scratch.put(route(sequences), "plan"), scratch
