"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents fall into blocks by a hash of the id. A source's target is a number of whole passes over it plus
a rest; the rest is drawn as whole blocks in permuted order and, from the block in which it ends, documents in permuted
order, each that still fits and one more if that comes nearer. The number of blocks that each source contributes (its
quota) is split exactly over the output shards by a binary tree whose every node draws, without replacement, how many
blocks of each source go left. A source's permuted blocks are then dealt to the shards by those numbers, disjointly, and
each shard is shuffled locally by a keyed hash. Reruns agree: all draws hang on the seed and on ids.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating, and share 150 % of all words; a target stops at
twice its source's size and the excess is reshared by weight.

Defined results: null or blank text has size 0 and is taken 0 words; a null source is a source of its own, the last; rows
with a null id are known by their text; repeated rows (same id, text and source) are drawn together; ties in a permuted
order go to the smaller id; texts of any length count whole; an empty table gives an empty result; other columns are not
read and keep their names and values, ``mix`` names its own after them. Per-source tables have one row a source and at most
``MAX_BLOCKS`` a source and pass; the tree splits the quotas of some ``GROUP`` sources at a time, so its numbers stay far
below numpy's bound of 10^9 and its memory doesn't grow with the number of sources.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, words

SEED = 20240229
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, TOP = 1.5, 2.0
BLOCK_ROWS, MAX_BLOCKS = 256, 1 << 16
SHARDS, GROUP = 32, 1024


def targets(rows: DataFrame) -> DataFrame:
    """One row a source: sk (its key), words, n_rows, target. Water filling: sources in order of cap over weight are at
    their cap as long as the level that the others would share is above it."""
    per = rows.groupBy("sk").agg(F.sum("size").alias("words"), F.count("*").alias("n_rows"))
    order = Window.orderBy(F.col("sk").startswith("n"), "sk")  # one row a source
    per = per.withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS)).cast("int")))
    level = Window.orderBy(F.col("words") / F.col("weight"), "sk").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    cap = TOP * F.col("words")
    left = SHARE * F.sum("words").over(every) - F.coalesce(F.sum(cap).over(level), F.lit(0.0))
    share = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(level), F.lit(0.0)))
    per = per.withColumn("cap", cap).withColumn("share", share).withColumn("full", F.col("cap") <= F.col("share") * F.col("weight"))
    common = F.max(F.when(~F.col("full"), F.col("share"))).over(every)
    return per.select("sk", "words", "n_rows", F.when(F.col("full"), F.col("cap")).otherwise(common * F.col("weight")).alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source in each shard (sources by shards): row sums are the quotas, shards' totals differ by one."""
    out = np.zeros((len(quotas), shards), np.int64)

    def node(q: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = q
            return
        mid = (lo + hi) // 2
        total = int(q.sum())
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(q, (total * (mid - lo) + (hi - lo) // 2) // (hi - lo), method="marginals") if total else q
        node(left, lo, mid)
        node(q - left, mid, hi)

    if len(quotas):
        node(quotas.astype(np.int64), 0, shards)
    return out


def _ranges(shards: int, seed: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        q = frame.sort_values("sk").reset_index(drop=True)
        ends = split_quotas(q["quota"].to_numpy(), shards, seed + int(key[0])).cumsum(1)
        starts = np.concatenate([np.zeros((len(q), 1), np.int64), ends[:, :-1]], 1)
        s, k = np.nonzero(ends > starts)
        return pd.DataFrame({"sk": q["sk"].to_numpy()[s], "shard": k.astype(np.int32), "lo": starts[s, k], "hi": ends[s, k]})

    return run


def _draw(frame: pd.DataFrame) -> pd.DataFrame:
    """The documents of a source's last block that its rest takes, in permuted order, repeated rows together."""
    frame = frame.sort_values(["ord", "doc_id", "mark"], na_position="last").reset_index(drop=True)
    ids = frame["doc_id"].astype("float64").fillna(-1) if frame["doc_id"].isna().any() else frame["doc_id"]
    first = (ids != ids.shift()) | (frame["mark"] != frame["mark"].shift()) | (frame["doc_id"].isna() != frame["doc_id"].isna().shift())
    unit = first.cumsum().to_numpy() - 1
    sizes = np.bincount(unit, frame["size"].to_numpy())
    need, got = float(frame["need"].iloc[0]), 0.0
    chosen = np.zeros(len(sizes), bool)
    for i, x in enumerate(sizes):
        if got + x <= need:
            chosen[i] = True
            got += x
    rest = np.flatnonzero(~chosen)
    if len(rest):
        least = rest[sizes[rest].argmin()]
        chosen[least] = need - got > abs(got + sizes[least] - need)
    return frame.assign(chosen=chosen[unit])[["doc_id", "mark", "sk", "size", "block", "chosen"]]


def _source_key(docs: DataFrame, source: str) -> Column:
    return F.coalesce(F.concat(F.lit("a"), docs[source].cast("string")), F.lit("n"))


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, mark (a hash of the text), sk (the source's key), size, source_size, target, copies, taken and shards (the shard of each copy)."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(docs[key].alias("doc_id"), F.xxhash64(docs[text]).alias("mark"), _source_key(docs, source).alias("sk"), F.size(words(docs[text])).cast("long").alias("size"))
    rows = scratch.put(rows, "rows")
    src = targets(rows).withColumn("passes", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("int"))
    src = src.withColumn("need", F.col("target") - F.col("passes") * F.col("words"))
    src = scratch.put(src.withColumn("blocks", F.least(F.ceil(F.col("n_rows") / BLOCK_ROWS), F.lit(MAX_BLOCKS)).cast("long")), "sources")
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("mark"))), F.col("blocks"))
    rows = rows.join(src.select("sk", "words", "target", "passes", "need", "blocks"), "sk").withColumn("block", block)
    per = rows.groupBy("sk", "block").agg(F.sum("size").alias("block_words"), F.first("passes").alias("passes"), F.first("need").alias("need"))
    order = Window.partitionBy("sk").orderBy(F.xxhash64(F.lit(seed + 1), "sk", "block"), "block")
    before = F.coalesce(F.sum("block_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("before", before).withColumn("whole", F.col("before") + F.col("block_words") <= F.col("need"))
    per = per.withColumn("part", ~F.col("whole") & (F.col("before") < F.col("need")))
    per = scratch.put(per.select("sk", "block", "passes", "whole", "part", (F.col("need") - F.col("before")).alias("left")), "blocks")
    # The quota of a source: its block copies. Their permuted order, and the shards that the tree gives them.
    copies = per.withColumn("n", F.col("passes") + (F.col("whole") | F.col("part")).cast("int")).where("n > 0").select("sk", "block", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("pass"))
    copies = scratch.put(copies.withColumn("rank", F.row_number().over(Window.partitionBy("sk").orderBy(F.xxhash64(F.lit(seed + 2), "sk", "block", "pass"), "block", "pass")) - 1), "copies")
    quotas = copies.groupBy("sk").agg(F.count("*").alias("quota"))
    groups = max(1, -(-src.count() // GROUP))
    ranges = quotas.groupBy(F.pmod(F.xxhash64("sk"), F.lit(groups)).alias("g")).applyInPandas(_ranges(shards, seed), "sk string, shard int, lo long, hi long")
    dealt = copies.join(ranges, ["sk"]).where("rank >= lo and rank < hi").groupBy("sk", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))
    plan = per.join(dealt, ["sk", "block"], "left").select("sk", "block", "whole", "part", "left", F.coalesce(F.transform("dealt", lambda x: x.shard), F.array().cast("array<int>")).alias("shards"))
    plan = scratch.put(plan, "plan")
    rows = rows.join(plan, ["sk", "block"])
    last = rows.where("part").select("doc_id", "mark", "sk", "size", "block", F.col("left").cast("double").alias("need"), F.xxhash64(F.lit(seed + 3), "doc_id", "mark").alias("ord"))
    drawn = last.groupBy("sk", "block").applyInPandas(_draw, "doc_id long, mark long, sk string, size long, block long, chosen boolean")
    drawn = drawn.join(src.select("sk", "words", "target", "passes"), "sk").join(plan.select("sk", "block", "shards"), ["sk", "block"])
    cols = ["doc_id", "mark", "sk", "size", "words", "target", "shards"]
    out = rows.where("not part").select(*cols, (F.col("passes") + F.col("whole").cast("int")).alias("copies")).unionByName(drawn.select(*cols, (F.col("passes") + F.col("chosen").cast("int")).alias("copies")))
    return out.select("doc_id", "mark", "sk", "size", F.col("words").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.slice("shards", F.lit(1), F.col("copies")).alias("shards"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: docs' columns and mix_shard, mix_order (with underscores added where docs has such columns); a
    document appears once for each copy taken. Sorting each shard by mix_order is its local shuffle; write with
    partitionBy("mix_shard")."""
    shard, order, name = fresh(docs, "mix_shard"), fresh(docs, "mix_order"), fresh(docs, "__mix")
    plan = mixture(docs, key, text, source, shards, seed).where("copies > 0").dropDuplicates(["doc_id", "mark", "sk"])
    plan = plan.select(F.col("doc_id").alias(f"{name}_i"), F.col("mark").alias(f"{name}_m"), F.col("sk").alias(f"{name}_s"), F.posexplode("shards").alias(f"{name}_p", shard))
    out = docs.join(plan, docs[key].eqNullSafe(plan[f"{name}_i"]) & (F.xxhash64(docs[text]) == plan[f"{name}_m"]) & (_source_key(docs, source) == plan[f"{name}_s"]))
    return out.withColumn(order, F.xxhash64(F.lit(seed + 4), shard, f"{name}_i", f"{name}_m", f"{name}_p")).drop(*[f"{name}_{x}" for x in "imsp"])
