"""Codebooks, neighbours and clustering over feature tables. Codebooks are small sides: their size is checked."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwise.functions import vectors as V

from .graph import _cut, min_label_components

#: Rows of a codebook, cluster sample or block of a table that are broadcast at once at most.
MAX_CODES = 65_536


def _matrix(df: DataFrame, key: str, vec: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a small table, in order of key; a larger one is an error."""
    rows = df.select(F.col(key).cast("long").alias("k"), V.doubles(F.col(vec)).alias("v")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: cluster a sample and assign the rest, or index the codebook")
    rows.sort(key=lambda r: r["k"])
    return np.array([r["k"] for r in rows], np.int64), np.array([r["v"] for r in rows], float)


def _blocks(df: DataFrame, key: str, vec: str, limit: int):
    """Keys and vectors of a table of any size, which the driver holds one block of limit rows of at a time; at least one
    block, each in order of key."""
    rows, first = df.select(F.col(key).cast("long").alias("k"), V.doubles(F.col(vec)).alias("v")).toLocalIterator(), True
    while (part := list(islice(rows, limit))) or first:
        first = False
        part.sort(key=lambda r: r["k"])
        yield np.array([r["k"] for r in part], np.int64), np.array([r["v"] for r in part], float)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0)


BLOCK = 1024


def nearest_code(df: DataFrame, vec: str, codes: DataFrame, code: str = "code_id", code_vec: str = "vec") -> DataFrame:
    """code and dist2: the nearest code of each row, ties to the smaller id. The codebook, whose size is checked, is
    broadcast once; rows meet it in blocks of a matrix product, so no pair of rows is ever made."""
    ids, book = _matrix(codes, code, code_vec, MAX_CODES)
    shared = df.sparkSession.sparkContext.broadcast((ids, book))

    @F.pandas_udf("code long, dist2 double")
    def near(vecs: pd.Series) -> pd.DataFrame:
        keys, c = shared.value
        x = np.array(vecs.tolist(), float)
        got, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
        for a in range(0, len(x), BLOCK):
            part = x[a : a + BLOCK]
            best = np.round(_squares(part, c), 9).argmin(1)
            got[a : a + BLOCK], dist[a : a + BLOCK] = keys[best], ((part - c[best]) ** 2).sum(1)
        return pd.DataFrame({"code": got, "dist2": dist})

    return df.withColumn("__near", near(F.col(vec))).withColumn("code", F.col("__near.code")).withColumn("dist2", F.col("__near.dist2")).drop("__near")


def code_usage(assigned: DataFrame, n_codes: int, code: str = "code") -> DataFrame:
    """One row: codes, used and unused codes, and the share of unused ones in percent."""
    counts = assigned.groupBy(F.col(code).cast("long").alias("id")).agg(F.count("*").alias("n"))
    every = assigned.sparkSession.range(n_codes).join(counts, "id", "left")
    return every.agg(F.count("*").alias("n_codes"), F.count("n").alias("n_used"), F.count_if(F.col("n").isNull()).alias("n_unused"), (100.0 * F.count_if(F.col("n").isNull()) / F.count("*")).alias("pct_unused"))


def code_sums(assigned: DataFrame, vec: str, code: str = "code") -> DataFrame:
    """Count and mean vector of each code: sums by code and place, partial first."""
    flat = assigned.select(code, F.posexplode(vec).alias("pos", "x")).groupBy(code, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    return flat.groupBy(code).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("xs")).select(code, "n", F.transform("xs", lambda x: x.s / F.col("n")).alias("mean"))


def ema_codebook(codes: DataFrame, assigned: DataFrame, vec: str, decay: float = 0.99) -> DataFrame:
    """code_id, vec, cluster_size after one step: moving averages to unit norm; empty codes keep their vector."""
    got = code_sums(assigned, vec).withColumnRenamed("code", "code_id")
    df = codes.join(got, "code_id", "left")
    size = F.col("cluster_size") * decay + F.coalesce(F.col("n"), F.lit(0)) * (1 - decay)
    new = F.when(F.col("n").isNull(), V.doubles(F.col("vec"))).otherwise(V.ema(V.doubles(F.col("vec")), V.l2norm(F.col("mean")), decay, unit=True))
    return df.select("code_id", new.alias("vec"), size.alias("cluster_size"))


def laplace_sizes(codes: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Smoothed cluster sizes that keep their sum."""
    every = Window.partitionBy()
    n, k = F.sum("cluster_size").over(every), F.count("*").over(every)
    return codes.withColumn("smoothed", (F.col("cluster_size") + eps) / (n + k * eps) * n)


def lloyd_step(df: DataFrame, vec: str, codes: DataFrame, cosine: bool = True) -> DataFrame:
    """One step of k-means: nearest code, means (unit norm for cosine), empty codes keep theirs."""
    got = code_sums(nearest_code(df, vec, codes), vec).withColumnRenamed("code", "code_id")
    mean = V.l2norm(F.col("mean")) if cosine else F.col("mean")
    return codes.join(got, "code_id", "left").select("code_id", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"), F.when(F.col("n").isNull(), V.doubles(F.col("vec"))).otherwise(mean).alias("vec"))


def pairs_within(df: DataFrame, key: str, vec: str, distance: float, limit: int = MAX_CODES) -> DataFrame:
    """a, b, dist for the pairs within distance: rows in blocks against the whole table, which is broadcast limit rows at a
    time."""
    rows, out = df.select(F.col(key).cast("long").alias("a"), V.doubles(F.col(vec)).alias("v")), None

    def against(shared):
        def run(frames):
            keys, y = shared.value
            for f in frames:
                for a in range(0, len(f), BLOCK):
                    own = f["a"].to_numpy()[a : a + BLOCK]
                    d = np.sqrt(_squares(np.array(f["v"].tolist()[a : a + BLOCK], float), y))
                    i, j = np.nonzero(d <= distance)
                    yield pd.DataFrame({"a": own[i], "b": keys[j], "dist": d[i, j]})

        return run

    for block in _blocks(df, key, vec, limit):
        shared = df.sparkSession.sparkContext.broadcast(block)
        part = rows.mapInPandas(against(shared), "a long, b long, dist double")
        if len(block[0]) == limit:  # more may follow
            part = _cut(part)
            shared.destroy()
        out = part if out is None else out.union(part)
    return out


def kth_distance(df: DataFrame, key: str, vec: str, k: int, limit: int = MAX_CODES) -> DataFrame:
    """Distance to the k-th neighbour, the point itself being the first: rows keep their k smallest distances while the
    whole table, limit rows at a time, is broadcast. Null in a table of fewer than k rows."""
    out = df.select(F.col(key).cast("long").alias(key), V.doubles(F.col(vec)).alias("v"), F.array().cast("array<double>").alias("near"))

    def against(shared):
        def run(frames):
            y = shared.value
            for f in frames:
                for a in range(0, len(f), BLOCK):
                    part = f.iloc[a : a + BLOCK]
                    d = np.hstack([np.array(part["near"].tolist(), float).reshape(len(part), -1), np.sqrt(_squares(np.array(part["v"].tolist(), float), y))])
                    d = np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d
                    yield pd.DataFrame({key: part[key].to_numpy(), "v": part["v"].to_numpy(), "near": list(np.sort(d, 1))})

        return run

    for ids, block in _blocks(df, key, vec, limit):
        shared = df.sparkSession.sparkContext.broadcast(block)
        out = out.mapInPandas(against(shared), f"`{key}` long, v array<double>, near array<double>")
        if len(ids) == limit:  # more may follow
            out = _cut(out)
            shared.destroy()
    return out.select(key, F.get("near", F.lit(k - 1)).alias("kth"))


def auto_eps(df: DataFrame, key: str, vec: str, k: int, pct: float = 0.85) -> DataFrame:
    """One row: a linear percentile of the k-th neighbour distances."""
    return kth_distance(df, key, vec, k).agg(F.percentile("kth", F.lit(pct)).alias("eps"))


def dbscan(df: DataFrame, key: str, vec: str, eps: float, min_samples: int) -> DataFrame:
    """key and cluster: dense numbers from 0 in order of the smallest core point, -1 for noise. A border point goes to the
    smallest cluster that reaches it."""
    near = pairs_within(df, key, vec, eps)
    core = near.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select("a")
    edges = near.join(core, "a").join(core.withColumnRenamed("a", "b"), "b").select("a", "b")
    label = min_label_components(edges)
    number = label.select("label").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("label")) - 1)  # one row a cluster
    label = label.join(number, "label").select(F.col("node").alias("b"), "cluster")
    best = near.join(label, "b").groupBy("a").agg(F.min("cluster").alias("border")).withColumnRenamed("a", key)
    own = label.select(F.col("b").alias(key), F.col("cluster").alias("own"))
    return df.select(key).join(own, key, "left").join(best, key, "left").select(key, F.coalesce("own", "border", F.lit(-1)).cast("int").alias("cluster"))


def pca(df: DataFrame, vec: str, k: int, scaled: bool = True) -> tuple[DataFrame, list[float]]:
    """df with pca (array) and the explained variances; z-scores with the population deviation, centred before."""
    df = df.withColumn("__v", array_to_vector(V.doubles(F.col(vec))))
    std = StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=scaled).fit(df)
    n = df.count()
    fit = PCA(k=k, inputCol="__s", outputCol="__p").fit(std.transform(df))
    grow = (n / (n - 1)) ** 0.5 if scaled and n > 1 else 1.0
    out = fit.transform(std.transform(df)).withColumn("pca", F.transform(vector_to_array("__p"), lambda x: x * grow))
    return out.drop("__v", "__s", "__p"), [float(x) for x in fit.explainedVariance]


def kmeans(df: DataFrame, vec: str, k: int, seed: int = 42, iterations: int = 500, cosine: bool = False) -> DataFrame:
    df = df.withColumn("__v", array_to_vector(V.doubles(F.col(vec))))
    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="__v", predictionCol="cluster", distanceMeasure="cosine" if cosine else "euclidean").fit(df)
    return model.transform(df).drop("__v")


def bisecting(df: DataFrame, vec: str, k: int, seed: int = 42) -> DataFrame:
    """A hierarchical clustering that scales; not the same algorithm as Ward's."""
    df = df.withColumn("__v", array_to_vector(V.doubles(F.col(vec))))
    return BisectingKMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(df).transform(df).drop("__v")


SAMPLE_ROWS = 5000


def _sampled(df: DataFrame, key: str, vec: str, run, limit: int) -> DataFrame:
    """key and cluster of every row. Up to limit rows are clustered exactly; of a larger table the limit rows of smallest
    key hash are, and every other row takes the cluster of the sampled row nearest to it."""
    small = df.select(F.col(key).cast("long").alias("key"), V.doubles(F.col(vec)).alias("v"))
    fit = lambda rows: rows.groupBy().applyInPandas(run, "key long, cluster int")
    if small.limit(limit + 1).count() <= limit:
        return fit(small).withColumnRenamed("key", key)
    small = _cut(small)
    sample = _cut(small.orderBy(F.xxhash64("key"), "key").limit(limit))
    got = _cut(fit(sample))
    rest = nearest_code(small.join(F.broadcast(got), "key", "left_anti"), "v", sample, "key", "v").select("key", "code")
    rest = rest.join(F.broadcast(got.withColumnRenamed("key", "code")), "code").select("key", "cluster")
    return got.union(rest).withColumnRenamed("key", key)


def ward(df: DataFrame, key: str, vec: str, k: int, limit: int = SAMPLE_ROWS) -> DataFrame:
    """Ward's agglomerative clustering, by nearest-neighbour chains of cluster means; over limit rows that of a sample, with
    the other rows assigned to it."""

    def run(pdf):
        pdf = pdf.sort_values("key").reset_index(drop=True)
        x, n = np.array(pdf["v"].tolist(), float), len(pdf)
        size, alive, parent = np.ones(n), np.ones(n, bool), np.arange(n)
        merges: list = []
        chain: list[int] = []
        while alive.sum() > 1:
            if not chain:
                chain.append(int(np.flatnonzero(alive)[0]))
            i = chain[-1]
            d = ((x - x[i]) ** 2).sum(1) * size * size[i] / (size + size[i])
            d[~alive] = np.inf
            d[i] = np.inf
            j = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[j]:
                j = chain[-2]
                chain = chain[:-2]
                a, b = min(i, j), max(i, j)
                merges.append((float(d[j]), a, b))
                x[a] = (x[a] * size[a] + x[b] * size[b]) / (size[a] + size[b])
                size[a] += size[b]
                alive[b] = False
            else:
                chain.append(j)
        for _, a, b in sorted(merges)[: max(0, n - k)]:
            ra, rb = a, b
            while parent[ra] != ra:
                ra = parent[ra]
            while parent[rb] != rb:
                rb = parent[rb]
            parent[max(ra, rb)] = min(ra, rb)
        root = np.arange(n)
        for i in range(n):
            r = i
            while parent[r] != r:
                r = parent[r]
            root[i] = r
        pdf["cluster"] = np.unique(root, return_inverse=True)[1].astype(np.int32)
        return pdf[["key", "cluster"]]

    return _sampled(df, key, vec, run, limit)


def hdbscan(df: DataFrame, key: str, vec: str, min_cluster: int, min_samples: int, limit: int = SAMPLE_ROWS) -> DataFrame:
    """Density hierarchy: mutual reachability, spanning tree, condensed tree, most stable clusters; -1 is noise. Over limit
    rows it is that of a sample, with the other rows assigned to it."""

    def run(pdf):
        pdf = pdf.sort_values("key").reset_index(drop=True)
        x, n = np.array(pdf["v"].tolist(), float), len(pdf)
        if not n:
            return pdf.assign(cluster=np.zeros(0, np.int32))[["key", "cluster"]]
        d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
        core = np.sort(d, 1)[:, min(min_samples, n) - 1]
        d = np.maximum(d, np.maximum(core[:, None], core[None]))
        inside, best, frm = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
        tree, at = [], 0
        for _ in range(n - 1):
            inside[at] = True
            closer = ~inside & (d[at] < best)
            best[closer], frm[closer] = d[at][closer], at
            at = int(np.where(inside, np.inf, best).argmin())
            tree.append((best[at], frm[at], at))
        tree.sort()
        top, kids, size, high = list(range(n)), {}, [1] * n, [0.0] * n
        group = list(range(n))

        def find(i):
            while group[i] != i:
                group[i] = group[group[i]]
                i = group[i]
            return i

        for w, a, b in tree:
            ra, rb = find(a), find(b)
            new = len(group)
            group.append(new)
            group[ra] = group[rb] = new
            kids[new], high_new = (ra, rb), w
            size.append(size[ra] + size[rb])
            high.append(high_new)
        del top
        # Condensed tree, from the root down.
        label, stab, parent, members, leaves = 0, {0: 0.0}, {0: None}, {0: []}, []
        stack = [(len(group) - 1, 0, 0.0)]
        while stack:
            node, c, birth = stack.pop()
            if node not in kids:
                continue
            lam = 1 / high[node] if high[node] > 0 else 1e12
            a, b = kids[node]
            big = [k for k in (a, b) if size[k] >= min_cluster]
            if len(big) == 2:
                stab[c] += (lam - birth) * size[node]
                for k in (a, b):
                    label += 1
                    stab[label], parent[label], members[label] = 0.0, c, []
                    stack.append((k, label, lam))
            else:
                for k in (a, b):
                    if k in big:
                        stack.append((k, c, birth))
                    else:
                        leaf = [k]
                        while leaf:
                            m = leaf.pop()
                            if m in kids:
                                leaf += kids[m]
                            else:
                                members[c].append(m)
                                stab[c] += lam - birth
            leaves.append(c)
        chosen, total = {c: True for c in stab}, dict(stab)
        for c in sorted(stab, reverse=True):
            below = [k for k, p in parent.items() if p == c]
            if below and sum(total[k] for k in below) > stab[c] or c == 0:
                chosen[c] = False
                total[c] = sum(total[k] for k in below)
            else:
                todo = list(below)
                while todo:
                    k = todo.pop()
                    chosen[k] = False
                    todo += [q for q, p in parent.items() if p == k]
        out, number = np.full(n, -1, np.int32), 0
        for c in sorted(chosen):
            if chosen[c]:
                todo = [c]
                while todo:
                    k = todo.pop()
                    out[members[k]] = number
                    todo += [q for q, p in parent.items() if p == k]
                number += 1
        return pdf.assign(cluster=out)[["key", "cluster"]]

    return _sampled(df, key, vec, run, limit)


BLOCK_TRIES = 64


def _noise(keys: np.ndarray, seed: int, count: int) -> np.ndarray:
    """Numbers in [0, 1) for each key, from its bits alone."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(count, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def block_masks(df: DataFrame, key: str, height: int, width: int, n_masked: int, min_block: int = 16, max_block: int | None = None, seed: int = 0) -> DataFrame:
    """key and mask (height * width of 0 and 1, n_masked ones). Every row has ``BLOCK_TRIES`` candidate rectangles, all drawn
    at once; they are laid down in order as long as the mask doesn't exceed n_masked; then the patches of smallest noise fill
    it to the exact number."""
    most = max_block or n_masked

    def masks(keys: np.ndarray) -> np.ndarray:
        noise = _noise(keys, seed, 4 * BLOCK_TRIES + height * width)
        area = min_block + (most - min_block) * noise[:, :BLOCK_TRIES]
        aspect = np.exp((2 * noise[:, BLOCK_TRIES : 2 * BLOCK_TRIES] - 1) * np.log(10 / 3))
        tall = np.clip(np.rint(np.sqrt(area * aspect)), 1, height)
        wide = np.clip(np.rint(np.sqrt(area / aspect)), 1, width)
        top = np.floor(noise[:, 2 * BLOCK_TRIES : 3 * BLOCK_TRIES] * (height - tall + 1))
        left = np.floor(noise[:, 3 * BLOCK_TRIES : 4 * BLOCK_TRIES] * (width - wide + 1))
        y, x = (g.ravel()[None, :] for g in np.mgrid[:height, :width])
        mask = np.zeros((len(keys), height * width), bool)
        for t in range(BLOCK_TRIES):
            side = lambda a: a[:, t : t + 1]  # noqa: B023, E731
            grown = mask | ((y >= side(top)) & (y < side(top) + side(tall)) & (x >= side(left)) & (x < side(left) + side(wide)))
            mask = np.where((grown.sum(1) <= n_masked)[:, None], grown, mask)
        # Masked patches first, then the others by noise.
        rank = np.argsort(np.argsort(np.where(mask, -1.0, noise[:, 4 * BLOCK_TRIES :]), axis=1, kind="stable"), axis=1)
        return rank < n_masked

    @F.pandas_udf("array<int>")
    def draw(keys: pd.Series) -> pd.Series:
        return pd.Series(list(masks(keys.to_numpy()).astype(np.int32)))

    return df.select(key, draw(F.col(key).cast("long")).alias("mask"))


def relative_index(spark, height: int, width: int) -> DataFrame:
    """q, k, idx: the relative position index of a grid, and the three special ids for token 0."""
    n = height * width
    special = (2 * height - 1) * (2 * width - 1)
    p = spark.range(n + 1).select(F.col("id").cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n))).alias("k"))
    r = lambda c: F.floor((F.col(c) - 1) / width).cast("int")
    c = lambda x: ((F.col(x) - 1) % width).cast("int")
    idx = (r("q") - r("k") + height - 1) * (2 * width - 1) + c("q") - c("k") + width - 1
    return p.select("q", "k", F.when((F.col("q") == 0) & (F.col("k") == 0), special + 2).when(F.col("q") == 0, special).when(F.col("k") == 0, special + 1).otherwise(idx).cast("int").alias("idx"))


def attention_kept(df: DataFrame, by: str, pos: str, value: str, threshold: float) -> DataFrame:
    """kept: values whose share, summed up from the smallest, is above 1 - threshold."""
    w = Window.partitionBy(by).orderBy(value, pos).rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum(value).over(w) / F.sum(value).over(Window.partitionBy(by))
    return df.withColumn("kept", F.round(share, 9) > 1 - threshold)


def quota_sample(tokens: DataFrame, key: str, code: str, cap: int, salt: int = 0) -> DataFrame:
    """At most cap images for each code, one code an image (the one where it ranks best): a deterministic variant of the
    greedy draw. Ranks are cut at cap before the second step."""
    h = F.xxhash64(F.lit(salt), key, code) if salt else F.col(key)
    w = Window.partitionBy(code).orderBy(h, key)
    first = tokens.select(key, code).distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    return first.groupBy(key).agg(F.min(F.struct("rank", code)).alias("m")).select(key, F.col(f"m.{code}").alias(code), F.col("m.rank").alias("rank"))


def label_of(index: Column, names: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, names)), index)
