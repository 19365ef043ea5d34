"""Near-duplicate groups by SetSketch.

Each text's set of 5-word shingles becomes ``M`` registers: minima of exponential variates, truncated to integers on an
exponential scale of base ``B``. Bands of ``ROWS`` register values propose pairs, a likelihood over register comparisons
(set sizes known) discards unlikely ones, and full sets confirm the rest. Equal sets collapse first, so groups of exact
copies cost one row. Within a bucket only links to its smallest member are tried; pairs that remain in different
components after that are compared in bounded blocks, by registers and then by full sets, and only links that join
components come out: no link between different texts is lost and no bucket emits its pairs.

Defined results: null, empty and blank texts have an empty set and link with nothing; rows with a null id take no part
and are kept; repeated rows are copies of each other and share component and fate; ties go to the smallest id; an empty
table gives an empty result; texts of any length are read whole, their sets in the memory of one task. Only the id and text
columns are read; other columns can have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .kernels import U, mix, sets_of, shingle_sets, slices, text_bytes, word_hashes

M, ROWS = 128, 4
B, RATE, TOP = 1.001, 20.0, 65535
#: Pairs whose likeliest similarity is below this are not confirmed: four standard deviations under 0.75.
LEAST = 0.58
#: Members of a bucket that one task compares with as many others.
BLOCK = 2048
_ODD = mix(np.arange(1, M + 1, dtype=np.uint64)) | U(1)


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sketches (rows by M, uint16) of consecutive non-empty sets."""
    low = np.empty((len(starts) - 1, M), np.uint64)
    buf = np.empty(len(hashes), np.uint64)
    for i in range(M):
        np.multiply(hashes, _ODD[i], out=buf)
        low[:, i] = np.minimum.reduceat(buf, starts[:-1])
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets, from theirs: a smaller minimum is a larger register."""
    return np.maximum(a, b)


SKETCH = "doc_id long, n_shingles long, d0 long, d1 long, regs binary"


def _sketch(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in slices(offsets):
            hashes, at = shingle_sets(data, offsets[a : b + 1])
            n = np.diff(at)
            full = np.flatnonzero(n)
            d = np.zeros((2, b - a), np.uint64)
            regs = [None] * (b - a)
            if len(full):
                starts = np.append(at[:-1][full], len(hashes))
                for k in (0, 1):
                    d[k, full] = np.add.reduceat(mix(hashes + U(977 + k)), starts[:-1])
                for i, r in zip(full, registers(hashes, starts), strict=True):
                    regs[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "d0", "d1", "regs"])


def likelihood(more: np.ndarray, less: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity from the registers in which u exceeds v and v exceeds u, and the set sizes."""
    u = (nu / (nu + nv))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :]
    j = grid * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (B - 1) / B) / np.log(B)
    up, down, tiny = p(u - v * j), p(v - u * j), 1e-12
    score = more[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny) + (M - more - less)[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def _matrix(column) -> np.ndarray:
    data, at = text_bytes(column)
    return np.frombuffer(data[at[0] : at[-1]].tobytes(), np.uint16).reshape(-1, M)


def _likely(batches):
    """a, b, na, nb, ra, rb: the pairs that may be similar enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = _matrix(batch.column(4)), _matrix(batch.column(5))
        est = likelihood((x > y).sum(1), (x < y).sum(1), batch.column(2).to_numpy(), batch.column(3).to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(est >= LEAST))


def _confirm(batches):
    """a, b, text a, text b: the pairs that are similar on full sets."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        known: dict = {}
        held = 0
        cols = [text_bytes(batch.column(2)), text_bytes(batch.column(3))]
        ids = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
        for i in range(batch.num_rows):
            pair = []
            for k in (0, 1):
                if (s := known.get(ids[k][i])) is None:
                    data, at = cols[k]
                    s = sets_of(*word_hashes(data, at[i : i + 2]))[0]
                    if held > 1 << 22:
                        known.clear()
                        held = 0
                    known[ids[k][i]] = s
                    held += len(s)
                pair.append(s)
            both = len(np.intersect1d(*pair, assume_unique=True))
            keep[i] = 100 * both >= 75 * (len(pair[0]) + len(pair[1]) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def _sets(batches):
    """rep, text: the sorted distinct shingle hashes of each text as bytes."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in slices(offsets):
            hashes, at = shingle_sets(data, offsets[a : b + 1])
            out = [hashes[at[k] : at[k + 1]].tobytes() for k in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(out, pa.binary())], ["rep", "hashes"])


def _cross(table: pa.Table) -> pa.Table:
    """For one block pair of a bucket: confirmed links between different components, as many as join them. side 0 and 1
    are the two blocks, 2 is both. A pair belongs to the first band that its two members share, so it is tried once."""
    rep, comp, n, side = (table.column(c).to_numpy() for c in ("rep", "comp", "n", "side"))
    band = int(table.column("band")[0].as_py()) if table.num_rows else 0
    regs = _matrix(table.column("regs"))
    data, at = text_bytes(table.column("hashes"))
    own = [np.frombuffer(data[at[k] : at[k + 1]].tobytes(), np.uint64) for k in range(len(rep))]
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    root, a, b = comp.copy(), [], []
    for i in left:
        j = right[(root[right] != root[i]) & ((side[right] != side[i]) | (rep[right] > rep[i]))]
        if not len(j):
            continue
        x, y = regs[i][None, :], regs[j]
        same = x == y
        shared = same.reshape(len(j), M // ROWS, ROWS).all(2)
        near = np.flatnonzero((same.sum(1) >= 0.4 * M) & shared[:, band] & (shared.argmax(1) == band))
        if not len(near):
            continue
        est = likelihood((x > y[near]).sum(1), (x < y[near]).sum(1), np.full(len(near), n[i]), n[j[near]])
        for k in near[np.argsort(-est, kind="stable")][: int((est >= LEAST).sum())]:
            o = j[k]
            if root[o] == root[i]:
                continue
            both = len(np.intersect1d(own[i], own[o], assume_unique=True))
            if 100 * both >= 75 * (len(own[i]) + len(own[o]) - both):
                a.append(min(rep[i], rep[o]))
                b.append(max(rep[i], rep[o]))
                root[root == root[o]] = root[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(nodes_edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp (smallest node reachable) for the nodes of undirected edges a, b. Smallest labels travel along edges and
    along their own pointers, so a long chain takes a logarithmic number of rounds."""
    e = scratch.put(nodes_edges.select("a", "b").union(nodes_edges.select("b", "a")).distinct(), "edges")
    label = scratch.put(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "label")
    while True:
        near = e.join(label, e.b == label.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = label.join(near, label.node == near.a, "left").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        up = label.select(F.col("node").alias("p"), F.col("comp").alias("pc"))
        step = step.join(up, step.comp == up.p, "left").select("node", F.least("comp", "pc").alias("comp"), "was")
        old = scratch.paths.get("label")
        new = scratch.put(step, "label")
        changed = new.where(F.col("comp") != F.col("was")).limit(1).count()
        label = new.select("node", "comp")
        scratch.paths["label-old"] = old
        scratch.drop("label-old")
        if not changed:
            scratch.drop("edges")
            return label


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    lean = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    sketch = scratch.put(lean.mapInArrow(_sketch, SKETCH), "sketch")
    linked = sketch.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    heads = linked.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    regs = linked.select(F.col("doc_id").alias("i"), F.col("n_shingles").alias("n"), "regs", F.col("d0").alias("e0"), F.col("d1").alias("e1"))
    reps = scratch.put(heads.join(regs, (heads.rep == regs.i) & (heads.d0 == regs.e0) & (heads.d1 == regs.e1)).select("rep", "d0", "d1", "n", "regs").dropDuplicates(["rep", "d0", "d1"]), "reps")
    bands = reps.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(M // ROWS - 1)), lambda i: F.substring("regs", i * (2 * ROWS) + 1, F.lit(2 * ROWS)))).alias("i", "part")).select("rep", F.col("i").alias("band"), F.xxhash64("i", "part").alias("bucket"))
    full = bands.groupBy("bucket").agg(F.min("rep").alias("center"), F.max("rep").alias("last"), F.count("*").alias("members")).where(F.col("center") != F.col("last"))
    member = scratch.put(bands.join(full, "bucket").select("bucket", "band", "rep", "center", "members"), "member")
    stars = member.where(F.col("rep") != F.col("center")).select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    links = scratch.put(_verified(stars, reps, lean), "links")
    label = components(links, scratch)
    # What the stars left in different components of one bucket: compared in blocks, by registers and then by full sets,
    # where they are; only links that join components come out, never pairs.
    wide = member.where(F.col("members") > 2).join(label, member.rep == label.node, "left").select("bucket", "band", "rep", "members", F.coalesce("comp", "rep").alias("comp"))
    mixed = wide.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("bucket")
    odd = scratch.put(wide.join(mixed, "bucket"), "odd")
    texts = lean.join(odd.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text")
    sets = texts.mapInArrow(_sets, "rep long, hashes binary")
    rows = odd.join(reps.select("rep", "n", "regs"), "rep").join(sets, "rep")
    rows = rows.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    keep = ["bucket", "band", "rep", "comp", "n", "regs", "hashes"]
    rows = rows.select(*keep, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select(*keep, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    more = scratch.put(rows.groupBy("bucket", "lo", "hi").applyInArrow(_cross, "a long, b long").distinct(), "more")
    if more.limit(1).count():
        label = components(links.union(more), scratch)
    scratch.drop("member", "odd")
    heads = reps.select("rep", "d0", "d1").join(label, reps.rep == label.node, "left").select("d0", "d1", F.coalesce("comp", "rep").alias("comp"), F.lit(True).alias("real"))
    out = sketch.drop("regs").join(heads, ["d0", "d1"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    comp = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def _verified(pairs: DataFrame, reps: DataFrame, lean: DataFrame) -> DataFrame:
    """The pairs a, b that are likely by registers and then similar on full sets."""
    x = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    y = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    pairs = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_likely, "a long, b long")
    x = lean.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")).where(F.col("a").isNotNull())
    y = lean.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")).where(F.col("b").isNotNull())
    return pairs.join(y, "b").join(x, "a").select("a", "b", "ta", "tb").mapInArrow(_confirm, "a long, b long").distinct()


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with its own columns: the one with the smallest id."""
    gone = near_duplicates(docs, key, text).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti")
