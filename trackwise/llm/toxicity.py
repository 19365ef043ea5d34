"""Toxicity by a convolutional text classifier, trained in numpy.

Words (lower-cased runs of letters and digits) are hashed into ``BUCKETS`` embeddings; filters of widths 1, 2 and 3 run
over them, the largest activation of each filter over the whole text goes to a logistic layer. Training reads every
labelled row that isn't held out, whole: the words are counted over all of them, and in each of ``EPOCHS`` rounds every
shard of rows (dealt by key hash, up to about ``SHARD_ROWS`` rows and ``MAX_BYTES`` of word numbers) trains from the same
parameters, whose moves are averaged: embeddings over the shards that used them, all others over all shards. Moves are
summed as whole numbers, so the result hangs neither on partitions nor on the order of tasks. One row of five is kept from
training; all of these calibrate the scores (Platt) and choose a threshold for each language, from counts of logits in
steps of 1 / ``STEPS``. The driver holds parameters and counts only, no rows.
For scoring, every filter's response to every bucket is tabulated, so a text costs a few table look-ups a word.

Defined results: null or empty text has no activation and gets the score of a text without features; where the labelled
rows that may be learned from lack a class, every score is the share of toxic labels (0 without labels); repeated rows and
ties score alike, an id is learned from once (of several labels the largest, of several texts the one whose word numbers
come first); a null id is not held out and has no label; texts of any length are learned from and scored whole; an empty
table gives an empty result; other columns are not read. Labels, language, source and id never enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out
from .kernels import NOT_ALNUM, slices, text_bytes, word_hashes

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 20, 16, (1, 2, 3)
EPOCHS, BATCH, RATE, SEED, SHARD_SEED = 8, 64, 0.005, 7, 11
#: A shard's rows and bytes of word numbers, about; every row is in one shard, and a longer text is in its shard whole.
SHARD_ROWS, MAX_BYTES = 8192, 16 << 20
#: Buckets in fewer training documents stand for no word, so that rare words can't be learned by heart; and the share of
#: words hidden from each training step.
LEAST_DOCS, HIDE = 5, 0.3
#: Bounds and unit of the word scores that the first embedding dimension starts from.
SCORE_TOP, SCORE_UNIT = 12.0, 3.0
CALIBRATION = 5  # one of so many rows, by key hash
CUT = 0.3
#: Steps of the logit by which calibration counts rows, logits beyond TOP at it; units of a parameter's moves when they are
#: summed; parameter rows that are summed in one place.
STEPS, TOP, UNITS, PIECE = 256, 64, 1 << 20, 1024


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, at = word_hashes(data, offsets, blank=NOT_ALNUM)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int32), at


def _tokenise(batches):
    """k, lang, t to k, lang and the bucket numbers as bytes."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        out = []
        for a, b in slices(offsets):
            ids, at = buckets(data, offsets[a : b + 1])
            ids = ids.astype(np.uint16)
            out += [ids[at[i] : at[i + 1]].tobytes() for i in range(b - a)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["k", "lang", "ids"])


def _pack(group: pa.Table) -> pa.Table:
    """A shard's rows as one row, ordered by hash and content."""
    h, ids, y = (group.column(c).to_pylist() for c in ("h", "ids", "y"))
    order = sorted(range(len(h)), key=lambda i: (h[i], ids[i], y[i]))
    at = np.cumsum([0, *[len(ids[i]) // 2 for i in order]]).astype(np.int64)
    row = [group.column("shard")[0].as_py(), np.array([y[i] for i in order], np.int8).tobytes(), at.tobytes(), b"".join(ids[i] for i in order)]
    return pa.table({"shard": pa.array([row[0]], pa.int32())} | {c: pa.array([v], pa.binary()) for c, v in zip(("y", "at", "ids"), row[1:], strict=True)})


def _unpack(batch: pa.RecordBatch):
    """Shard number, documents and labels of each packed row."""
    for i in range(batch.num_rows):
        at, ids = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((2, np.int64), (3, np.uint16)))
        y = np.frombuffer(batch.column(1)[i].as_buffer(), np.int8)
        yield batch.column(0)[i].as_py(), [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], y.astype(np.int64)


_PART = "piece int, at binary, move binary"


def _parts(at: np.ndarray, moves: np.ndarray) -> pa.RecordBatch:
    """Rows of whole numbers and their places, by piece."""
    cuts = np.searchsorted(at, np.arange(0, (int(at[-1]) if len(at) else 0) + PIECE, PIECE))
    some = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(at)], strict=True)) if b > a]
    cols = [pa.array([p for p, _, _ in some], pa.int32()), *[pa.array([x[a:b].tobytes() for _, a, b in some], pa.binary()) for x in (at.astype(np.int32), moves.astype(np.int32))]]
    return pa.RecordBatch.from_arrays(cols, ["piece", "at", "move"])


def _totals(df: DataFrame, rows: int, width: int) -> np.ndarray:
    """The sums of all parts, and in a last column how many parts had each row."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, at, move in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                at = np.frombuffer(at, np.int32) - p * PIECE
                to = sums.setdefault(p, np.zeros((PIECE, width + 1), np.int64))
                to[at, :width] += np.frombuffer(move, np.int32).reshape(-1, width)
                to[at, width] += 1
        for p, to in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([to.tobytes()], pa.binary())], ["piece", "sums"])

    pieces = -(-rows // PIECE)
    out = np.zeros((pieces * PIECE, width + 1), np.int64)
    for r in df.repartition(pieces, "piece").mapInArrow(add, "piece int, sums binary").collect():
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["sums"], np.int64).reshape(PIECE, width + 1)
    return out[:rows]


def _count(batches):
    """Of each bucket, the documents and the toxic documents that have it."""
    for batch in batches:
        for _, docs, y in _unpack(batch):
            n = np.zeros((BUCKETS, 2), np.int64)
            for d, label in zip(docs, y, strict=True):
                n[np.unique(d)] += (1, label)
            at = np.flatnonzero(n[:, 0])
            yield _parts(at, n[at])


class Net:
    """Parameters, training and scoring."""

    def __init__(self, prior: float = 0.0):
        rng = np.random.default_rng(SEED)
        self.emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.conv = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.known = np.ones(BUCKETS, bool)
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.off = np.zeros(1, np.float32)
        self.platt, self.prior, self.thresholds = (1.0, 0.0), prior, {}

    def params(self):
        return [self.emb, *self.conv, *self.bias, self.out, self.off]

    def matrix(self) -> np.ndarray:
        """All parameters as rows of DIM: the embeddings, then the others."""
        rest = np.concatenate([p.ravel() for p in self.params()[1:]])
        return np.vstack([self.emb, np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])

    def take(self, matrix: np.ndarray) -> None:
        self.emb = matrix[:BUCKETS].astype(np.float32)
        rest, a = matrix[BUCKETS:].astype(np.float32).ravel(), 0
        for p in self.params()[1:]:
            p[...] = rest[a : a + p.size].reshape(p.shape)
            a += p.size
        self.__dict__.pop("_resp", None)

    def responses(self):
        if not hasattr(self, "_resp"):
            emb = np.where(self.known[:, None], self.emb, 0).astype(np.float32)
            self._resp = [[emb @ w[j] for j in range(len(w))] for w in self.conv]
        return self._resp

    def pooled(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Largest activation of each filter over each row, not below zero."""
        n, rows = len(ids), len(at) - 1
        out = np.zeros((rows, FILTERS * len(WIDTHS)), np.float32)
        for k, (w, tables) in enumerate(zip(WIDTHS, self.responses(), strict=True)):
            full = np.flatnonzero(np.diff(at) >= w)
            if not len(full):
                continue
            act = tables[0][ids[: n - w + 1]].copy()
            for j in range(1, w):
                act += tables[j][ids[j : n - w + 1 + j]]
            for j in range(1, w):  # windows that cross into the next row
                cross = at[1:-1] - j
                act[cross[(cross >= 0) & (cross < len(act))]] = -np.inf
            best = np.maximum.reduceat(act, at[:-1][full])
            out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(best + self.bias[k], 0)
        return out

    def logits(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.pooled(ids, at) @ self.out + self.off[0]

    def scores(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.platt is None:
            return np.full(len(at) - 1, self.prior)
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.logits(ids, at).astype(np.float64) + b, -60, 60)))

    def start(self, seen: np.ndarray, toxic: np.ndarray, share: float) -> None:
        """A warm start from the documents and toxic documents of each bucket."""
        self.known = seen >= LEAST_DOCS
        # The signed root of the likelihood ratio of a word's toxic documents, which leaves chance finds of rare words near
        # the noise. Words are dealt over as many dimensions as there are filters of width 1, each of which reads one, so
        # several different words count for more than one word.
        part = np.where(toxic > 0, toxic * np.log(np.maximum(toxic, 1) / np.maximum(seen * share, 1e-9)), 0.0)
        rest = np.where(seen > toxic, (seen - toxic) * np.log(np.maximum(seen - toxic, 1) / np.maximum(seen * (1 - share), 1e-9)), 0.0)
        root = np.sqrt(2 * np.maximum(part + rest, 0)) * np.where(toxic >= seen * share, 1, -1)
        self.emb[:, :FILTERS] = 0
        own = np.arange(BUCKETS)
        self.emb[own, own % FILTERS] = np.clip(root, -SCORE_TOP, SCORE_TOP) / SCORE_UNIT
        self.conv[0][:] = 0
        self.conv[0][0, np.arange(FILTERS), np.arange(FILTERS)] = 1.0
        self.bias[0][:] = -1.0
        self.out[:FILTERS] = 0.5
        self.out[FILTERS:] *= 0.2

    def epoch(self, docs: list[np.ndarray], y: np.ndarray, rng) -> np.ndarray:
        """Trains on every document once; returns the rows of matrix() that moved."""
        m = [np.zeros_like(p) for p in self.params()]
        v = [np.zeros_like(p) for p in self.params()]
        moved = np.ones(len(self.matrix()), bool)
        moved[:BUCKETS] = False
        for step, rows in enumerate(np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)), 1):
            grads = self._gradients([docs[i] for i in rows], y[rows], rng)
            for p, g, a, b in zip(self.params(), grads, m, v, strict=True):
                if isinstance(g, tuple):  # embeddings: only the rows that were used
                    at, g = g
                    moved[at] = True
                    a[at] = 0.9 * a[at] + 0.1 * g
                    b[at] = 0.999 * b[at] + 0.001 * g * g
                    p[at] -= RATE * (a[at] / (1 - 0.9**step)) / (np.sqrt(b[at] / (1 - 0.999**step)) + 1e-8)
                else:
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self.__dict__.pop("_resp", None)
        return np.flatnonzero(moved)

    def _gradients(self, docs: list[np.ndarray], y: np.ndarray, rng):
        ids, n = np.concatenate(docs), len(docs)
        at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        shown = self.known[ids] & (rng.random(len(ids), np.float32) >= HIDE)
        # Words by their place among those that are shown; what isn't is place 0, of zeros.
        place = np.zeros(BUCKETS, np.int32)
        place[ids[shown]] = 1
        own = np.flatnonzero(place)
        place[own] = np.arange(1, len(own) + 1)
        word = np.where(shown, place[ids], 0)
        emb = np.vstack([np.zeros((1, DIM), np.float32), self.emb[own]])
        pooled, where = np.zeros((n, FILTERS * len(WIDTHS)), np.float32), np.full((n, FILTERS * len(WIDTHS)), -1)
        for k, w in enumerate(WIDTHS):
            if len(ids) < w:
                continue
            act = np.take(self.conv[k][0].T @ emb.T, word[: len(ids) - w + 1], axis=1)
            for j in range(1, w):
                act += np.take(self.conv[k][j].T @ emb.T, word[j : len(ids) - w + 1 + j], axis=1)
            for i in range(n):
                if at[i + 1] - at[i] >= w:
                    part = act[:, at[i] : at[i + 1] - w + 1]
                    best = part.argmax(1)
                    top = part[np.arange(FILTERS), best] + self.bias[k]
                    pooled[i, k * FILTERS : (k + 1) * FILTERS] = np.maximum(top, 0)
                    where[i, k * FILTERS : (k + 1) * FILTERS] = np.where(top > 0, best + at[i], -1)
        d = ((1 / (1 + np.exp(-np.clip(pooled @ self.out + self.off[0], -60, 60)))) - y).astype(np.float32) / max(1, n)
        g_out, g_off = pooled.T @ d + 1e-4 * self.out, np.array([d.sum()], np.float32)
        up = d[:, None] * self.out[None, :]
        g_conv, g_bias = [np.zeros_like(w) for w in self.conv], [np.zeros_like(b) for b in self.bias]
        rows, vals = [], []
        for k, w in enumerate(WIDTHS):
            i, f = np.nonzero(where[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
            pos, g = where[i, k * FILTERS + f], up[i, k * FILTERS + f]
            one = np.zeros((FILTERS, len(f)), np.float32)
            one[f, np.arange(len(f))] = g
            g_bias[k][:] = one.sum(1)
            for j in range(w):
                seen = word[pos + j]
                g_conv[k][j] = (one @ emb[seen]).T
                rows.append(seen)
                vals.append(g[:, None] * self.conv[k][j].T[f])
        r, val = np.concatenate(rows), np.concatenate(vals)
        used = np.flatnonzero(np.bincount(r, minlength=len(emb))[1:]) + 1
        g_emb = np.stack([np.bincount(r, val[:, c], len(emb)) for c in range(DIM)], 1)[used].astype(np.float32)
        return [(own[used - 1], g_emb), *g_conv, *g_bias, g_out, g_off]

    def calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Platt scaling by the numbers n of rows of logit z and label y, moved so that CUT is the best cut."""
        a, b, total = 1.0, 0.0, n.sum()

        def loss(a, b):
            return (n * (np.logaddexp(0, a * z + b) - y * (a * z + b))).sum() + 0.5e-5 * total * (a - 1) ** 2

        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
            h, e = n * np.maximum(p * (1 - p), 1e-6), n * (p - y)
            hess = np.array([[(h * z * z).sum() + 1e-5 * total, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9 * total]])
            delta = np.linalg.solve(hess, [(e * z).sum() + 1e-5 * total * (a - 1), e.sum()])
            was = loss(a, b)
            while np.abs(delta).max() >= 1e-8 and not loss(a - delta[0], b - delta[1]) <= was:  # a step too far
                delta = delta / 2
            a, b = a - delta[0], b - delta[1]
            if np.abs(delta).max() < 1e-8:
                break
        a = max(a, 0.05)
        self.platt = (a, np.log(CUT / (1 - CUT)) - a * best_cut(z, y, n))


def best_cut(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The cut of the best F1 between n rows of logit z and label y; of several the middle one."""
    at, back = np.unique(z, return_inverse=True)
    every, bad = np.bincount(back, n), np.bincount(back, n * y)
    above, hit = np.cumsum(every[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    if len(at) > 1:
        at, above, hit = (at[1:] + at[:-1]) / 2, above[1:], hit[1:]
    f1 = 2 * hit / np.maximum(bad.sum() + above, 1e-9)
    good = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(at[good[len(good) // 2]])


def _cuts(group: pa.Table) -> pa.Table:
    """A language's best cut, where it has five toxic rows and others."""
    z, y, n = (group.column(c).to_numpy() for c in ("bin", "y", "n"))
    bad = int((n * y).sum())
    keep = group.slice(0, int(5 <= bad < n.sum())).select(["lang"])
    return keep.append_column("cut", pa.array([best_cut((z + 0.5) / STEPS, y, n)] * keep.num_rows, pa.float64()))


def _rounds(net: Net, shards: DataFrame) -> None:
    """EPOCHS rounds over all shards."""
    context, size = shards.sparkSession.sparkContext, len(net.matrix())
    for turn in range(EPOCHS):
        shared = context.broadcast(net)

        def run(batches, shared=shared, turn=turn):
            before = shared.value.matrix()
            mine = Net()
            mine.known = shared.value.known
            for batch in batches:
                for shard, docs, y in _unpack(batch):
                    mine.take(before)
                    at = mine.epoch(docs, y, np.random.default_rng([SEED, turn, shard]))
                    yield _parts(at, np.rint((mine.matrix()[at] - before[at]) * np.float64(UNITS)))

        got = _totals(shards.mapInArrow(run, _PART), size, DIM)
        net.take(net.matrix() + got[:, :DIM] / (np.maximum(got[:, DIM:], 1) * UNITS))
        shared.destroy()


def _logits(rows: DataFrame, net: Net) -> DataFrame:
    """How many rows of each language and label have a logit in each step."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            z = np.zeros(batch.num_rows)
            for a, b in slices(offsets, 1 << 18):
                z[a:b] = shared.value.logits(data[offsets[a] : offsets[b]].view(np.uint16), (offsets[a : b + 1] - offsets[a]) // 2)
            bins = np.floor(np.clip(z, -TOP, TOP) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bins)], ["y", "lang", "bin"])

    return rows.select("y", "lang", "ids").mapInArrow(run, "y int, lang string, bin int").groupBy("lang", "bin", "y").agg(F.count("*").alias("n"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> Net:
    """Fits and calibrates on all labelled rows that aren't held out, shard by shard on the executors. Its scratch tables are
    gone when it returns."""
    lab = labels.select(labels[key].alias("k"), labels[label].cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("k")))
    lab = lab.groupBy("k").agg(F.max("y").alias("y"))
    lean = docs.where(docs[key].isNotNull() & ~held_out(docs[key])).select(docs[key].alias("k"), docs[lang].cast("string").alias("lang"), docs[text].alias("t"))
    # Word numbers take a third of the text, so what is dealt by key for the join is small.
    kind = lean.schema["k"].dataType.simpleString()
    rows = lean.mapInArrow(_tokenise, f"k {kind}, lang string, ids binary").join(lab, "k")
    rows = rows.groupBy("k", "y").agg(F.min(F.struct("ids", "lang")).alias("m"))
    h = F.xxhash64(F.lit(SEED), "k")
    rows = rows.select(h.alias("h"), (F.pmod(F.xxhash64(F.lit(CALIBRATION), "k"), F.lit(CALIBRATION)) == 0).alias("kept"), "y", "m.lang", "m.ids")
    scratch = Scratch(docs.sparkSession)
    try:
        rows = scratch.put(rows, "rows")
        n = {(r["kept"], r["y"]): (r["n"], r["b"]) for r in rows.groupBy("kept", "y").agg(F.count("*").alias("n"), F.sum(F.octet_length("ids").cast("long")).alias("b")).collect()}
        if len({y for _, y in n}) < 2:
            counts = lab.agg(F.avg("y").alias("share")).first()
            net = Net(counts["share"] or 0.0)
            net.platt = None
            return net
        fit, kept = rows, rows
        if len(n) == 4:  # else both parts are all rows
            fit, kept = rows.where("not kept"), rows.where("kept")
            fitted = {y: n[False, y] for y in (0, 1)}
        else:
            fitted = {y: tuple(map(sum, zip(*[v for (_, o), v in n.items() if o == y], strict=True))) for y in (0, 1)}
        total, size = (sum(fitted[y][c] for y in (0, 1)) for c in (0, 1))
        net = Net(fitted[1][0] / total)
        count = max(1, -(-total // SHARD_ROWS), -(-size // MAX_BYTES))
        shard = F.pmod(F.xxhash64(F.lit(SHARD_SEED), "h"), F.lit(count)).cast("int").alias("shard")
        packed = fit.select(shard, "h", "y", "ids").groupBy("shard").applyInArrow(_pack, "shard int, y binary, at binary, ids binary")
        shards = scratch.put(packed, "shards")
        seen = _totals(shards.mapInArrow(_count, _PART), BUCKETS, 2)
        net.start(seen[:, 0], seen[:, 1], net.prior)
        _rounds(net, shards)
        hist = scratch.put(_logits(kept, net), "logits")
        got = hist.groupBy("bin", "y").agg(F.sum("n").alias("n")).toArrow()
        net.calibrate(*((got.column(c).to_numpy().astype(np.float64) + o) / u for c, o, u in (("bin", 0.5, STEPS), ("y", 0, 1), ("n", 0, 1))))
        a, b = net.platt
        for r in hist.where("lang is not null").groupBy("lang").applyInArrow(_cuts, "lang string, cut double").collect():
            net.thresholds[r["lang"]] = float(1 / (1 + np.exp(-(a * r["cut"] + b))))
        return net
    finally:
        scratch.close()


def score(docs: DataFrame, net: Net, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """doc_id, held_out, score, predicted (score at CUT) and flagged (score at the threshold of the row's language)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(3))
            got = np.zeros(batch.num_rows)
            for a, b in slices(offsets, 1 << 20):
                got[a:b] = m.scores(*buckets(data, offsets[a : b + 1]))
            cut = np.array([m.thresholds.get(x, CUT) for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= CUT).astype(np.int32)), pa.array((got >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted", "flagged"])

    by = docs[lang].cast("string") if lang else F.lit(None).cast("string")
    lean = docs.select(docs[key].cast("long").alias("doc_id"), held_out(docs[key]).alias("held_out"), by.alias("l"), docs[text].alias("t"))
    return lean.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, flagged int")
