"""Language identification by prediction by partial matching.

Each language has a variable-order byte model: contexts of up to three bytes, frozen counts, escape probabilities by
method C (a context's escape weighs as many as it has distinct successors), uniform bytes at the end. A text's exact code
length in each language is the sum over all of its bytes; the shortest wins. For speed the cost of every 4-byte string
seen in training, in every language, is worked out beforehand; other strings walk down the escapes.

Models learn from at most ``PER_LANGUAGE`` distinct texts of each language in a pseudo-random order of their hashes, as
many as fit into the language's share of ``MAX_BYTES``, and never from held-out rows. ``MAX_BYTES`` and ``MAX_LANGUAGES``
bound what the driver reads and what is broadcast.

Defined results: null text or text without a letter is ``und`` with score 0; with nothing to learn from all are ``und``;
repeated rows get the same answer; ties go to the first language by name; a null id is not held out; texts of any length are
scored whole, one that alone exceeds its language's share of bytes isn't learned from; an empty table gives an empty
result. The id, the source and the true language never enter a prediction; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out
from .kernels import _LOWER, slices, text_bytes

PER_LANGUAGE, MAX_LANGUAGES, MAX_BYTES = 400, 200, 64 << 20
#: How many times a sample's expected size is looked at, and the resolution of the share of hashes that is.
SPARE, STEPS = 6, 1 << 20
MULT = np.uint32(0x9E3779B1)


def _grams(body: np.ndarray, k: int) -> np.ndarray:
    """Codes of the k-byte strings of body that end at each byte, from the k-th on."""
    out = np.zeros(max(0, len(body) - k + 1), np.uint32)
    for j in range(k):
        out = (out << np.uint32(8)) | body[j : len(body) - k + 1 + j]
    return out


class Trees:
    """Counts of one language's contexts."""

    def __init__(self, texts: list[bytes]):
        self.count: list[tuple[np.ndarray, np.ndarray]] = []
        for k in (1, 2, 3, 4):
            parts = [_grams(_LOWER[np.frombuffer(b"\0" * 3 + t, np.uint8)], k) for t in texts]
            self.count.append(np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint32), return_counts=True))
        self.context = []
        for g, c in self.count:
            if not len(g):
                self.context.append((g, c, c))
                continue
            ctx, first = np.unique(g >> np.uint32(8), return_index=True)
            self.context.append((ctx, np.add.reduceat(c, first), np.diff(np.append(first, len(g)))))

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, x), max(0, len(keys) - 1))
        return at, (keys[at] == x) if len(keys) else np.zeros(len(x), bool)

    def escape(self, order: int, ctx: np.ndarray) -> np.ndarray:
        """Bits of leaving contexts of an order; none where the context was never seen."""
        keys, n, d = self.context[order]
        at, seen = self._find(keys, ctx)
        return np.where(seen, -np.log2(d[at] / (n[at] + d[at])), 0.0) if len(keys) else np.zeros(len(ctx))

    def cost(self, order: int, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each (order + 1)-byte string after the others."""
        if order < 0:
            return np.full(len(gram), 8.0)
        grams, c = self.count[order]
        ctx = gram >> np.uint32(8)
        low = self.cost(order - 1, gram & np.uint32((1 << 8 * order) - 1)) if order else np.full(len(gram), 8.0)
        if not len(grams):
            return low
        at, seen = self._find(grams, gram)
        keys, n, d = self.context[order]
        where, _ = self._find(keys, ctx)
        return np.where(seen, -np.log2(c[at] / (n[where] + d[where])), self.escape(order, ctx) + low)


class Model:
    """Costs by language for the strings that any language has seen; what executors get."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        trees = [Trees(texts[k]) for k in self.langs]
        every = lambda k: np.unique(np.concatenate([t.count[k - 1][0] for t in trees])) if trees else np.zeros(0, np.uint32)
        self.four, self.three = every(4), every(3)
        stack = lambda f, x: np.stack([f(t, x) for t in trees], 1).astype(np.float32) if trees else np.zeros((len(x), 0), np.float32)
        two = np.arange(1 << 16, dtype=np.uint32)
        self.cost4, self.cost3 = stack(lambda t, x: t.cost(3, x), self.four), stack(lambda t, x: t.cost(2, x), self.three)
        self.leave3 = stack(lambda t, x: t.escape(3, x), self.three)
        self.leave2, self.cost2 = stack(lambda t, x: t.escape(2, x), two), stack(lambda t, x: t.cost(1, x), two)

    def tables(self):
        """One-probe hash tables from 4-byte strings to their numbers; those that collide go to a further one."""
        if not hasattr(self, "_tables"):
            self._tables, left, bits = [], np.arange(len(self.four)), 21
            while len(left):
                slot = (self.four[left] * (MULT + np.uint32(2 * len(self._tables)))) >> np.uint32(32 - bits)
                table = np.full(1 << bits, -1, np.int32)
                table[slot] = left
                self._tables.append((bits, MULT + np.uint32(2 * len(self._tables)), table))
                left = left[table[slot] != left]
        return self._tables

    def find4(self, g: np.ndarray) -> np.ndarray:
        out = np.full(len(g), -1, np.int32)
        open_ = None
        for bits, mult, table in self.tables():
            x = g if open_ is None else g[open_]
            got = table[(x * mult) >> np.uint32(32 - bits)]
            ok = (got >= 0) & (self.four[np.maximum(got, 0)] == x)
            if open_ is None:
                out = np.where(ok, got, -1)
                open_ = np.flatnonzero(~ok)
            else:
                out[open_[ok]] = got[ok]
                open_ = open_[~ok]
            if not len(open_):
                break
        return out

    def rare(self, g: np.ndarray) -> np.ndarray:
        """Costs of 4-byte strings that no language has seen."""
        ctx, low = g >> np.uint32(8), g & np.uint32(0xFFFFFF)
        at, seen = Trees._find(self.three, ctx)
        cost = np.where(seen[:, None], self.leave3[at], 0.0) if len(self.three) else np.zeros((len(g), len(self.langs)))
        at, seen = Trees._find(self.three, low)
        down = self.leave2[low >> np.uint32(8)] + self.cost2[low & np.uint32(0xFFFF)]
        return cost + (np.where(seen[:, None], self.cost3[at], down) if len(self.three) else down)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths, rows by languages."""
        lo, rows = int(offsets[0]), len(offsets) - 1
        at = offsets - lo
        n = len(data[lo : int(offsets[-1])])
        total = np.zeros((rows, len(self.langs)))
        if not n or not self.langs:
            return total
        body = _LOWER[data[lo : lo + n]]
        # Three zero bytes stand before each text.
        pad = np.zeros(n + 3, np.uint8)
        pad[3:] = body
        g = _grams(pad, 4)
        for k in range(3):
            start = at[:-1][at[1:] > at[:-1] + k] + k
            g[start] &= np.uint32((1 << 8 * (k + 1)) - 1)
        ids = self.find4(g)
        full = np.flatnonzero(at[1:] > at[:-1])
        unseen = np.flatnonzero(ids < 0)
        extra = self.rare(g[unseen]) if len(unseen) else None
        for j in range(len(self.langs)):
            c = self.cost4[:, j][ids] if len(self.four) else np.zeros(n, np.float32)
            if extra is not None:
                c[unseen] = extra[:, j]
            total[full, j] = np.add.reduceat(c, at[:-1][full], dtype=np.float64)
        return total


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fits the models on the driver from a bounded sample of whole texts."""
    rows = docs.select(docs[text].alias("t"), docs[lang].cast("string").alias("l"), held_out(docs[key]).alias("h")).where("t is not null and l is not null and not h")
    rows = rows.select("l", "t", F.xxhash64("t").alias("x"), F.octet_length("t").alias("n"))
    counts = rows.groupBy("l").agg(F.approx_count_distinct("x").alias("texts")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; raise MAX_LANGUAGES knowing that models are broadcast")
    # The share of hashes that is looked at by language, so that no task ranks a language's texts all.
    ok = F.lit(False)
    for r in counts:
        ok = ok | ((F.col("l") == r["l"]) & (F.pmod("x", F.lit(STEPS)) < max(1, min(STEPS, SPARE * per_language * STEPS // max(1, r["texts"])))))
    few, share = rows.where(ok), MAX_BYTES // max(1, len(counts))
    order = Window.partitionBy("l").orderBy(F.pmod("x", F.lit(STEPS)), "x")
    few = few.where(F.col("n") <= share).groupBy("l", "x").agg(F.max("n").alias("n")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    few = few.withColumn("b", F.sum("n").over(order)).where(F.col("b") <= share)
    chosen = few.select(F.col("l").alias("fl"), F.col("x").alias("fx"))  # at most per_language rows a language
    rows = rows.join(F.broadcast(chosen), (F.col("l") == F.col("fl")) & (F.col("x") == F.col("fx")))
    texts: dict[str, list[bytes]] = {}
    for r in rows.groupBy("l", "x").agg(F.min("t").alias("t")).orderBy("l", "x").toLocalIterator():
        texts.setdefault(r["l"], []).append(r["t"].encode())
    return Model(texts)


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            column = batch.column(2)
            data, offsets = text_bytes(column)
            pred, score = np.full(batch.num_rows, len(m.langs)), np.zeros(batch.num_rows)
            for a, b in slices(offsets, 1 << 19):
                at = offsets[a : b + 1]
                bits = m.bits(data, at)
                seen = np.concatenate([[0], np.cumsum(_LETTER[data[at[0] : at[-1]]])])
                ok = seen[at[1:] - at[0]] > seen[at[:-1] - at[0]]
                for i in np.flatnonzero(~ok):
                    ok[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
                if not m.langs:
                    continue
                gap = (bits - bits.min(1, keepdims=True)) / np.sqrt(np.maximum(np.diff(at), 1))[:, None]
                pred[a:b] = np.where(ok, bits.argmin(1), len(m.langs))
                score[a:b] = np.where(ok, 1 / np.exp2(-gap).sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[pred], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    lean = docs.select(docs[key].cast("long").alias("doc_id"), held_out(docs[key]).alias("held_out"), docs[text].alias("t"))
    return lean.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
