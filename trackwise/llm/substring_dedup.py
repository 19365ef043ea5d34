"""Repeated passages by longest-previous-factor arrays over a sparse, distributed suffix order.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier: in a document with a smaller id, or
earlier in the same one. That is so for the window at p exactly if the longest previous factor at p is LENGTH or more, and
in suffix order that factor is the longer of the common prefixes with the previous and the next smaller position.

The order is never built for the whole corpus at once. Every window holds an anchor: a ``GRAM``-byte string whose hash is
smallest among some SPAN neighbours, found by content alone, so equal windows hold equal anchors at equal places, and the
suffixes that can share LENGTH bytes stand in the order of one anchor's bucket.
1. Anchors go by hash, each with a hash of its context (all bytes that a window around it can reach). An equal context
   with a smaller position removes the whole context. Repeats inside a task are settled there, so a passage in very many
   documents sends one row a task; an anchor with many contexts in a task is dealt out by context at once.
2. Where one anchor has several contexts, the suffixes from the anchor are sorted, and the bytes before it backwards. For
   each offset before the anchor that gives the order of the suffixes there: by the bytes before, then by the anchor's
   order; common prefixes are range minima, previous and next smaller positions come by pointer jumping, and the longer
   of the two common prefixes is the longest previous factor.
   An anchor with more than ``CROWD`` contexts is made longer first: all windows that start lo to hi bytes before it also
   share the lo bytes before it and some after it, so a context goes to a longer anchor for each quarter of the offsets; of
   contexts that are equal as far as those windows reach, only the first one goes on, as in step 1. An anchor that is a
   window itself has one context left.
3. The intervals of each document are joined to it and cut out.

Defined results: null text counts as empty; texts under LENGTH bytes lose nothing; rows with equal ids are the same
document and share their cuts; rows with a null id come last in order, as one document; a document is read whole by one task,
however long; an empty table gives an empty result. Only id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .kernels import U, _powers, mix, slices, text_bytes

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # neighbouring grams of a window
REACH = LENGTH - GRAM  # bytes of context on either side
LAST = 2**63 - 1  # stands for a null id
WORK = 1 << 19
#: Contexts of one anchor above which it is made longer; and contexts of one anchor in a slice of a task above which they
#: are dealt out by context, and over how many parts.
CROWD, HOT, PARTS = 20_000, 32, 256
TOP = U(2**64 - 1)


def prefix_hashes(body: np.ndarray):
    up, down = _powers.get(len(body) + 1)
    total = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + U(1)) * up[: len(body)], out=total[1:])
    return total, down


def anchors(body: np.ndarray, at: np.ndarray):
    """Of concatenated texts: positions of the anchors, their hashes, and the hash and bounds of their contexts."""
    n = len(body)
    total, down = prefix_hashes(body)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    end = at[1:][row] if n else np.zeros(0, np.int64)
    p = np.arange(n)
    grams = n - GRAM + 1
    if n < LENGTH:
        z = np.zeros(0, np.int64)
        return z, z.view(np.uint64), z.view(np.uint64), z, z
    h = mix((total[GRAM:] - total[:grams]) * down[:grams]) | U(1)
    h[p[:grams] + GRAM > end[:grams]] = TOP
    # Smallest hash of each window, then the largest of those over the windows that hold a gram.
    low, width = h, 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - LENGTH + 1], low[SPAN - width : SPAN - width + n - LENGTH + 1])
    low[p[: n - LENGTH + 1] + LENGTH > end[: n - LENGTH + 1]] = 0
    high = np.zeros(grams + SPAN - 1, np.uint64)
    high[SPAN - 1 : SPAN - 1 + len(low)] = low
    width = 1
    while 2 * width <= SPAN:
        high = np.maximum(high[:-width], high[width:])
        width *= 2
    high = np.maximum(high[:grams], high[SPAN - width : SPAN - width + grams])
    pos = np.flatnonzero((high == h) & (h != TOP))
    r = row[pos]
    a, b = np.maximum(pos - REACH, at[:-1][r]), np.minimum(pos + GRAM + REACH, at[1:][r])
    ctx = mix(mix((total[b] - total[a]) * down[a]) ^ (((pos - a).astype(np.uint64) << U(32)) | (b - pos).astype(np.uint64)))
    return pos, h[pos], ctx, a, b


def merged(doc: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Union of intervals that are sorted by doc and start, ends not falling within a doc."""
    if not len(doc):
        return doc, s, e
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (s[1:] > e[:-1])
    i = np.flatnonzero(first)
    return doc[i], s[i], np.append(e[i[1:] - 1], e[-1])


SENT = "h long, ctx long, doc long, pos int, upto int"


class _Least:
    """The smallest position of every key so far, in sorted runs of doubling size."""

    def __init__(self):
        self.runs: list = []

    def find(self, keys: np.ndarray, doc: np.ndarray, pos: np.ndarray):
        """The smaller of the positions given and those held, for each key."""
        for held, d, p in self.runs:
            at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
            less = (held[at] == keys) & ((d[at] < doc) | ((d[at] == doc) & (p[at] < pos)))
            doc, pos = np.where(less, d[at], doc), np.where(less, p[at], pos)
        return doc, pos

    def add(self, keys: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> None:
        """Sorted distinct keys."""
        run = (keys, doc, pos)
        while self.runs and len(self.runs[-1][0]) <= 2 * len(run[0]):
            k, d, p = (np.concatenate(x) for x in zip(self.runs.pop(), run, strict=True))
            o = np.lexsort((p, d, k))
            keep = np.ones(len(k), bool)
            keep[1:] = k[o][1:] != k[o][:-1]
            o = o[keep]
            run = (k[o], d[o], p[o])
        self.runs.append(run)


#: upto of an anchor's row (less the part that it is dealt to), and of a row that says that an anchor has further contexts
#: in other parts.
ANCHOR, OTHERS = -1, -1_000


def _send(batches):
    """Anchors that are first in this task for their context, and intervals (upto is their end) for others."""
    least = _Least()
    for batch in batches:
        ids = batch.column(0).to_numpy()
        data, offsets = text_bytes(batch.column(1))
        for i, j in slices(offsets, WORK):
            lo = offsets[i]
            body, at = data[lo : offsets[j]], offsets[i : j + 1] - lo
            pos, h, ctx, a, b = anchors(body, at)
            if not len(pos):
                continue
            r = np.searchsorted(at, pos, "right") - 1
            doc, base = ids[i:j][r], at[:-1][r]
            p = pos - base
            key = mix(h ^ (ctx * U(3)))
            # The smallest position of each context so far in this task.
            order = np.lexsort((p, doc, key))
            k, d, q = key[order], doc[order], p[order]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            first = np.flatnonzero(new)
            fd, fq = least.find(k[first], d[first], q[first])
            least.add(k[first], fd, fq)
            group = np.cumsum(new) - 1
            out = np.empty(len(k), bool)
            out[order] = (fd[group] < d) | ((fd[group] == d) & (fq[group] < q))
            mine = ~out
            own, where, many = np.unique(h[mine], return_inverse=True, return_counts=True)
            crowded = many > HOT
            part = np.where(crowded[where], 1 + (ctx[mine] % U(PARTS)).astype(np.int64), 0)
            yield _rows(h[mine].view(np.int64), ctx[mine].view(np.int64), doc[mine], p[mine], ANCHOR - part)
            z = np.zeros(crowded.sum(), np.int64)
            yield _rows(own[crowded].view(np.int64), z, z, z, z + OTHERS)
            x, s, e = merged(r[out], (a - base)[out], (b - base)[out])
            x = ids[i:j][x]
            yield _rows(mix(x.view(np.uint64)).view(np.int64), np.zeros(len(x), np.int64), x, s, e)


def _rows(h, ctx, doc, pos, upto):
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(ctx), pa.array(doc), pa.array(pos.astype(np.int32)), pa.array(upto.astype(np.int32))], ["h", "ctx", "doc", "pos", "upto"])


def _part(upto: Column) -> Column:
    """The part that a row is dealt to; rows other than anchors go with those of part 0."""
    return F.when(upto == OTHERS, ANCHOR).otherwise(F.least(upto, F.lit(ANCHOR)))


def _settle(batches):
    """Rows sorted by h, part, upto, ctx, doc, pos: intervals for later occurrences of a context (pos is the anchor's place:
    the interval is cut to the text later), and first occurrences (ANCHOR) where an anchor has several contexts."""
    last = None  # h, part, ctx, doc and pos of the last first occurrence; whether it has been sent
    known = None  # h of the last OTHERS row
    for batch in batches:
        h, ctx, doc, pos, upto = (c.to_numpy() for c in batch.columns)
        ready = upto >= 0
        if ready.any():
            yield _rows(h[ready], ctx[ready], doc[ready], pos[ready], upto[ready])
        others = h[upto == OTHERS]
        if known is not None:
            others = np.append(known, others)
        known = others[-1] if len(others) else None
        use = ~ready & (upto != OTHERS)
        h, part, ctx, doc, pos = h[use], upto[use], ctx[use], doc[use], pos[use]
        n = len(h)
        if not n:
            continue
        new_h, new_c = np.ones(n, bool), np.ones(n, bool)
        new_h[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
        new_c[1:] = new_h[1:] | (ctx[1:] != ctx[:-1])
        if last is not None and last[0] == h[0] and last[1] == part[0]:
            new_h[0], new_c[0] = False, last[2] != ctx[0]
        head = np.maximum.accumulate(np.where(new_c, np.arange(n), -1))
        hd = np.where(head >= 0, doc[np.maximum(head, 0)], last[3] if last else 0)
        hp = np.where(head >= 0, pos[np.maximum(head, 0)], last[4] if last else 0)
        again = ~new_c & ((hd != doc) | (hp != pos))
        s = np.maximum(pos[again] - REACH, 0)
        yield _rows(h[again], ctx[again], doc[again], s, pos[again] + GRAM + REACH)
        r = np.flatnonzero(new_c)
        if len(r):
            several = ~new_h[r] | (part[r] < ANCHOR) | np.isin(h[r], others)
            several[:-1] |= ~new_h[r[1:]]
            if not new_h[r[0]] and last is not None and not last[5]:
                yield _rows(*(np.array([v]) for v in (last[0], *last[2:5])), np.array([ANCHOR]))
            m = r[several]
            yield _rows(h[m], ctx[m], doc[m], pos[m], np.full(len(m), ANCHOR))
            last = (h[r[-1]], part[r[-1]], ctx[r[-1]], doc[r[-1]], pos[r[-1]], bool(several[-1]))


#: An anchor's context: the windows that start lo to hi bytes before it stand in the bucket h.
CONTEXT = "h long, lo int, hi int, doc long, pos int, before int, bytes binary"


def _context(h, lo, hi, doc, pos, before, texts):
    ints = lambda x: pa.array(np.asarray(x).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(h), ints(lo), ints(hi), pa.array(doc), ints(pos), ints(before), pa.array(texts, pa.binary())], ["h", "lo", "hi", "doc", "pos", "before", "bytes"])


def _contexts(batches):
    """doc, anchors (array of h, pos), text: each anchor's context."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        lists, ids = batch.column(1), batch.column(0).to_numpy()
        counts = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        h, pos = (flat.field(k).to_numpy() for k in range(2))
        row = np.repeat(np.arange(batch.num_rows), counts)
        a = np.maximum(offsets[row] + pos - REACH, offsets[row])
        b = np.minimum(offsets[row] + pos + GRAM + REACH, offsets[row + 1])
        for i in range(0, len(h), 20_000):
            k = slice(i, i + 20_000)
            texts = [data[x:y].tobytes() for x, y in zip(a[k], b[k], strict=True)]
            yield _context(h[k], np.zeros(len(texts)), np.full(len(texts), REACH), ids[row[k]], pos[k], offsets[row[k]] + pos[k] - a[k], texts)


LONGER = f"{CONTEXT}, reach long"


def _longer(batches):
    """Contexts of crowded anchors to those of longer anchors, one for each quarter of the offsets, and reach: a hash of all
    that those windows reach. Without bytes: intervals pos to before, for contexts that are not first in this task."""
    least = _Least()
    for batch in batches:
        lo, hi, doc, pos, before = (batch.column(k).to_numpy() for k in range(1, 6))
        data, at = text_bytes(batch.column(6))
        body = data[at[0] : at[-1]]
        total, down = prefix_hashes(body)
        at = at - at[0]
        digest = lambda s, e: mix((total[e] - total[s]) * down[s])  # noqa: B023, E731
        after = at[1:] - at[:-1] - before
        step, gone = (hi - lo) // 4 + 1, []
        for x in (lo, lo + step, lo + 2 * step, lo + 3 * step):
            y = np.minimum(x + step - 1, hi)
            ok = np.flatnonzero((x <= y) & (lo < hi) & (np.minimum(y, before) >= np.maximum(x, LENGTH - after)))
            if not len(ok):
                continue
            x, y, d, p, b = x[ok], y[ok], doc[ok], pos[ok], before[ok]
            mid, span = at[:-1][ok] + b, (x.astype(np.uint64) << U(32)) | y.astype(np.uint64)
            h = mix(digest(mid - x, mid + LENGTH - y) ^ mix(span))
            left, right = np.minimum(y, b), np.minimum(LENGTH - x, after[ok])
            reach = mix(digest(mid - left, mid + right) ^ mix((left.astype(np.uint64) << U(32)) | right.astype(np.uint64)))
            key = mix(h ^ (reach * U(3)))
            order = np.lexsort((p, d, key))
            new = np.ones(len(ok), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            first = order[new]
            fd, fp = least.find(key[first], d[first], p[first])
            least.add(key[first], fd, fp)
            group = np.cumsum(new) - 1
            later = np.empty(len(ok), bool)
            later[order] = (fd[group] < d[order]) | ((fd[group] == d[order]) & (fp[group] < p[order]))
            gone.append((d[later], (p - left)[later], (p + right)[later]))
            on = np.flatnonzero(~later)
            texts = [body[m - u : m + v].tobytes() for m, u, v in zip(mid[on], left[on], right[on], strict=True)]
            out = _context(h[on].view(np.int64), x[on], y[on], d[on], p[on], left[on], texts)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(reach[on].view(np.int64))], [*out.schema.names, "reach"])
        # The quarters' intervals of a context overlap, and so do those of neighbouring anchors.
        if gone:
            d, s, e = (np.concatenate(c) for c in zip(*gone, strict=True))
            order = np.lexsort((s, d))
            d, s, e = d[order], s[order], e[order].astype(np.int64)
            own = np.cumsum(np.append(True, d[1:] != d[:-1])) << 32
            d, s, e = merged(d, s, np.maximum.accumulate(own + e) - own)
            z = np.zeros(len(d), np.int64)
            out = _context(mix(d.view(np.uint64)).view(np.int64), z, z, d, s, e, [None] * len(d))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(z)], [*out.schema.names, "reach"])


def _firsts(batches):
    """Rows sorted by h, reach, doc, pos: contexts that aren't the first become intervals."""
    last = None
    for batch in batches:
        h, lo, hi, doc, pos, before = (batch.column(k).to_numpy() for k in range(6))
        reach, texts = batch.column(7).to_numpy(), batch.column(6)
        ready = np.asarray(texts.is_null())
        sizes = np.diff(text_bytes(texts)[1])
        use = np.flatnonzero(~ready)
        again = np.zeros(len(h), bool)
        if len(use):
            k = np.stack([h[use], reach[use]])
            new = np.ones(len(use), bool)
            new[1:] = (k[:, 1:] != k[:, :-1]).any(0)
            new[0] = last is None or (k[:, 0] != last[0]).any()
            head = np.maximum.accumulate(np.where(new, np.arange(len(use)), -1))
            fd = np.where(head >= 0, doc[use][np.maximum(head, 0)], last[1] if last else 0)
            fp = np.where(head >= 0, pos[use][np.maximum(head, 0)], last[2] if last else 0)
            again[use] = ~new & ((fd != doc[use]) | (fp != pos[use]))
            last = (k[:, -1], fd[-1], fp[-1])
            repeat = use[~new & ~again[use]]  # the same occurrence once more, from repeated rows
            keep = np.ones(len(h), bool)
            keep[repeat] = False
        else:
            keep = np.ones(len(h), bool)
        s, e = np.where(again, pos - before, pos), np.where(again, pos - before + sizes, before)
        kept = texts.to_numpy(zero_copy_only=False)[keep]
        kept[again[keep]] = None
        yield _context(h[keep], lo[keep], hi[keep], doc[keep], s[keep], e[keep], kept)


def _order(h: np.ndarray, body: np.ndarray):
    """Rows of body (0 for none) sorted inside h: the order, and the common prefix of each with the one before it, -1 where
    h changes."""
    width = body.shape[1]
    keys = np.empty((len(h), 8 + width), np.uint8)
    keys[:, :8] = np.ascontiguousarray(h).view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    keys[:, 8:] = body
    order = np.argsort(keys.view(f"S{8 + width}")[:, 0], kind="stable")
    common = np.full(len(h), -1, np.int16)
    x, y, g = body[order[1:]], body[order[:-1]], h[order]
    unequal = x != y
    common[1:] = np.where(g[1:] == g[:-1], np.where(unequal.any(1), unequal.argmax(1), width), -1)
    return order, common


class _Minima:
    """Minima of ranges of an array."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while 2 << (len(self.levels) - 1) <= len(x):
            half, y = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(y[:-half], y[half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima from a to b, both included."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.levels[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][a[at]], self.levels[k][b[at] - (1 << k) + 1])
        return out


def _smaller(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For suffixes in order, with common prefixes with the one before (0 where there is none): the common prefix with the
    previous one of smaller place, 0 without one."""
    before, least = np.arange(len(place)) - 1, common.copy()
    before[common == 0] = -1
    open_ = np.flatnonzero(before >= 0)
    while len(open_ := open_[(before[open_] >= 0) & (place[np.maximum(before[open_], 0)] >= place[open_])]):
        j = before[open_]
        least[open_], before[open_] = np.minimum(least[open_], least[j]), before[j]
    return np.where(before >= 0, least, 0)


def longest_previous(h, lo, hi, doc, pos, before, texts, least: int = LENGTH):
    """Yields d, rows and longest previous factors (up to LENGTH) of the suffixes that start d bytes before the anchors of
    rows; those that can't reach least are left out."""
    n = len(h)
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    mid = np.cumsum(sizes) - sizes + before
    after = np.minimum(sizes - before, LENGTH)
    ahead = np.minimum(before, REACH)
    grid = np.arange(LENGTH)
    # UTF-8 has no byte 255, so one more than each byte leaves 0 for the end.
    right = np.where(grid < after[:, None], flat[np.minimum(mid[:, None] + grid, len(flat) - 1)] + np.uint8(1), 0).astype(np.uint8)
    left = np.where(grid[:REACH] < ahead[:, None], flat[np.maximum(mid[:, None] - 1 - grid[:REACH], 0)] + np.uint8(1), 0).astype(np.uint8)
    by_right, common = _order(h, right)
    by_left, shared = _order(h, left)
    rank, minima = np.empty(n, np.int64), _Minima(common)
    rank[by_right] = np.arange(n)
    place = np.empty(n, np.int64)
    text_order = np.lexsort((pos, doc))
    d0, p0 = doc[text_order], pos[text_order]
    place[text_order] = np.cumsum(np.concatenate([[True], (d0[1:] != d0[:-1]) | (p0[1:] != p0[:-1])])) if n else 0
    side, other = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(lo.min()), int(hi.max()) + 1):
        side[by_left] = np.cumsum(shared < d)
        other[by_right] = np.cumsum(common < min(LENGTH, max(least - d, 0)))
        at = np.flatnonzero((lo <= d) & (d <= hi) & (ahead >= d) & (after >= least - d))
        # Suffixes that share the bytes before or after the anchor with no other one can't reach least.
        for x in (side, other):
            at = at[np.bincount(x[at], minlength=1)[x[at]] > 1] if len(at) else at
        if not len(at):
            continue
        at = at[np.argsort(side[at] * n + rank[at])]
        r, s = rank[at], side[at]
        near = np.zeros(len(at), np.int64)
        same = np.flatnonzero(s[1:] == s[:-1]) + 1
        near[same] = d + minima.of(r[same - 1] + 1, r[same])
        near = np.minimum(near, d + after[at])
        up = _smaller(place[at], near)
        down = _smaller(place[at][::-1], np.append(near[1:], 0)[::-1])[::-1]
        yield d, at, np.minimum(np.maximum(up, down), np.minimum(LENGTH, d + after[at]))


def window_repeats(h, lo, hi, doc, pos, before, texts):
    """Intervals of the windows around anchors whose longest previous factor is LENGTH."""
    rows, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d, at, factor in longest_previous(h, lo, hi, doc, pos, before, texts):
        hit = at[factor >= LENGTH]
        rows.append(hit)
        starts.append(pos[hit].astype(np.int64) - d)
    x, w = np.concatenate(rows), np.concatenate(starts)
    o = np.lexsort((w, x))
    r, a, b = merged(x[o], w[o], w[o] + LENGTH)
    return doc[r], a, b


def _compare(batches):
    """Rows sorted by h; whole buckets at a time."""
    held, n = [], 0
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held.append(cols)
        n += len(cols[0])
        # A batch that only goes on with the last bucket can't be cut.
        if n < 8192 or cols[0][0] == cols[0][-1]:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = np.flatnonzero(cols[0][1:] != cols[0][:-1])[-1] + 1
        yield _found(*window_repeats(*[c[:cut] for c in cols]))
        held, n = [[c[cut:] for c in cols]], len(cols[0]) - cut
    if n:
        yield _found(*window_repeats(*[np.concatenate(x) for x in zip(*held, strict=True)]))


def _found(doc, s, e):
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["doc", "s", "e"])


def _cut(with_bytes: bool):
    """doc_id, cuts, text: counts, hash and, if asked for, what is left."""
    return lambda batches: _cut_batches(batches, with_bytes)


def _cut_batches(batches, with_bytes: bool):
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        cuts = batch.column(1).to_pylist()
        out: list[list] = [[], [], [], [], []]
        for i in range(batch.num_rows):
            body = data[offsets[i] : offsets[i + 1]].tobytes()
            kept, end, gone, spans, open_ = [], 0, 0, 0, False
            for c in sorted((c["s"], min(c["e"], len(body))) for c in cuts[i] or ()):
                if c[0] > end or not open_:
                    kept.append(body[end : c[0]])
                    spans += 1
                    gone += c[1] - c[0]
                    end, open_ = c[1], True
                elif c[1] > end:
                    gone += c[1] - end
                    end = c[1]
            kept.append(body[end:])
            left = b"".join(kept)
            for k, v in enumerate((len(body), gone, spans, hashlib.sha256(left).hexdigest(), left if with_bytes else None)):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _crowded(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("h")


def _intervals(contexts: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, s, e of the windows that an earlier position has too. Crowded anchors are made longer until their buckets are
    small, or hold one window each."""
    cuts = None
    while True:
        crowded = scratch.put(_crowded(contexts), "crowded")
        some = crowded.limit(1).count() > 0
        small = contexts.join(crowded, "h", "left_anti") if some else contexts
        found = small.repartition("h").sortWithinPartitions("h").mapInArrow(_compare, "doc long, s int, e int")
        cuts = found if cuts is None else cuts.unionByName(found)
        if not some:
            return cuts
        rows = contexts.join(crowded, "h", "left_semi").mapInArrow(_longer, LONGER).repartition("h", "reach")
        rows = scratch.put(rows.sortWithinPartitions("h", "reach", "doc", "pos").mapInArrow(_firsts, CONTEXT), "longer")
        cuts = cuts.unionByName(rows.where("bytes is null").select("doc", F.col("pos").alias("s"), F.col("before").alias("e")))
        contexts = rows.where("bytes is not null")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes, which cuts may leave as broken
    UTF-8; null without with_bytes) for each row."""
    scratch = Scratch(docs.sparkSession)
    lean = docs.select(F.coalesce(docs[key].cast("long"), F.lit(LAST)).alias("doc"), docs[text].alias("t"), docs[key].cast("long").alias("doc_id"))
    long = lean.where(F.octet_length("t") >= LENGTH).select("doc", "t")
    sent = long.mapInArrow(_send, SENT)
    part = _part(F.col("upto"))
    level = scratch.put(sent.repartition(F.col("h"), part).sortWithinPartitions(F.col("h"), part, "upto", "ctx", "doc", "pos").mapInArrow(_settle, SENT), "level")
    cuts = level.where("upto >= 0").select("doc", F.col("pos").alias("s"), F.col("upto").alias("e"))
    first = level.where(F.col("upto") == ANCHOR).select("h", "doc", "pos")
    listed = first.groupBy("doc").agg(F.collect_list(F.struct("h", "pos")).alias("anchors"))
    contexts = scratch.put(listed.join(long, "doc").select("doc", "anchors", "t").mapInArrow(_contexts, CONTEXT), "contexts")
    cuts = cuts.unionByName(_intervals(contexts, scratch))
    cuts = cuts.groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("cuts"))
    return lean.join(cuts, "doc", "left").select("doc_id", "cuts", "t").mapInArrow(_cut(with_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
