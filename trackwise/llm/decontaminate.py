"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Tokens are lower-cased runs of letters and digits. A mask names the positions of a short window that count; the ones it
leaves out may differ. Hashes of all benchmark windows under all masks are joined with those of all document windows. Two
bit sets made from the benchmark (eight slots a hash, between ``SLOTS`` and ``MOST_SLOTS``) drop nearly all document windows
before the join; they have no false negatives. A hit names a diagonal: item, document and the difference of positions.
On each diagonal the tokens are compared one by one, and a stretch of ``SPAN`` tokens (the item's length if shorter) with
at least ``SAME`` of them equal is a leak.

The masks miss no leak: whichever tokens of a stretch differ, as long as ``SAME`` of them are equal, one of the masks for
its length lies on equal tokens only. Items shorter than ``SPAN`` have masks by their length, which the documents are
searched with only if the benchmark has such items.

Defined results: null or empty texts on either side have no tokens and match nothing; items shorter than ``SPAN`` are
compared over their own length, those of up to 3 tokens whole; ties go to the longest match, then the smallest position;
repeated rows are reported once per id; a null id is reported as null; texts of any length are read whole, and the
diagonals kept for one of them and an item are at most as many as both have tokens; empty tables give an empty result. Only
the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, long_array

# The masks by the length of the stretch compared; 1 counts, 0 is ignored.
MASKS = {
    1: ["1"],
    2: ["11"],
    3: ["111"],
    4: ["111", "1101", "1011"],
    5: ["1111", "11101", "11011", "10111"],
    6: ["1111", "11011"],
    7: ["11011"],
    8: ["1111", "11011", "1100011"],
    9: ["11101", "100111"],
    10: ["111011", "1101011", "1110011"],
    11: ["1101011", "1110011"],
    12: ["11101", "10111"],
    13: ["111011", "1101011", "1100001011"],
}
SLOTS, MOST_SLOTS = 1 << 19, 1 << 22
POS_BITS = 30
SPAN, SAME = 13, 0.75


def tokens(text: Column) -> Column:
    """Hashes of a text's tokens."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(h: Column, mask: str) -> Column:
    """For each window: its masked hash (34 bits) above its position (30 bits)."""
    at = [i for i, c in enumerate(mask) if c == "1"]
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (len(mask) - 1), F.lit(0))), lambda x, i: F.shiftleft(F.xxhash64(F.lit(mask), x, *[F.get(h, i + k) for k in at[1:]]), POS_BITS).bitwiseOR(i.cast("long")))


def _key(x: Column) -> Column:
    return F.shiftrightunsigned(x, POS_BITS)


def _slot(key: Column, which: int, slots: int) -> Column:
    return F.pmod(key if which == 0 else F.shiftright(key, 7), F.lit(slots if which == 0 else slots - 3)).cast("int")


def _bits(keys: DataFrame, which: int, slots: int) -> Column:
    """An array literal of bits, 64 in an element, set at the slots of keys. The driver reads slots / 64 numbers at most,
    however large the benchmark."""
    slot = _slot(F.col("key"), which, slots)
    cells = np.zeros(slots // 64, np.int64)
    for cell, bits in keys.groupBy(F.shiftright(slot, 6).alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63))))).collect():
        cells[cell] = bits
    return long_array(keys.sparkSession, cells)


def _has(bits: Column, slot: Column) -> Column:
    return F.call_function("shiftright", F.get(bits, F.shiftright(slot, 6)), slot.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_same, n_span, doc_start (token position): one row for each document and item it leaks."""
    every = _leaks(docs, benchmark, key, text, item, item_text)
    best = every.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_same", (-F.col("doc_start")).alias("back"), "n_span")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n_same").alias("n_same"), F.col("m.n_span").alias("n_span"), (-F.col("m.back")).alias("doc_start"))


def _row(docs: DataFrame, key: str, text: str) -> Column:
    """What tells rows with a null id apart, null for the others."""
    return F.when(docs[key].isNull(), F.xxhash64(docs[text]))


def _meets(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["row"].eqNullSafe(b["row"])


def _leaks(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """doc_id, row, item_id, n_same, n_span, doc_start of every diagonal that is a leak."""
    scratch = Scratch(docs.sparkSession)
    items = scratch.put(benchmark.select(benchmark[item].alias("item_id"), tokens(benchmark[item_text]).alias("ih")).where(F.size("ih") > 0), "items")
    span = F.least(F.size("ih"), F.lit(SPAN))
    lengths = {n for (n,) in items.select(span).distinct().collect()} or {SPAN}  # SPAN numbers at most
    masks = {m: [n for n in sorted(lengths) if m in MASKS[n]] for n in sorted(lengths) for m in MASKS[n]}
    ikeys = items.select("item_id", F.explode(F.concat(*[F.when(span.isin(ns), _seeds(F.col("ih"), m)).otherwise(F.array().cast("array<bigint>")) for m, ns in masks.items()])).alias("x"))
    ikeys = scratch.put(ikeys.select("item_id", _key(F.col("x")).alias("key"), F.col("x").bitwiseAND(F.lit((1 << POS_BITS) - 1)).alias("ipos")), "keys")
    lean = docs.select(docs[key].alias("doc_id"), _row(docs, key, text).alias("row"), docs[text].alias("t"))
    df = let(lean, "d", h=tokens(F.col("t")))
    slots = min(MOST_SLOTS, max(SLOTS, 1 << (8 * ikeys.count()).bit_length()))
    bits = [_bits(ikeys, w, slots) for w in (0, 1)]
    df = let(df, "d", **{f"s{i}": _seeds(F.col("d__h"), m) for i, m in enumerate(masks)})
    may = [F.filter(F.col(f"d__s{i}"), lambda x: _has(bits[0], _slot(_key(x), 0, slots)) & _has(bits[1], _slot(_key(x), 1, slots))) for i in range(len(masks))]
    seen = let(df, "d", may=F.concat(*may)).select("doc_id", "row", F.explode("d__may").alias("x"))
    seen = seen.select("doc_id", "row", _key(F.col("x")).alias("key"), F.col("x").bitwiseAND(F.lit((1 << POS_BITS) - 1)).alias("pos"))
    diag = seen.join(ikeys, "key").select("doc_id", "row", "item_id", (F.col("pos") - F.col("ipos")).cast("int").alias("diag")).distinct()
    diag = scratch.put(diag.groupBy("doc_id", "row", "item_id").agg(F.collect_set("diag").alias("diags")), "diagonals")
    hit = diag.select("doc_id", "row").distinct()
    mine = lean.join(hit, _meets(lean, hit), "left_semi")
    mine = scratch.put(let(mine, "d", h=tokens(F.col("t"))).select("doc_id", "row", F.col("d__h").alias("h")), "texts")
    both = mine.join(diag, _meets(mine, diag)).select(mine["doc_id"], mine["row"], "h", "item_id", "diags").join(items, "item_id")
    every = let(both.select("doc_id", "row", "item_id", "h", "ih", F.explode("diags").alias("diag")), "v", same=F.transform("ih", lambda x, i: F.when(F.get("h", F.col("diag") + i) == x, 1).otherwise(0)), span=F.least(F.size("ih"), F.lit(SPAN)))
    same, span = F.col("v__same"), F.col("v__span")
    run = F.transform(F.sequence(F.lit(1), F.size(same) - span + 1), lambda i: F.aggregate(F.slice(same, i, span), F.lit(0), lambda a, x: a + x))
    every = let(every, "v", best=F.array_max(run)).where(F.col("v__best") >= F.ceil(F.col("v__span") * SAME))
    total = F.aggregate(same, F.lit(0), lambda a, x: a + x)
    return every.select("doc_id", "row", "item_id", total.alias("n_same"), F.col("v__span").alias("n_span"), F.greatest(F.col("diag"), F.lit(0)).alias("doc_start"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that leak no benchmark item, with their own columns."""
    bad = _leaks(docs, benchmark, key, text, item, item_text).select(F.col("doc_id").alias("__leak"), F.col("row").alias("__row")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["__leak"]) & _row(docs, key, text).eqNullSafe(bad["__row"]), "left_anti")


def oracle(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """The same in DuckDB, without seeds: every diagonal on which an item and a document share enough tokens at all."""
    return rf"""with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as h from {documents} where text is not null),
  i as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as h from {benchmark} where text is not null),
  dt as (select doc_id, unnest(h) as w, unnest(range(len(h))) as pos from d),
  it as (select item_id, len(h) as n, least(len(h), {SPAN}) as span, unnest(h) as w, unnest(range(len(h))) as pos from i),
  same as (select doc_id, item_id, n, span, dt.pos - it.pos as diag, it.pos as ipos from dt join it on dt.w = it.w),
  able as (select doc_id, item_id, n, span, diag, list(distinct ipos) as hits from same group by all having count(distinct ipos) >= ceil(span * {SAME})),
  best as (select *, list_max(list_transform(range(n - span + 1), lambda a: len(list_filter(hits, lambda x: x >= a and x < a + span)))) as most from able)
select doc_id, item_id, m.n_same::int as n_same, m.n_span::int as n_span, (-m.back)::int as doc_start from (
  select doc_id, item_id, max({{'n_same': len(hits), 'back': -greatest(diag, 0), 'n_span': span}}) as m from best where most >= ceil(span * {SAME}) group by all)"""
