"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with references of its
language by Jensen-Shannon distance (base 2, 0 to 1). The references are mean histograms over all documents of the
language that have at least ``min_words`` words, so one long document can't own them by length. One pass over the texts
writes small features; references (one row per language, partial sums first) and verdicts come from those.

Defined results: null, empty or blank text has zero words and fails the base rule; rows with a null language are compared
with each other; without a reference only the base rule speaks; repeated rows are judged alike; an empty table gives an
empty result; texts of any length are read whole (up to 2^30 words), a tie with a threshold passes; extra columns are
untouched, whatever their names. Texts below ``min_words`` are left to the base rule (minimum-length guard).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, fresh, let, words

# Frequent words by language, the bins of the common-word histogram.
COMMON = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "as", "on", "at"],
    "es": ["de", "la", "que", "el", "en", "los", "se", "del", "las", "un", "por", "con"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "dans", "pour"],
}
#: Bins for a language without a list of its own.
OTHER = ["de", "la", "the", "of", "in", "en", "der", "die", "que", "and", "el", "le"]
SYMBOLS = r"#*$%&|<>"
#: Low bits of a packed three-word window that hold its position; the rest hold its hash.
POS_BITS = 30
CHAR_BINS, WORD_BINS = 5, len(OTHER) + 1
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _bins(lang: Column) -> Column:
    out = F.array(*map(F.lit, OTHER))
    for k, v in COMMON.items():
        out = F.when(lang == k, F.array(*map(F.lit, v))).otherwise(out)
    return out


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, rf"[^{chars}]+", "")).cast("long")


def _unit(xs: Column) -> Column:
    total = F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(total > 0, F.transform(xs, lambda x: x / total))


def _plog(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence of two histograms of equal length."""
    terms = F.zip_with(p, q, lambda x, y: _plog(x, (x + y) / 2) + _plog(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def features(df: DataFrame, text: Column, lang: Column, name: str) -> DataFrame:
    """Adds name__n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words, __chars and __common (histograms
    that sum to 1; null without characters or words). One pass, each row on its own."""
    t, col, at = F.coalesce(text, F.lit("")), lambda k: F.col(f"{name}__{k}"), F.get
    df = let(df, name, words=words(text), bins=_bins(F.coalesce(lang, F.lit(""))))
    w = col("words")
    grams = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.shiftleft(F.xxhash64(x, at(w, i + 1), at(w, i + 2)), POS_BITS).bitwiseOR(i.cast("long")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))
    every = sorted({x for v in [*COMMON.values(), OTHER] for x in v})
    df = let(df, name, s=F.sort_array(grams), lines=lines, hits=F.filter(w, lambda x: x.isin(every)), n_words=F.size(w).cast("long"),
             word_chars=F.length(F.concat_ws("", w)).cast("long"), n_symbols=_count(t, SYMBOLS), upper=_count(t, r"\p{Lu}"), stops=_count(t, r".,;:?!'\"()\-"))
    s, hits, n, shift = col("s"), col("hits"), F.length(t).cast("long"), lambda x: F.shiftright(x, POS_BITS)
    maybe = F.transform(F.filter(s, lambda x, i: (shift(x) == shift(at(s, i - 1))) | (shift(x) == shift(at(s, i + 1)))), lambda x: x.bitwiseAND(F.lit((1 << POS_BITS) - 1)).cast("int"))
    raw = F.array(col("word_chars") - col("n_symbols") - col("upper") - col("stops"), col("upper"), col("stops"), col("n_symbols"), n - col("word_chars"))
    counts = F.transform(col("bins"), lambda b: F.size(F.filter(hits, lambda h: h == b)).cast("long"))
    df = let(df, name, maybe=maybe, raw=raw, counts=counts, n_dup_lines=(F.size(col("lines")) - F.size(F.array_distinct(col("lines")))).cast("long"))
    # Equal hashes are confirmed on the words themselves.
    exact = F.array_sort(F.transform(col("maybe"), lambda p: F.struct(F.concat_ws(" ", at(w, p), at(w, p + 1), at(w, p + 2)).alias("g"), p.alias("p"))))
    df = let(df, name, exact=exact, all=F.array_append(col("counts"), col("n_words") - F.aggregate(col("counts"), F.lit(0).cast("long"), lambda u, x: u + x)))
    e = col("exact")
    seen = F.sort_array(F.transform(F.filter(e, lambda x, i: (x.g == at(e, i - 1).g) | (x.g == at(e, i + 1).g)), lambda x: x.p))
    df = let(df, name, seen=seen, chars=_unit(col("raw")), common=_unit(col("all")))
    q = col("seen")
    covered = F.aggregate(F.transform(q, lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - at(q, i - 1)))), F.lit(0), lambda u, x: u + x)
    return let(df, name, n_repeat_words=covered.cast("long"))


def language_references(feats: DataFrame, lang: str, name: str, min_words: int = 50) -> DataFrame:
    """One row per language: mean histograms over its documents that are long enough."""
    at = lambda c, i: F.get(f"{name}__{c}", F.lit(i))
    return feats.where(F.col(f"{name}__n_words") >= min_words).groupBy(F.coalesce(lang, F.lit("")).alias("ref")).agg(
        F.array(*[F.avg(at("chars", i)) for i in range(CHAR_BINS)]).alias("ref_chars"), F.array(*[F.avg(at("common", i)) for i in range(WORD_BINS)]).alias("ref_common"))


def with_divergence(feats: DataFrame, lang: str, name: str, min_words: int = 50, max_chars: float = 0.165, max_common: float = 0.3) -> DataFrame:
    """feats with name__js_chars, __js_common (null without a reference), __base_failed and __kept. The join's small side
    has one row per language."""
    refs, col = language_references(feats, lang, name, min_words), lambda k: F.col(f"{name}__{k}")
    key = fresh(feats, "__lang")
    df = feats.withColumn(key, F.coalesce(lang, F.lit(""))).join(refs, F.col(key) == F.col("ref"), "left")
    df = let(df, name, js_chars=js_distance(col("chars"), F.col("ref_chars")), js_common=js_distance(col("common"), F.col("ref_common")))
    base = (col("n_words") < min_words) | (100 * col("n_repeat_words") > 50 * col("n_words"))
    fits = (F.coalesce(col("js_chars"), F.lit(0.0)) <= max_chars) & (F.coalesce(col("js_common"), F.lit(0.0)) <= max_common)
    return df.withColumns({f"{name}__base_failed": base, f"{name}__kept": ~base & fits})


def quality(docs: DataFrame, keys: list[str], text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """keys and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, js_chars, js_common, base_failed, kept.

    The features, some hundred bytes a document, are written once; references and verdicts are made from them."""
    ks = [f"k{i}" for i in range(len(keys))]
    lean = docs.select(*[docs[k].alias(a) for k, a in zip(keys, ks, strict=True)], docs[text].alias("t"), docs[lang].cast("string").alias("l"))
    feats = features(lean, F.col("t"), F.col("l"), "q").select(*ks, "l", *[f"q__{c}" for c in [*BASE, "chars", "common"]])
    feats = Scratch(docs.sparkSession).put(feats, "features")
    out = [*BASE, "js_chars", "js_common", "base_failed", "kept"]
    return with_divergence(feats, "l", "q", **options).select(*[F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)], *[F.col(f"q__{c}").alias(c) for c in out])


def reject_low_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The rows that pass, with their own columns. A row is known by its id and a hash of text and language, so repeated
    rows share a verdict and a null id is no obstacle."""
    mark = F.xxhash64(docs[text], docs[lang])
    lean = docs.select(docs[key].alias("i"), mark.alias("m"), docs[text].alias("t"), docs[lang].alias("l"))
    bad = quality(lean, ["i", "m"], "t", "l", **options).where(~F.col("kept")).select(F.col("i").alias("__bad_i"), F.col("m").alias("__bad_m")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["__bad_i"]) & (mark == bad["__bad_m"]), "left_anti")
