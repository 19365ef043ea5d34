"""Array arithmetic on feature vectors; column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO = 0.0


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(_ZERO), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * k)


def l2norm(a: Column, floor: float = 1e-12) -> Column:
    """Unit norm, the norm clamped from below."""
    return F.transform(F.array(F.greatest(norm(a), F.lit(floor))), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def unit_each(a: Column, eps: float = 1e-8) -> Column:
    """Unit norm with eps added to the norm."""
    return F.transform(F.array(norm(a) + eps), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def fuse_each(image: Column, text: Column, text_weight: float = 1.0) -> Column:
    """Each modality to unit norm, the text weighted, joined."""
    return F.concat(unit_each(image), scale(unit_each(text), F.lit(text_weight)))


def fuse_jointly(image: Column, text: Column, text_weight: float = 1.0) -> Column:
    """The weighted join to unit norm; a zero row gives NaN."""
    both = F.concat(doubles(image), scale(text, F.lit(text_weight)))
    return F.transform(F.array(norm(both)), lambda n: F.transform(both, lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x / n)))[0]


def cosine_loss(rec: Column, target: Column, floor: float = 1e-12) -> Column:
    """1 - cos of two vectors; the open variants clamp norms at 1e-6."""
    return 1 - dot(rec, target) / (F.greatest(norm(rec), F.lit(floor)) * F.greatest(norm(target), F.lit(floor)))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x.cast("double") - top))
    return F.transform(F.array(total(e)), lambda t: F.transform(e, lambda x: x / t))[0]


def ema(old: Column, new: Column, decay: float, unit: bool = False) -> Column:
    """Moving average of two vectors, to unit norm on request."""
    mean = F.zip_with(old, new, lambda o, n: o * decay + n * (1 - decay))
    return l2norm(mean) if unit else mean


def scale_pixels(a: Column, mean: list[float], std: list[float]) -> Column:
    """[0, 1] or [0, 255] values to [-1, 1], then mean and standard deviation by channel (cyclic)."""
    k = len(mean)
    one = F.when(F.array_max(a) <= 1.0, F.transform(a, lambda x: x * 2.0 - 1.0)).otherwise(F.transform(a, lambda x: x / 127.5 - 1.0))
    ms, ss = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    return F.transform(one, lambda x, i: (x - F.get(ms, i % k)) / F.get(ss, i % k))


def top_k(values: Column, k: int) -> Column:
    """Structs v, i of the k largest values, ties to the smaller index."""
    return F.slice(F.array_sort(F.transform(values, lambda x, i: F.struct((-x).alias("o"), i.alias("i"), x.alias("v")))), 1, k)
