"""Helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise.scratch import Scratch, released, shared_dir

__all__ = ["SPACE", "WORD", "Scratch", "fresh", "held_out", "let", "long_array", "released", "shared_dir", "words"]

#: White space that separates words, as a Java and Python character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, so that extra columns can't clash."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def let(df: DataFrame, name: str, **exprs: Column) -> DataFrame:
    """Adds columns name__key that the optimizer neither repeats nor moves into lambdas or filters."""
    return df.select("*", F.inline_outer(F.array(F.struct(*[e.alias(f"{name}__{k}") for k, e in exprs.items()]))))


def long_array(spark: SparkSession, values: np.ndarray) -> Column:
    """An array<bigint> literal that is one block of bytes and that plans print in a few characters. array(...) has an
    expression for each element, lit of a NumPy array prints each, in every copy and description of a plan that the driver
    makes and keeps."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    held = gateway.new_array(jvm.long, len(values))
    jvm.java.nio.ByteBuffer.wrap(np.asarray(values, ">i8").tobytes()).asLongBuffer().get(held)
    catalyst = jvm.org.apache.spark.sql.catalyst.expressions
    block = catalyst.UnsafeArrayData.fromPrimitiveArray(held)
    kind = jvm.org.apache.spark.sql.types.DataType.fromDDL("array<bigint>")
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(catalyst.Literal(block, kind)))


def words(text: Column) -> Column:
    """The words of a text, none for null."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, rf"[{SPACE}]+"))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn labels from; a null id isn't one."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))
