"""Seams for models that the caller supplies: columns in, columns out, one model for each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PROVIDERS: dict[str, Callable] = {}


def register_model(name: str, provider: Callable) -> None:
    """provider() is called once a worker and returns a function from a pandas frame of inputs to a list of outputs."""
    _PROVIDERS[name] = provider


def model(name: str) -> Callable:
    if name not in _PROVIDERS:
        raise NotImplementedError(f"no model is registered as {name}")
    return _PROVIDERS[name]


def infer(df: DataFrame, inputs: list[str], provider: Callable, returns: str, out: str = "output") -> DataFrame:
    """Adds provider's output for each row. A batch that fails gives nulls, and the job goes on."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        predict = provider()
        for batch in batches:
            try:
                got = list(predict(batch))
            except Exception:
                got = [None] * len(batch)
            yield pd.Series(got)

    return df.withColumn(out, run(F.struct(*inputs)))


def infer_masks(df: DataFrame, provider: Callable) -> DataFrame:
    """path, height, width to mask runs: path, class_id, row, col_start, col_end."""
    runs = "array<struct<class_id int, row int, col_start int, col_end int>>"
    return infer(df, ["path", "height", "width"], provider, runs, "runs").select("path", F.inline("runs"))


def generate_text(df: DataFrame, provider: Callable) -> DataFrame:
    """original_image_path, bbox_image_path, inference_result."""
    return infer(df, ["ori_path", "bbox_path"], provider, "string", "inference_result").select(F.col("ori_path").alias("original_image_path"), F.col("bbox_path").alias("bbox_image_path"), F.trim("inference_result").alias("inference_result"))
