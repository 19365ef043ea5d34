"""The corpus pipeline: quality rules, near-duplicates, benchmark leaks, personal data, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. ``run`` writes each stage's rows to the shared folder and reads them again.

Odd inputs have the results that the operators' docstrings state: null or empty texts fail the first stage, rows with a null
id are judged by their text, repeated rows share their fate, texts of any length are read whole, an empty table stays empty,
and further columns of any name pass through.
"""

from __future__ import annotations

from trackwise.llm.common import Scratch, released
from trackwise.llm.decontaminate import drop_leaks
from trackwise.llm.mixing import mix
from trackwise.llm.near_dedup import drop_near_duplicates
from trackwise.llm.pii import replace_pii, session_secret
from trackwise.llm.quality import reject_low_quality


def quality_rules(spark, docs, sf_dir):
    return reject_low_quality(docs)


def near_duplicates(spark, docs, sf_dir):
    return drop_near_duplicates(docs)


def decontamination(spark, docs, sf_dir):
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark, docs, sf_dir):
    return replace_pii(docs, session_secret(spark))


def mixing(spark, docs, sf_dir):
    return mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing", mixing),
]

#: Several stages (sketches, keyed surrogates, permuted draws) can't be said in SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, scratch, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), None
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with released():  # what a stage wrote for itself goes once its rows are written
            docs = scratch.put(stage(spark, docs, sf_dir), f"stage{k}")
        if last:
            scratch.drop(last)
        last = f"stage{k}"
