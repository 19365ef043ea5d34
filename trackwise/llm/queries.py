"""The corpus operators' queries, each over its whole table with production parameters."""

from __future__ import annotations

from trackwise.session import table

from . import decontaminate, html_text, language_id, licenses, mixing, near_dedup, pii, quality, substring_dedup, toxicity


def op1_keyed_surrogates(spark, sf_dir):
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_secret(spark), count="n_entities")


def op2_lpf_repeats(spark, sf_dir):
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


def op3_setsketch_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_spaced_seed_leaks(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_tag_path_text(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op6_license_dice(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_toxicity_cnn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_quality_divergence(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), ["doc_id"])


def op9_ppm_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op10_splitting_tree_mix(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


OP3 = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
  s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as g from w),
  n as (select doc_id, count(*) as n from s group by 1),
  p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
  l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
  e as (select x, y from l union all select y, x from l),
  reach as (select doc_id as x, doc_id as y from documents union select reach.x, e.y from reach join e on e.x = reach.y),
  k as (select x, min(y) as c from reach group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, k.c as component_id, k.c = w.doc_id as kept from w join k on k.x = w.doc_id left join n on n.doc_id = w.doc_id"""


def oracle_sql():
    """Where SQL can say it; the other operators are held against brute force in tests/llm."""
    return {"op3_setsketch_dedup": OP3, "op4_spaced_seed_leaks": decontaminate.oracle(), "op6_license_dice": licenses.oracle()}
