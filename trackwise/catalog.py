"""Registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from trackwise.plans import queries_domain, queries_files, queries_vectors


def flagship(spark, sf_dir):
    """The whole mask-to-groups plan: components, filters, rules, finders, one bag, suppression."""
    return queries_files.q94_mask_to_groups(spark, sf_dir)


def queries():
    return {**queries_domain.Q, **queries_vectors.Q, **queries_files.Q}


def oracle_sql():
    return {**queries_domain.SQL, **queries_vectors.SQL, **queries_files.SQL}
