"""Registered queries of the rating engine and their SQL."""

from rankwright.plans import curation, rating, signals, sources, tables

_ALL = {**rating.QUERIES, **tables.QUERIES, **signals.QUERIES, **curation.QUERIES, **sources.QUERIES}


def flagship(spark, sf_dir):
    return rating.rate_supplier_years(spark, sf_dir)


def queries():
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
