"""Queries over the given tables and the SQL that checks them."""

from barflow.catalog import registry


def queries():
    return registry.queries()


def oracle_sql():
    return registry.oracle_sql()
