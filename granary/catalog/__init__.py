"""Registered queries over the test tables, one module per area, with their SQL twins."""

from granary.catalog import (
    cleaning,
    matrix,
    reports,
    scoring,
    shapes,
    splits,
    streams,
    telemetry,
)

MODULES = (shapes, cleaning, splits, matrix, scoring, telemetry, streams, reports)


def all_queries():
    return {name: q for module in MODULES for name, q in module.QUERIES.items()}


def all_oracles():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
