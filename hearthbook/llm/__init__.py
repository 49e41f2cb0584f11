"""Operators of a training-data pipeline; nothing outside this package imports them."""


def registry():
    """Queries by name, and the SQL twins of those that have one."""
    from hearthbook.llm import queries, queries_corpus  # noqa: F401

    return dict(queries.QUERIES), dict(queries.ORACLES)
