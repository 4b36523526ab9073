"""Operators for preparing training corpora, and the queries that apply them to the given tables."""


def load_corpus():
    """(queries, SQL twins) of the corpus operators and of the pipeline."""
    from .registered import ORACLES, QUERIES
    return dict(QUERIES), dict(ORACLES)
