"""All registered queries and their SQL oracles."""

from __future__ import annotations

from wordfold.plans import catalog_corpus, catalog_matrix, catalog_train, catalog_vectors

_CATALOGS = [catalog_corpus, catalog_vectors, catalog_matrix, catalog_train]


def queries() -> dict:
    out = {}
    for c in _CATALOGS:
        out.update(c.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for c in _CATALOGS:
        out.update(c.SQL)
    return out
