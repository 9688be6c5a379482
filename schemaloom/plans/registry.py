"""All registered queries and their SQL."""

from . import catalog_queries, compat_queries, dialect_queries, document_queries, type_queries

_MODULES = [catalog_queries, document_queries, compat_queries, dialect_queries, type_queries]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: text for module in _MODULES for name, text in module.ORACLES.items()}
