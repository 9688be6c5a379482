"""All queries of this subpackage with their SQL."""

from schemaloom.llm import (
    queries_benchmark,
    queries_duplicates,
    queries_licenses,
    queries_manifest,
    queries_pages,
    queries_privacy,
    queries_quality,
    queries_scores,
    queries_secrets,
    queries_tokens,
    queries_vectors,
)

_ALL = (
    queries_benchmark,
    queries_duplicates,
    queries_licenses,
    queries_manifest,
    queries_pages,
    queries_privacy,
    queries_quality,
    queries_scores,
    queries_secrets,
    queries_tokens,
    queries_vectors,
)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _ALL for k, v in m.ORACLES.items()}
