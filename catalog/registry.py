"""All registered queries."""

from catalog import checks, claims, documents, sources, storage

REGISTERED = {
    **documents.QUERIES,
    **claims.QUERIES,
    **sources.QUERIES,
    **checks.QUERIES,
    **storage.QUERIES,
}
