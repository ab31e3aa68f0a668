"""Plan construction: operator registry, dispatch, lineage."""
