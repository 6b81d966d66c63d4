"""Scans, views and sinks."""

from roomrank.sources.tables import (  # noqa: F401
    SPLITS, read_table, users_view, reviews_view, matches_view, user_vectors,
    review_vectors, vector_table, split_col, load_split, USER_SCHEMA, REVIEW_SCHEMA, MATCH_SCHEMA,
)
