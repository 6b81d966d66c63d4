"""Named end-to-end queries and their oracle SQL."""
