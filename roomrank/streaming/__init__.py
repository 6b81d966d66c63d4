"""Structured Streaming jobs (the reference itself has no stream; this runs its prediction incrementally)."""
