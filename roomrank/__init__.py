"""roomrank: review ranking for accommodation bookings, expressed as Spark jobs.

Sub-packages
------------
sources    scans of the driver tables, the users / reviews / matches views, sinks and caches
functions  Column -> Column helpers (vector math, prompt rendering, hashed text encoder)
operators  DataFrame -> DataFrame building blocks (features, candidates, scoring, ranking, losses, models)
plans      named end-to-end queries (the registry used by ``__spark_entry__``) and their oracle SQL
streaming  intentionally empty: the reference works on finished files only
"""

__version__ = "0.1.0"
