"""Learning analytics and legacy-record migration as PySpark jobs."""
