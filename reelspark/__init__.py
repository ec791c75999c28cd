"""Spark-first analytics over credit data: who worked on what, in which role, when."""
