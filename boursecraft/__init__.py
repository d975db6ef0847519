"""Spark-native equity-research analytics: ingest, reconcile, derive, score and compare."""
