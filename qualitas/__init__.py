"""qualitas: a Spark-native data-quality engine (profiles, rule checks, scores, reports)."""
__version__ = "0.1.0"
