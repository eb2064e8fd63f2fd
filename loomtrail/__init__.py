"""loomtrail: a Spark-native engine for building, validating and scoring agent training data."""

__version__ = "0.1.0"
